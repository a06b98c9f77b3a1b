"""Temperature mixing: source shares to an exponent found by bisection, realised as budgeted block permutations of the documents."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import HASH_BITS, hash60, join_sized, row_key, spill, table

MAX_EPOCHS = 2.0
ROWS_PER_BLOCK = 2_000
SEED = 7
HALVINGS = 20  # steps of the bisection; five are answered by one job


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))


def _tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(shares: DataFrame, max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None, budget: float | None = None) -> float:
    """Exponent in [0, 1] for the shares of ``shares(t)``; 0 makes all sources equal, 1 leaves their shares.

    With ``max_epochs`` the smallest exponent at which no source repeats more often; with ``entropy`` (in nats) the largest at which
    the entropy of the weights is at least that. With both, the repetition limit holds first. Only sums over the sources, one row per
    tried exponent, come to the driver.
    """
    known = spill(shares.where("t > 0").select("t"))
    total, n = known.agg(F.sum("t").cast("double"), F.count("*")).first()
    if not n:
        return 1.0
    logs = known.select(F.log(F.col("t") / F.lit(total)).alias("lp"))

    def tried(values: list[float]) -> list[tuple[float, bool, bool]]:
        rows = logs.select("lp", F.explode(F.array(*[F.lit(v) for v in values])).alias("a")).groupBy("a").agg(
            F.sum(F.exp(F.col("a") * F.col("lp"))).alias("z"), F.sum(F.exp(F.col("a") * F.col("lp")) * F.col("lp")).alias("s"), F.min("lp").alias("low"), F.max("lp").alias("top")).collect()
        out = []
        for r in sorted(rows, key=lambda r: r["a"]):
            most = math.exp((r["a"] - 1) * (r["low"] - r["top"])) if budget is None else budget / total * math.exp((r["a"] - 1) * r["low"]) / r["z"]
            out.append((r["a"], max_epochs is None or most <= max_epochs, entropy is None or math.log(r["z"]) - r["a"] * r["s"] / r["z"] >= entropy))
        return out

    def bisect(at_end: bool, which: int) -> float:
        """Smallest (largest) exponent that passes test ``which``, to 2**-HALVINGS."""
        low, high = 0.0, 1.0
        end = tried([high if at_end else low])[0]
        if end[which]:
            return end[0]
        for _ in range(HALVINGS // 5):
            step = (high - low) / 32
            for a, *passes in tried([low + step * k for k in range(1, 32)]):
                if passes[which - 1] != at_end:  # passing from here on: the border is below
                    high = min(high, a)
                else:
                    low = max(low, a) if a < high else low
        return low if at_end else high

    by_limit = bisect(False, 1) if max_epochs is not None else 0.0
    return max(by_limit, bisect(True, 2)) if entropy is not None else by_limit


def realise(docs: DataFrame, max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None, budget: float | None = None, seed: int = SEED,
            rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(row, source_key, n_tokens, quota, epoch, perm): every use of a document; order by (epoch, perm) gives the training order.

    Tokens are words between blanks. The quota of a source is its weight times the budget; without ``budget`` the smallest one that
    uses every document at least once. A source is used in whole epochs and one part of an epoch: the documents in the order of
    that epoch's hash as long as their running sum stays within the rest of the quota. The hash range is cut into blocks; sums of
    blocks are added up per source and rows only inside their block, so that no task holds a source.

    A NULL source is a source of its own; NULL and empty texts have no tokens and come with the whole epochs; a source without
    tokens is used once; repeated rows are used alike; an empty table gives no rows; other columns pass through.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), _source().alias("source_key"), _tokens().alias("n_tokens"), row_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("rid"))
    shares = spill(docs.select(_source().alias("source_key"), _tokens().alias("n_tokens")).groupBy("source_key").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")))
    a = exponent(shares, max_epochs, entropy, budget)
    total, top, most = shares.agg(F.sum("t"), F.max("t"), F.max("n")).first()
    lp = F.log(F.col("t") / F.lit(float(total or 1)))
    if budget is None:
        epochs = F.exp((a - 1) * (lp - F.lit(math.log(top / total) if total else 0.0)))
    else:
        z = shares.where("t > 0").agg(F.sum(F.exp(F.lit(a) * lp))).first()[0] or 1.0
        epochs = F.exp((a - 1) * lp) / z * (budget / (total or 1))
    quota = F.when(F.col("t") > 0, F.floor(epochs * F.col("t") + 0.5)).otherwise(0).cast("long")
    whole = F.when(F.col("t") > 0, F.floor(F.col("quota") / F.col("t"))).otherwise(1).cast("int")
    plan = spill(shares.withColumn("quota", quota).withColumn("whole", whole).select("source_key", "quota", "whole", (F.col("quota") - F.col("whole") * F.col("t")).alias("rest")))
    bits = max(0, math.ceil(math.log2((most or 1) / rows_per_block)))

    def perm(epoch: Column) -> Column:
        return hash60(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("rid")))

    planned = join_sized(keyed, plan, ["source_key"]).withColumn("last", perm(F.col("whole") + 1)).withColumn("block", F.shiftright("last", HASH_BITS - bits))
    per_block = planned.groupBy("source_key", "block").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = spill(per_block.select("source_key", "block", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("shift")))
    running = F.sum("n_tokens").over(Window.partitionBy("source_key", "block").orderBy("last", "rid").rowsBetween(Window.unboundedPreceding, 0))
    used = join_sized(planned.withColumn("running", running), shift, ["source_key", "block"])
    extra = ((F.col("rest") > 0) & (F.col("shift") + F.col("running") <= F.col("rest"))).cast("int")
    used = used.withColumn("uses", F.col("whole") + extra).where("uses > 0")
    return used.select("row", "rid", "source_key", "n_tokens", "quota", F.explode_outer(F.sequence(F.lit(1), F.col("uses"))).alias("epoch")).withColumn("perm", perm(F.col("epoch"))).drop("rid")


def mix(docs: DataFrame, **targets) -> DataFrame:
    """The documents in their own columns, each as often as the mixture uses it."""
    return realise(docs, **targets).select("row.*")


def op10_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realise(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("row.doc_id", "row.source", "n_tokens", "quota", "epoch", "perm")


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, '~') AS sk, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n,
  md5(coalesce('=' || doc_id::VARCHAR, '~') || chr(1) || coalesce('=' || source, '~') || chr(1) || coalesce('=' || text, '~')) AS rid FROM documents),
s AS (SELECT sk, sum(n)::BIGINT AS t FROM d GROUP BY sk),
l AS (SELECT sk, t, ln(t / sum(t) OVER ()::DOUBLE) AS lp FROM s WHERE t > 0),
m AS (SELECT min(lp) AS low, max(lp) AS top FROM l),
b AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
 SELECT step + 1, CASE WHEN exp(((lo + hi) / 2 - 1) * (low - top)) <= {MAX_EPOCHS} THEN lo ELSE (lo + hi) / 2 END, CASE WHEN exp(((lo + hi) / 2 - 1) * (low - top)) <= {MAX_EPOCHS} THEN (lo + hi) / 2 ELSE hi END
 FROM b, m WHERE step < {HALVINGS}),
e AS (SELECT CASE WHEN exp(-(low - top)) <= {MAX_EPOCHS} THEN 0.0 ELSE hi END AS a FROM b, m WHERE step = {HALVINGS}),
q0 AS (SELECT sk, t, floor(exp((a - 1) * (lp - top)) * t + 0.5)::BIGINT AS quota FROM l, m, e UNION ALL SELECT sk, t, 0 FROM s WHERE t = 0),
q AS (SELECT sk, t, quota, CASE WHEN t > 0 THEN quota // t ELSE 1 END AS whole FROM q0),
r AS (SELECT d.*, quota, whole, quota - whole * t AS rest, ('0x' || substr(md5('{SEED}:' || (whole + 1)::VARCHAR || ':' || rid), 1, 15))::BIGINT AS last FROM d JOIN q USING (sk)),
u AS (SELECT *, sum(n) OVER (PARTITION BY sk ORDER BY last, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM r),
x AS (SELECT *, whole + CASE WHEN rest > 0 AND running <= rest THEN 1 ELSE 0 END AS uses FROM u),
z AS (SELECT doc_id, source, n, quota, rid, unnest(range(1, uses + 1)) AS epoch FROM x)
SELECT doc_id, source, n::BIGINT AS n_tokens, quota::BIGINT AS quota, epoch::INT AS epoch, ('0x' || substr(md5('{SEED}:' || epoch::VARCHAR || ':' || rid), 1, 15))::BIGINT AS perm FROM z
"""
