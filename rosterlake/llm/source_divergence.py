"""Source divergence audit: how far the word use of each source lies from its language and from the language's other sources.

Arrow kernels count the terms of a task's documents; the counts are merged, cut into shards of terms, and each shard gives partial
divergences, which add up.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import join_sized, small_batches, spill, table

BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what lies between two terms; letters are lower-cased before
MIN_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000  # shares are whole numbers of this part
SLICE_BYTES = 16 << 20  # text that is split at once
PARTIAL_ROWS = 400_000  # distinct (group, term) counts a task holds before it hands them on
SHARD_TERMS = 2048
TILE_SOURCES = 256
COUNTS = "lang string, source string, term string, n long, d long"
PARTS = "lang string, source string, part string, item string, value long, seen long"


def _slices(batch: pa.RecordBatch):
    """The batch in slices of bounded text, a single longer text alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)
    cut = np.cumsum(sizes) // SLICE_BYTES
    edges = np.r_[0, np.flatnonzero(cut[1:] != cut[:-1]) + 1, len(sizes)]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _summed(parts: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    merged = pa.concat_tables(parts).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("d", "sum")])
    return merged.select([*keys, "n_sum", "d_sum"]).rename_columns([*keys, "n", "d"])


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each term in each (lang, source) of a batch; a NULL term stands for the group itself."""
    lang, source, text = (pc.fill_null(batch.column(c), "") for c in ("lang", "source", "text"))
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    group = np.asarray(langs.indices, np.int64) * len(sources.dictionary) + np.asarray(sources.indices, np.int64)
    pieces = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    flat, doc = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
    filled = pc.not_equal(pc.binary_length(flat), 0)
    terms, doc = flat.filter(filled).dictionary_encode(), doc.filter(filled)
    held = pa.table({"doc": doc, "code": terms.indices}).group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
    held = pa.table({"group": group[np.asarray(held["doc"], np.int64)], "code": held["code"], "n": held["count_all"]})
    cells = held.group_by(["group", "code"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    there = np.unique(group)
    at = np.concatenate([np.asarray(cells["group"], np.int64), there])
    codes = pa.chunked_array([cells["code"].combine_chunks().cast(pa.int32()), pa.nulls(len(there), pa.int32())]).combine_chunks()
    zero = np.zeros(len(there), np.int64)
    return pa.table({"lang": langs.dictionary.take(pa.array(at // len(sources.dictionary))), "source": sources.dictionary.take(pa.array(at % len(sources.dictionary))),
                     "term": terms.dictionary.take(codes), "n": np.concatenate([np.asarray(cells["n_sum"], np.int64), zero]), "d": np.concatenate([np.asarray(cells["count_all"], np.int64), zero])})


def _partial(batches):
    held: list[pa.Table] = []
    for batch in batches:
        held.extend(_counted(s) for s in _slices(batch))
        if sum(t.num_rows for t in held) > PARTIAL_ROWS:
            held = [_summed(held)]
            if held[0].num_rows > PARTIAL_ROWS // 2:
                yield from held.pop().to_batches(max_chunksize=65536)
    if held:
        yield from _summed(held).to_batches(max_chunksize=65536)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of each term of each group; the row with a NULL term stands for the group."""
    small_batches(docs.sparkSession)
    texts = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    return texts.mapInArrow(_partial, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def shares(counts: np.ndarray, totals: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exactly: the quotient is taken in three steps of three decimal digits."""
    below = totals + 2 * terms
    rest, out = np.divmod(counts + 2, below)[::-1]
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _best_terms(p: np.ndarray, counts: np.ndarray, q: np.ndarray, names: np.ndarray, top: int):
    """Of each source the first terms it uses more than its language: (source, term, value)."""
    for s in range(len(p)):
        at = np.flatnonzero((counts[s] > 0) & (p[s] > q))
        value = gap(p[s, at], q[at])
        if len(at) > top:  # those that reach the value of the last place; their ties are told apart by the sort
            far = np.flatnonzero(value >= np.partition(value, len(value) - top)[len(value) - top])
            at, value = at[far], value[far]
        for v, i in sorted(zip((-value).tolist(), at.tolist()), key=lambda x: (x[0], names[x[1]]))[:top]:
            yield s, i, -v


def _divergences(top: int):
    def unit(rows: pa.Table) -> pa.Table:
        """One shard of terms and two tiles of sources: partial sums of all pairs of sources, and best terms where the tiles are one."""
        col = {c: rows[c].combine_chunks() for c in rows.column_names}
        lang, i, j = (col[c][0].as_py() for c in ("lang", "i", "j"))
        real = np.asarray(pc.is_valid(col["term"]))
        terms = col["term"].filter(pa.array(real)).dictionary_encode()
        names = [x.encode() for x in terms.dictionary.to_pylist()]
        tiles, at = np.asarray(col["tile"], np.int64), np.asarray(terms.indices, np.int64)
        n, total, v = (np.asarray(col[c], np.int64) for c in ("n", "total", "v"))
        out: dict[str, list] = {c: [] for c in ("source", "part", "item", "value")}

        def dense(tile: int):
            pick = tiles == tile
            sources = col["source"].filter(pa.array(pick)).dictionary_encode()
            row = np.asarray(sources.indices, np.int64)
            totals, counts = np.zeros((len(sources.dictionary), 1), np.int64), np.zeros((len(sources.dictionary), len(names)), np.int64)
            totals[row, 0] = total[pick]
            filled = pick[real]
            counts[row[real[pick]], at[filled]] = n[real & pick]
            return sources.dictionary.to_pylist(), counts, shares(counts, totals, v[:1])

        left, counts, p = dense(i)
        right, q = (left, p) if i == j else dense(j)[::2]
        for s, a in enumerate(left):
            first = s + 1 if i == j else 0
            sums = gap(p[s], q[first:]).sum(axis=1).tolist()
            for b, x in zip(right[first:], sums):
                for one, other in ((a, b), (b, a)):
                    out["source"].append(one), out["part"].append("pair"), out["item"].append(other), out["value"].append(x)
        if i == j and names:
            whole = np.zeros(len(names), np.int64)
            whole[at] = np.asarray(col["n_lang"].filter(pa.array(real)), np.int64)
            for s, t, x in _best_terms(p, counts, shares(whole, np.asarray(col["total_lang"], np.int64)[:1], v[:1]), names, top):
                out["source"].append(left[s]), out["part"].append("term"), out["item"].append(names[t].decode()), out["value"].append(x)
        k = len(out["value"])
        return pa.table({"lang": pa.array([lang] * k, pa.string()), **{c: pa.array(out[c], pa.string()) for c in ("source", "part", "item")},
                         "value": pa.array(out["value"], pa.int64()), "seen": pa.array([len(names)] * k, pa.int64())})

    return unit


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS, shard_terms: int = SHARD_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): of each (lang, source) its divergence from every other source of the language (part ``pair``),
    and the ``top`` terms it uses more than its language (part ``term``).

    Terms are runs of letters (A-Z lower-cased, all characters above ASCII are letters); a language keeps those in at least
    ``min_documents`` of its documents. Share p = 1 + floor(10^9 (count + 2) / (N + 2 V)) with N the group's kept occurrences and V the
    language's kept terms; the divergence of two shares is floor((p - q)^2 / (p + q)), summed over all kept terms for a pair. All whole
    numbers, exact for groups below 10^15 occurrences. Rank 1 has the largest value; ties go by the UTF-8 of the item.

    NULL text, lang and source are empty strings; texts without terms count for their group only; a very long text is split by itself
    and may fill a task's memory with a few times its size; repeated rows count again; other columns are ignored; an empty table gives
    no rows, and a language with one source gives no pairs.

    A shard is at most about ``shard_terms`` terms of one language and two tiles of about ``tile_sources`` sources, whatever the
    language's size; the result holds all pairs of sources by its definition, and so do the partial sums of a shard.
    """
    counts = spill(term_counts(docs))
    groups = counts.where("term IS NULL").select("lang", "source")
    per_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("n_lang")).where(F.col("d") >= min_documents).drop("d")
    cells = spill(counts.where("term IS NOT NULL").drop("d").join(per_term, ["lang", "term"]))
    of_lang = spill(groups.groupBy("lang").agg(F.count("*").alias("s"))
                    .join(cells.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total_lang")), "lang", "left")
                    .select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total_lang", F.lit(0)).alias("total_lang"),
                            F.ceil(F.col("s") / tile_sources).cast("int").alias("tiles"), F.ceil(F.coalesce("v", F.lit(0)) / shard_terms).cast("int").alias("shards")))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = join_sized(groups.join(totals, ["lang", "source"], "left"), of_lang, ["lang"])
    groups = spill(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "v", "total_lang", "tiles", "shards", F.pmod(F.xxhash64("source"), "tiles").cast("int").alias("tile")))
    info = ["lang", "source", "total", "v", "total_lang", "tiles", "tile"]
    filled = join_sized(cells, groups, ["lang", "source"]).select(*info, "term", "n", "n_lang", F.pmod(F.xxhash64("term"), "shards").cast("int").alias("shard"))
    empty = groups.where("shards > 0").select(*info, F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_lang"),
                                              F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    placed = filled.union(empty).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("lang", "source", "total", "v", "total_lang", "term", "n", "n_lang", "shard", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    parts = spill(placed.groupBy("lang", "shard", "i", "j").applyInArrow(_divergences(top), PARTS))
    summed = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    one = groups.select("lang", "source", "tile", "total", "v", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("tile").alias("other"), F.col("total").alias("total2"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    pairs = one.join(two, ["lang", "tile", "other"]).where("source <> item").select("lang", "source", "item", "total", "total2", "v").join(summed, ["lang", "source", "item"], "left")
    unused = {k: F.expr(f"1 + {2 * SCALE} div (greatest({k}, 0) + 2 * greatest(v, 1))") for k in ("total", "total2")}
    pairs = pairs.withColumns({"p": unused["total"], "q": unused["total2"]}).withColumn("rest", F.expr("(v - coalesce(seen, 0)) * ((p - q) * (p - q) div (p + q))"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + F.col("rest")).cast("long").alias("value")).withColumn("rank", F.row_number().over(by))
    terms = parts.where("part = 'term'").drop("seen").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.union(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCUMENTS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, source, term),
g AS (SELECT g.lang, g.source, coalesce(x.total, 0) AS total, coalesce(l.v, 0) AS v, coalesce(l.total, 0) AS total_lang FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) x USING (lang, source) LEFT JOIN l ON l.lang = g.lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE} * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.total + 2 * g.v) AS p,
  1 + ({SCALE} * (k.n + 2)::HUGEINT) // (g.total_lang + 2 * g.v) AS q FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value, rank::INT AS rank FROM k WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
