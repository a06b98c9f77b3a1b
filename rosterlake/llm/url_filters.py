"""URL verdicts from host and path rules and, where none fits, from a tree of path templates judged by labelled pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import LETTERS_LOW, LETTERS_UP, join_sized, row_key, spill, table

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
MIN_SUPPORT = 3  # pages that must share a segment for it to stay spelled out
MIN_SHARE = 0.02  # and their share of the host's pages at that place
DIFFERENT = 3.84  # squared z from which two neighbouring branches stay apart (95 percent)
PRIOR_WEIGHT = 4.0
MIN_PURITY = 0.2
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
VARIABLE = r"^[0-9A-Fa-f-]*[0-9][0-9A-Fa-f-]*(\.[A-Za-z]+)?$"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), LETTERS_UP, LETTERS_LOW)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path begins the url's; else NULL."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, p = rule.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def templates(urls: DataFrame) -> DataFrame:
    """(rid, host, nodes): for ``urls(rid, host, path)`` the prefixes of each path's template, shortest first.

    Numbers and hexadecimal ids become ``*`` (a file ending stays); so does every segment that too few pages of the host have there.
    """
    parts = urls.select("rid", "host", F.posexplode_outer(F.split(F.substring(F.col("path"), 2, 1 << 30), "/")).alias("pos", "seg"))
    parts = parts.withColumn("seg", F.when(F.col("seg").rlike(VARIABLE), F.concat(F.lit("*"), F.regexp_extract("seg", VARIABLE, 1))).otherwise(F.col("seg")))
    used = parts.groupBy("host", "pos", "seg").agg(F.count("*").alias("n"))
    places = used.groupBy("host", "pos").agg(F.sum("n").alias("all"))
    spelled = spill(used.join(places, ["host", "pos"]).where((F.col("n") >= MIN_SUPPORT) & (F.col("n") >= MIN_SHARE * F.col("all"))).select("host", "pos", "seg", F.lit(True).alias("kept")))
    general = join_sized(parts, spelled, ["host", "pos", "seg"], "left").withColumn("seg", F.when(F.col("kept"), F.col("seg")).otherwise("*"))
    segments = general.groupBy("rid", "host").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "seg"))), lambda s: s["seg"]).alias("segs"))
    prefix = F.transform(F.sequence(F.lit(1), F.size("segs")), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("segs", 1, i), "/")))
    return segments.select("rid", "host", prefix.alias("nodes"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, bad: Column | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    ``bad`` (a boolean column of ``pages``, NULL: not labelled) labels pages; by default the pages that a rule decides are labelled by
    it. Every page enters the template tree of its host; a page without a label counts as good by the share of good ones among all
    labelled pages. Sibling branches in the order of their bad share are merged with their neighbour unless a two-proportion test tells
    them apart. Purity is the good share of the merged branch, smoothed by the same share. A page without a rule is blocked if the
    purity of its whole template's branch is below ``MIN_PURITY``.

    A NULL url and one without ``://`` have an empty host and path and are allowed; repeated rows give repeated equal rows; an empty
    table gives no rows; branches of equal share are in the order of their templates; a very long url has a node per segment; other columns
    are ignored.
    """
    found = pages.select(row_key(F.col("page_id"), F.col("url")).alias("rid"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                         (F.lit(None).cast("boolean") if bad is None else bad).alias("bad"))
    found = found.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    label = F.coalesce("bad", F.col("r.verdict") == "block").cast("int")
    found = spill(found.select("rid", "page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("by_rule"), label.alias("bad")))
    urls = found.groupBy("rid", "host", "path").agg(F.first("by_rule").alias("by_rule"), F.count("*").alias("rows"), F.sum("bad").alias("bad"), F.count("bad").alias("n"))
    good, seen = found.agg(F.sum(1 - F.col("bad")), F.count("bad")).first()
    prior = (good or 0) / seen if seen else 1.0
    tree = spill(templates(urls).join(urls.select("rid", "rows", "bad", "n"), "rid"))
    nodes = tree.select("host", F.posexplode("nodes").alias("depth", "node"), F.array_union(F.array(F.lit("")), "nodes").alias("up"), "rows", "bad", "n")
    nodes = nodes.select("host", "node", F.element_at("up", F.col("depth") + 1).alias("parent"), "rows", "bad", "n").groupBy("host", "parent", "node").agg(
        F.sum("rows").alias("rows"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.sum("n").alias("n"))
    nodes = nodes.select("host", "parent", "node", (F.col("bad") + F.lit(1 - prior) * (F.col("rows") - F.col("n"))).alias("bad"), F.col("rows").alias("n"))
    share, order = F.col("bad") / F.col("n"), Window.partitionBy("host", "parent").orderBy(F.col("bad") / F.col("n"), "node")
    was_bad, was_n = F.lag("bad").over(order), F.lag("n").over(order)
    pooled = (F.col("bad") + was_bad) / (F.col("n") + was_n)
    z2 = (share - was_bad / was_n) * (share - was_bad / was_n) / (pooled * (1 - pooled) * (1 / F.col("n") + 1 / was_n))
    apart = F.when(pooled.isNull() | (pooled <= 0) | (pooled >= 1), 0).when(z2 > DIFFERENT, 1).otherwise(0)
    islands = nodes.withColumn("apart", apart).withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = Window.partitionBy("host", "parent", "island")
    purity = (F.sum(F.col("n") - F.col("bad")).over(merged) + PRIOR_WEIGHT * prior) / (F.sum("n").over(merged) + PRIOR_WEIGHT)
    judged = spill(islands.withColumn("purity", purity).select("host", "node", "purity"))
    asked = tree.select("rid", "host", F.element_at("nodes", -1).alias("template"))
    at = join_sized(asked, judged.withColumnRenamed("node", "template"), ["host", "template"], "left").drop("host")
    verdict = F.coalesce("by_rule", F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow"))
    return join_sized(found, spill(at), ["rid"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op2_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).withColumn("purity", F.round("purity", 6))


def _rule_sql() -> str:
    cases = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        h, p = rule.split("/", 1)
        cases.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{verdict}|{rule}'")
    return " ".join(cases)


_VARIABLE_SQL = VARIABLE.replace("'", "''")
SQL = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{LETTERS_UP}', '{LETTERS_LOW}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
f AS (SELECT page_id, host, path, nullif(split_part(c, '|', 2), '') AS rule, nullif(split_part(c, '|', 1), '') AS by_rule FROM
  (SELECT *, CASE {_rule_sql()} END AS c FROM u)),
b AS (SELECT *, CASE by_rule WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad FROM f),
p0 AS (SELECT page_id, host, bad, by_rule, string_split(substr(path, 2), '/') AS ss FROM b),
p1 AS (SELECT page_id, host, i AS pos, ss[i] AS s FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM p0)),
p2 AS (SELECT page_id, host, pos, CASE WHEN regexp_matches(s, '{_VARIABLE_SQL}') THEN '*' || regexp_extract(s, '{_VARIABLE_SQL}', 1) ELSE s END AS s FROM p1),
c AS (SELECT host, pos, s, count(*) AS n, sum(count(*)) OVER (PARTITION BY host, pos) AS t FROM p2 GROUP BY host, pos, s),
p3 AS (SELECT page_id, p2.host, p2.pos, CASE WHEN n >= {MIN_SUPPORT} AND n >= {MIN_SHARE} * t THEN p2.s ELSE '*' END AS s FROM p2 JOIN c ON p2.host = c.host AND p2.pos = c.pos AND p2.s = c.s),
nd AS (SELECT page_id, host, pos, '/' || string_agg(s, '/') OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS node,
  CASE WHEN pos = 1 THEN '' ELSE '/' || string_agg(s, '/') OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent FROM p3),
pr AS (SELECT coalesce(avg(1 - bad), 1.0) AS prior FROM b),
g0 AS (SELECT nd.host, parent, node, coalesce(sum(bad), 0) AS bad, count(bad) AS n, count(*) AS m FROM nd JOIN b USING (page_id) GROUP BY nd.host, parent, node),
g AS (SELECT host, parent, node, bad + (1 - prior) * (m - n) AS bad, m AS n FROM g0, pr),
g1 AS (SELECT *, bad::DOUBLE / n AS share, lag(bad) OVER o AS wb, lag(n) OVER o AS wn FROM g WINDOW o AS (PARTITION BY host, parent ORDER BY bad::DOUBLE / n, node)),
g2 AS (SELECT *, (bad + wb)::DOUBLE / (n + wn) AS pool FROM g1),
g3 AS (SELECT *, CASE WHEN pool IS NULL OR pool <= 0 OR pool >= 1 THEN 0 WHEN (share - wb::DOUBLE / wn) * (share - wb::DOUBLE / wn) / (pool * (1 - pool) * (1.0::DOUBLE / n + 1.0::DOUBLE / wn)) > {DIFFERENT} THEN 1 ELSE 0 END AS apart FROM g2),
g4 AS (SELECT *, sum(apart) OVER (PARTITION BY host, parent ORDER BY share, node ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g3),
g5 AS (SELECT host, node, (sum(n - bad) OVER i + {PRIOR_WEIGHT} * prior) / (sum(n) OVER i + {PRIOR_WEIGHT}) AS purity FROM g4, pr WINDOW i AS (PARTITION BY host, parent, island)),
a AS (SELECT page_id, arg_max(nd.node, pos) AS node, arg_max(purity, pos) AS purity FROM nd JOIN g5 ON nd.host = g5.host AND nd.node = g5.node GROUP BY page_id)
SELECT b.page_id, b.host, b.path, b.rule, coalesce(by_rule, CASE WHEN purity < {MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict, a.node AS template, round(purity, 6) AS purity
FROM b LEFT JOIN a USING (page_id)
"""
