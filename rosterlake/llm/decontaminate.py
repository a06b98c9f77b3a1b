"""Prefix-filtered set join of documents with benchmark windows: rarest word first, bounds, then an exact check of each window."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.common import LETTERS_LOW, LETTERS_UP, join_sized, row_key, spill, table

WINDOW = 10
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # A-Z are letters until they are lower-cased
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text):
    """Words in order, in their own case; the first or last entry is empty where the text begins or ends between words."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def _lower(text):
    """A-Z lower-cased and nothing else; for ASCII the faster built-in does the same."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, LETTERS_UP, LETTERS_LOW))


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, wkey, n): ``window`` consecutive words of each item, or all of a shorter one; a word array is joined by blanks."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.array_remove(_words(F.col("text")), "").alias("ws")).where(F.size("ws") > 0)
    starts = words.select("item", "ws", F.explode_outer(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - window + 1))).alias("at"))
    piece = F.slice("ws", F.col("at"), F.least(F.lit(window), F.size("ws")))
    return starts.select("item", _lower(F.array_join(piece, " ")).alias("wkey"), F.size(piece).alias("n"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, hits, n_hit, n_items, items_sha256) of each distinct document row in which a benchmark window occurs.

    Words are ordered by how often the documents use them (words are joined by their 64-bit hash; what counts is the comparison at the
    end). A window can only occur where its rarest word does, so that one word is its prefix: documents are joined on it, the start it
    implies must lie inside the document, and the words there are compared.
    """
    pairs = spill(windows_of(benchmark, window).distinct())
    wins = pairs.select("wkey", "n").distinct()
    spelled = wins.select("wkey", "n", F.posexplode_outer(F.split("wkey", " ")).alias("off", "word")).select("wkey", "n", "off", F.xxhash64("word").alias("word"))
    vocabulary = spill(spelled.select("word").distinct())
    hashed = F.xxhash64(_lower(F.col("word"))).alias("word")
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rid"), "text")
    used = docs.select(F.explode_outer(_words(F.col("text"))).alias("word")).select(hashed)
    used = spill(join_sized(used, vocabulary, ["word"]).groupBy("word").agg(F.count("*").alias("uses")))
    rarest = spelled.join(used, "word", "left").groupBy("wkey", "n").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "word", "off")).alias("p"))
    prefix = spill(rarest.where("p.uses > 0").select("wkey", "n", "p.word", "p.off"))
    places = keyed.select("rid", _words(F.col("text")).alias("ws")).select("rid", F.size("ws").alias("size"), F.posexplode_outer("ws").alias("pos", "word"))
    places = places.select("rid", "size", "pos", hashed)
    found = join_sized(places, prefix, ["word"]).select("rid", "size", (F.col("pos") - F.col("off")).alias("start"), "n", "wkey")
    found = spill(found.where("start >= 0 AND start + n <= size").select("rid", "start", "n", "wkey").distinct())
    per_row = found.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "wkey")).alias("places"))
    texts = join_sized(keyed, found.select("rid").distinct(), ["rid"], "left_semi")

    def same(ws):
        """The places where the words are those of the window; ``ws`` is bound once for a document."""
        return F.filter("places", lambda c: _lower(F.array_join(F.slice(ws, c["start"] + 1, c["n"]), " ")) == c["wkey"])

    rows = texts.join(per_row, "rid").select("rid", F.element_at(F.transform(F.array(_words(F.col("text"))), same), 1).alias("hits"))
    rows = spill(rows.where(F.size("hits") > 0).dropDuplicates(["rid"]))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))
    named = rows.select("rid", F.explode(F.array_distinct(F.transform("hits", lambda h: h["wkey"]))).alias("wkey")).join(pairs.select("wkey", "item"), "wkey")
    named = named.groupBy("rid").agg(F.collect_set("item").alias("items"))
    return rows.select("rid", "hits", F.size(covered).cast("long").alias("n_hit")).join(named, "rid").select(
        "rid", "hits", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, words inside benchmark windows, items with a window there, and the flag.

    NULL and empty texts have no words and are clean; an item without words has no window; a NULL item_id counts as the empty
    string; repeated rows give repeated equal rows; copies of an item count by their item_id; empty tables give clean documents or
    no rows; other columns are ignored. ``items_sha256`` of a clean document is the digest of the empty string.
    """
    found = hits(docs, benchmark, window).drop("hits")
    base = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rid"), "doc_id", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return join_sized(base, spill(found), ["rid"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, in their own columns, in which no benchmark window occurs."""
    bad = spill(hits(docs, benchmark, window).select("rid"))
    whole = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return join_sized(whole, bad, ["rid"], "left_anti").select("row.*")


def op4_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS_UP}', '{LETTERS_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS_UP}', '{LETTERS_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
s AS (SELECT item, ws, least({WINDOW}, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - {WINDOW - 1}) + 1)) AS a FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, n, array_to_string(ws[a : a + n - 1], ' ') AS k FROM s),
ns AS (SELECT DISTINCT n FROM w),
g0 AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS a FROM d, ns WHERE len(ws) >= n),
g AS (SELECT doc_id, n, a, array_to_string(ws[a : a + n - 1], ' ') AS k FROM g0),
h AS (SELECT g.doc_id, g.a, g.n, w.item FROM g JOIN w ON g.k = w.k AND g.n = w.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(a, a + n)) AS p FROM (SELECT DISTINCT doc_id, a, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
