"""Cross-document line frequency: lines that many documents of a host repeat are removed; depleted documents are rejected."""
from __future__ import annotations

from hashlib import md5
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.common import LETTERS_LOW, LETTERS_UP, hash60, join_sized, row_key, map_columns, small_batches, spill, table

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
MIN_DOCUMENTS = 20
MAX_SHARE = 0.001
MAX_REMOVED = 0.5
SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
FOLD = bytes.maketrans(LETTERS_UP.encode() + b"123456789", LETTERS_LOW.encode() + b"000000000")
PARSED = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "lines array<struct<h:long,w:int>>")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    first: dict = {}
    ids = np.fromiter(map(first.setdefault, words, count()), np.int64, n)
    pair = ids[:-2] * n + ids[1:-1]
    if n > 2_000_000:  # three numbers of this size would not fit into 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    seen: dict = {}
    at = np.fromiter(map(seen.setdefault, (pair * n + ids[2:]).tolist(), count()), np.int64, n - 2)
    later = np.flatnonzero(at != np.arange(n - 2))
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[later + k] = True
        hit[at[later] + k] = True
    return int(hit.sum())


def line_table(text: bytes) -> list[dict]:
    """Distinct normalised lines with their words."""
    words: dict[int, int] = {}
    for line in text.translate(FOLD).split(b"\n"):
        if parts := line.split():
            h = int(md5(b" ".join(parts)).hexdigest()[:15], 16)
            words[h] = words.get(h, 0) + len(parts)
    return [{"h": h, "w": w} for h, w in words.items()]


def _parse(texts: list[str]) -> list[list]:
    rows = []
    for text in texts:
        raw = text.encode()
        words = raw.split()
        n_dup, seen = 0, set()
        for line in raw.split(b"\n"):
            if line in seen:
                n_dup += 1
            elif line.strip(SPACES):
                seen.add(line)
        spaces = len(raw) - len(raw.translate(None, SPACES))
        rows.append((len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), n_dup, repeated_words(words), line_table(raw)))
    return [list(c) for c in zip(*rows)] or [[]] * 6


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    return docs.select(row_key(F.col("doc_id"), F.col(host), F.col("text")).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col(host).cast("string").alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def normalised(line):
    """The same line form as ``line_table``, as a column."""
    return F.trim(F.regexp_replace(F.translate(line, LETTERS_UP + "123456789", LETTERS_LOW + "000000000"), r"[\x20\x09-\x0D]+", " "))


def judge(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """One row per document: base counts, what the line limits take away, and the verdict.

    A line is lower-cased (A-Z), its digits become 0 and its spaces one blank. It goes if more than ``min_documents`` documents and more
    than ``max_share`` of the host's documents hold it; a document counts once for each of its lines, copies of one document count each.
    A document is depleted if more than ``max_removed`` of its words go.

    NULL and empty texts have no words and fail the base rule; a NULL host is a host of its own; repeated rows give repeated equal
    rows, which are documents each; lines at a limit stay; a very long text is parsed whole by one task; an empty table gives an empty
    result; other columns are ignored. ``removed`` holds the hashes of the removed lines.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parsed = spill(map_columns(_keyed(docs, host), ["text"], PARSED, _parse))
    lines = parsed.select("rid", "host", F.inline("lines"))
    hosts = parsed.groupBy("host").agg(F.count("*").alias("host_docs"))
    counted = lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > min_documents)
    heavy = spill(counted.join(hosts, counted.host.eqNullSafe(hosts.host)).where(F.col("n") > F.col("host_docs") * max_share)
                  .select(row_key(counted.host, counted.h).alias("line")))
    taken = join_sized(lines.select("rid", "h", "w", row_key(F.col("host"), F.col("h")).alias("line")), heavy, ["line"], "left_semi")
    taken = taken.groupBy("rid", "h").agg(F.max("w").alias("w")).groupBy("rid").agg(F.sum("w").alias("w_removed"), F.collect_list("h").alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    gone = F.coalesce(F.col("w_removed"), F.lit(0)).cast("long")
    return (parsed.drop("lines").join(taken, "rid", "left").withColumn("n_words_removed", gone).withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.col("n_words_removed") <= F.col("n_words") * max_removed))
            .select("rid", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words_removed", "base_failed", "kept", "removed"))


def clean(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The kept documents in their own columns, without the removed lines; ``n_chars``, where there, is counted again.

    Documents that fail the base rule or are depleted go, NULL and empty texts among them; a NULL host is a host of its own; repeated
    rows stay repeated; very long texts are handled whole; ties do not arise; an empty table gives an empty one; columns of any name are kept.
    """
    verdicts = judge(docs, host, **limits)
    acted = spill(verdicts.where("NOT kept OR removed IS NOT NULL").select("rid", "kept", "removed").dropDuplicates(["rid"]))
    whole = docs.select(row_key(F.col("doc_id"), F.col(host), F.col("text")).alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = join_sized(whole, acted, ["rid"], "left").where("kept IS NULL OR kept")
    left = F.filter(F.split(F.col("row.text"), "\n"), lambda x: ~F.array_contains(F.col("removed"), hash60(normalised(x))))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("rid", "removed")


SQL = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, host, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
l0 AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS raw FROM d),
l1 AS (SELECT doc_id, host, raw, trim(regexp_replace(translate(raw, '{LETTERS_UP}123456789', '{LETTERS_LOW}000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM l0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM l1 WHERE line <> '' GROUP BY doc_id),
l2 AS (SELECT doc_id, host, ('0x' || substr(md5(line), 1, 15))::BIGINT AS h, sum(len(string_split(line, ' '))) AS w FROM l1 WHERE line <> '' GROUP BY doc_id, host, line),
heavy AS (SELECT host, h FROM l2 GROUP BY host, h HAVING count(*) > {MIN_DOCUMENTS} AND count(*) > {MAX_SHARE} * (SELECT count(*) FROM d WHERE d.host IS NOT DISTINCT FROM l2.host)),
gone AS (SELECT l2.doc_id, sum(w) AS n FROM l2 JOIN heavy ON l2.h = heavy.h AND l2.host IS NOT DISTINCT FROM heavy.host GROUP BY l2.doc_id),
b AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_words_removed
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words_removed::BIGINT AS n_words_removed,
 (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed,
 NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND n_words_removed <= {MAX_REMOVED} * n_words AS kept
FROM b
"""
