"""Jaccard self-join of documents on word shingles: a MinHash LSH forest proposes, exact set arithmetic verifies."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import components, hash60, join_sized, map_columns, row_key, small_batches, spill, table

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8  # minimum hashes in a tree's signature, the longest prefix
TARGET_RECALL = 0.9995
RELATED = 0.3  # estimated similarity from which two documents are verified together
BLOCK = 256  # documents of a group that one task compares with as many others
RNG = np.random.default_rng(20240601)
MULTIPLY = (RNG.integers(0, 1 << 32, TREES * DEPTH, np.uint32) | np.uint32(1))[None, :]
MIX = RNG.integers(0, 1 << 32, TREES * DEPTH, np.uint32)[None, :]


class WordHashes(dict):
    """64-bit hash of each word met, emptied when it grows past a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; fewer words are one shingle, no word gives none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    acc = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(32)
        acc += w[i : len(w) - k + 1 + i]
    acc ^= acc >> np.uint64(31)
    acc *= np.uint64(0xD6E8FEB86659FD93)
    acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def signature(shingles: np.ndarray) -> bytes:
    """Minimum hashes, tree after tree."""
    low = np.full(MULTIPLY.shape[1], 0xFFFFFFFF, np.uint32)
    top = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    for i in range(0, len(top), 512):
        np.minimum(low, ((top[i : i + 512] ^ MIX) * MULTIPLY).min(axis=0), out=low)
    return low.astype(">u4").tobytes()


def _sketch(texts: list[str | None]) -> list[list]:
    hashes, out = WordHashes(), ([], [], [])
    for t in texts:
        s = shingle_set(t or "", hashes)
        out[0].append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
        out[1].append(len(s))
        out[2].append(signature(s) if len(s) else None)
    return list(out)


def _sets(texts: list[str | None]) -> list[list]:
    hashes = WordHashes()
    return [[shingle_set(t or "", hashes).view(np.int64) for t in texts]]


def _agreement(left: list[bytes], right: list[bytes]) -> list[np.ndarray]:
    a, b = (np.frombuffer(b"".join(x), np.uint32).reshape(len(x), -1) for x in (left, right))
    return [(a == b).mean(axis=1) if len(left) else np.zeros(0)]


def found_share(similarity, depth: int, trees: int = TREES):
    """Probability that two documents share a prefix of ``depth`` hashes in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def _verify(threshold: float):
    """Exact comparison inside a group of rows; each row is a set written as its difference from the group's pivot set."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in rows.groupby("root", sort=False):
            same = g["pair"].iloc[0]
            block = g["block"].to_numpy()
            changes = [np.concatenate([a, m]) for a, m in zip(g["added"], g["missing"])]
            sizes, of_pivot = g["size"].to_numpy(np.int64), g["of_pivot"].to_numpy(np.int64)
            lengths = np.fromiter(map(len, changes), np.int64, len(changes))
            words, at = np.unique(np.concatenate(changes), return_inverse=True) if lengths.sum() else (np.zeros(0), np.zeros(0, np.int64))
            row = np.repeat(np.arange(len(g)), lengths)
            common = np.zeros((len(g), len(g)), np.float64)
            for lo in range(0, len(words), 16384):
                pick = (at >= lo) & (at < lo + 16384)
                x = np.zeros((len(g), min(16384, len(words) - lo)), np.float32)
                x[row[pick], at[pick] - lo] = 1
                common += x @ x.T
            missing = np.fromiter(map(len, g["missing"]), np.int64, len(g))
            both = of_pivot[0] - missing[:, None] - missing[None, :] + common
            linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if not same:
                linked &= block[:, None] != block[None, :]
            n = g["n"].to_numpy(np.int64)
            label = np.arange(len(g))
            while True:
                low = np.minimum(label, np.where(linked, label[None, :], len(g)).min(axis=1))
                if (low == label).all():
                    break
                label = low
            hit = linked.any(axis=1)
            node = g["node"].to_numpy()
            out.append(pd.DataFrame({"node": node[hit], "links": (linked @ n)[hit], "near": node[label][hit]}))
        return pd.concat(out, ignore_index=True)

    return compare


def sketches(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, node, size, mins): the key of the shingle set, its size and its signature, for every document row."""
    small_batches(docs.sparkSession)
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_columns(keyed, ["text"], "node binary, size int, mins binary", _sketch)


def forest_edges(reps: DataFrame, threshold: float, target: float) -> DataFrame:
    """(a, b, est): documents that share a tree's prefix, each with the first document of that place in the trie.

    The prefix is the longest by which a pair exactly at the threshold is found with the target probability, so every link is found at
    least that surely, whatever else the corpus holds.
    """
    depth = next((d for d in range(DEPTH, 1, -1) if found_share(threshold, d) >= target), 1)
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("mins", 4 * DEPTH * i + 1, 4 * depth)) for i in range(TREES)])
    placed = reps.select("node", F.explode_outer(keys).alias("key"))
    shared = spill(placed.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead"))
    pairs = spill(join_sized(placed, shared, ["key"]).where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())
    with_a = join_sized(reps.select(F.col("node").alias("a"), F.col("mins").alias("ma")), pairs, ["a"])
    with_b = join_sized(reps.select(F.col("node").alias("b"), F.col("mins").alias("mb")), spill(with_a), ["b"])
    return spill(map_columns(with_b, ["ma", "mb"], "est double", _agreement))


def join(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """One row per document: (rid, doc_id, root, n_links), ``root`` NULL where no other row is similar or equal.

    Rows with equal shingle sets are one node. Nodes that the forest relates form a group; all pairs of a group are compared exactly,
    in blocks of nodes, each as a difference from the group's first node, and come out as counts and a spanning tree, never as pairs.
    ``n_links`` counts the other document rows of similarity ``threshold`` or more, copies included; ``root`` is the smallest node key
    of the connected class.

    NULL and empty texts have no shingles and are similar to nothing; repeated rows are copies; a NULL doc_id is a document like any
    other; other columns are ignored; an empty table gives no rows.
    """
    sk = spill(sketches(docs))
    reps = spill(sk.where("node IS NOT NULL").groupBy("node").agg(F.min("rid").alias("rid"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("mins").alias("mins")))
    edges = forest_edges(reps.select("node", "mins"), threshold, target).where(F.col("est") >= min(RELATED, threshold)).select("a", "b")
    member = join_sized(reps.select("node", "rid", "n", "size"), components(edges), ["node"])
    per_root = member.groupBy("root").agg(F.count("*").alias("m"))
    member = spill(member.join(per_root, "root").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")))
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rid"), "text")
    texts = join_sized(texts, member.select("rid", "node", "root", "n", "size", "blocks"), ["rid"])
    sets = spill(map_columns(texts, ["text"], "items array<bigint>", _sets).dropDuplicates(["node"]))
    pivots = sets.where("node = root").select("root", F.col("items").alias("base"))
    diffs = sets.join(pivots, "root").select("root", "node", "n", "size", "blocks", F.size("base").alias("of_pivot"), F.array_except("items", "base").alias("added"),
                                             F.array_except("base", "items").alias("missing"))
    diffs = diffs.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    packs = max(1, math.ceil(member.count() / (4 * BLOCK)))
    small = diffs.where("blocks = 1").select("root", "node", "n", "size", "of_pivot", "added", "missing", "block", F.lit(True).alias("pair"),
                                             F.pmod(F.xxhash64("root"), F.lit(packs)).alias("k0"), F.lit(-1).alias("k1"), F.lit(-1).alias("k2"))
    large = diffs.where("blocks > 1").withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("root", "node", "n", "size", "of_pivot", "added", "missing", "block", (F.col("block") == F.col("other")).alias("pair"),
                         F.xxhash64("root").alias("k0"), F.least("block", "other").alias("k1"), F.greatest("block", "other").alias("k2"))
    links = spill(small.union(large).groupBy("k0", "k1", "k2").applyInPandas(_verify(threshold), "node binary, links long, near binary"))
    classes = components(links.select(F.col("node").alias("a"), F.col("near").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    info = reps.select("node", "n").join(counts, "node", "left").join(classes, "node", "left").where("n > 1 OR links IS NOT NULL")
    info = spill(info.select("node", F.coalesce("root", "node").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return join_sized(sk.select("rid", "doc_id", "node"), info, ["node"], "left").select("rid", "doc_id", "root", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents in their own columns, one of each class: that of the smallest doc_id (NULL last), then row key."""
    found = spill(join(docs, threshold).where("root IS NOT NULL").select("rid", "doc_id", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("rid"))
    first = found.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.rid").alias("rid"), F.lit(True).alias("first"))
    acted = spill(found.groupBy("rid").agg(F.count("*").alias("rows")).join(first, "rid", "left").where("first IS NULL OR rows > 1").select("rid", "first"))
    whole = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = join_sized(whole, acted, ["rid"], "left_anti")
    again = join_sized(whole, acted.where("first").select("rid"), ["rid"], "left_semi").dropDuplicates(["rid"])
    return kept.union(again).select("row.*")


def class_ids(found: DataFrame) -> DataFrame:
    """(root, class_id): the smallest doc_id of a class; a class without one, or whose id an earlier class has, takes a negative number of its own."""
    own = -1 - hash60(F.hex("root"))
    low = found.groupBy("root").agg(F.min("doc_id").alias("low"))
    named = low.where("low IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("low").orderBy("root")))
    return named.select("root", F.when(F.col("k") == 1, F.col("low")).otherwise(own).alias("class_id")).union(low.where("low IS NULL").select("root", own))


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spill(join(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ids = class_ids(found.where("root IS NOT NULL"))
    return join_sized(found, spill(ids), ["root"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")
