"""Hard negatives by exact integer scores: component matrices are multiplied modulo small primes in float32 and put together by remainders."""
from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.common import spill, stored, table
from rosterlake.llm.vectors import finite_vectors, packed, unpacked

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = 30, 90  # percent of the positive score
LARGEST_PRIME = 1021
EXACT = 1 << 24  # whole numbers up to here are exact in float32
SCORE_LIMIT = 1 << 56  # 90 times a score still fits into 64 bits
BLOCK_COMPONENTS = 1 << 20  # components of the anchors that one pass holds
ROWS, ANCHORS = 4096, 512  # rows and anchors of one product


def primes(bound: int) -> list[int]:
    """The largest primes up to ``LARGEST_PRIME`` whose product is above four times the bound, so that the highest digit shows the sign."""
    out: list[int] = []
    n = LARGEST_PRIME
    while not out or math.prod(out) <= 4 * bound:
        if all(n % k for k in range(2, math.isqrt(n) + 1)):
            out.append(n)
        n -= 1
    return out


def residues(matrix: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """For each prime the residues nearest to zero, as float32."""
    whole = matrix.astype(np.int64)
    out = []
    for p in moduli:
        r = whole % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def products(left: list[np.ndarray], right: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Exact scores of all rows of ``left`` against all rows of ``right`` from their residues.

    A product of float32 matrices is exact as long as its sums stay below 2**24, so dimensions are taken in runs of so many that they do;
    the remainders of the runs are added. The score comes from its remainders digit by digit in the mixed radix of the primes.
    """
    digits: list[np.ndarray] = []
    score = np.zeros((len(left[0]), len(right[0])), np.int64)
    weight = 1
    for k, p in enumerate(moduli):
        run = max(1, EXACT // (p // 2) ** 2)
        rest = np.zeros(score.shape, np.int64)
        for a in range(0, left[k].shape[1], run):
            rest += (left[k][:, a : a + run] @ right[k][:, a : a + run].T).astype(np.int64)
        digit = (rest - score % p) * pow(weight, -1, p) % p if k else rest % p
        if k == len(moduli) - 1:
            digit = np.where(digit > p // 2, digit - p, digit)  # the highest digit carries the sign
        digits.append(digit)
        score = score + digit * weight
        weight *= p
    return score


def _whole(batches, dtype: str):
    for b in batches:
        labels, ids = b.column("label").to_pylist(), b.column("vec_id").to_pylist()
        out: dict[str, list] = {c: [] for c in ("vec_id", "label", "dims", "vec", "key", "square")}
        for rows, x in finite_vectors(b.column("embedding")):
            x = np.floor(SCALE * x)
            if x.size and np.abs(x).max() >= SCORE_LIMIT:
                raise ValueError("components are too large")
            for i, v, s in zip(rows.tolist(), packed(x, dtype), (x * x).sum(axis=1).tolist()):
                if labels[i] is not None and ids[i] is not None:
                    label = math.copysign(1, labels[i] + 1).__int__() * (abs(labels[i] + 1) % 10) if ids[i] % 7 == 0 else labels[i]
                    for c, value in zip(out, (ids[i], label, x.shape[1], v, md5(b"%d %d %d " % (ids[i], label, x.shape[1]) + v).digest(), s)):
                        out[c].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64()))], names=list(out))


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` of each row by score descending, then id; places without an id are not filled."""
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


NONE = np.iinfo(np.int64).max  # id of a place that is not filled
LOW = -SCORE_LIMIT


class Block:
    """A block of anchors of one length: their residues and, row by row, what has been found for them so far."""

    def __init__(self, ids, labels, vecs, dims, moduli, dtype):
        self.ids, self.labels, self.dims, self.moduli = np.array(ids, np.int64), np.array(labels, np.int64), dims, moduli
        self.residues = residues(unpacked(vecs, dims, dtype), moduli)

    def scored(self, batch_ids: np.ndarray, batch_labels: np.ndarray, x: np.ndarray, same: bool):
        """Yield (anchors, ids, scores) of the rows with the same label, or with others, in parts of bounded size; rows come in the order of their ids."""
        order = np.argsort(batch_ids, kind="stable")
        for v in np.unique(self.labels):
            mine = np.flatnonzero(self.labels == v)
            rows = order[(batch_labels[order] == v) == same]
            for r in range(0, len(rows), ROWS):
                part = rows[r : r + ROWS]
                right = residues(x[part], self.moduli)
                for a in range(0, len(mine), ANCHORS):
                    at = mine[a : a + ANCHORS]
                    yield at, batch_ids[part], products([m[at] for m in self.residues], right, self.moduli)


def _positives(block: Block, dtype: str):
    def run(batches):
        scores, ids = np.full((len(block.ids), POSITIVES), LOW), np.full((len(block.ids), POSITIVES), NONE)
        for batch_ids, labels, x in _rows(batches, block.dims, dtype):
            for at, other, s in block.scored(batch_ids, labels, x, same=True):
                self_ = other[None, :] == block.ids[at, None]
                s = np.where(self_, LOW, s)
                near = np.argsort(-s, axis=1, kind="stable")[:, : POSITIVES]
                found = np.where(np.take_along_axis(self_, near, 1), NONE, other[near])
                scores[at], ids[at] = _first(np.hstack([scores[at], np.take_along_axis(s, near, 1)]), np.hstack([ids[at], found]), POSITIVES)
        row, col = np.nonzero(ids != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[row]), pa.array(row), pa.array(ids[row, col]), pa.array(scores[row, col])], names=["anchor_id", "anchor", "positive_id", "positive_score"])

    return run


def _negatives(block: Block, positive: np.ndarray, dtype: str):
    """``positive``: scores of the positives of each anchor, ``LOW`` where there are fewer."""
    there = positive > LOW
    high, low = (np.where(there, x, 0) for x in (HIGHEST * np.where(there, positive, 0) // 100, -(-LOWEST * np.where(there, positive, 0) // 100)))
    width = positive.shape[1]

    def run(batches):
        scores, ids = np.full((len(block.ids), width, NEGATIVES), LOW), np.full((len(block.ids), width, NEGATIVES), NONE)
        for batch_ids, labels, x in _rows(batches, block.dims, dtype):
            for at, other, s in block.scored(batch_ids, labels, x, same=False):
                order = np.argsort(-s, axis=1, kind="stable")
                s = np.take_along_axis(s, order, 1)
                for j in range(width):  # a window: the places from the first score that is not too high
                    start = (s > high[at, j, None]).sum(axis=1)
                    place = start[:, None] + np.arange(NEGATIVES)
                    in_ = place < s.shape[1]
                    place = np.where(in_, place, 0)
                    found = np.take_along_axis(s, place, 1)
                    in_ &= (found >= low[at, j, None]) & there[at, j, None]
                    found, names = np.where(in_, found, LOW), np.where(in_, other[np.take_along_axis(order, place, 1)], NONE)
                    scores[at, j], ids[at, j] = _first(np.hstack([scores[at, j], found]), np.hstack([ids[at, j], names]), NEGATIVES)
        row, j, col = np.nonzero(ids != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(j), pa.array(ids[row, j, col]), pa.array(scores[row, j, col])], names=["anchor", "place", "negative_id", "negative_score"])

    return run


def _rows(batches, dims: int, dtype: str):
    """Ids, labels and components of the batches, put together to matrices of ``ROWS`` rows or more."""
    held: list[pa.RecordBatch] = []

    def together():
        t = pa.Table.from_batches(held)
        return np.asarray(t["vec_id"], np.int64), np.asarray(t["label"], np.int64), unpacked(t["vec"].to_pylist(), dims, dtype)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= ROWS:
            yield together()
            held = []
    if sum(x.num_rows for x in held):
        yield together()


def _best(found: DataFrame, by: list[str], id_: str, score: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), id_)
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mine(vectors: DataFrame, anchors: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of (vec_id, label, embedding) that are anchors.

    A component x counts as floor(256 x); a score is the exact inner product. Where vec_id is divisible by 7, the label first becomes
    (label + 1) % 10. An anchor's positives are its first five other rows of the same label, by score descending, then vec_id; for each
    positive come the first ten rows of other labels whose score lies between 30 and 90 percent of the positive's, both included.
    ``anchors`` defaults to vec_id divisible by 100.

    Rows with a NULL vec_id, label or vector, or a NULL or non-finite component take no part; rows of another length than the anchor's
    have no score with it; equal anchor rows are mined once, other repeated rows are rows each; rows of the anchor's own vec_id are not
    its positives; ties go by vec_id; long vectors are multiplied in runs of dimensions; an empty table gives no rows; other columns are
    ignored. Scores that could reach 2**56 raise an error.

    Anchors go to the tasks in blocks of ``BLOCK_COMPONENTS`` components at most on average, whatever their number; each block passes
    over the rows twice, and a task keeps only its first rows for each anchor.
    """
    spark = vectors.sparkSession
    dtype = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"  # 256 x has the digits of x
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = spill(given.mapInArrow(lambda batches: _whole(batches, dtype), "vec_id long, label long, dims int, vec binary, key binary, square double"))
    picked = spill(rows.where(F.col("vec_id") % 100 == 0 if anchors is None else anchors).dropDuplicates(["key"]))
    sizes = {r.dims: r for r in picked.groupBy("dims").agg(F.count("*").alias("n"), F.max("square").alias("most")).collect()}
    most = {r.dims: r.most for r in rows.join(picked.select("dims").distinct(), "dims", "left_semi").groupBy("dims").agg(F.max("square").alias("most")).collect()}
    done = []
    for dims, size in sizes.items():
        bound = math.ceil(math.sqrt(size.most) * math.sqrt(most[dims]) * (1 + 1e-9)) + 1
        if bound >= SCORE_LIMIT:
            raise ValueError(f"scores of vectors of length {dims} could reach {bound}")
        moduli, blocks = primes(bound), math.ceil(size.n * max(1, dims) / BLOCK_COMPONENTS)
        with_rows = rows.where(F.col("dims") == dims).select("vec_id", "label", "vec")
        for k in range(blocks):
            some = picked.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("key"), F.lit(blocks)) == k)).select("vec_id", "label", "vec").collect()
            if some:
                done.append(_mined(with_rows, Block(*zip(*some), dims, moduli, dtype), dtype))
    if not done:
        return spark.createDataFrame([], FOUND)
    return spark.read.schema(FOUND).parquet(*done)


def _mined(rows: DataFrame, block: Block, dtype: str) -> str:
    """The folder with the rows of one block."""
    found = rows.mapInArrow(_positives(block, dtype), "anchor_id long, anchor long, positive_id long, positive_score long")
    positives = spill(_best(found, ["anchor"], "positive_id", "positive_score", POSITIVES, "place").withColumn("place", F.col("place") - 1))
    scores = np.full((len(block.ids), POSITIVES), LOW)
    for r in positives.select("anchor", "place", "positive_score").collect():
        scores[r.anchor, r.place] = r.positive_score
    found = rows.mapInArrow(_negatives(block, scores, dtype), "anchor long, place long, negative_id long, negative_score long")
    best = _best(found, ["anchor", "place"], "negative_id", "negative_score", NEGATIVES, "rank")
    return stored(best.join(positives, ["anchor", "place"]).select(*[f.name for f in T.StructType.fromDDL(FOUND)]))


FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def op13_residue_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e,
  len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AS odd FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
r AS (SELECT vec_id, label, e FROM v WHERE odd = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other)::INT AS rank, s.other AS negative_id,
  p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN {LOWEST} * p.score AND {HIGHEST} * p.score)
SELECT * FROM n WHERE rank <= {NEGATIVES}
"""
