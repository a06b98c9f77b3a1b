"""Near duplicates among embeddings: product quantisation over coarse inverted lists, with bounds that keep every link, and an exact rerank."""
from __future__ import annotations

import math
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.common import components, join_sized, spill, table
from rosterlake.llm.vectors import finite_vectors, packed, units, unpacked

THRESHOLD = 0.93
SAMPLE = 16_384  # distinct vectors, by hash, on which lists, codes and pivots are fitted
LIST_ROWS = 8192  # distinct vectors per list, up to MOST_LISTS lists
LEAST_LISTS, MOST_LISTS = 16, 512
CODES, CODE_DIMS = 16, 4  # codewords of a subspace, dimensions of a subspace
ROUNDS = 8
BLOCK = 8192  # rows of a list that one comparison holds, on either side
PACK_ROWS = 4096
HEAVY = 8  # sampled neighbours that make a pivot
PIVOT_TRIALS = 1024  # sampled vectors of a label that are tried as pivots
QUERIES, PAIRS = 256, 1 << 18  # queries whose table distances, and pairs whose cosines are computed at once
SLACK = 1e-6


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (2 * x @ centers.T - (centers * centers).sum(axis=1)).argmax(axis=1)


def means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, centers)
        n, total = np.bincount(at, minlength=len(centers)), np.zeros_like(centers)
        np.add.at(total, at, x)
        centers[n > 0] = total[n > 0] / n[n > 0, None]
    return centers


@dataclass
class Quantiser:
    """Centres of the lists, codewords of each subspace for what a centre leaves over, and pivots of crowded places per label."""

    centers: np.ndarray
    books: list[np.ndarray]
    pivots: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        self.cuts = np.cumsum([0, *(b.shape[1] for b in self.books)])
        self.apart = np.sqrt(np.maximum(((self.centers[:, None, :] - self.centers[None, :, :]) ** 2).sum(axis=2), 1e-24))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and distance to the coded place, for every vector of length one."""
        at = _nearest(x, self.centers)
        rest = x - self.centers[at]
        code = np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            rest[:, a:b] -= book[code[:, m]]
        return at, code, np.sqrt((rest * rest).sum(axis=1))

    def probes(self, x: np.ndarray, at: np.ndarray, reach: float) -> np.ndarray:
        """Lists, as a matrix of booleans, to which the boundary of a vector's own list is at most half of ``reach`` away.

        A segment between two vectors of different lists crosses the boundary of the two, so one of its ends is no farther from it than
        half of its length: of any two vectors within ``reach`` at least one probes the list of the other.
        """
        far = (self.centers * self.centers).sum(axis=1) - 2 * x @ self.centers.T
        own = np.take_along_axis(far, at[:, None], 1)
        return (far - own) / (2 * self.apart[at]) <= reach / 2 + SLACK

    def tables(self, x: np.ndarray, at: int) -> list[np.ndarray]:
        """Squared distance of every query from every codeword, subspace by subspace, seen from the centre of a list."""
        rest = x - self.centers[at]
        return [(rest[:, a:b] ** 2).sum(axis=1, keepdims=True) - 2 * rest[:, a:b] @ book.T + (book * book).sum(axis=1) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]


def plain(dims: int) -> Quantiser:
    """For lengths that the sample does not hold: one list and one code for all, so every pair is reranked."""
    return Quantiser(np.zeros((1, dims)), [np.zeros((1, dims))])


def pivots(x: np.ndarray, cosine: float) -> np.ndarray:
    """Centres of the sample's crowded places: around each, ``HEAVY`` vectors or more lie within the threshold of one of them."""
    out, trials = [], x[:PIVOT_TRIALS]
    near = np.zeros(len(trials), np.int64)
    for i in range(0, len(x), 4096):
        near += (trials @ x[i : i + 4096].T >= cosine).sum(axis=1)
    for t in np.argsort(-near, kind="stable"):
        if near[t] >= HEAVY and not any(trials[t] @ p >= cosine for p in out):
            out.append(units(x[x @ trials[t] >= cosine].mean(axis=0, keepdims=True))[0])
    return np.array(out).reshape(len(out), x.shape[1])


def fit(x: np.ndarray, labels: np.ndarray, lists: int, threshold: float) -> Quantiser:
    rng = np.random.default_rng(20240611)
    centers = means(x, max(1, min(lists, len(x) // 16)), rng)
    rest = x - centers[_nearest(x, centers)]
    books = [means(part, CODES, rng) for part in np.array_split(rest, max(1, x.shape[1] // CODE_DIMS), axis=1)]
    found = {int(v): pivots(x[labels == v], threshold) for v in np.unique(labels)}
    return Quantiser(centers, books, {v: p for v, p in found.items() if len(p)})


def _prepared(dtype: str):
    def run(batches):
        for b in batches:
            n, labels = b.num_rows, b.column("label").to_pylist()
            node, vec, dims = [None] * n, [None] * n, [None] * n
            for rows, x in finite_vectors(b.column("embedding")):
                x = x + 0.0  # one zero
                for i, v, some in zip(rows.tolist(), packed(x, dtype), x.any(axis=1).tolist()):
                    if some and labels[i] is not None:
                        node[i], vec[i], dims[i] = md5(b"%d %d " % (labels[i], x.shape[1]) + v).digest(), v, x.shape[1]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(dims, pa.int32()), pa.array(node, pa.binary()), pa.array(vec, pa.binary())],
                                             names=["vec_id", "label", "dims", "node", "vec"])

    return run


def _indexed(models: dict[int, Quantiser], dtype: str, threshold: float):
    reach, inside = math.sqrt(2 - 2 * threshold), math.cos(math.acos(threshold) / 2) + 1e-9

    def run(batches):
        for b in batches:
            dims, labels, vecs = np.asarray(b.column("dims"), np.int64), np.asarray(b.column("label"), np.int64), b.column("vec").to_pylist()
            n = b.num_rows
            home, ball, err, code, goes = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.zeros(n), [b""] * n, [None] * n
            for d in np.unique(dims).tolist():
                rows, q = np.flatnonzero(dims == d), models.get(d) or plain(d)
                x = units(unpacked([vecs[i] for i in rows], d, dtype))
                at, c, e = q.encode(x)
                home[rows], err[rows] = at, e
                probes = q.probes(x, at, reach)
                for i, r in enumerate(rows.tolist()):
                    code[r], goes[r] = c[i].tobytes(), np.flatnonzero(probes[i]).tolist()
                for v, p in q.pivots.items():
                    mine = labels[rows] == v
                    cos = x[mine] @ p.T
                    ball[rows[mine]] = np.where(cos.max(axis=1) >= inside, cos.argmax(axis=1), -1) if mine.any() else -1
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("node", "label", "dims", "vec", "n", "first_id")], pa.array(home), pa.array(code, pa.binary()), pa.array(err), pa.array(ball),
                                              pa.array(goes, pa.list_(pa.int32()))], names=["node", "label", "dims", "vec", "n", "first_id", "home", "code", "err", "ball", "probes"])

    return run


def _merge(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of ``a[i]`` and ``b[i]``; afterwards every entry points to the first of its set."""
    pair = np.unique(np.stack([up[a], up[b]], axis=1), axis=0)
    for x, y in pair[pair[:, 0] != pair[:, 1]].tolist():
        while up[x] != x:
            x = up[x]
        while up[y] != y:
            y = up[y]
        up[max(x, y)] = min(x, y)
    while (up[up] != up).any():
        up[:] = up[up]


def _compare(models: dict[int, Quantiser], dtype: str, threshold: float):
    """All lists of a pack: how many vectors each row is linked with here, and the first group of those it is connected with."""
    reach = math.sqrt(2 - 2 * threshold)

    def one(items: pa.Table, queries: pa.Table, d: int, at: int) -> list:
        q = models.get(d) or plain(d)
        both = [{c: t[c].to_pylist() for c in ("node", "g", "vec", "code", "probes")} | {c: np.asarray(t[c], np.int64) for c in ("n", "home", "ball")} for t in (items, queries)]
        y, x = ({**s, "raw": unpacked(s["vec"], d, dtype)} for s in both)
        for s in (y, x):
            s["norm"], s["unit"] = np.sqrt((s["raw"] ** 2).sum(axis=1)), units(s["raw"])
        place: dict[bytes, int] = {}
        x["id"], y["id"] = (np.array([place.setdefault(v, len(place)) for v in s["node"]], np.int64) for s in (x, y))
        codes = np.frombuffer(b"".join(y["code"]), np.uint8).reshape(len(y["node"]), -1)
        limit = (reach + np.asarray(items["err"]) + SLACK) ** 2
        sees = np.zeros((len(y["node"]), len(q.centers)), bool)
        sees[np.repeat(np.arange(len(sees)), [len(p) for p in y["probes"]]), np.concatenate([np.array(p, np.int64) for p in y["probes"]])] = True
        up, links = np.arange(len(place)), np.zeros(len(place), np.int64)
        for lo in range(0, len(x["node"]), QUERIES):
            part = slice(lo, lo + QUERIES)
            gap = sum(t[:, codes[:, m]] for m, t in enumerate(q.tables(x["unit"][part], at)))
            near = (gap <= limit) & (x["id"][part, None] != y["id"]) & ((x["ball"][part, None] != y["ball"]) | (y["ball"] < 0))
            left, right = np.nonzero(near)
            left += lo
            for k in range(0, len(left), PAIRS):
                i, j = left[k : k + PAIRS], right[k : k + PAIRS]
                linked = np.einsum("ij,ij->i", x["raw"][i], y["raw"][j]) / (x["norm"][i] * y["norm"][j]) >= threshold
                i, j = i[linked], j[linked]
                np.add.at(links, x["id"][i], y["n"][j])
                once = (x["home"][i] != at) & ~sees[j, x["home"][i]]  # nobody asks the other way round
                np.add.at(links, y["id"][j[once]], x["n"][i[once]])
                _merge(up, x["id"][i], y["id"][j])
        names, groups = list(place), {n: g for s in (x, y) for n, g in zip(s["node"], s["g"])}
        return [(names[i], int(links[i]), groups[names[i]], groups[names[up[i]]]) for i in np.flatnonzero((links > 0) | (up != np.arange(len(up))))]

    def run(rows: pa.Table) -> pa.Table:
        out = []
        keys = ["label", "dims", "at", "i", "j"]
        rows = rows.sort_by([(k, "ascending") for k in keys])
        key = np.stack([np.asarray(rows[k], np.int64) for k in keys], axis=1)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        for a, b in zip(starts, np.r_[starts[1:], len(key)]):
            piece = rows.slice(a, b - a)
            asks = np.asarray(piece["asks"])
            if asks.any() and not asks.all():
                out += one(piece.filter(pa.array(~asks)), piece.filter(pa.array(asks)), *key[a, 1:3].tolist())
        cols = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.binary(), pa.binary()))], names=["node", "links", "g", "near"])

    return run


def link(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, lists: int | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of (vec_id, label, embedding).

    Two rows are linked if their labels are equal and their cosine in double precision is at least ``threshold``. ``n_links`` counts the
    other rows a row is linked with, ``component_id`` is the smallest vec_id reachable by links, ``kept`` marks the rows that have it.

    Rows whose vectors and labels are equal are one node. Centres, codewords and pivots are fitted on about ``sample`` distinct vectors;
    every node is indexed: it lies in the list of its nearest centre and asks all lists to whose boundary it is close enough for a link
    (see ``Quantiser.probes``). An item stays if the table distance of query and code is at most the link distance plus the item's own
    coding error, which loses no link; then the exact cosine decides. Nodes within half the link angle of a pivot of their label are all
    linked with each other by the triangle inequality and are counted as a group instead of being compared, so a crowd of near copies
    costs no pairs. Lists are compared in blocks, and only counts and connections leave them.

    Rows with a NULL label, a NULL or zero vector, or a NULL or non-finite component link with nothing, nor do vectors of different
    lengths; rows with equal vec_id count each by themselves; a NULL vec_id never names a component of others; a very long vector is a
    row like any other; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    dtype = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = spill(given.mapInArrow(_prepared(dtype), "vec_id long, label long, dims int, node binary, vec binary"))
    nodes = spill(rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), *[F.first(c).alias(c) for c in ("label", "dims", "vec")]))
    count = nodes.count()
    share = min(1 << 30, math.ceil(sample / max(1, count) * (1 << 30)))
    drawn = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < share).select("label", "dims", "vec").limit(2 * sample).collect()
    models = {}
    for d in {r.dims for r in drawn}:
        some = [r for r in drawn if r.dims == d]
        models[d] = fit(units(unpacked([r.vec for r in some], d, dtype)), np.array([r.label for r in some]), lists or min(MOST_LISTS, max(LEAST_LISTS, count // LIST_ROWS)), threshold)
    index = spill(nodes.mapInArrow(_indexed(models, dtype, threshold), "node binary, label long, dims int, vec binary, n long, first_id long, home int, code binary, err double, ball int, probes array<int>"))
    crowds = spill(index.where("ball >= 0").groupBy("label", "dims", "ball").agg(F.min("node").alias("lead"), F.sum("n").alias("crowd")))
    index = spill(join_sized(index, crowds, ["label", "dims", "ball"], "left").withColumn("g", F.coalesce("lead", "node")).drop("lead"))
    asked = index.withColumn("at", F.explode("probes"))
    sizes = asked.groupBy("label", "dims", "at").agg(F.count("*").alias("queries"), F.count(F.when(F.col("at") == F.col("home"), 1)).alias("items")).where("items > 0")
    sizes = spill(sizes.select("label", "dims", "at", F.ceil(F.col("items") / block).cast("int").alias("is"), F.ceil(F.col("queries") / block).cast("int").alias("js"),
                               (F.ceil(F.col("items") / block) * F.col("queries") + F.ceil(F.col("queries") / block) * F.col("items")).alias("copies")))
    packs = max(1, math.ceil((sizes.agg(F.sum("copies")).first()[0] or 0) / PACK_ROWS))
    placed = join_sized(asked, sizes.drop("copies"), ["label", "dims", "at"])
    own = ["node", "g", "vec", "n", "home", "ball", "label", "dims", "at"]
    mine, other = (lambda s: F.pmod(F.xxhash64("node"), s).cast("int")), (lambda s: F.explode(F.sequence(F.lit(0), F.col(s) - 1)))
    nothing = [F.lit(b"").alias("code"), F.lit(0.0).alias("err"), F.array().cast("array<int>").alias("probes")]
    queries = placed.select(*own, *nothing, F.lit(True).alias("asks"), mine("js").alias("j"), other("is").alias("i"))
    items = placed.where("at = home").select(*own, "code", "err", "probes", F.lit(False).alias("asks"), mine("is").alias("i"), other("js").alias("j"))
    units_ = queries.unionByName(items).withColumn("pack", F.pmod(F.xxhash64("label", "dims", "at", "i", "j"), F.lit(packs)))
    links = spill(units_.groupBy("pack").applyInArrow(lambda t: _compare(models, dtype, threshold)(t.drop(["pack"])), "node binary, links long, g binary, near binary"))
    classes = components(links.select(F.col("g").alias("a"), F.col("near").alias("b")).distinct())
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    info = index.select("node", "g", "n", "first_id", "crowd").join(counted, "node", "left").where("n > 1 OR links > 0 OR crowd > n")
    info = spill(info.join(classes.withColumnRenamed("node", "g"), "g", "left").select("node", "first_id", F.coalesce("root", "g").alias("root"), (
        F.coalesce("links", F.lit(0)) + F.coalesce("crowd", "n") - 1).cast("long").alias("n_links")))
    named = spill(info.groupBy("root").agg(F.min("first_id").alias("component_id")))
    info = spill(join_sized(info, named, ["root"]).select("node", "n_links", "component_id"))
    linked = join_sized(rows.where("node IS NOT NULL").select("vec_id", "node"), info, ["node"], "left").select("vec_id", "n_links", "component_id")
    alone = rows.where("node IS NULL").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = linked.union(alone).select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AS odd FROM embeddings),
ok AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND CASE WHEN e IS NULL OR odd > 0 THEN false ELSE list_inner_product(e, e) > 0 END),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
c AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.seen),
m AS (SELECT node, min(seen) AS component_id FROM c GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.component_id, v.vec_id = m.component_id AS kept FROM v JOIN m ON m.node = v.vec_id
"""
