"""Embedding near-dedup and hard negatives against brute force: crowds of near copies, exact copies, odd rows, ties, lengths, large numbers."""
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import embedding_dedup as dedup
from rosterlake.llm import hard_negatives as hard

SCHEMA = "vec_id long, label int, embedding array<float>"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS node", "'x' AS n", "'x' AS key", "'x' AS pack", "'x' AS rank", "1 AS anchor")


def links_of(rows, threshold):
    """n_links and component of every row."""
    ok = []
    for i, (_, label, e) in enumerate(rows):
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e):
            ok.append((i, label, len(e), np.asarray(e, np.float64)))
    links, up = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    groups = defaultdict(list)
    for i, label, n, e in ok:
        groups[label, n].append((i, e / np.linalg.norm(e)))
    for some in groups.values():
        x = np.array([e for _, e in some])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            i, j = some[a][0], some[b][0]
            links[i] += 1
            links[j] += 1
            up[max(top(i), top(j))] = min(top(i), top(j))
    low = defaultdict(list)
    for i, (v, _, _) in enumerate(rows):
        low[top(i)].append(v)
    first = {k: min((v for v in vs if v is not None), default=None) for k, vs in low.items()}
    return sorted(((v, links[i], first[top(i)], v == first[top(i)]) for i, (v, _, _) in enumerate(rows)), key=str)


def made(seed, n=700, dims=24):
    """Loose vectors, one crowd of near copies over two labels, chains that only neighbours link, and exact copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + 1.2 * rng.normal(size=(8, dims))[rng.integers(0, 8, n)]
    center = rng.normal(size=dims)
    x[:250] = center + 0.18 * rng.normal(size=(250, dims)) * np.linspace(0.2, 2.2, 250)[:, None]
    for k in range(250, 330):  # each is 0.95 from the one before
        step = rng.normal(size=dims)
        step -= step @ x[k - 1] / (x[k - 1] @ x[k - 1]) * x[k - 1]
        x[k] = x[k - 1] + step / np.linalg.norm(step) * np.linalg.norm(x[k - 1]) * math.tan(math.acos(0.95))
    labels = rng.integers(0, 3, n)
    labels[:330] = np.arange(330) % 2 * (np.arange(330) < 20)
    x = x.astype(np.float32)
    x[600:640] = x[0]
    x[640:660] = x[300]
    return [(int(i), int(v), e.tolist()) for i, v, e in zip(rng.permutation(n), labels, x)]


@pytest.mark.parametrize("seed, sample, lists, block", [(1, 16_384, None, 8192), (2, 300, 24, 64), (3, 40, 2, 31)])
def test_links_against_brute_force(spark, monkeypatch, seed, sample, lists, block):
    monkeypatch.setattr(dedup, "PAIRS", 100)
    rows = made(seed)
    got = sorted((tuple(r) for r in dedup.link(frame(spark, rows), sample=sample, lists=lists, block=block).collect()), key=str)
    want = links_of(rows, dedup.THRESHOLD)
    assert got == want and max(r[1] for r in want) > 150 and len({r[2] for r in want}) < 500


def test_links_of_odd_rows(spark):
    one, nan, inf = [1.0, 0.0, 2.0], [1.0, math.nan, 2.0], [math.inf, 0.0, 2.0]
    rows = [(1, 1, one), (2, 1, one), (2, 1, one), (3, 1, nan), (4, 1, inf), (5, 1, None), (6, None, one), (7, 1, [1.0, None, 2.0]), (8, 1, [0.0, 0.0, 0.0]), (8, 1, [-0.0, 0.0, 0.0]),
            (9, 2, one), (10, 1, [2.0, -0.0, 4.0]), (11, 1, [1.0, 0.0, 2.0, 0.0]), (12, 1, []), (None, 1, one), (None, 3, one), (13, 4, [1e-30, 0.0]), (14, 4, [1e30, 0.0]), (15, 4, [1e30, 1e29])]
    got = sorted((tuple(r) for r in dedup.link(frame(spark, rows)).collect()), key=str)
    want = [(v, n, c, v == c if v is not None else c is None) for v, n, c, _ in links_of(rows, dedup.THRESHOLD)]
    assert got == sorted(want, key=str)
    assert dedup.link(frame(spark, rows).where("false")).count() == 0
    long_ = [(k, 0, [float((i * k) % 7) for i in range(5000)]) for k in (1, 2, 9, 16)]
    assert sorted((tuple(r) for r in dedup.link(frame(spark, long_, "vec_id long, label int, embedding array<double>")).collect()), key=str) == links_of(long_, dedup.THRESHOLD)


def test_every_link_is_probed_and_passes_the_table_distance():
    """The two bounds by themselves, on pairs around the threshold in lists that cut the clusters."""
    rng = np.random.default_rng(8)
    x = dedup.units(rng.normal(size=(1500, 16)) + 2 * rng.normal(size=(5, 16))[rng.integers(0, 5, 1500)])
    q = dedup.fit(x, np.zeros(len(x)), 40, 0.9)
    at, code, err = q.encode(x)
    probes = q.probes(x, at, math.sqrt(0.2))
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert len(a) > 500 and (probes[a, at[b]] | probes[b, at[a]]).all() and not probes.all()
    for v in np.unique(at[b]):
        d = sum(t[:, code[:, m]] for m, t in enumerate(q.tables(x, v)))
        mine = at[b] == v
        assert (np.sqrt(np.maximum(0, d[a[mine], b[mine]])) <= math.sqrt(0.2) + err[b[mine]] + 1e-6).all()


def negatives_of(rows, every=100):
    ok = {}
    for v, label, e in rows:
        if None not in (v, label, e) and all(x is not None and math.isfinite(x) for x in e):
            r = label + 1
            ok[v] = ((r % 10 if r >= 0 else -(-r % 10)) if v % 7 == 0 else label, [math.floor(256 * x) for x in e])
    out = set()
    for a, (label, x) in ok.items():
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y)), v, other == label) for v, (other, y) in ok.items() if v != a and len(y) == len(x))
        for s, v, _ in [t for t in scores if t[2]][:5]:
            found = [(t, w) for t, w, same in scores if not same and -30 * s <= -100 * t <= -90 * s][:10]
            out |= {(a, v, k, w, -s, -t) for k, (t, w) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("seed, components", [(1, 1 << 20), (2, 100)])
def test_negatives_against_brute_force(spark, monkeypatch, seed, components):
    monkeypatch.setattr(hard, "BLOCK_COMPONENTS", components)
    monkeypatch.setattr(hard, "ROWS", 50)
    monkeypatch.setattr(hard, "ANCHORS", 3)
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(0, 4)), (np.round(rng.normal(size=9) * 2) / 16).astype(np.float32).tolist()) for i in range(900)]  # many equal scores
    rows += [(1000, 1, [0.5, 0.25]), (1001, 1, [0.5, 0.5]), (1002, 3, [0.3, 0.2]), (1003, None, [1.0, 1.0]), (1004, 1, None), (1005, 1, [math.nan, 1.0]), (1006, 1, [None, 1.0]), (None, 1, [1.0, 1.0]),
             (1100, -12, [0.5, 0.25]), (1204, -12, [0.5, 0.5]), (1107, 9, [0.4, 0.4]), (2000, 1, []), (2001, 1, []), (2002, 2, []), (2100, 5, [0.1, 0.2, 0.3])]
    got = [tuple(r) for r in hard.mine(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == negatives_of(rows) and len(got) > 200
    assert hard.mine(frame(spark, rows).where("false")).collect() == [] and hard.mine(frame(spark, rows).where("vec_id % 100 = 7")).collect() == []


def test_repeated_rows_and_long_vectors(spark):
    rows = [(100, 1, [1.0, 0.0]), (100, 1, [1.0, 0.0]), (3, 1, [0.9, 0.1]), (3, 1, [0.9, 0.1]), (4, 2, [0.6, 0.0]), (4, 2, [0.6, 0.0])]
    got = sorted(tuple(r) for r in hard.mine(frame(spark, rows)).collect())
    assert got == [(100, 3, 1, 4, 58880, 39168), (100, 3, 1, 4, 58880, 39168), (100, 3, 2, 4, 58880, 39168), (100, 3, 2, 4, 58880, 39168)]
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, (rng.normal(size=3000) * 1000).round(3).tolist()) for i in range(0, 400, 20)]
    got = [tuple(r) for r in hard.mine(frame(spark, rows, "vec_id long, label int, embedding array<double>")).collect()]
    assert set(got) == negatives_of(rows)
    with pytest.raises(Exception, match="could reach"):
        hard.mine(frame(spark, [(0, 1, [1e9]), (1, 1, [1e9])], "vec_id long, label int, embedding array<double>")).collect()


def test_residue_products_are_exact():
    rng = np.random.default_rng(3)
    for size in (1, 100, 1 << 20):
        a, b = (rng.integers(-size, size + 1, (20, 150)).astype(float) for _ in range(2))
        bound = int(150 * size * size)
        moduli = hard.primes(bound)
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert hard.products(hard.residues(a, moduli), hard.residues(b, moduli), moduli).tolist() == want
    edge = np.array([[30.0, 40.0]])
    moduli = hard.primes(2500)
    assert hard.products(hard.residues(edge, moduli), hard.residues(np.vstack([edge, -edge]), moduli), moduli).tolist() == [[2500, -2500]]


def test_mined_query_covers_its_anchors(spark):
    got = hard.op13_residue_gemm(spark, "/root/testdata/sf0.01")
    assert got.select(F.countDistinct("anchor_id")).first()[0] == 5 and got.schema["rank"].dataType.simpleString() == "int"
