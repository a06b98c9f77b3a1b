"""The divergence audit against plain Python: ties, large counts, several shards and tiles, missing values."""
import re
from collections import Counter, defaultdict

import numpy as np

from rosterlake.llm import source_divergence as sd


def brute(rows, least, top):
    occ, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang or "", source or ""))
        occ[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        v = len(kept)

        def p(count, v=v, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * v) for t in kept}

        mine, whole = p(occ[lang, source]), Counter()
        for (x, s), c in occ.items():
            whole += c if x == lang else Counter()
        whole = p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = []
        for x, s in groups:
            if x == lang and s != source:
                other = p(occ[x, s])
                pairs.append((-sum(f(mine[t], other[t]) for t in kept), s.encode()))
        terms = [(-f(mine[t], whole[t]), t.encode()) for t in kept if occ[lang, source][t] and mine[t] > whole[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "'x' AS term", "'x' AS n", "'x' AS tile", "'x' AS shard", "'x' AS v")


def test_against_brute_force_in_several_shards_and_tiles(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("Ab", "é", "日本", "zz", "q") for b in "abcdefghij"]
    rows = [(["en", "de", None][rng.integers(3)], f"s{rng.integers(9)}", " ".join(words[i] for i in rng.integers(0, 50, rng.integers(0, 30)) ** 2 // 50)) for _ in range(200)]
    rows += [("en", None, None), ("en", "", ""), ("it", "alone", "1 2 3"), ("pt", "a", "few few"), ("pt", "b", "few"), rows[0], rows[0]]
    rows.append(("de", "s1", "very long " * 200_000))
    want = brute(rows, 3, 4)
    for shard_terms, tile_sources in ((2048, 256), (5, 2)):
        got = [tuple(r) for r in sd.audit(frame(spark, rows), 3, 4, shard_terms, tile_sources).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_ties_go_by_the_bytes_of_the_item(spark):
    rows = [("en", s, t) for s, t in (("a", "é z b"), ("b", "x x x"), ("c", "x x x"), ("d", "x x x")) for _ in range(2)]
    got = {(r.source, r.part, r["rank"]): r.item for r in sd.audit(frame(spark, rows), 2, 3).collect()}
    assert [got["a", "term", k] for k in (1, 2, 3)] == ["b", "z", "é"]
    assert [got["a", "pair", k] for k in (1, 2, 3)] == ["b", "c", "d"]


def test_empty_table_and_languages_without_terms(spark):
    assert sd.audit(frame(spark, [("en", "a", "x")]).where("false")).count() == 0
    got = sorted(tuple(r) for r in sd.audit(frame(spark, [("en", "a", "x"), ("en", "b", None)])).collect())
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact_for_large_counts():
    counts, totals, terms = np.array([0, 7, 10**14, 999_999_999_999_999]), np.array([10**15 - 1] * 4), np.array([12_345_678] * 4)
    want = [1 + 10**9 * (c + 2) // (10**15 - 1 + 2 * 12_345_678) for c in counts.tolist()]
    assert sd.shares(counts, totals, terms).tolist() == want


def test_partial_counts_of_a_task_stay_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sd, "PARTIAL_ROWS", 10)
    monkeypatch.setattr(sd, "SLICE_BYTES", 40)
    batches = [pa.record_batch({"lang": ["en"] * 6, "source": ["a", "b"] * 3, "text": [" ".join(f"{'abcdefgh'[k]}{'xyz'[i % 3]}" for i in range(k + 1)) for k in range(6)]}) for _ in range(3)]
    out = pa.Table.from_batches(list(sd._partial(batches))).to_pylist()
    total = Counter()
    for r in out:
        total[r["source"], r["term"]] += r["n"]
    want = Counter((s, w) for b in batches for s, t in zip(b["source"].to_pylist(), b["text"].to_pylist()) for w in t.split())
    assert +total == want and len(out) > len(set(total))
