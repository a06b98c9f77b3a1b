"""NULLs, empty and long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""
import gzip
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rosterlake.llm import decontaminate, license_scans, lm_scoring, mixing, ngram_join, quality_rules, sharding, toxicity, url_filters, warc
from rosterlake.llm.common import components


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(f"line3 word{i}" for i in range(12))), (2, "ONE"), (3, None), (4, ""), (None, "two")], "item_id long, text string")


def test_quality_rules(edge_docs, empty_docs):
    got = by_id(quality_rules.judge(edge_docs))
    assert sum(map(len, got.values())) == 12 and len(got[5]) == 2
    assert got[1][0].n_words == 0 and got[1][0].base_failed and not got[2][0].kept
    assert got[5][0].n_words == 144 and got[5][0].kept and got[5][0].n_repeat_words == 0
    assert got[7][0].n_words == 3  # a no-break space is part of a word
    assert quality_rules.judge(empty_docs).count() == 0
    kept = quality_rules.clean(edge_docs)
    assert kept.columns == edge_docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, None} and kept.count() == 5
    assert quality_rules.clean(empty_docs).count() == 0


def test_common_lines_go_and_copies_count_each(spark):
    shared = "please subscribe to our list"
    body = [" ".join(f"doc{'q' * d}word{i}" for i in range(60)) for d in range(40)]  # digits are all one to a line
    rows = [(d, f"{b}\n{shared.upper() if d % 2 else shared}\n{'x' * d} tail", "h") for d, b in enumerate(body)]
    rows += [(100 + d, "\n".join(" ".join(f"copy{k}w{i}" for i in range(20)) for k in range(4)) + f"\nend {d}", "h") for d in range(60)]
    rows += [(300, shared + "\n" + " ".join(f"z{i}" for i in range(60)), "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(quality_rules.judge(docs, max_share=0.0))
    assert all(got[d][0].n_words_removed == 5 and got[d][0].kept for d in range(40))
    assert got[115][0].n_words_removed == got[115][0].n_words == 82 and not got[115][0].kept and got[300][0].n_words_removed == 0  # 60 documents hold each of the four lines, and "end 00" 50
    assert got[100][0].n_words_removed == 80  # "end 0" is in ten documents only
    texts = {r.doc_id: r.text for r in quality_rules.clean(docs, max_share=0.0).collect()}
    assert texts[1] == f"{body[1]}\nx tail" and len(texts) == 41
    ones = spark.createDataFrame([(d, "page not found " + "again " * 60, "h") for d in range(60)], "doc_id long, text string, source string")
    assert all(r.n_words_removed == r.n_words for r in quality_rules.judge(ones, max_share=0.0).collect())
    assert all(r.n_words_removed == 0 for r in quality_rules.judge(ones.where("doc_id < 20"), max_share=0.0).collect())
    depleted = spark.createDataFrame([(d, (shared + "\n") * 20 + " ".join(f"d{d}w{i}" for i in range(60)), "h") for d in range(30)], "doc_id long, text string, source string")
    assert not any(r.kept for r in quality_rules.judge(depleted, max_share=0.0).collect())


def test_lines_go_from_documents_that_share_a_second_line(spark):
    first, second = sorted((f"{a} shared line {b}" for a in "abcdefghij" for b in "abcdefghij"), key=lambda x: quality_rules.line_table(x.encode())[0]["h"])[:2]
    body = [" ".join(f"{'abcdefgh'[d % 8]}{'klmno'[d // 8]}word{'x' * i}" for i in range(60)) for d in range(40)]
    docs = spark.createDataFrame([(d, f"{first}\n{b}\n{second}", "h") for d, b in enumerate(body)], "doc_id long, text string, source string")
    assert {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, "").collect()} == dict(enumerate(body))


def test_url_rules_and_templates(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/en/1"), (4, "https://WWW.Example.com/en/12?x#y"), (5, "http://a.example.com/en/12"), (6, "http://b.net/es/7"), (7, "http://b.net/es"),
            (8, "http://shop.com"), (9, "http://shop.com/"), (9, "http://shop.com/"), (10, "http://netx/es/1"), (11, "a://b://c/d")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rid", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("www.example.com", "/en/12", "www.example.com/en/", "allow"),
                   5: ("a.example.com", "/en/12", "example.com/en/", "block"), 6: ("b.net", "/es/7", "net/es/", "block"), 7: ("b.net", "/es", None, "allow"), 8: ("shop.com", "", None, "allow"),
                   9: ("shop.com", "/", "com/", "allow"), 10: ("netx", "/es/1", None, "allow"), 11: ("b:", "//c/d", None, "allow")}
    assert url_filters.judge(pages).count() == len(rows) and url_filters.judge(pages.where("false")).count() == 0
    labelled = [(i, f"http://s.org/spam/{i}", True) for i in range(20)] + [(100 + i, f"http://s.org/news/{i}.html", False) for i in range(20)]
    labelled += [(200, "http://s.org/spam/x77", None), (201, "http://s.org/news/99.html", None), (202, "http://s.org/else/1", None), (203, "http://t.org/spam/1", None)]
    pages = spark.createDataFrame(labelled, "page_id long, url string, is_bad boolean")
    got = {r.page_id: r.verdict for r in url_filters.judge(pages, [], F.col("is_bad")).collect()}
    assert [got[i] for i in (0, 100, 200, 201, 202, 203)] == ["block", "allow", "block", "allow", "allow", "allow"]


def test_neighbouring_spellings_and_every_known_text(spark):
    rows = [(k, text, key) for k, (key, (_, text)) in enumerate(license_scans.LICENSES.items())] + [(100, "Whilst whilst whilst", None), (101, "while WHILE while", None)]
    got = {r.doc_id: r for r in license_scans.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert all(got[k].license == key for k, _, key in rows) and got[100].digest == got[101].digest and got[100].n_words == 3


def test_license_forms(spark, edge_docs, empty_docs):
    title, text = license_scans.LICENSES["MIT"]
    rows = [(1, text), (2, f"{title}\n\nCopyright (c) 2020 Some Body\n\n{text.upper()}"), (3, text.replace("sublicense", "sub-license").replace('"', "'").replace("\n\n", "\n * ")),
            (4, text + " extra"), (5, "Released under the MIT Licence."), (6, None), (7, "..."), (8, "(c) 2021 A\nAll rights reserved.")]
    got = {r.doc_id: r.license for r in license_scans.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: "MIT-reference", 6: None, 7: None, 8: None}
    assert license_scans.scan(edge_docs).count() == 12 and license_scans.scan(empty_docs).count() == 0


def test_decontamination(edge_docs, empty_docs, items):
    got = by_id(decontaminate.report(edge_docs, items))
    assert sum(map(len, got.values())) == 12
    assert all(r.n_hit == 24 and r.n_items == 1 for r in got[5] + got[6]) and sorted(r.n_hit for r in got[None]) == [0, 24]
    assert sorted((r.n_hit, r.n_items) for r in got[8]) == [(1, 1), (1, 1)] and not got[1][0].contaminated and got[4][0].n_hit == 0
    assert decontaminate.report(empty_docs, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(edge_docs, items.where("false")).collect())
    left = decontaminate.drop_contaminated(edge_docs, items)
    assert left.columns == edge_docs.columns and left.count() == 6


def test_sharding(edge_docs, empty_docs):
    got = sharding.assign(edge_docs, n_shards=3, rows_per_block=1).collect()
    assert len(got) == 12 and all(r.grown_shard in (r.shard, 3) for r in got)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r["size"] for r in got if r.text is None or r.text == ""} == {1} and sharding.assign(empty_docs).count() == 0
    keys = np.random.default_rng(1).integers(0, 1 << 60, 20_000)
    a, b = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(b[a != b]) == {16} and abs((a != b).mean() - 1 / 17) < 0.01 and np.bincount(a).min() > 1000


def test_mixing(spark, edge_docs, empty_docs):
    mixed = mixing.mix(edge_docs)
    assert mixed.columns == edge_docs.columns and mixing.mix(empty_docs).count() == 0
    assert {(r.doc_id, r.text) for r in mixed.collect()} == {(r.doc_id, r.text) for r in edge_docs.collect()}
    shares = spark.createDataFrame([(1000,), (100,), (100,), (0,)], "t long")
    assert mixing.exponent(shares, 1.0) == 1.0 and mixing.exponent(shares, 10.1) == 0.0
    a = mixing.exponent(shares, 2.0)
    assert 10 ** (1 - a) <= 2 < 10 ** (1 - a + 2e-6)
    weights = np.array([1000, 100, 100.0]) / 1200
    e = mixing.exponent(shares, None, 0.9)
    w = weights**e / (weights**e).sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9, abs=1e-4)
    docs = spark.createDataFrame([(i, "a b c d", "big" if i < 900 else "small") for i in range(1000)], "doc_id long, text string, source string")
    whole = mixing.realise(docs, rows_per_block=50)
    assert sorted(map(str, whole.collect())) == sorted(map(str, mixing.realise(docs, rows_per_block=100_000).collect()))
    uses = {r["source_key"]: r["n"] for r in whole.groupBy("source_key").agg(F.sum("n_tokens").alias("n")).collect()}
    assert uses["=big"] == 3600 and 796 < uses["=small"] <= 800
    spent = mixing.realise(docs, max_epochs=3.0, budget=2000.0).agg(F.sum("n_tokens")).first()[0]
    assert 1990 <= spent <= 2000


def test_similarity_classes(spark, edge_docs, empty_docs):
    got = by_id(ngram_join.join(edge_docs))
    assert sum(map(len, got.values())) == 12 and ngram_join.join(empty_docs).count() == 0
    assert all(r.n_links == 3 for r in got[5] + got[6]) and sorted(r.n_links for r in got[None]) == [0, 3]
    assert got[1][0].root is None and got[2][0].root is None
    kept = ngram_join.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 7, 8, 8] and kept.count() == 9


def test_large_near_copy_group_is_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    texts = []
    for d in range(90):
        words = list(base)
        for j in rng.choice(200, 3, replace=False):
            words[j] = f"new{d}x{j}"
        texts.append(" ".join(words))
    from brute import similar

    links, tops = similar(texts)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    got = by_id(ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[d][0].n_links for d in range(90)] == links and 0 < sum(links) < 90 * 89
    roots = {}
    for d in range(90):
        roots.setdefault(got[d][0].root or d, set()).add(tops[d])
    assert all(len(x) == 1 for x in roots.values()) and len(roots) == len(set(tops))


def test_borderline_pairs_are_found_beside_a_large_copy_group(spark):
    rng = np.random.default_rng(8)
    text = lambda d, n, changed, mark: " ".join(f"{mark}{j}" if j in changed else f"d{d}w{j}" for j in range(n))
    rows = [(d, text("group", 400, {int(rng.integers(400))}, f"g{d}x")) for d in range(1500)]
    for d in range(200):  # similarity 0.80 to 0.83
        rows += [(2000 + 2 * d, text(d, 188 + d % 25, (), "")), (2001 + 2 * d, text(d, 188 + d % 25, {30, 70, 110, 150}, "n"))]
    sk = ngram_join.sketches(spark.createDataFrame(rows, "doc_id long, text string")).localCheckpoint()
    of = {bytes(r.node): r.doc_id // 2 for r in sk.where("doc_id >= 2000").collect()}
    edges = ngram_join.forest_edges(sk.select("node", "mins").dropDuplicates(["node"]), ngram_join.THRESHOLD, ngram_join.TARGET_RECALL).collect()
    found = {of[bytes(r.a)] for r in edges if bytes(r.a) in of and of[bytes(r.a)] == of.get(bytes(r.b))}
    assert len(found) >= 199  # 0.04 pairs are lost on average


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
    assert components(edges.where("false")).count() == 0


def test_language_model_edges(edge_docs, empty_docs):
    got = by_id(lm_scoring.score(edge_docs))
    assert sum(map(len, got.values())) == 12 and lm_scoring.score(empty_docs).count() == 0
    assert got[1][0].n_tokens == 1 and got[1][0].score == got[2][0].score == got[3][0].score and all(math.isfinite(r.score) for x in got.values() for r in x)
    assert got[5][0].score == pytest.approx(got[5][1].score) and got[4][0].n_tokens == 60_001


def test_attention_windows_score_every_token_once():
    ranks = lm_scoring.ranks_of(lm_scoring.TOKENIZER)
    counts = np.random.default_rng(0).integers(0, 100, len(ranks))
    model = lm_scoring.Attention(counts, 10, ranks)
    texts = [np.array(x, np.uint16) for x in ([], [5], list(range(300, 316)), list(range(1000, 1071)))]
    model.follow({5 << 16 | 300: 7})
    model.train(texts)
    p = {k: v.copy() for k, v in model.p.items()}
    model.fold()
    gain, begins = model.next_logs(texts)
    at = 0
    for ids in texts:
        line = [lm_scoring.BEGIN] * (lm_scoring.CONTEXT + 1) + [int(model.vector[i]) for i in ids]
        for j, target in enumerate([*ids.tolist(), len(model.vector) - 1]):
            start = j // lm_scoring.BLOCK * lm_scoring.BLOCK
            seen = line[start : j + lm_scoring.CONTEXT + 1]
            x = p["e"][seen]
            s = x @ p["k"] @ (x[-1] @ p["q"]) / np.sqrt(lm_scoring.WIDTH) + p["near"][np.arange(len(seen))[::-1]]
            a = np.exp(s) / np.exp(s).sum()
            z = np.maximum(a @ (x @ p["v"]) + x[-1] @ p["u"], 0) @ p["o"] + p["b"]
            q = np.exp(z) / np.exp(z).sum()
            assert gain[at] == pytest.approx(np.log(q[model.group[target]]), abs=1e-3)
            assert begins[at] == pytest.approx(np.log(q[model.opens].sum()), abs=1e-3)
            at += 1
    assert at == len(gain)


def test_member_logs_come_from_all_pairs_of_a_large_corpus(spark):
    words = spark.createDataFrame([("the", 3_000_000_000), ("unbelievable", 2000), ("xylographically", 1500), ("unbelievably", 0), ("zzqqxx", 0)], "word string, c long")
    coded = lm_scoring.coded_words(words, lm_scoring.TOKENIZER).localCheckpoint()
    pairs = lm_scoring.pair_counts(coded).localCheckpoint()
    model = lm_scoring.Attention(lm_scoring.subword_counts(coded, pairs, lm_scoring.TOKENIZER), 10, lm_scoring.ranks_of(lm_scoring.TOKENIZER))
    encoder = lm_scoring.Subwords(lm_scoring.TOKENIZER).encoder
    ids = {r.word: encoder.encode_ordinary(" " + r.word) for r in words.collect()}
    exact: dict = {}
    for r in words.collect():
        for a, b in zip(ids[r.word], ids[r.word][1:]):
            exact[a << 16 | b] = exact.get(a << 16 | b, 0) + r.c
    assert {r["key"]: r["c"] for r in pairs.collect()} == exact and len(exact) > 3
    model.follow(exact)
    got = {r["word"]: r["member"] for r in lm_scoring.member_table(coded, pairs, model).collect()}
    assert got == {w: pytest.approx(model.member_logs(x)) for w, x in ids.items()}


def test_attention_sees_sixteen_tokens_before_a_window_and_has_own_classes():
    ranks = lm_scoring.ranks_of(lm_scoring.TOKENIZER)
    counts = np.random.default_rng(0).permutation(len(ranks)) + 1
    model = lm_scoring.Attention(counts, 10, ranks)
    top = np.argsort(-counts)[:63]
    assert model.within[top] == pytest.approx(1) and model.p["o"].shape[1] == 128 and model.opens.size == 128
    model.fold()
    text = np.arange(300, 332)
    other = text.copy()
    other[0] = int(top[0])
    first, second = model.next_logs([text])[0], model.next_logs([other])[0]
    assert first[16] != second[16]  # the first subword of the second window, sixteen places later
    assert (first[17:] == second[17:]).any()


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "http://a/ü\r\nX: y", ""), (None, "n", big), (5, "u", "small"), (6, "u", "small"), (2, "again", big), (None, "m", "z" * 1000), (None, "m", "z" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("file", F.lit(1))
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_records(index, with_payload=True).collect()
    assert len(got) == len(rows) and sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == sorted([
        (1, "revisit", 2), (2, "response", 0), (2, "response", 0), (3, "response", 0), (4, "response", 0), (0, "revisit", 2), (5, "response", 0), (6, "response", 0), (0, "response", 0), (0, "response", 0)])
    assert all(r.payload_bytes == 1200 for r in got if r.page_id in (1, 2)) and {r.payload.decode() for r in got if r.page_id == 2} == {big}
    some = warc.read_records(index.where("page_id IN (5, 1)"), with_payload=True).collect()
    assert sorted((r.page_id, r.payload and bytes(r.payload)) for r in some) == [(1, None), (5, b"small")]
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz"))
    assert raw.count(b"WARC/1.1\r\n") == len(rows)
    assert warc.read_records(warc.write_archives(pages.where("false"), f"file://{tmp_path}/e")).count() == 0


def test_reads_are_cut_and_coalesced(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 2000)
    rng = np.random.default_rng(3)
    pages = spark.createDataFrame([(i, f"http://h/{i}", "".join(map(chr, rng.integers(97, 123, 900)))) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    want = {r.page_id: r.html for r in pages.collect()}
    got = warc.read_records(warc.write_archives(pages, f"file://{tmp_path}/w"), with_payload=True).collect()
    assert {r.page_id: r.payload.decode() for r in got} == want and len(got) == 60


def test_toxicity_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(4, 0), (5, 1), (5, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(edge_docs, toxicity.train(edge_docs, labels)).collect()} == {0.0}
    rng = np.random.default_rng(4)
    word = lambda: "".join(map(chr, rng.integers(97, 107, 6)))
    vocabulary = [word() for _ in range(400)]
    rows = []
    for d in range(600):
        words = [vocabulary[i] for i in rng.integers(0, 400, 40)]
        if d % 3 == 0:
            words[5:7] = ["nasty", "Blockhead"]
        rows.append((d, " ".join(words) + ".", int(d % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    assert all((got[d].score >= 0.5) == bool(y) for d, _, y in rows)
    s = got[0].spans[0]
    assert rows[0][1][s.start : s.end] == "nasty Blockhead"
    edge = by_id(toxicity.score(edge_docs, model))
    assert edge[1][0].score == edge[2][0].score < 0.5 and sum(map(len, edge.values())) == 12 and toxicity.score(empty_docs, model).count() == 0


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(6)
    x, n, trans, begin = rng.uniform(0.1, 3, (3, 5)), np.array([5, 3, 1]), rng.uniform(0.2, 2, (2, 2)), 0.7
    p, _, _ = toxicity.forward_backward(x, n, trans, begin)
    for r in range(3):
        weight, toxic = 0.0, np.zeros(n[r])
        for path in np.ndindex(*[2] * n[r]):
            w = (begin if path[0] else 1) * np.prod([x[r, t] for t in range(n[r]) if path[t]]) * np.prod([trans[a, b] for a, b in zip(path, path[1:])])
            weight += w
            toxic += w * np.array(path)
        assert p[r, : n[r]] == pytest.approx(toxic / weight)


def test_pipeline_edges(spark, edge_docs, empty_docs, tmp_path):
    items = spark.createDataFrame([(1, "unheard of words " * 5)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (edge_docs, empty_docs):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{start is edge_docs}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{start is edge_docs}-{k}")
            if name != "shards":
                assert docs.columns == edge_docs.columns
        assert {r.doc_id for r in docs.collect()} == ({4, 5} if start is edge_docs else set())


def test_class_ids_are_unique(spark):
    found = spark.createDataFrame([(b"a", 5), (b"a", 7), (b"b", 5), (b"c", None), (b"c", None), (b"d", None)], "root binary, doc_id long")
    got = {bytes(r.root): r.class_id for r in ngram_join.class_ids(found).collect()}
    assert got[b"a"] == 5 and len(set(got.values())) == 4 and all(got[x] < 0 for x in (b"b", b"c", b"d"))


def test_attention_learns_from_every_training_text(spark):
    """One text more among those after the start texts, its words known already in their counts, moves the weights."""
    ranks = lm_scoring.ranks_of(lm_scoring.TOKENIZER)
    counts = np.random.default_rng(0).integers(0, 100, len(ranks))
    learned = [" ".join(f"word{(i * j) % 37}" for j in range(1, 60)) for i in range(30)]
    got = []
    for texts in (learned, [*learned[:-1], " ".join(learned[-1].split()[::-1])], []):
        model = lm_scoring.Attention(counts, 30, ranks)
        before = {k: x.copy() for k, x in model.p.items()}
        lm_scoring.go_on(model, spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), lm_scoring.TOKENIZER)
        got.append({k: np.abs(x - before[k]).max() for k, x in model.p.items()} | {"weights": np.concatenate([x.ravel() for x in model.p.values()])})
    assert all(got[0][k] > 0 for k in ("e", "q", "k", "v", "u", "o", "b", "near")) and (got[0]["weights"] != got[1]["weights"]).any()
    assert all(got[2][k] == 0 for k in ("e", "q", "k", "v", "u", "o", "b", "near"))


def test_weights_of_tasks_are_averaged_by_their_windows(spark):
    ranks = lm_scoring.ranks_of(lm_scoring.TOKENIZER)
    counts = np.random.default_rng(0).integers(0, 100, len(ranks))
    texts = [" ".join(f"a{(i * j) % 41}" for j in range(1, 30 + 40 * i)) for i in range(4)]
    subwords, parts = lm_scoring.Subwords(lm_scoring.TOKENIZER), []
    for t in texts:
        alone = lm_scoring.Attention(counts, 4, ranks)
        logs = np.zeros((2, lm_scoring.CLASSES))
        parts.append((alone.go_on(lm_scoring.ids_of(subwords, [t]), np.random.default_rng(17), logs), alone.p, logs))
    model = lm_scoring.Attention(counts, 4, ranks)
    lm_scoring.go_on(model, spark.createDataFrame(spark.sparkContext.parallelize([(t,) for t in texts], 4), "text string"), lm_scoring.TOKENIZER)
    n = sum(w for w, _, _ in parts)
    for k, x in model.p.items():
        assert x == pytest.approx(sum(w * p[k] for w, p, _ in parts) / n, abs=1e-6)
    number, logs = sum(x for _, _, x in parts)
    assert model.means[number > 0] == pytest.approx((logs / np.maximum(number, 1))[number > 0])


def test_gradients_are_the_slopes_of_the_cross_entropy():
    ranks = lm_scoring.ranks_of(lm_scoring.TOKENIZER)
    counts = np.random.default_rng(0).integers(0, 100, len(ranks))
    model, rng = lm_scoring.Attention(counts, 10, ranks), np.random.default_rng(1)
    model.p = {k: x.astype(np.float64) + 0.3 * rng.standard_normal(x.shape) for k, x in model.p.items()}
    seen, want, _ = model.windows([rng.integers(0, 3000, n) for n in (0, 5, 15, 16, 70)])
    g, group, gain = model.gradients(seen, want)
    assert len(group) == len(gain) == 5 + 106 and len(seen) == 1 + 1 + 1 + 2 + 5
    used = int(seen[-1, 20])
    for k, at in [("e", (used, 3)), ("q", (2, 5)), ("k", (1, 7)), ("v", (4, 4)), ("u", (6, 2)), ("o", (3, int(group[7]))), ("b", int(group[9])), ("near", 2)]:
        kept, side = model.p[k][at], []
        for step in (1e-4, -1e-4):
            model.p[k][at] = kept + step
            side.append(-model.gradients(seen, want)[2].sum())
        model.p[k][at] = kept
        assert g[k][at] == pytest.approx((side[0] - side[1]) / 2e-4, rel=2e-2, abs=2e-3), k


def test_gate_comes_from_all_words(spark):
    ranks = lm_scoring.ranks_of(lm_scoring.TOKENIZER)
    model = lm_scoring.Attention(np.ones(len(ranks), np.int64), 50, ranks)
    rng = np.random.default_rng(5)
    words = [(f"w{i}", int(rng.integers(0, 40)), -float(rng.uniform(1, 9)), -float(rng.uniform(1, 9))) for i in range(3000)]
    total = sum(c for _, c, _, _ in words) + 50
    got = lm_scoring.gate_of(spark.createDataFrame(words, "word string, c long, member double, mean double"), model, total, 50)
    ahead = [(math.log((c - 1) / total) - m - n if c > 1 else -math.inf, c) for _, c, m, n in words if c] + [(math.log(50 / total) - model.means[lm_scoring.OWN_CLASSES - 1], 50)]
    gate = 0.5
    for _ in range(30):
        gate = sum(c * gate * math.exp(d) / (gate * math.exp(d) + 1 - gate) for d, c in ahead) / total
    assert got == pytest.approx(gate, abs=0.005) and 0.05 < gate < 0.95


def test_words_encoded_together_have_the_subwords_of_each():
    wide = [chr(i) for i in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    words = ["".join(x) for n in (1, 2, 3) for x in itertools.product(["a", "1", "'", "é", "中", "\xa0", "\u3000"], repeat=n)]
    words += [*wide, *(s + "x" for s in wide), *("x" + s for s in wide), "don't", "it's,", "\x1ca", "\x00", "\u200b", "😀😀", "unbelievable", "x" * 3000, "a"]
    subwords, rng = lm_scoring.Subwords(lm_scoring.TOKENIZER, {"don't": 0, "é": 1}, np.array([7, 9]), np.array([-1.5, -2.5])), np.random.default_rng(0)
    for _ in range(3):
        mixed = [words[i] for i in rng.permutation(len(words))]
        exact = [subwords.encoder.encode_ordinary(" " + w) for w in mixed]
        ids, size = subwords.encode(mixed)
        assert size.tolist() == list(map(len, exact)) and ids.tolist() == list(itertools.chain.from_iterable(exact))
    ids, size, member, count = subwords.encode_all(pa.array(["é", "z", "don't", "é"]))
    assert ids.tolist() == [i for w in ("é", "z", "don't", "é") for i in subwords.encoder.encode_ordinary(" " + w)] and len(size) == 4
    assert member.tolist() == [-2.5, 0, -1.5, -2.5] and count.tolist() == [9, 0, 7, 9]
    assert [len(x) for x in subwords.encode([])] == [0, 0] and [len(x) for x in lm_scoring.ids_of(subwords, ["", "a"])] == [0, 1]


def test_attention_bounds_no_logs_where_exponents_overflow():
    ranks = lm_scoring.ranks_of(lm_scoring.TOKENIZER)
    counts, rng = np.random.default_rng(0).integers(0, 100, len(ranks)), np.random.default_rng(2)
    model = lm_scoring.Attention(counts, 10, ranks)
    model.p |= {k: (rng.standard_normal(model.p[k].shape) * s).astype(np.float32) for k, s in (("e", 2), ("q", 2), ("k", 2), ("o", 4))}
    texts = [rng.integers(0, 3000, 40).astype(np.int32)]
    p = {k: x.astype(np.float64) for k, x in model.p.items()}
    line, logs, highest = [lm_scoring.BEGIN] * (lm_scoring.CONTEXT + 1) + [int(model.vector[i]) for i in texts[0]], [], []
    for j, target in enumerate([*texts[0].tolist(), len(model.vector) - 1]):
        x = p["e"][line[j // lm_scoring.BLOCK * lm_scoring.BLOCK : j + lm_scoring.CONTEXT + 1]]
        s = x @ p["k"] @ (x[-1] @ p["q"]) / np.sqrt(lm_scoring.WIDTH) + p["near"][np.arange(len(x))[::-1]]
        a = np.exp(s - s.max())
        z = np.maximum(a / a.sum() @ (x @ p["v"]) + x[-1] @ p["u"], 0) @ p["o"] + p["b"]
        logs.append(z[model.group[target]] - z.max() - np.log(np.exp(z - z.max()).sum()))
        highest.append(s.max())
    assert max(highest) > 100
    seen, want, _ = model.windows(texts)
    g, _, gain = model.gradients(seen, want)
    assert gain == pytest.approx(logs, rel=1e-3, abs=1e-2) and all(np.isfinite(x).all() for x in g.values())
    model.fold()
    assert model.next_logs(texts)[0] == pytest.approx(logs, rel=1e-3, abs=1e-2)
