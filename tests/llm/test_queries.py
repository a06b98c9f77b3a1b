"""Queries of the package against SQL, or against plain Python where SQL cannot say them."""
import math
import re
import zlib
from collections import Counter

import pytest
from brute import similar

from check import compare
from check import duck as open_duck
from rosterlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    ok, message = compare(spark, open_duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, message


def test_only_these_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"op6_attention", "op8_minhash_forest", "op9_field_marginals"}


def test_similarity_join_against_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    links, tops = similar([t for _, t in docs])
    want = {(d, docs[top][0], n) for (d, _), top, n in zip(docs, tops, links)}
    assert {tuple(r) for r in QUERIES["op8_minhash_forest"](spark, SF).collect()} == want
    assert sum(links) > 0


def test_language_model_columns_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    split = {d: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))) + [None] for d, t in docs}
    out = {d for d, _ in docs if zlib.crc32(str(d).encode()) % 10 == 0}
    counts = Counter(w for d, ws in split.items() if d not in out for w in ws)
    n, v = sum(counts.values()), len(counts)
    better = 0
    for r in QUERIES["op6_attention"](spark, sf).collect():
        ws = split[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in out, len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
        better += r.score - r.base_score if r.held_out else 0
    assert better > 0


def test_language_model_columns_on_the_smaller_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    split = {d: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [None] for d, t in docs.items()}
    counts = Counter(w for d, ws in split.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = QUERIES["op6_attention"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ws = split[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_field_marginals"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == r.toxic for r in got) / len(got) >= 0.9
