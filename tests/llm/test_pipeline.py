"""Each stage of the pipeline on its own input, against SQL or plain Python."""
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import similar

import corpus_pipeline
from rosterlake.llm import decontaminate, mixing, quality_rules, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    paths, docs = [f"{SF}/documents.parquet"], spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        paths.append(f"{base}/{k}/*.parquet")
    return paths


def test_quality(steps, duck):
    con = duck(documents=steps[0], after=steps[1])
    want = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.SQL}) WHERE kept").fetchall()}
    assert {r[0] for r in con.sql("SELECT doc_id FROM after").fetchall()} == want
    docs = con.sql("SELECT doc_id, source, text FROM documents").fetchall()
    fold = lambda line: re.sub("[ \t\r\x0b\x0c]+", " ", re.sub("[1-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line))).strip(" ")
    held, hosts = Counter(), Counter(s for _, s, _ in docs)
    for _, s, t in docs:
        held.update({(s, fold(x)) for x in (t or "").split("\n")})
    gone = {(s, x) for (s, x), n in held.items() if x and n > quality_rules.MIN_DOCUMENTS and n > quality_rules.MAX_SHARE * hosts[s]}
    text = {d: "\n".join(x for x in t.split("\n") if (s, fold(x)) not in gone) for d, s, t in docs if d in want}
    assert dict(con.sql("SELECT doc_id, text FROM after").fetchall()) == text


def test_near_duplicates(steps, duck):
    con = duck(before=steps[1], after=steps[2])
    docs = con.sql("SELECT doc_id, text FROM before ORDER BY doc_id").fetchall()
    _, tops = similar([t for _, t in docs])
    assert sorted(con.sql("SELECT doc_id, text FROM after").fetchall()) == [docs[i] for i in sorted(set(tops))]


def test_benchmark_free(steps, duck):
    con = duck(documents=steps[2], benchmark=f"{SF}/benchmark.parquet", after=steps[3])
    want = {r[0] for r in con.sql(f"SELECT doc_id FROM ({decontaminate.SQL}) WHERE NOT contaminated").fetchall()}
    assert {r[0] for r in con.sql("SELECT doc_id FROM after").fetchall()} == want


def test_mixture(steps, duck):
    con = duck(documents=steps[3], after=steps[4])
    assert sorted(con.sql("SELECT doc_id FROM after").fetchall()) == sorted(con.sql(f"SELECT doc_id FROM ({mixing.SQL})").fetchall())


def test_shards(steps, duck):
    con = duck(before=steps[4], after=steps[5])
    assert con.sql("SELECT count(*) FROM before").fetchall() == con.sql("SELECT count(*) FROM after").fetchall()
    assert con.sql("SELECT shard FROM after GROUP BY shard HAVING count(DISTINCT slot) <> count(*) OR max(slot) <> count(*) - 1").fetchall() == []
    assert con.sql("SELECT doc_id FROM after GROUP BY doc_id HAVING count(DISTINCT shard) > 1").fetchall() == []
    before, after = (con.sql(f"SELECT doc_id, source, text{c} FROM {n}").fetchall() for n, c in (("before", ""), ("after", ", shard, slot, size, text_crc32, grown_shard")))
    uses, want = Counter(), []
    for d, _, text in before:
        uses[d] += 1
        rid = hashlib.md5(f"={d}\x01={text}".encode()).hexdigest()
        order = int(hashlib.md5(f"{corpus_pipeline.SEED}:{uses[d]}:{rid}".encode()).hexdigest()[:15], 16)
        key = int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16)
        want.append((int(sharding.jump(np.array([key]), 16)[0]), uses[d], order, d, len(text.encode()) + 1, zlib.crc32(text.encode()), int(sharding.jump(np.array([key]), 17)[0])))
    slots, placed = Counter(), set()
    for shard, _, _, d, size, crc, grown in sorted(want):
        placed.add((d, shard, slots[shard], size, crc, grown))
        slots[shard] += 1
    assert {(d, s, slot, size, crc, g) for d, _, _, s, slot, size, crc, g in after} == placed and max(uses.values()) > 1
    near = [(s, slot) for d, _, _, s, slot, *_ in after for e, _, _, t, other, *_ in after if d == e and s == t and other == slot + 1 and slots[s] > 2]
    assert near == []  # no document follows itself
