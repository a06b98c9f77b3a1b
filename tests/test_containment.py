"""Containment against a plain loop, for both modes, odd keywords and a lexicon of a million."""
import random
import re

import ahocorasick

from rosterlake.operators.containment import contained_terms

TEXTS = ["Multimedia media, social-media! the media", "public works department of public workshops", "c++ and c#, c", "  two  spaces ", "tab\there", "ein Straßenname; été, ÉTÉ",
         "a.b.c ... d", "under_score under score", "日本語 test 日本", "x", "", None, "The CAT scattered", "it unit it's", "100% of 100", "\u0001odd\u0001 marks", "oil & gas & oil"]
KEYWORDS = ["media", "MEDIA,", "public works", "lic works dep", "works", "c++", "c", "+", "#", "  ", " ", "s  ", "\t", "stra", "été", "a.b", "..", "under", "under_score", "日本", "日本語 t", "x", "cat", "it", "it ",
            " it", "100", "0% o", "odd", "oil & gas", "& o", "zzz", "media zzz", "s of p", "", None, "e", "e ", "partment of public workshops"]


def edge(text, word, at):
    """Whether the occurrence at ``at`` keeps to the edges of words."""
    w = re.compile(r"\w")
    left = at > 0 and w.match(word[0]) and w.match(text[at - 1])
    end = at + len(word)
    right = end < len(text) and w.match(word[-1]) and w.match(text[end])
    return not left and not right


def brute(texts, keywords, boundary):
    out = []
    for i, t in enumerate(texts):
        for k in keywords:
            if t is not None and k:
                low, word = t.lower().replace("\u0001", " ") if boundary else t.lower(), k.lower()
                at = [m.start() for m in re.finditer(f"(?={re.escape(word)})", low)]
                if any(not boundary or edge(low, word, a) for a in at):
                    out.append((i, word))
    return sorted(out)


def test_both_modes_against_a_loop(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").selectExpr("*", "'x' AS row", "'x' AS token", "'x' AS keyword")
    lex = spark.createDataFrame([("c", k, 1.0) for k in KEYWORDS], "category string, keyword string, weight double")
    for boundary in (False, True):
        want = brute(TEXTS, KEYWORDS, boundary)
        for gram in (1, 3, 5):
            assert sorted((r.k, r.keyword) for r in contained_terms(texts, lex, "k", "t", gram, boundary).collect()) == want
    assert brute(TEXTS, KEYWORDS, False) != brute(TEXTS, KEYWORDS, True)
    assert contained_terms(texts.where("false"), lex, "k", "t").count() == 0


def test_a_text_is_marked_once_and_not_for_each_keyword(spark):
    texts, lex = spark.createDataFrame([(1, "oil & gas, oil"), (2, "oils & gas")], "k int, t string"), spark.createDataFrame([("c", "oil & gas", 1.0), ("c", "gas", 1.0)], "category string, keyword string, weight double")
    hits = contained_terms(texts, lex, "k", "t", boundary=True)
    assert "translate(_t" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.k, r.keyword) for r in hits.collect()) == [(1, "gas"), (1, "oil & gas"), (2, "gas")]


def test_pairs_of_text_and_keyword_are_not_shuffled(spark):
    texts = spark.createDataFrame([(i, f"the fathers, of other leathers {i % 7}x own-{i}") for i in range(300)], "k int, t string")
    lex = spark.createDataFrame([("c", k, 1.0) for k in ("the", "her", "e", "x", "s,", "own-1", "zz")], "category string, keyword string, weight double")
    hits = contained_terms(texts, lex, "k", "t")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "word#" in x]
    assert sorted((r.k, r.keyword) for r in hits.collect()) == brute([r.t for r in texts.sort("k").collect()], [r.keyword for r in lex.collect()], False)


def test_random_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab c-_") for _ in range(rng.randint(0, 25))) for _ in range(120)]
    words = ["".join(rng.choice("ab c-_") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    words = sorted(set(words))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    lex = spark.createDataFrame([("c", k, 1.0) for k in words], "category string, keyword string, weight double")
    for boundary in (False, True):
        assert sorted((r.k, r.keyword) for r in contained_terms(df, lex, "k", "t", 2, boundary).collect()) == brute(texts, words, boundary)


def test_a_million_keywords_in_one_scan(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rng = random.Random(7)
    texts = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    pool = [t for t in texts.values() if len(t) > 200]
    made = {f"made{i:x} word{i * 7919 % 104729:x}" for i in range(900_000)}
    for _ in range(100_000):
        t = rng.choice(pool)
        a = rng.randrange(len(t) - 30)
        made.add(t[a : a + rng.randint(6, 30)])
    (tmp_path / "words.txt").write_text("\n".join(sorted(w for w in made if "\n" not in w)))
    lex = spark.read.text(str(tmp_path / "words.txt")).selectExpr("'c' AS category", "value AS keyword", "CAST(1 AS DOUBLE) AS weight")
    machine, n = ahocorasick.Automaton(), 0
    for w in made:
        if "\n" not in w:
            machine.add_word(w, w)
            n += 1
    machine.make_automaton()
    want = {(d, w) for d, t in texts.items() for _, w in machine.iter(t)}
    got = contained_terms(docs, lex, "doc_id", "text")
    rows = [(r.doc_id, r.keyword) for r in got.collect()]
    assert n > 980_000 and len(rows) == len(set(rows)) and set(rows) == want and len(want) > 90_000
    assert "documents.parquet" not in got._jdf.queryExecution().toString()  # the given table is read once, before
