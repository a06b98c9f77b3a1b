"""Properties that must hold whatever the data and however it is partitioned; hot keys; brute-force comparisons."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rosterlake.operators.containment import contained_terms
from rosterlake.operators import merge as M
from rosterlake.operators import pages as P
from rosterlake.operators import reports as R
from rosterlake.operators import scoring as S
from rosterlake.operators import selection as SEL
from rosterlake.operators import suppression as K
from rosterlake.plans.bindings import Tables
from rosterlake.sources import html as H
from rosterlake.streaming import tracking as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def plan_text(df):
    return df._jdf.queryExecution().toString()


def fold(times, gap):
    last, out = None, []
    for x in times:
        if last is None or x - last >= gap:
            out.append(x)
            last = x
    return out


@pytest.mark.parametrize("seed,span,n,long_run,chunk", [(1, 5000, 400, 10**6, 3600), (2, 5000, 400, 0, 60), (3, 20000, 700, 50, 300), (4, 900, 900, 0, 120), (5, 200000, 300, 0, 3600)])
def test_suppression_equals_sequential_fold(spark, seed, span, n, long_run, chunk):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows, want = [], []
    for key in ("hot", "b"):
        times = sorted(rnd.randrange(span * 1000) for _ in range(n if key == "hot" else 20))
        rows += [(len(rows) + i, "open", key, t0 + dt.timedelta(milliseconds=x)) for i, x in enumerate(times)]
        want += [(key, x) for x in fold(sorted(set(times)), 60000)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, tracking_id string, ts timestamp").repartition(5)
    got = K.suppress_repeats(df, long_run=long_run, chunk_seconds=chunk).join(df.select("event_id", "ts"), "event_id")
    got = [(r["tracking_id"], round((r["ts"] - t0).total_seconds() * 1000)) for r in got.collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("seed,span", [(1, 300), (2, 3000), (3, 60000)])
def test_rate_limit_equals_sequential_count(spark, seed, span):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice(["hot", "hot", "cold"]), t0 + dt.timedelta(milliseconds=rnd.randrange(span * 1000))) for i in range(500)]
    want, state = {}, {}
    for i, ip, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        count, last = state.get(ip, (0, None))
        count = 1 if last is not None and (ts - last) > dt.timedelta(seconds=60) else count + 1
        state[ip] = (count, ts)
        want[i] = count <= 20
    df = spark.createDataFrame(rows, "event_id long, ip_address string, ts timestamp")
    assert {r["event_id"]: r["allowed"] for r in K.rate_limit(df, limit=20).collect()} == want


def test_duplicate_roots_equal_brute_force(spark):
    rnd = random.Random(7)
    names = ["Acme", "Acme Water", "Acme Water Works", "Acm", "Beta", "beta", "Beta Co", "Gamma"]
    rows = [(i, rnd.choice(names), "water", rnd.choice(["UT", "NV"]), float(rnd.randrange(5))) for i in range(60)]
    best = {}
    for i, n, ty, st, rel in rows:
        same = [(-r[4], r[0]) for r in rows if (r[2], r[3]) == (ty, st) and (r[1].lower().startswith(n.lower()) or n.lower().startswith(r[1].lower()))]
        best[i] = min(same)[1]
    roots = {}
    for i in best:
        cur = i
        while best[cur] != cur:
            cur = best[cur]
        roots[i] = cur
    df = spark.createDataFrame(rows, "id long, name string, org_type string, state string, relevance_score double")
    assert {r["id"]: r["root_id"] for r in M.duplicate_roots(df).collect()} == roots
    assert {r["id"]: r["match_id"] for r in M.best_duplicate(df).collect()} == {i: b for i, b in best.items() if i != b}


def test_merge_is_idempotent_and_keeps_values(t):
    once = M.merge_duplicate_contacts(t.contacts).drop("merged_count")
    keys = once.filter("trim(email) <> ''").select(F.lower(F.trim("email")).alias("k"))
    assert keys.count() == keys.distinct().count()
    again = M.merge_duplicate_contacts(once).drop("merged_count")
    assert once.exceptAll(again).count() == 0
    before = t.contacts.filter("trim(email) <> '' AND trim(job_title) <> ''").select(F.lower(F.trim("email")).alias("k")).distinct()
    after = once.filter("trim(job_title) <> ''").select(F.lower(F.trim("email")).alias("k"))
    assert before.exceptAll(after.distinct()).filter("k IS NOT NULL").count() == 0


def test_merged_organizations_keep_all_contacts(t):
    roots = M.duplicate_roots(t.organizations)
    assert roots.alias("a").join(roots.alias("b"), F.col("a.root_id") == F.col("b.id")).filter("b.id <> b.root_id").count() == 0
    moved = M.move_contacts(t.contacts, roots.select(F.col("id").alias("old_id"), F.col("root_id").alias("new_id")))
    assert moved.count() == t.contacts.count()


def test_best_contact_is_one_per_organization_and_stable(t):
    a = SEL.best_contact_per_organization(t.contacts, t.organizations, None, 0.5)
    b = SEL.best_contact_per_organization(t.contacts.repartition(13), t.organizations.repartition(3), None, 0.5)
    assert a.count() == a.select("organization_id").distinct().count()
    assert a.exceptAll(b).count() == 0


def test_parts_sum_to_totals(t):
    n = t.organizations.count()
    assert R.count_by(t.organizations, "org_type").agg(F.sum("n")).head()[0] == n
    c = {r["link_type"]: r["links"] for r in R.click_statistics(t.shortened_urls).collect()}
    assert c.pop("(all)") == sum(c.values())


def test_limits_reach_below_the_shuffle(t):
    p = plan_text(SEL.top_pages(t.discovered_urls))
    assert p.count("WindowGroupLimit") >= 2
    assert "CartesianProduct" not in p


def test_filters_and_columns_reach_the_scan(t):
    df = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    p = plan_text(SEL.eligible_contacts(t.contacts, t.organizations).select("id"))
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan_text(df)
    assert "html" not in p and "o_totalprice" not in p.split("== Physical Plan ==")[1]


def test_no_query_forms_a_cross_product(spark):
    from rosterlake.plans import load_all
    from rosterlake.plans.registry import QUERIES

    load_all()
    lazy = [n for n in QUERIES if not any(x in n for x in ("stream", "m6_", "m7_", "p16", "p20", "p22", "j11"))]
    for n in lazy:
        p = plan_text(QUERIES[n](spark, SF))
        assert "CartesianProduct" not in p and "NestedLoopJoin" not in p, n


def test_large_lexicon_join_equals_literals(spark, t):
    lex = spark.createDataFrame([("a", w, 1.0) for w in ("the", "nd th", "e", "zz", "ention")], "category string, keyword string, weight double")
    a = contained_terms(t.documents, lex, "doc_id", "text")
    b = contained_terms(t.documents, lex, "doc_id", "text", gram=1)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 0


def test_website_scores_do_not_need_one_site_text(spark):
    pages = spark.createDataFrame([(1, "a water district"), (1, "our water  district and farm"), (2, "nothing")], "site long, text string")
    got = {(r["site"], r["category"]): r["score"] for r in S.website_category_scores(pages, "site", "text").collect()}
    assert got == {(1, "water"): 1.0, (1, "agriculture"): 1.0}


def test_containment_keeps_repeats_nulls_and_short_words(spark):
    texts = spark.createDataFrame([(1, "A an cat"), (1, "A an cat"), (None, "cat"), (2, None), (3, "")], "k long, t string")
    lex = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 1.0), ("y", "CAT", None), ("z", "", 2.0), ("z", None, 2.0)], "category string, keyword string, weight double")
    for gram in (1, 3):
        got = contained_terms(texts, lex, "k", "t", gram).collect()
        assert sorted((r.k or 0, r.category, r.weight or 0) for r in got) == sorted([(1, "x", 1.0)] * 4 + [(1, "y", 0)] * 2 + [(0, "x", 1.0)] * 2 + [(0, "y", 0)])
    assert contained_terms(texts, lex.where("false"), "k", "t").count() == 0


def test_json_ld_people_to_any_depth(spark):
    person = '{"@type": ["Person"], "name": "Ann Lee", "email": "a@x.org"}'
    deep = '{"@type": "Organization", "member": ' * 30 + person + "}" * 30
    page = f'<script type="application/ld+json">{deep}</script><script type="application/ld+json">not json</script><script type="application/ld+json">[{person}, {{"@type": "Person"}}]</script>'
    rows = spark.createDataFrame([(1, "u", page), (2, "u", "<p>none</p>"), (3, "u", None)], "page_id long, url string, html string")
    got = P.people_from_json_ld(rows).collect()
    assert [(r.page_id, r.first_name, r.last_name, r.email) for r in got] == [(1, "Ann", "Lee", "a@x.org")] * 2


def test_finds_with_bars_in_names_stay_apart(spark):
    stored = spark.createDataFrame([], "id long, organization_id long, first_name string, last_name string, job_title string, email string, phone string, contact_relevance_score double, notes string")
    found = spark.createDataFrame([(1, 7, "A|B", "C", None, None, None, False), (2, 7, "A", "B|C", None, None, None, False), (3, 7, "A", "B|C", None, None, None, False)],
                                  "seq long, organization_id long, first_name string, last_name string, job_title string, email string, phone string, is_decision_maker boolean")
    assert M.upsert_crawled_contacts(stored, found).count() == 2


@pytest.mark.parametrize("value", [None, ""])
def test_null_matrix(spark, value):
    cols = ["name", "description", "website_text", "website", "org_type", "state", "job_title", "city", "t", "industry"]
    df = spark.createDataFrame([tuple([value] * len(cols))], ", ".join(f"{c} string" for c in cols))
    assert S.organization_relevance(df).head()["relevance_score"] == 0.4
    assert S.data_quality(df).head()["data_quality_score"] == 0.0
    assert S.infrastructure_evidence(df, "t", "industry").head()["infrastructure_score"] == 0.0
    assert S.competitor_analysis(df, "t").head()["is_likely_competitor"] is False
    r = df.select(S.title_fit("job_title", "org_type").alias("a"), S.municipal_title_score("job_title").alias("b"),
                  S.title_department_score("job_title", "org_type").alias("c"), S.role_flags("job_title").alias("d"), S.type_multiplier("org_type").alias("e"),
                  S.title_rule_score("job_title", "org_type").alias("f"), S.engineering_subtype("name", "t").alias("g")).head()
    assert (r["a"], r["b"], r["c"], r["e"], r["f"], r["g"]) == (0.3, 5.0, 5.0, 0.7, None, "multidisciplinary") and not any(r["d"])


def test_stream_over_many_files_equals_batch(spark, t, tmp_path):
    e = t.tracking_events.orderBy("ts")
    pdf = e.toPandas()
    for i in range(4):
        part = spark.createDataFrame(pdf.iloc[i * len(pdf) // 4:(i + 1) * len(pdf) // 4], e.schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    closing = e.limit(1).withColumns({"ts": F.lit("2024-03-01").cast("timestamp_ntz"), "event_type": F.lit(ST.HEARTBEAT)})  # hits come out once the watermark has passed them
    closing.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ST.run_to_table(ST.suppress_repeats_stream(stream, seconds=3600), str(tmp_path / "k2")).select("event_id")
    want = K.suppress_repeats(t.tracking_events, seconds=3600).select("event_id")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_parse_keeps_text_once(spark):
    html = "<div>a<div>b<div>c</div></div></div><script>var x = '<p>no</p>';</script>"
    r = H.parse_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).head()
    assert r["text"] == "abc" and [e["tag"] for e in r["elements"]] == ["div", "div", "div"]


def test_finds_are_matched_once(spark):
    stored = spark.createDataFrame([(1, 10, "Ann", "Bee", None, "a@x.org", None, 1.0), (2, 10, "Cy", "", None, None, None, None)],
                                   "id long, organization_id long, first_name string, last_name string, job_title string, email string, phone string, contact_relevance_score double")
    found = spark.range(4).selectExpr("id AS seq", "CASE id WHEN 0 THEN 11L ELSE 10L END AS organization_id", "element_at(array('Ann', 'Cy', 'New', 'Ann'), CAST(id AS INT) + 1) AS first_name", "CAST(NULL AS STRING) AS last_name",
                                      "'Clerk' AS job_title", "CASE id WHEN 0 THEN ' A@X.org' WHEN 3 THEN 'a@x.org' END AS email", "CAST(NULL AS STRING) AS phone", "true AS is_decision_maker")
    matched = M.match_finds(stored, found)
    assert matched._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert sorted((r.seq, r.target_id, r.matched_by) for r in matched.collect()) == [(0, 1, "email"), (1, 2, "name"), (2, None, None), (3, 1, "email")]
    out = M.upsert_crawled_contacts(stored, found)
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()  # read where the matches were written
    assert sorted((r.id or 0, r.first_name, r.job_title, r.contact_relevance_score, r.notes) for r in out.collect()) == [
        (0, "New", "Clerk", 7.0, None), (1, "Ann", "Clerk", 7.0, "Also associated with organization ID: 11"), (2, "Cy", "Clerk", None, None)]
