"""Hand-made rows with the expected values of the published rules."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import content as C
from rosterlake.functions import people as N
from rosterlake.functions import urls as U
from rosterlake.functions.text import rows_of
from rosterlake.operators import engagement as E
from rosterlake.operators import merge as M
from rosterlake.operators import pages as P
from rosterlake.operators import scoring as S
from rosterlake.operators import selection as SEL
from rosterlake.operators import suppression as K
from rosterlake.sources import html as H


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column.alias("v")).head()["v"]


@pytest.mark.parametrize("full,first,last", [
    ("Dr. Ann B Lee", "Dr", "Lee"), ("Ann B Lee", "Ann", "Lee"), ("Ann Van Lee", "Ann", "Van Lee"), ("Ann", None, None), ("Al", None, None),
    ("", None, None), ("Zoë O'Neil-Smith", "Zoë", "O'Neil-Smith")])
def test_person_name(spark, full, first, last):
    v = one(spark, N.person_name("n"), n=full)
    assert (v and v["first"], v and v["last"]) == (first, last)


@pytest.mark.parametrize("name,expected", [("How to size a pump", True), ("12 best utilities", True), ("Acme Water District", False),
                                           ("Acme - YouTube", True), ("one two three four five six seven eight nine ten eleven", True)])
def test_webpage_title(spark, name, expected):
    assert one(spark, N.webpage_title("n"), n=name) is expected


def test_normalize_url(spark):
    assert one(spark, U.normalize_url("u"), u=" example.org/a/ ") == "https://example.org/a"


def test_salvage_json(spark):
    v = one(spark, C.json_records("t"), t='text [ {"name":"A"} ] more')
    assert v == [{"name": "A"}]
    assert one(spark, C.json_records("t"), t='{"name": "B"}') == [{"name": "B"}]
    assert not one(spark, C.json_records("t"), t="nothing")


def test_device(spark):
    v = one(spark, N.device("a"), a="Mozilla/5.0 (Linux; Android 13) Mobile Safari")
    assert (v["device_type"], v["os"]) == ("mobile", "Linux")


def test_name_from_email(spark):
    v = one(spark, N.name_from_email("e"), e="jane.doe@x.org")
    assert (v["first"], v["last"]) == ("Jane", "Doe")
    assert one(spark, N.name_from_email("e"), e="jdoe@x.org") is None


def test_best_category_default(spark):
    df = spark.createDataFrame([("", "", "")], "name string, description string, website_text string")
    v = S.category_scores(df).select(S.best_category("scores").alias("b")).head()["b"]
    assert (v["category"], v["confidence"]) == ("engineering", 0.3)


def test_category_score_weights_and_tokens(spark):
    df = spark.createDataFrame([("Farm Water District", "a farming hospital.", "farmland")], "name string, description string, website_text string")
    got = {r["category"]: r["score"] for r in S.category_scores(df).select(rows_of("scores").alias("s")).select("s.*").collect()}
    # name: farm, water district; description: farming, hospital; "farmland" is another token
    assert got == {"water": 5.0, "agriculture": 7.0, "healthcare": 2.0, "emergency": 0.0}


def test_data_quality(spark):
    df = spark.createDataFrame([("A", "water", "Utah", None, "", None)], "name string, org_type string, state string, website string, city string, description string")
    assert S.data_quality(df).head()["data_quality_score"] == 0.571429


@pytest.mark.parametrize("title,score", [("Director of Water Operations", 10.0), (None, 5.0), ("", 5.0), ("Poet", 5.0)])
def test_municipal_title(spark, title, score):
    assert one(spark, S.municipal_title_score("t"), t=title) == score


def test_competitor(spark):
    df = spark.createDataFrame([("An automation contractor with SCADA expertise",)], "t string")
    r = S.competitor_analysis(df, "t").head()
    assert (r["competitor_score"], r["is_likely_competitor"]) == (4.0, True)


def test_client_rank(spark):
    v = spark.range(1).select(S.client_rank(F.lit(5.0), F.lit(0.8), F.lit("water"), F.lit(False), F.lit(0.0)).alias("v")).head()["v"]
    assert v == 6.2


def test_opportunity(spark):
    ext = json.dumps({"infrastructure_indicators": {"infrastructure_matches": list("abcde"), "process_matches": list("wxyz")}})
    o = spark.createDataFrame([(1, 0.5, False, ext)], "id long, relevance_score double, is_competitor boolean, extended_data string")
    u = spark.createDataFrame([(1, True, None), (1, False, "broken")], "organization_id long, contains_infrastructure boolean, project_data string")
    r = S.opportunity_rerank(o, u).head()
    got = [round(r[c], 6) for c in ("infrastructure_score", "process_complexity_score", "automation_level", "integration_opportunity_score", "relevance_score")]
    assert got == [1.0, 0.5, 0.3, 0.76, 0.708]


def test_contact_confidence(spark):
    df = spark.createDataFrame([("Ann", "Lee", "Chief", "a@x", None, "website", 0.9)], "f string, l string, t string, e string, p string, m string, c double")
    assert df.select(S.contact_confidence("f", "l", "t", "e", "p", "m", "c").alias("v")).head()["v"] == 0.875


def test_engagement_score(spark):
    as_of = dt.datetime(2024, 1, 31)
    d = as_of - dt.timedelta(days=2)
    e = spark.createDataFrame([(1, 7, d, True, d, True, d, False, None, False, None)],
                              "id long, contact_id long, email_sent_date timestamp, email_opened boolean, email_opened_date timestamp, email_replied boolean, "
                              "email_replied_date timestamp, clicked_link boolean, clicked_link_date timestamp, converted boolean, conversion_date timestamp")
    r = E.engagement_scores(e, as_of).head()
    assert [r[c] for c in ("base_score", "recency_score", "frequency_score", "depth_score", "conversion_score", "engagement_score")] == [40, 81.0, 0.0, 100.0, 0.0, 47.3]


@pytest.mark.parametrize("url,name,state,valid", [
    ("https://www.springfieldwater.gov", "Springfield Water", "Utah", True), ("https://cityofmesa.org", "City of Mesa", "Arizona", True),
    ("https://www.facebook.com/mesa", "City of Mesa", "Arizona", False), ("https://news.example.com", "City of Mesa", None, False)])
def test_website_confidence(spark, url, name, state, valid):
    assert (one(spark, U.website_confidence("u", "n", "s"), u=url, n=name, s=state) >= 0.6) is valid


def hits(spark, seconds, key="a"):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "open", key, "10.0.0.1", t0 + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "event_id long, event_type string, tracking_id string, ip_address string, ts timestamp")


@pytest.mark.parametrize("long_run", [2_000_000, 0])
def test_suppression(spark, long_run):
    got = K.suppress_repeats(hits(spark, [0, 30, 59, 60, 90, 121]), long_run=long_run, chunk_seconds=60)
    assert sorted(r["event_id"] for r in got.collect()) == [0, 3, 5]


def test_rate_limit(spark):
    secs = [float(i) for i in range(52)] + [111.0, 171.000001]
    got = {r["event_id"]: r["allowed"] for r in K.rate_limit(hits(spark, secs)).collect()}
    assert [i for i, ok in got.items() if not ok] == [50, 51, 52] or sorted(i for i, ok in got.items() if not ok) == [50, 51, 52]


CONTACT = ("id long, organization_id long, first_name string, last_name string, job_title string, email string, phone string, date_added timestamp, "
           "contact_confidence_score double, contact_relevance_score double, notes string")


def contact(id, email, conf=0.5, first=None, last=None, title=None, phone=None, rel=5.0, org=1, notes=None):
    return (id, org, first, last, title, email, phone, dt.datetime(2024, 1, 1), conf, rel, notes)


def test_upsert_fills_blanks_only(spark):
    old = spark.createDataFrame([contact(1, "a@x", phone="1")], CONTACT)
    new = spark.createDataFrame([(9, 2, "Ann", "a@x", "2")], "seq long, organization_id long, first_name string, email string, phone string")
    r = M.upsert_contacts_by_email(old, new, F.current_timestamp()).collect()
    assert len(r) == 1 and (r[0]["first_name"], r[0]["phone"], r[0]["organization_id"]) == ("Ann", "1", 1)


def test_merge_duplicates(spark):
    df = spark.createDataFrame([contact(1, "A@x", 0.2, "Low", None, "T2", "p3"), contact(2, " a@x", 0.9, None, "Best"), contact(3, "a@x ", 0.5, "Mid", "M", "T5")], CONTACT)
    r = M.merge_duplicate_contacts(df).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["id"], r["first_name"], r["last_name"], r["job_title"], r["phone"], r["merged_count"]) == (2, "Mid", "Best", "T5", "p3", 2)
    lines = M.merge_note_lines(df)
    whole = M.attach_notes(M.merge_duplicate_contacts(df).drop("notes"), lines).head()
    assert whole["notes"].split("\n") == ["Merged with duplicate contact: Mid M", "Merged with duplicate contact: Low "]
    assert lines.count() == 2
    many = spark.range(1500).selectExpr("2L AS id", "id AS ord", "'line ' || id AS line")
    assert M.attach_notes(M.merge_duplicate_contacts(df).drop("notes"), many).head()["notes"].count("\n") == 1499


def test_distinct_contacts(spark):
    df = spark.createDataFrame([contact(1, "A@x", first="Ann", last="Lee", rel=5.0), contact(2, "a@x", first="Ann", last="Lee", rel=7.0),
                                contact(3, None, first="Ann", last="Lee")], CONTACT)
    assert sorted(r["id"] for r in SEL.distinct_contacts(df).collect()) == [2, 3]


def page(spark, html, url="https://town.gov/staff"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_json_ld_people(spark):
    person = '{"@type": "Person", "name": "%s", "jobTitle": "Mayor"}'
    html = '<script type="application/ld+json">{"@type": "Organization", "employee": [' + person % "Ann Lee" + "," + person % "Bo Ray" + "]}</script>"
    got = P.people_from_json_ld(page(spark, html)).orderBy("last_name").collect()
    assert [(r["first_name"], r["last_name"], r["confidence"]) for r in got] == [("Ann", "Lee", 0.95), ("Bo", "Ray", 0.95)]


def test_table_department_fallback(spark):
    html = "<table><tr><th>Name</th><th>Department</th><th>Phone</th></tr><tr><td>Ann Lee</td><td>Water</td><td>(555) 123-4567</td></tr></table>"
    r = P.people_from_tables(H.parse_pages(page(spark, html))).collect()
    assert [(x["first_name"], x["job_title"], x["phone"], x["confidence"]) for x in r] == [("Ann", "Water Staff", "(555) 123-4567", 0.85)]


def test_mailto_people(spark):
    html = '<p><a href="mailto:info@x.org">i</a></p><p><a href="mailto:jane.doe@x.org">mail</a></p>'
    r = P.people_from_mailto(H.parse_pages(page(spark, html))).collect()
    assert [(x["first_name"], x["last_name"], x["confidence"]) for x in r] == [("Jane", "Doe", 0.75)]


def test_unclosed_tags_do_not_break_the_parse(spark):
    html = '<div class="staff-card"><h3>Ann Lee<p><b>bold <div class="title">Mayor</div>'
    r = P.people_from_cards(H.parse_pages(page(spark, html))).collect()
    assert len(r) >= 1


def test_crawl_quota_per_host(spark):
    links = spark.createDataFrame([("http://a.org/", f"http://a.org/p{i}") for i in range(20)] + [("http://a.org/", "http://a.org/staff")], "src string, dst string")
    seeds = spark.createDataFrame([("http://a.org/",)], "url string")
    got = P.crawl_frontier(seeds, links, max_per_host=5).collect()
    assert len(got) == 5 and any(r["url"].endswith("/staff") for r in got)
