"""Files in and out."""
import datetime as dt
import json

from pyspark.sql import functions as F

from rosterlake.plans.bindings import Tables
from rosterlake.sources import lexicon as LX
from rosterlake.sources import tables as TB
from rosterlake.sources import tracking as TR

SF = "/root/testdata/sf0.001"


def test_tracking_log_round_trip(spark, tmp_path):
    e = Tables(spark, SF).tracking_events.withColumn("referrer", F.lit("r|with|bars"))
    TR.write_tracking(e, str(tmp_path / "log"))
    back = TR.read_tracking(spark, str(tmp_path / "log"))
    assert back.count() == e.count()
    cols = ["event_type", "tracking_id", "ip_address", "user_agent", "referrer"]
    assert back.select(F.col("ts").cast("string"), *cols).exceptAll(e.select(F.col("ts").cast("timestamp").cast("string"), *cols)).count() == 0


def test_settings(spark, tmp_path):
    a = tmp_path / "a.json"
    a.write_text(json.dumps({"water": "ana", "municipal": "ana", "engineering": "ben"}))
    rows = TB.read_assignments(spark, str(a)).orderBy("rank").collect()
    assert [(r["org_type"], r["assigned_to"]) for r in rows] == [("water", "ana"), ("municipal", "ana"), ("engineering", "ben")]
    h = tmp_path / "h.json"
    h.write_text(json.dumps({"org_confidence_hurdle": 1.5, "name_confidence_hurdle": 0.4}))
    assert TB.read_hurdles(spark, str(h)) == {"org_confidence_hurdle": 0.7, "name_confidence_hurdle": 0.4}


def test_csv_export_and_lexicon(spark, tmp_path):
    lex = LX.lexicon(spark, "category", {"water": ["Water District", "sewage"]})
    TB.export_csv(lex, str(tmp_path / "lex"))
    assert [tuple(r) for r in LX.read_lexicon(spark, str(tmp_path / "lex")).orderBy("rank").collect()] == [
        ("category", "water", "water district", 1.0, 0), ("category", "water", "sewage", 1.0, 1)]


def test_run_log(spark):
    t0 = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([(1, "x", t0, t0 + dt.timedelta(hours=1), "completed", 5, 2), (2, "x", t0, None, None, None, None)],
                                 "id long, process_type string, started_at timestamp, completed_at timestamp, status string, items_processed int, items_added int")
    log = TB.run_started(runs).unionByName(TB.run_finished(runs.filter("status IS NOT NULL"), "completed_at", ["items_processed"]))
    got = {r["id"]: (r["status"], r["completed_at"]) for r in TB.latest_runs(log).collect()}
    assert got == {1: ("completed", t0 + dt.timedelta(hours=1)), 2: ("running", None)}


def test_run_metrics_append(spark, tmp_path):
    m = TB.run_metrics(spark.range(1).select(F.lit(3).alias("urls_discovered")), dt.datetime(2024, 1, 1), 9)
    for _ in range(2):
        TB.append_table(m, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_bare_tags_are_read_without_the_general_parser(monkeypatch):
    from html.parser import HTMLParser
    from rosterlake.sources.html import _Elements
    seen = []
    general = HTMLParser.parse_starttag
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: seen.append(self.rawdata[i : i + 12]) or general(self, i))
    p = _Elements()
    p.feed("<TABLE><tr class='x'><td>a &amp; b</TD></tr></table><script><p>no</p></script><p>yes</p>")
    text, rows = p.done()
    assert [x[:4] for x in seen] == ["<tr ", "<scr"]
    assert text == "a & byes" and [(r["tag"], r["parent"], r["last"]) for r in rows] == [("table", -1, 2), ("tr", 0, 2), ("td", 1, 2), ("p", -1, 3)]
