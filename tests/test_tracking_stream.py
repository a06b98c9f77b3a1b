"""Judging hits in time order whatever order they come in, and the rows a batch of hits changes."""
import datetime as dt
from types import SimpleNamespace

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlake.streaming import tracking as ST

T0 = 1_700_000_000


class Value(dict):
    exists = lambda self: "v" in self
    get = lambda self: self["v"]
    update = lambda self, v: self.__setitem__("v", v)
    clear = lambda self: self.pop("v", None)


class Slots(dict):
    containsKey = lambda self, k: k in self
    getValue = lambda self, k: self[k]
    updateValue = lambda self, k, v: self.__setitem__(k, v)
    removeKey = lambda self, k: self.pop(k)
    keys = lambda self: iter(list(dict.keys(self)))


class Handle:
    """State of one key in memory."""

    def __init__(self):
        self.timers, self.waiting, self.values = set(), Slots(), {}

    def getMapState(self, *_):
        return self.waiting

    def getValueState(self, name, *_):
        return self.values.setdefault(name, Value())

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


def played(make, batches, seconds, slot, **more):
    """Rows of one key as they come out, batch by batch, with the watermark after each batch."""
    p = make("ts", "event_id", ["ts", "event_id"], slot * 1000, seconds * 1_000_000, "", ["ip", "ts", "event_id", "verdict"])
    p.keys, h = ["ip"], Handle()
    for k, v in more.items():
        setattr(p, k, v)
    p.init(h)
    out = []
    for rows, watermark in batches:
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w * 1000)
        if rows:
            frame = pd.DataFrame({"ts": pd.to_datetime([t for t, _ in rows], unit="s"), "event_id": [i for _, i in rows]})
            list(p.handleInputRows(("a",), iter([frame]), clock))
        while due := [t for t in h.timers if t <= watermark * 1000]:
            h.timers.discard(min(due))
            for f in p.handleExpiredTimer(("a",), clock, SimpleNamespace(getExpiryTimeInMs=lambda: 0)):
                out += list(zip(f["event_id"], f["verdict"]))
    return out, h


def one_by_one(rows, judge):
    state, out = (0, None), []
    for t, i in sorted(rows):
        verdict, state = judge(t, *state)
        out.append((i, verdict))
    return out


def burst(limit, gap):
    def judge(t, n, last):
        n = 1 if last is None or t - last > gap else n + 1
        return (None if n <= limit else ST.LIMITED), (n, t)
    return judge


def repeat(wait):
    return lambda t, n, last: (ST.REPEATED, (n, last)) if last is not None and t - last < wait else (None, (n, t))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.booleans()), max_size=40), st.integers(1, 90), st.integers(1, 4), st.integers(1, 70))
def test_arrival_order_does_not_matter(times, wait, limit, slot):
    rows = [(T0 + t, i) for i, (t, _) in enumerate(times)]
    late = [r for r, (_, second) in zip(rows, times) if second]
    batches = [([r for r in rows if r not in late], T0 - 1000), (late, T0 + 150), ([], T0 + 10**6)]
    late_in_time = [r for r in late if r[0] >= T0 - 1000]
    assert late_in_time == late
    for make, judge, more in ((ST.Repeat, repeat(wait), {}), (ST.Burst, burst(limit, wait), {"limit": limit})):
        got, h = played(make, batches, wait, slot, **more)
        assert got == one_by_one(rows, judge)
        assert not h.waiting and not h.timers and not any(v.exists() for v in h.values.values())  # nothing is kept for ever


def test_slots_wait_for_the_watermark_and_memory_lasts():
    batches = [([(T0 + 5, 1), (T0 + 130, 2)], T0 + 60), ([(T0 + 61, 3)], T0 + 125), ([(T0 + 126, 4)], T0 + 10**5)]
    got, _ = played(ST.Repeat, batches, 60, 10)
    assert got == [(1, None), (3, ST.REPEATED), (4, None), (2, ST.REPEATED)]


@pytest.fixture
def tables(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    mails = spark.createDataFrame([(k, k % 40, f"m{k}", at, False, None, False, None, False, None, False, None) for k in range(300)],
                                  "id long, contact_id long, email_id string, email_sent_date timestamp, email_opened boolean, email_opened_date timestamp, email_replied boolean, "
                                  "email_replied_date timestamp, clicked_link boolean, clicked_link_date timestamp, converted boolean, conversion_date timestamp")
    links = spark.createDataFrame([(f"s{k}", k % 40, f"m{k}", 1) for k in range(200)], "short_id string, contact_id long, email_id string, clicks long")
    scores = spark.createDataFrame([(c, 0.0, 0.0, 0.0, 0.0, 0.0, at) for c in range(40)],
                                   "contact_id long, engagement_score double, recency_score double, frequency_score double, depth_score double, conversion_score double, last_calculated timestamp")
    ST.start_tables(mails, links, scores, str(tmp_path))
    return str(tmp_path)


def hits(spark, rows):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 2, 0, i), t, k, v) for i, (t, k, v) in enumerate(rows)], "event_id long, ts timestamp, event_type string, tracking_id string, verdict string")


def test_a_batch_writes_only_what_it_changes_and_can_run_again(spark, tables):
    as_of = dt.datetime(2024, 1, 31)
    first = hits(spark, [("open", "m1", None), ("open", "m1", None), ("click", "s2", None), ("click", "s2", None), ("open", "m3", ST.LIMITED), ("open", "gone", None), ("click", "gone", None),
                         ("click", "s5", ST.REPEATED), ("open", "m2", None), ("open", "m2", None)])
    second = hits(spark, [("open", "m1", None), ("click", "s2", None)])

    def now(name):
        return sorted(map(tuple, ST.table_now(spark, tables, name).collect()), key=str)

    ST.apply_batch(first, 0, tables, as_of)
    once = {n: now(n) for n in ST.TABLES}
    written = {n: ST.TABLES[n].every(spark, f"{tables}/{n}").where("batch = 0").count() for n in ST.TABLES}
    assert written == {"engagements": 2, "links": 1, "scores": 2, "outcomes": 6}
    ST.apply_batch(first, 0, tables, as_of)
    assert {n: now(n) for n in ST.TABLES} == once
    ST.apply_batch(second, 1, tables, as_of)
    mails = {r.id: r for r in ST.table_now(spark, tables, "engagements").collect()}
    assert len(mails) == 300 and [(mails[k].email_opened_count, mails[k].clicked_link_count) for k in (1, 2, 3, 5)] == [(3, 0), (2, 3), (0, 0), (0, 0)]
    assert mails[1].email_opened_date == dt.datetime(2024, 1, 2) and mails[2].clicked_link_date == dt.datetime(2024, 1, 2, 0, 2)
    links = {r.short_id: r.clicks for r in ST.table_now(spark, tables, "links").collect()}
    assert (len(links), links["s2"], links["s5"]) == (200, 4, 1)
    log = first.union(second).select("event_type", "ts").union(spark.createDataFrame([("heartbeat", dt.datetime(2024, 2, 1)), ("open", dt.datetime(2024, 1, 2))], "t string, ts timestamp"))
    got = {(r.event_type, r.outcome): (r.n, r.accepted) for r in ST.outcome_totals(spark, tables, log).collect()}
    assert got == {("open", "Open recorded"): (5, True), ("open", "Email not found"): (1, False), ("open", ST.LIMITED): (1, False), ("open", ST.LATE): (1, False),
                   ("click", "Click recorded"): (3, True), ("click", "Link not found"): (1, False), ("click", ST.REPEATED): (1, False)}


def test_tables_can_be_compacted(spark, tables, tmp_path):
    ST.apply_batch(hits(spark, [("open", "m1", None)]), 0, tables, dt.datetime(2024, 1, 31))
    changes, target = ST.TABLES["engagements"], str(tmp_path / "compacted")
    changes.compact(spark, f"{tables}/engagements", target)
    want = sorted(map(tuple, ST.table_now(spark, tables, "engagements").collect()))
    assert sorted(map(tuple, changes.current(spark, target).collect())) == want
    some = spark.createDataFrame([("m1",), ("m1",), ("m7",), ("no",), (None,)], "email_id string")
    assert sorted(r.email_id for r in changes.current(spark, target, keys=some).collect()) == ["m1", "m7"]
    assert changes.every(spark, target).select(F.countDistinct("batch")).first()[0] == 1
