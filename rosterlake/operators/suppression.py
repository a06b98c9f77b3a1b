"""Duplicate suppression and rate limits over stored events (batch twins of the streaming operators).

Both depend on order, but neither needs a key's whole history in one task.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.operators.selection import rank_within

NONE = np.iinfo(np.int64).min // 4  # "nothing accepted yet": far below any timestamp, safe to add to


def _orbit_ends(a: np.ndarray, gap: int) -> np.ndarray:
    """For every start position: the last accepted time when that start is accepted."""
    nxt = np.searchsorted(a, a + gap)
    end = a.copy()
    for i in range(len(a) - 1, -1, -1):
        if nxt[i] < len(a):
            end[i] = end[nxt[i]]
    return end


def _steps(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Keep the last start of every run of equal ends: all earlier starts of the run lead to the same end."""
    keep = np.append(ends[1:] != ends[:-1], True)
    return starts[keep].tolist(), ends[keep].tolist()


def _enter(starts: Sequence[int], ends: Sequence[int], last: int, gap: int) -> int:
    """Last accepted time after a stretch entered with ``last`` accepted before it."""
    i = int(np.searchsorted(np.asarray(starts, dtype=np.int64), last + gap))
    return int(ends[i]) if i < len(starts) else last


def accepted(us: np.ndarray, last: int, gap: int) -> tuple[list[int], int]:
    """Places of the accepted among sorted times, each found by a jump over its wait, and the last accepted time."""
    keep, at = [], int(np.searchsorted(us, last + gap))
    while at < len(us):
        keep.append(at)
        last = int(us[at])
        at += int(np.searchsorted(us[at:], last + gap))
    return keep, last


def suppress_repeats(events: DataFrame, keys: Sequence[str] = ("event_type", "tracking_id"), ts: str = "ts", row: str = "event_id",
                     seconds: float = 60, long_run: int = 2_000_000, chunk_seconds: int = 3600) -> DataFrame:
    """Accepted events only: an event is dropped when it comes less than ``seconds`` after the last *accepted* one of
    its key. Dropped events do not extend the wait. ``row`` is the unique event id.

    A silence of the full wait makes the next event accepted whatever came before, so a key's time line falls into
    independent runs; they are found on a table of time buckets one wait long (no such silence fits inside one). Runs
    shorter than the wait are settled by their first event. The others are scanned in order with one number
    of state; a run with more than ``long_run`` distinct times is cut into chunks, see :func:`_scan_in_chunks`.
    """
    gap = int(seconds * 1_000_000)
    k = list(keys)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    # equal times of one key: only the first row can be accepted, so repeats are reduced before any shuffle
    e = events.groupBy(*k, us.alias("us")).agg(F.min(row).alias(row)).withColumn("b", F.floor(F.col("us") / F.lit(gap)).cast("long"))
    buckets = e.groupBy(*k, "b").agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("*").alias("n"),
                                     F.min_by(row, "us").alias("first_row"))
    w = Window.partitionBy(*k).orderBy("b")
    opens = F.coalesce(F.col("lo") - F.lag("hi").over(w) >= gap, F.lit(True))
    buckets = buckets.withColumn("rid", F.last(F.when(opens, F.col("first_row")), True).over(w))
    runs = buckets.groupBy(*k, "rid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    alone = runs.filter(F.col("hi") - F.col("lo") < gap).select(*k, F.col("rid").alias(row))
    longer = runs.filter(F.col("hi") - F.col("lo") >= gap).select(*k, "rid", (F.col("n") > long_run).alias("huge"))
    where = buckets.join(longer, [*k, "rid"]).select(*k, "b", "rid", "huge")
    work = e.join(where, [*k, "b"]).drop("b")
    plain = _scan(work.filter("NOT huge").select(*k, "rid", "us", row), k, row, gap)
    huge = _scan_in_chunks(work.filter("huge").select(*k, "rid", "us", row), k, row, gap, max(chunk_seconds * 1_000_000, gap))
    return alone.unionByName(plain).unionByName(huge)


def _scan(work: DataFrame, keys: Sequence[str], row: str, gap: int) -> DataFrame:
    """Walk every run in time order; a run may span any number of batches, only the last accepted time is kept."""
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last = None, NONE
        for pdf in batches:
            rid, us, keep = pdf["rid"].to_numpy(), pdf["us"].to_numpy(), []
            start = np.flatnonzero(np.append(True, rid[1:] != rid[:-1])) if len(rid) else []
            for a, b in zip(start, [*start[1:], len(rid)]):
                last, run = (last if rid[a] == run else NONE), rid[a]
                hits, last = accepted(us[a:b], last, gap)
                keep.extend(a + h for h in hits)
            yield pdf.iloc[keep][[*keys, row]]

    schema = T.StructType([work.schema[c] for c in [*keys, row]])
    return work.repartition("rid").sortWithinPartitions("rid", "us").mapInPandas(walk, schema)


def _scan_in_chunks(work: DataFrame, keys: Sequence[str], row: str, gap: int, chunk: int, chunks_per_span: int = 24) -> DataFrame:
    """A run too long for one task. How a chunk of it maps "last accepted before" to "last accepted after" depends on
    the chunk's first wait only, so a chunk is summed up by a short step function; these are joined over spans of
    chunks, spans over the run, and the results handed back down. The heavy passes work per (run, chunk).
    """
    e = work.withColumn("chunk", F.floor(F.col("us") / F.lit(chunk)).cast("long")).withColumn(
        "span", F.floor(F.col("chunk") / F.lit(chunks_per_span)).cast("long"))
    rid = T.StructField("rid", work.schema["rid"].dataType)
    f_span, f_chunk, f_last = (T.StructField(c, T.LongType()) for c in ("span", "chunk", "last"))
    f_map = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "ends")]

    def chunk_map(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.sort(pdf["us"].to_numpy())
        n = int(np.searchsorted(a, key[-1] * chunk + gap)) + 1
        starts, ends = _steps(a[:n], _orbit_ends(a, gap)[:n])
        return pd.DataFrame([{"rid": key[0], "span": key[1], "chunk": key[2], "starts": starts, "ends": ends}])

    def span_map(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        # a wait that outlasts every start of the first chunk passes it unchanged, so later starts matter too
        edge = int(pdf["chunk"].iloc[0]) * chunk + gap
        every = np.unique(np.concatenate([np.asarray(s, dtype=np.int64) for s in pdf["starts"]]))
        every = every[:int(np.searchsorted(every, edge)) + 1]
        out = []
        for s in every:
            last = int(s) - gap
            for cs, ce in zip(pdf["starts"], pdf["ends"]):
                last = _enter(cs, ce, last, gap)
            out.append(last)
        st, en = _steps(every, np.asarray(out, dtype=np.int64))
        return pd.DataFrame([{"rid": key[0], "span": key[1], "starts": st, "ends": en}])

    def fold(pdf: pd.DataFrame, last: int, part: str) -> pd.DataFrame:
        rows = []
        for r in pdf.sort_values(part).to_dict("records"):
            rows.append({"rid": r["rid"], "span": r["span"], part: r[part], "last": last})
            last = _enter(r["starts"], r["ends"], last, gap)
        return pd.DataFrame(rows)

    def accept(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("us")
        keep, _ = accepted(pdf["us"].to_numpy(), int(pdf["last"].iloc[0]), gap)
        return pdf.iloc[keep][[*keys, row]]

    maps = e.groupBy("rid", "span", "chunk").applyInPandas(chunk_map, T.StructType([rid, f_span, f_chunk, *f_map]))
    spans = maps.groupBy("rid", "span").applyInPandas(span_map, T.StructType([rid, f_span, *f_map]))
    into_spans = spans.groupBy("rid").applyInPandas(lambda pdf: fold(pdf, NONE, "span"), T.StructType([rid, f_span, f_last]))
    into_chunks = maps.join(into_spans, ["rid", "span"]).groupBy("rid", "span").applyInPandas(
        lambda pdf: fold(pdf, int(pdf["last"].iloc[0]), "chunk"), T.StructType([rid, f_span, f_chunk, f_last]))
    tasks = e.join(into_chunks.select("rid", "chunk", "last"), ["rid", "chunk"])
    return tasks.groupBy("rid", "chunk").applyInPandas(accept, T.StructType([work.schema[c] for c in [*keys, row]]))


def rate_limit(events: DataFrame, who: str = "ip_address", ts: str = "ts", row: str = "event_id", limit: int = 50,
               gap_seconds: int = 60) -> DataFrame:
    """Flag every event: ``allowed`` is false from the (limit+1)-th request of a burst on; a burst ends with a
    silence longer than the gap, and every request, allowed or not, keeps it going.

    Requests less than a gap apart share a burst, so time buckets one gap long never straddle two: bursts are
    found on the small table of buckets. Only the one bucket of a burst in which the limit falls needs a rank.
    """
    gap = gap_seconds * 1_000_000
    e = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn(
        "_b", F.floor(F.col("_us") / F.lit(gap)).cast("long"))
    buckets = e.groupBy(who, "_b").agg(F.min("_us").alias("lo"), F.max("_us").alias("hi"), F.count("*").alias("n"))
    w = Window.partitionBy(who).orderBy("_b")
    starts = F.coalesce(F.col("lo") - F.lag("hi").over(w) > gap, F.lit(True)).cast("int")
    buckets = buckets.withColumn("_new", starts).withColumn("burst", F.sum("_new").over(w))
    wb = Window.partitionBy(who, "burst").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("n").over(wb), F.lit(0)))
    room = F.lit(limit) - F.col("before")
    crossing = buckets.filter((room > 0) & (room < F.col("n"))).select(who, "_b", room.alias("_room"))
    first = rank_within(e.join(crossing, [who, "_b"]), [who, "_b"], [F.asc("_us"), F.asc(row)], limit, "_r")
    cut = first.filter(F.col("_r") == F.col("_room")).select(who, "_b", F.struct("_us", row).alias("_cut"))
    verdict = buckets.select(who, "_b", "burst", F.when(room >= F.col("n"), "all").when(room <= 0, "none").otherwise("part").alias("_v"))
    j = e.join(verdict.join(cut, [who, "_b"], "left"), [who, "_b"])
    ok = (F.col("_v") == "all") | ((F.col("_v") == "part") & (F.struct("_us", row) <= F.col("_cut")))
    return j.withColumn("allowed", ok).select(*events.columns, "burst", "allowed")


def outcome_counts(resolved: DataFrame) -> DataFrame:
    """Events per outcome; what could not be matched counts as rejected with its reason."""
    return resolved.groupBy("event_type", "outcome").agg(F.count("*").alias("n")).withColumn(
        "accepted", F.col("outcome").endswith("recorded"))


def device_breakdown(events: DataFrame, *window: str) -> DataFrame:
    from rosterlake.functions.people import device
    d = events.withColumn("d", device("user_agent"))
    keys = [F.window("ts", *window).alias("window")] if window else []
    g = d.groupBy(*keys, F.col("d.device_type").alias("device_type"), F.col("d.browser").alias("browser"), F.col("d.os").alias("os")).agg(
        F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), "device_type", "browser", "os", "n") if window else g
