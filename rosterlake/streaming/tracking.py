"""Tracking hits as a stream: rate limit, duplicate suppression, effects on the stored tables.

All timing is event time. A hit waits in the state of its key until the watermark has passed its time, and is then judged: whatever
order the hits arrive in, each key sees them in the order of their times. Hits that arrive behind the watermark are too late for any
verdict; they are counted, not applied. A line of type ``heartbeat`` only moves the watermark on.
"""
from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rosterlake.operators import engagement as E
from rosterlake.operators import joins as J
from rosterlake.operators.suppression import NONE, device_breakdown
from rosterlake.streaming import changes as C

WATERMARK = "10 minutes"
HEARTBEAT = "heartbeat"
LIMITED, REPEATED, LATE = "Rate limit exceeded", "Cached", "Too late"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InTimeOrder(StatefulProcessor):
    """Rows of a key, one by one in the order of (time, row id), whatever order they come in.

    Rows lie in a map from time slot to the rows of the slot. A key has one timer, at the end of its first slot: when it fires, the slots
    that the watermark has passed are taken one after the other, so no more than a slot is in memory. ``judge`` sees each row once and
    says what to put out for it. What it remembers are two numbers, a count and a time in microseconds, which are forgotten ``keep_us``
    after that time.
    """

    def __init__(self, ts: str, row: str, columns: Sequence[str], slot_ms: int, keep_us: int, payload: str, out: Sequence[str]):
        self.ts, self.row, self.columns, self.slot_ms, self.keep_us, self.payload, self.out = ts, row, list(columns), slot_ms, keep_us, payload, list(out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long", self.payload)
        self.memory = handle.getValueState("memory", "n long, last long")
        self.timer = handle.getValueState("timer", "ms long")

    def wake(self, ms: int, pending: int | None) -> None:
        if pending is not None:
            self.handle.deleteTimer(pending)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            pdf = pdf[pdf[self.ts].notna()]  # a line without a time is never judged
            us = pdf[self.ts].astype("datetime64[us]").astype("int64")
            slots = (us // (self.slot_ms * 1000) + 1) * self.slot_ms
            for slot, some in pdf.assign(**{self.ts: us}).groupby(slots.to_numpy()):
                slot, new = int(slot), [some[c].tolist() for c in self.columns]
                if self.waiting.containsKey((slot,)):
                    new = [[*old, *more] for old, more in zip(self.waiting.getValue((slot,)), new)]
                self.waiting.updateValue((slot,), tuple(new))
                first = slot if first is None else min(first, slot)
        pending = self.timer.get()[0] if self.timer.exists() else None
        if first is not None and (pending is None or first < pending):
            self.wake(first, pending)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        slots = sorted(k[0] for k in self.waiting.keys())
        n, last = self.memory.get() if self.memory.exists() else (0, NONE)
        due, shown, held = [s for s in slots if s <= now], [], 0
        for slot in due:
            rows = pd.DataFrame(dict(zip(self.columns, self.waiting.getValue((slot,))))).sort_values([self.ts, self.row], kind="stable")
            self.waiting.removeKey((slot,))
            verdicts = []
            for r in rows.to_dict("records"):
                verdict, n, last = self.judge(r, n, last)
                verdicts.append(verdict)
            shown.append(self.shown(key, rows, verdicts, now))
            held += len(rows)
            if held > 10_000:
                yield pd.concat(shown)
                shown, held = [], 0
        if shown:
            yield pd.concat(shown)
        later = slots[len(due):]
        forget = max(last, 0) // 1000 + self.keep_us // 1000 + self.slot_ms + 1  # no row of a slot still to come can be within the time
        if later or forget > now:
            self.memory.update((n, last))
            self.wake(min([*later[:1], max(forget, now + 1)]), None)
        else:
            self.memory.clear()
            self.timer.clear()

    def shown(self, key, rows: pd.DataFrame, verdicts: list, due_ms: int) -> pd.DataFrame:
        out = rows.assign(verdict=verdicts, due=pd.Timestamp(due_ms, unit="ms", tz="UTC"), **{self.ts: pd.to_datetime(rows[self.ts], unit="us", utc=True)})
        return out.assign(**dict(zip(self.keys, key)))[self.out]

    def judge(self, row: dict, n: int, last: int) -> tuple:
        raise NotImplementedError


class Burst(InTimeOrder):
    """Rate limit: a burst ends with a silence longer than the gap, and every request keeps it going."""

    def judge(self, row, n, last):
        n = 1 if row[self.ts] - last > self.keep_us else n + 1
        return (None if n <= self.limit else LIMITED), n, row[self.ts]


class Repeat(InTimeOrder):
    """Repeats: less than the wait after the last accepted hit. A hit with a verdict keeps it and changes nothing."""

    def judge(self, row, n, last):
        if row.get("verdict") is not None:
            return row["verdict"], n, last
        return (REPEATED, n, last) if row[self.ts] - last < self.keep_us else (None, n, row[self.ts])


def clocked(events: DataFrame, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """The hits under a watermark that heartbeats move too. The condition names the time, so that it is not tested before the watermark."""
    hit = F.coalesce(F.col("event_type") != HEARTBEAT, F.lit(True)) | F.col(ts).isNull()
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).where(hit)


def _judged(hits: DataFrame, make: type, keys: Sequence[str], ts: str, row: str, seconds: float, slot: float, **more) -> DataFrame:
    """All columns of ``hits``, a verdict, NULL for a hit that goes on, and ``due``: when it was judged, the event time for what follows."""
    spark = hits.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    fields = {f.name: f.dataType for f in hits.schema if f.name not in keys and f.name != "due"}
    held = {**fields, ts: T.LongType()}
    out = T.StructType([*[f for f in hits.schema if f.name not in ("verdict", "due")], T.StructField("verdict", T.StringType()), T.StructField("due", T.TimestampType())])
    payload = ", ".join(f"`{c}` array<{d.simpleString()}>" for c, d in held.items())
    p = make(ts, row, list(held), int(slot * 1000), int(seconds * 1_000_000), payload, out.names)
    p.keys = list(keys)
    for name, value in more.items():
        setattr(p, name, value)
    return hits.groupBy(*keys).transformWithStateInPandas(p, out, "Append", "EventTime", eventTimeColumnName="due")


def limit_bursts(hits: DataFrame, who: str = "ip_address", ts: str = "ts", row: str = "event_id", limit: int = 50, gap_seconds: float = 60, slot: float = 1) -> DataFrame:
    """Clocked hits with a verdict column: ``LIMITED`` from the (limit+1)-th request of an address's burst on, else NULL."""
    return _judged(hits, Burst, [who], ts, row, gap_seconds, slot, limit=limit)


def mark_repeats(hits: DataFrame, keys: Sequence[str] = ("event_type", "tracking_id"), ts: str = "ts", row: str = "event_id", seconds: float = 60, slot: float = 1) -> DataFrame:
    """Clocked hits with a verdict column: ``REPEATED`` less than ``seconds`` after the key's last accepted hit; earlier verdicts stay."""
    return _judged(hits, Repeat, keys, ts, row, seconds, slot)


def suppress_repeats_stream(events: DataFrame, keys: Sequence[str] = ("event_type", "tracking_id"), ts: str = "ts", row: str = "event_id",
                            seconds: float = 60, watermark: str = WATERMARK, slot: float = 1) -> DataFrame:
    """Accepted events, once the watermark has passed them."""
    return mark_repeats(clocked(events, ts, watermark).select(*keys, ts, row), keys, ts, row, seconds, slot).where("verdict IS NULL").drop("verdict", "due")


def rate_limit_stream(events: DataFrame, who: str = "ip_address", ts: str = "ts", row: str = "event_id", limit: int = 50,
                      gap_seconds: int = 60, watermark: str = WATERMARK, slot: float = 1) -> DataFrame:
    """Every event and whether it is allowed, once the watermark has passed it."""
    out = limit_bursts(clocked(events, ts, watermark).select(who, ts, row), who, ts, row, limit, gap_seconds, slot)
    return out.select(who, ts, row, F.col("verdict").isNull().alias("allowed"))


def judged_hits(events: DataFrame, limit: int = 50, gap_seconds: float = 60, seconds: float = 60, watermark: str = WATERMARK, slot: float = 1) -> DataFrame:
    """Hits through both rules: the rate limit of the address, which every request counts for, then the repeats among what it lets through."""
    hits = clocked(events, "ts", watermark).select("ip_address", "ts", "event_id", "event_type", "tracking_id")
    return mark_repeats(limit_bursts(hits, limit=limit, gap_seconds=gap_seconds, slot=slot), seconds=seconds, slot=slot)


def device_stream(events: DataFrame, window: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """Clicks per device, browser and system in tumbling windows."""
    clicks = events.filter("event_type = 'click'").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return device_breakdown(clicks, window)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder; a local one only for a local master without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="rosterlake-stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def state_partitions(spark: SparkSession, n: int | None):
    """Streams that start for the first time in here deal their state to ``n`` partitions; by default as the session says."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n or old))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def run_to_table(stream: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Process everything available, then read the written rows."""
    with state_partitions(stream.sparkSession, partitions):
        q = (stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_counts_to_table(stream: DataFrame, folder: str, value: str = "n") -> DataFrame:
    """Process everything available of a windowed count and read its last state, open windows included.

    Every trigger writes the counts that changed under its own number, so a repeated trigger replaces its rows; the latest count of
    a key holds.
    """
    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("epoch", T.LongType())])).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    return rows.groupBy(*[c for c in stream.columns if c != value]).agg(F.max_by(value, "epoch").alias(value))


TABLES = {"engagements": C.Changes(("id",), ("email_id",)), "links": C.Changes(("short_id",), ("short_id",)), "scores": C.Changes(("contact_id",), ("contact_id",)),
          "outcomes": C.Changes(("event_type", "outcome"), ("event_type",))}


def apply_batch(batch: DataFrame, number: int, folder: str, as_of: dt.datetime) -> None:
    """One micro-batch of judged hits -> the rows of engagements, links and scores that it changes, and its outcome counts.

    Only what earlier batches wrote is read, and the batch writes to folders of its own number, so a batch that is run again after a
    failure gives the same tables. Of engagements only the mails hit are read for their counters; a score takes all mails of its contact.
    """
    spark = batch.sparkSession
    tables = {n: (t, f"{folder}/{n}") for n, t in TABLES.items()}
    stored = lambda name, before, **only: tables[name][0].current(spark, tables[name][1], before, **only)
    batch = batch.persist()
    if batch.isEmpty():
        return
    hits = batch.where("verdict IS NULL")
    opens, clicks = hits.where("event_type = 'open'"), hits.where("event_type = 'click'")
    links = stored("links", number, keys=clicks.select(F.col("tracking_id").alias("short_id")))
    hit_mails = opens.select(F.col("tracking_id").alias("email_id")).union(links.select("email_id"))
    mails = stored("engagements", number, keys=hit_mails)
    resolved = J.resolve_tracking(hits, links, mails)
    was = F.struct("email_opened_count", "clicked_link_count")
    new_mails = E.apply_clicks_to_mails(E.apply_opens(mails.withColumn("_was", was), opens), links, clicks).where(F.col("_was") != was).drop("_was")
    for name, rows in (("engagements", new_mails), ("links", E.apply_clicks_to_links(links, clicks))):
        tables[name][0].write(rows, tables[name][1], number)
    touched = E.touched_contacts(resolved)
    scores = E.engagement_scores(stored("engagements", number + 1).join(touched, "contact_id", "left_semi"), as_of)
    tables["scores"][0].write(scores.drop("base_score"), tables["scores"][1], number)
    outcomes = resolved.select("event_type", "outcome").union(batch.where("verdict IS NOT NULL").select("event_type", "verdict"))
    tables["outcomes"][0].write(outcomes.groupBy("event_type", "outcome").agg(F.count("*").alias("n")), tables["outcomes"][1], number)
    batch.unpersist()


def start_tables(mails: DataFrame, links: DataFrame, scores: DataFrame, folder: str) -> None:
    """The tables before the first batch, with the counters and dates that hits change."""
    extra = {"engagements": (mails, {"email_opened_count": "long", "clicked_link_count": "long"}), "links": (links, {"last_clicked": "timestamp"}), "scores": (scores, {})}
    for name, (df, missing) in extra.items():
        for c, d in missing.items():
            if c not in df.columns:
                df = df.withColumn(c, F.lit(0 if d == "long" else None).cast(d))
        TABLES[name].start(df, f"{folder}/{name}")
    TABLES["outcomes"].start(mails.sparkSession.createDataFrame([], "event_type string, outcome string, n long"), f"{folder}/outcomes")


def run_effects(judged: DataFrame, folder: str, as_of: dt.datetime, partitions: int | None = None) -> None:
    """Apply a stream of judged hits to the tables in ``folder``; a later call goes on where the last one stopped."""
    with state_partitions(judged.sparkSession, partitions):
        q = (judged.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, folder, as_of)).option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start())
        q.awaitTermination()


def table_now(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return TABLES[name].current(spark, f"{folder}/{name}")


def outcome_totals(spark: SparkSession, folder: str, log: DataFrame, watermark: str = WATERMARK, slot: float = 1) -> DataFrame:
    """(event_type, outcome, n, accepted) over all batches. Hits of the log behind the watermark that got no verdict came too late."""
    counts = TABLES["outcomes"].every(spark, f"{folder}/outcomes").groupBy("event_type", "outcome").agg(F.sum("n").alias("n"))
    log = log.select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    end = log.agg(F.unix_micros(F.max("ts") - F.expr(f"INTERVAL {watermark}"))).first()[0] or 0
    width = int(slot * 1_000_000)
    due = log.where((F.col("event_type") != HEARTBEAT) & (F.unix_micros("ts") < end // width * width))
    seen = counts.groupBy("event_type").agg(F.sum("n").alias("seen"))
    late = due.groupBy("event_type").agg(F.count("*").alias("all")).join(seen, "event_type", "left").select(
        "event_type", F.lit(LATE).alias("outcome"), (F.col("all") - F.coalesce("seen", F.lit(0))).alias("n")).where("n > 0")
    return counts.union(late).withColumn("accepted", F.col("outcome").endswith("recorded"))
