"""Streams over the event table: the same results as the batch twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.operators import engagement as E
from rosterlake.plans.bindings import VIEWS
from rosterlake.plans.q_engagement import AS_OF, FOLD, HITS
from rosterlake.plans.registry import ORACLES, query
from rosterlake.streaming import tracking as ST

CLOSING = "2024-03-01"
STATE_PARTITIONS, SLOT = 4, 6 * 3600


def event_stream(t):
    """The event table as a file stream, seen through the tracking view."""
    raw = (t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir))
    return t.spark.sql(VIEWS["tracking_events"][0], events=raw)


def heartbeat(t):
    """One line after the last hit, in the columns of the tracking view."""
    return t.tracking_events.limit(1).withColumns({"ts": F.lit(CLOSING).cast("timestamp_ntz"), "event_type": F.lit(ST.HEARTBEAT)})


def closed_stream(t):
    folder = ST.shared_folder(t.spark, "closing")
    heartbeat(t).write.parquet(folder)
    events = event_stream(t)
    return events.union(t.spark.readStream.schema(events.schema).parquet(folder))


@query("k2_stream_suppress_repeats", sql=None)
def _(t):
    out = ST.run_to_table(ST.suppress_repeats_stream(closed_stream(t), slot=SLOT), ST.shared_folder(t.spark, "k2"), STATE_PARTITIONS)
    return out.select("event_type", "tracking_id", "event_id")


@query("k3_stream_rate_limit", sql=None)
def _(t):
    out = ST.run_to_table(ST.rate_limit_stream(closed_stream(t), limit=2, gap_seconds=1800, slot=SLOT), ST.shared_folder(t.spark, "k3"), STATE_PARTITIONS)
    return out.select("event_id", "allowed")


@query("k9_stream_device_windows", "tracking_events", """
SELECT date_trunc('day', ts) AS window_start, CASE event_id % 4 WHEN 1 THEN 'mobile' WHEN 2 THEN 'mobile' ELSE 'desktop' END AS device_type, CASE event_id % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' WHEN 2 THEN 'Firefox' ELSE 'unknown' END AS browser,
 CASE event_id % 4 WHEN 0 THEN 'Windows' WHEN 1 THEN 'macOS' WHEN 2 THEN 'Linux' ELSE 'unknown' END AS os, count(*)::BIGINT AS n FROM tracking_events WHERE event_type = 'click' GROUP BY ALL""")
def _(t):
    out = ST.run_counts_to_table(ST.device_stream(event_stream(t)), ST.shared_folder(t.spark, "k9"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


HIT_ID = "CASE WHEN event_type = 'click' THEN 's' || CAST(event_id % 400 AS {s}) WHEN event_id % 41 = 0 THEN 'gone' ELSE 'm' || CAST(event_id % 300 * 2 AS {s}) END"
LATE = "event_id % 97 = 0 AND ts < TIMESTAMP '2024-01-10'"
CHAIN = f"""hit AS (SELECT event_id, ts, event_type, ip_address, {HIT_ID.format(s='VARCHAR')} AS tracking_id FROM tracking_events),
k3 AS (SELECT *, row_number() OVER (PARTITION BY ip_address, burst ORDER BY ts, event_id) > 2 AS limited FROM (SELECT *, sum(nw) OVER (PARTITION BY ip_address ORDER BY ts, event_id) AS burst FROM (
 SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY ip_address ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM hit WHERE NOT ({LATE})))),
e AS (SELECT event_type, tracking_id, ts, min(event_id) AS event_id FROM k3 WHERE NOT limited GROUP BY 1, 2, 3),
nx AS (SELECT *, min(ts) OVER (PARTITION BY event_type, tracking_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS nts FROM e),
acc AS (SELECT event_type, tracking_id, min(ts) AS ts FROM e GROUP BY 1, 2 UNION ALL SELECT acc.event_type, acc.tracking_id, nx.nts FROM acc JOIN nx ON nx.event_type = acc.event_type AND nx.tracking_id = acc.tracking_id AND nx.ts = acc.ts WHERE nx.nts IS NOT NULL),
fine AS (SELECT e.* FROM acc JOIN e ON e.event_type = acc.event_type AND e.tracking_id = acc.tracking_id AND e.ts = acc.ts)"""
EFFECTS = f"""{CHAIN},
opened AS (SELECT tracking_id, count(*) AS n, min(ts) AS first FROM fine WHERE event_type = 'open' GROUP BY 1),
clicked AS (SELECT l.email_id, count(*) AS n, min(ts) AS first FROM fine JOIN shortened_urls l ON l.short_id = tracking_id WHERE event_type = 'click' GROUP BY 1),
mails AS (SELECT e.* REPLACE (e.email_opened OR o.n IS NOT NULL AS email_opened, coalesce(e.email_opened_date, o.first) AS email_opened_date, e.clicked_link OR c.n IS NOT NULL AS clicked_link, coalesce(e.clicked_link_date, c.first) AS clicked_link_date),
 coalesce(o.n, 0) AS opens, coalesce(c.n, 0) AS clicks FROM email_engagements e LEFT JOIN opened o ON o.tracking_id = e.email_id LEFT JOIN clicked c ON c.email_id = e.email_id),
{FOLD.replace('email_engagements', 'mails')}"""


def log_parts(t):
    """The hits in arrival order: eight-day files of which neighbours change places, then stragglers, then a heartbeat."""
    hits = t.tracking_events.withColumn("tracking_id", F.expr(HIT_ID.format(s="STRING"))).select("event_id", "ts", "event_type", "tracking_id", "ip_address")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    part = F.when(F.expr(LATE), 4).otherwise(F.floor(day / 8).bitwiseXOR(F.lit(1)))
    return hits.withColumn("part", part).unionByName(heartbeat(t).select(*hits.columns, F.lit(5).alias("part")))


@query("k2_k3_k4_k5_k6_stream", "tracking_events shortened_urls email_engagements", f"""
WITH RECURSIVE {EFFECTS}
SELECT 'mail' AS kind, CAST(id AS VARCHAR) AS name, opens::BIGINT AS n, clicks::BIGINT AS m, email_opened_date AS first_at, clicked_link_date AS last_at, NULL::DOUBLE AS score FROM mails
UNION ALL SELECT 'link', l.short_id, (l.clicks + count(f.ts))::BIGINT, count(f.ts)::BIGINT, NULL, max(f.ts), NULL FROM shortened_urls l LEFT JOIN fine f ON f.event_type = 'click' AND f.tracking_id = l.short_id GROUP BY l.short_id, l.clicks
UNION ALL SELECT 'score', CAST(contact_id AS VARCHAR), NULL, NULL, NULL, NULL, engagement_score FROM score
UNION ALL SELECT 'outcome', event_type || ': ' || outcome, count(*)::BIGINT, NULL, NULL, NULL, NULL FROM (
 SELECT event_type, '{ST.LATE}' AS outcome FROM hit WHERE {LATE} UNION ALL SELECT event_type, '{ST.LIMITED}' FROM k3 WHERE limited
 UNION ALL SELECT event_type, '{ST.REPEATED}' FROM k3 WHERE NOT limited AND event_id NOT IN (SELECT event_id FROM fine)
 UNION ALL SELECT event_type, CASE WHEN event_type = 'open' THEN CASE WHEN tracking_id IN (SELECT email_id FROM email_engagements) THEN 'Open recorded' ELSE 'Email not found' END
  ELSE CASE WHEN tracking_id IN (SELECT short_id FROM shortened_urls) THEN 'Click recorded' ELSE 'Link not found' END END FROM fine) GROUP BY event_type, outcome""")
def _(t):
    folder, log = ST.shared_folder(t.spark, "effects"), ST.shared_folder(t.spark, "log")
    mails, parts = t.email_engagements, log_parts(t)
    ST.start_tables(mails, t.shortened_urls, E.engagement_scores(mails, AS_OF).drop("base_score"), folder)
    rows = parts.drop("part")
    for half in (range(2), range(2, 6)):  # the second start goes on from the stored state of the first
        for k in half:
            parts.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(log)
        stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(log)
        ST.run_effects(ST.judged_hits(stream, 2, 1800, 6 * 3600, "17 days", SLOT), folder, AS_OF, STATE_PARTITIONS)
    now = lambda name: ST.table_now(t.spark, folder, name)
    none = lambda d: F.lit(None).cast(d)
    before = t.shortened_urls.select("short_id", F.col("clicks").alias("was"))
    cast = lambda c: F.col(c).cast("timestamp_ntz")
    out = now("engagements").select(F.lit("mail").alias("kind"), F.col("id").cast("string").alias("name"), F.col("email_opened_count").alias("n"), F.col("clicked_link_count").alias("m"),
                                    cast("email_opened_date").alias("first_at"), cast("clicked_link_date").alias("last_at"), none("double").alias("score"))
    out = out.union(now("links").join(before, "short_id").select(F.lit("link"), "short_id", F.col("clicks"), F.col("clicks") - F.col("was"), none("timestamp_ntz"), cast("last_clicked"), none("double")))
    out = out.union(now("scores").select(F.lit("score"), F.col("contact_id").cast("string"), none("long"), none("long"), none("timestamp_ntz"), none("timestamp_ntz"), "engagement_score"))
    totals = ST.outcome_totals(t.spark, folder, t.spark.read.schema(rows.schema).parquet(log), "17 days", SLOT)
    return out.union(totals.select(F.lit("outcome"), F.concat_ws(": ", "event_type", "outcome"), "n", none("long"), none("timestamp_ntz"), none("timestamp_ntz"), none("double")))


@query("k4_k5_k6_stream_effects", "tracking_events shortened_urls email_engagements", f"""
SELECT e.id, e.email_opened OR o.n IS NOT NULL AS email_opened, coalesce(o.n, 0)::BIGINT AS email_opened_count, e.clicked_link OR c.n IS NOT NULL AS clicked_link, coalesce(c.n, 0)::BIGINT AS clicked_link_count FROM email_engagements e
LEFT JOIN (SELECT tracking_id, count(*) AS n FROM {HITS} WHERE event_type = 'open' GROUP BY 1) o ON o.tracking_id = e.email_id
LEFT JOIN (SELECT l.email_id, count(*) AS n FROM {HITS} h JOIN shortened_urls l ON l.short_id = h.tracking_id WHERE event_type = 'click' GROUP BY 1) c ON c.email_id = e.email_id""")
def _(t):
    """The tables alone: every hit counts as accepted."""
    folder = ST.shared_folder(t.spark, "effects")
    mails = t.email_engagements
    ST.start_tables(mails, t.shortened_urls, E.engagement_scores(mails, AS_OF).drop("base_score"), folder)
    hits = event_stream(t).withColumn("tracking_id", F.expr(
        "CASE WHEN event_type = 'click' THEN 's' || CAST(event_id % 400 AS STRING) ELSE 'm' || CAST(event_id * 2 AS STRING) END"))
    ST.run_effects(hits.withColumn("verdict", F.lit(None).cast("string")), folder, AS_OF)
    return ST.table_now(t.spark, folder, "engagements").select("id", "email_opened", "email_opened_count", "clicked_link", "clicked_link_count")


for stream, batch in (("k2_stream_suppress_repeats", "k2_suppress_repeats"), ("k3_stream_rate_limit", "k3_rate_limit")):
    ORACLES[stream] = ORACLES[batch]
