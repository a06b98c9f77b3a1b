"""Engagement rates and scores, tracking events."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rosterlake.operators import engagement as E
from rosterlake.operators import joins as J
from rosterlake.operators import merge as M
from rosterlake.operators import reports as R
from rosterlake.operators import suppression as K
from rosterlake.plans.registry import query

AS_OF = dt.datetime(2024, 1, 31)

RATES = """count(*)::BIGINT AS sent, count(*) FILTER (email_opened)::BIGINT AS opened, count(*) FILTER (email_replied)::BIGINT AS replied, count(*) FILTER (converted)::BIGINT AS conversions,
 count(*) FILTER (email_opened) * 100.0::DOUBLE / count(*) AS open_rate, count(*) FILTER (email_replied) * 100.0::DOUBLE / count(*) AS reply_rate, count(*) FILTER (converted) * 100.0::DOUBLE / count(*) AS conversion_rate"""

FOLD = """fold AS (SELECT contact_id, count(*) AS mails, count(*) FILTER (email_opened) AS opens, count(*) FILTER (email_replied) AS replies, count(*) FILTER (clicked_link) AS clicks, count(*) FILTER (converted) AS conversions,
 min(email_sent_date) AS first_sent, max(email_sent_date) AS last_sent, arg_max(struct_pack(s := greatest(email_opened_date, email_replied_date, clicked_link_date, conversion_date)), struct_pack(d := email_sent_date, i := id)).s AS seen FROM email_engagements GROUP BY 1),
score AS (SELECT contact_id, base_score, recency_score, frequency_score, depth_score, conversion_score, round(least(100, base_score * 0.2 + r * 0.3 + f * 0.2 + d * 0.15 + c * 0.15), 6) AS engagement_score FROM (SELECT *, round(r, 6) AS recency_score, round(f, 6) AS frequency_score, round(d, 6) AS depth_score, round(c, 6) AS conversion_score FROM (
 SELECT contact_id, (opens * 10 + replies * 30 + clicks * 20 + conversions * 50)::BIGINT AS base_score, coalesce(100 * pow(0.9, floor(date_diff('microsecond', seen, TIMESTAMP '2024-01-31') / 86400000000)), 0)::DOUBLE AS r,
  CASE WHEN mails > 1 THEN least(100, (opens + replies + clicks + conversions) * 30 / greatest(1, floor(date_diff('microsecond', first_sent, last_sent) / 86400000000)) * 20) ELSE 0 END::DOUBLE AS f,
  CASE WHEN opens > 0 THEN least(100, (replies + clicks + conversions) / opens * 100) ELSE 0 END::DOUBLE AS d, CASE WHEN opens + replies + clicks + conversions > 0 THEN least(100, conversions / (opens + replies + clicks + conversions) * 100) ELSE 0 END::DOUBLE AS c FROM fold)))"""


@query("a12_engagement_summary", "email_engagements", f"""
WITH {FOLD} SELECT {RATES}, count(*) FILTER (clicked_link)::BIGINT AS clicked, count(*) FILTER (clicked_link) * 100.0::DOUBLE / count(*) AS click_rate, (SELECT round(avg(engagement_score), 6) FROM score) AS average_score FROM email_engagements""")
def _(t):
    return R.engagement_summary(t.email_engagements, E.engagement_scores(t.email_engagements, AS_OF)).withColumn(
        "average_score", F.round("average_score", 6))


@query("a13_engagement_by_type", "email_engagements contacts organizations", f"""
SELECT org_type, {RATES} FROM email_engagements e JOIN contacts c ON c.id = e.contact_id JOIN organizations o ON o.id = c.organization_id GROUP BY 1""")
def _(t):
    j = J.engagement_with_organization(t.email_engagements, t.contacts, t.organizations)
    return R.engagement_rates(j, "org_type", clicks=False)


@query("a23_contact_fold", "email_engagements", f"""
WITH {FOLD} SELECT contact_id, mails::BIGINT AS mails, opens::BIGINT AS opens, replies::BIGINT AS replies, clicks::BIGINT AS clicks, conversions::BIGINT AS conversions, (opens + replies + clicks + conversions)::BIGINT AS interactions, (opens * 10 + replies * 30 + clicks * 20 + conversions * 50)::BIGINT AS base_score, first_sent, last_sent, seen AS last_interaction FROM fold""")
def _(t):
    return E.contact_fold(t.email_engagements)


@query("c30_engagement_scores", "email_engagements", f"WITH {FOLD} SELECT * FROM score")
def _(t):
    return E.engagement_scores(t.email_engagements, AS_OF).drop("last_calculated")


@query("t2_top_engaged_contacts", "email_engagements contacts", f"""
WITH {FOLD} SELECT s.contact_id, c.email, s.engagement_score FROM score s JOIN contacts c ON c.id = s.contact_id ORDER BY engagement_score DESC, contact_id LIMIT 10""")
def _(t):
    return E.top_contacts(E.engagement_scores(t.email_engagements, AS_OF), t.contacts).select("contact_id", "email", "engagement_score")


@query("m19_k6_refresh_scores", "email_engagements", f"""
WITH {FOLD} SELECT i.contact_id, CASE WHEN i.contact_id IN (SELECT contact_id FROM email_engagements WHERE converted AND email_sent_date >= TIMESTAMP '2024-01-29') THEN s.engagement_score ELSE 0 END AS engagement_score
FROM (SELECT DISTINCT contact_id FROM email_engagements) i JOIN score s ON s.contact_id = i.contact_id""")
def _(t):
    e = t.email_engagements
    stored = e.select("contact_id").distinct().withColumn("engagement_score", F.lit(0.0))
    return E.refresh_scores(stored, e, e.filter("converted AND email_sent_date >= TIMESTAMP '2024-01-29'"), AS_OF)


STATUS = "SELECT 'm' || CAST(event_id AS {s}) AS email_id, value > 10 AS opened, value > 60 AS replied, value > 30 AS clicked, ts AS opened_date, ts AS replied_date, ts AS clicked_date FROM {e} WHERE event_type <> 'error'"


@query("k7_status_poll", "email_engagements", f"""
WITH s AS ({STATUS.format(s='VARCHAR', e='events')}) SELECT e.id, e.email_opened OR coalesce(s.opened AND p, false) AS email_opened, e.email_replied OR coalesce(s.replied AND p, false) AS email_replied, e.clicked_link OR coalesce(s.clicked AND p, false) AS clicked_link,
 coalesce(s.opened AND p AND NOT e.email_opened, false) AS new_opened, coalesce(s.email_id IS NOT NULL AND p, false) AS tracked FROM (SELECT *, email_sent_date >= TIMESTAMP '2024-01-11' AS p FROM email_engagements) e LEFT JOIN s ON s.email_id = e.email_id""")
def _(t):
    s = t.spark.sql(STATUS.format(s="STRING", e="{e}"), e=t.events)
    return E.apply_status_poll(t.email_engagements, s, AS_OF, 20).select(
        "id", "email_opened", "email_replied", "clicked_link", "new_opened", F.col("last_tracked").isNotNull().alias("tracked"))


@query("k7_poll_metrics", "email_engagements", f"""
WITH s AS ({STATUS.format(s='VARCHAR', e='events')}) SELECT count(*)::BIGINT AS emails_processed, count(*) FILTER (s.opened AND NOT e.email_opened)::BIGINT AS new_opens, count(*) FILTER (s.replied AND NOT e.email_replied)::BIGINT AS new_replies, count(*) FILTER (s.clicked AND NOT e.clicked_link)::BIGINT AS new_clicks
FROM email_engagements e JOIN s ON s.email_id = e.email_id WHERE email_sent_date >= TIMESTAMP '2024-01-11'""")
def _(t):
    s = t.spark.sql(STATUS.format(s="STRING", e="{e}"), e=t.events)
    return E.poll_metrics(E.apply_status_poll(t.email_engagements, s, AS_OF, 20))


@query("k8_replied_conversations", "", "SELECT conv_id, count(*)::BIGINT AS messages, count(*) > 1 AS replied FROM conversations GROUP BY 1")
def _(t):
    return E.replied_conversations(t.conversations, "conv_id")


@query("k1_parse_tracking_lines", "tracking_events", """
SELECT event_id, event_type, tracking_id, ip_address, user_agent, '' AS referrer FROM tracking_events""")
def _(t):
    from rosterlake.sources.tracking import format_line, parse_lines
    lines = t.tracking_events.withColumn("referrer", F.lit("")).select("event_id", format_line().alias("value"))
    return parse_lines(lines, keep=["event_id"]).drop("ts")


@query("k2_suppress_repeats_6h_in_chunks", "tracking_events", """
WITH RECURSIVE e AS (SELECT event_type, tracking_id, ts, min(event_id) AS event_id FROM tracking_events GROUP BY 1, 2, 3),
nx AS (SELECT *, min(ts) OVER (PARTITION BY event_type, tracking_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS nts FROM e),
acc AS (SELECT event_type, tracking_id, min(ts) AS ts FROM e GROUP BY 1, 2 UNION ALL SELECT acc.event_type, acc.tracking_id, nx.nts FROM acc JOIN nx ON nx.event_type = acc.event_type AND nx.tracking_id = acc.tracking_id AND nx.ts = acc.ts WHERE nx.nts IS NOT NULL)
SELECT e.event_type, e.tracking_id, e.event_id FROM acc JOIN e ON e.event_type = acc.event_type AND e.tracking_id = acc.tracking_id AND e.ts = acc.ts""")
def _(t):
    return K.suppress_repeats(t.tracking_events, seconds=6 * 3600, long_run=100, chunk_seconds=24 * 3600)


@query("k2_suppress_repeats", "tracking_events", """
WITH RECURSIVE e AS (SELECT event_type, tracking_id, ts, min(event_id) AS event_id FROM tracking_events GROUP BY 1, 2, 3),
nx AS (SELECT *, min(ts) OVER (PARTITION BY event_type, tracking_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nts FROM e),
acc AS (SELECT event_type, tracking_id, min(ts) AS ts FROM e GROUP BY 1, 2 UNION ALL SELECT acc.event_type, acc.tracking_id, nx.nts FROM acc JOIN nx ON nx.event_type = acc.event_type AND nx.tracking_id = acc.tracking_id AND nx.ts = acc.ts WHERE nx.nts IS NOT NULL)
SELECT e.event_type, e.tracking_id, e.event_id FROM acc JOIN e ON e.event_type = acc.event_type AND e.tracking_id = acc.tracking_id AND e.ts = acc.ts""")
def _(t):
    return K.suppress_repeats(t.tracking_events)


@query("k3_rate_limit", "tracking_events", """
SELECT event_id, row_number() OVER (PARTITION BY ip_address, burst ORDER BY ts, event_id) <= 2 AS allowed FROM (SELECT *, sum(nw) OVER (PARTITION BY ip_address ORDER BY ts, event_id) AS burst FROM (
 SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY ip_address ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true) THEN 1 ELSE 0 END AS nw FROM tracking_events))""")
def _(t):
    return K.rate_limit(t.tracking_events, limit=2, gap_seconds=1800).select("event_id", "allowed")


def _hits(t):
    return t.tracking_events.withColumn("tracking_id", F.expr(
        "CASE WHEN event_type = 'click' THEN 's' || CAST(event_id % 400 AS STRING) ELSE 'm' || CAST(event_id * 2 AS STRING) END"))


HITS = "(SELECT * REPLACE (CASE WHEN event_type = 'click' THEN 's' || CAST(event_id % 400 AS VARCHAR) ELSE 'm' || CAST(event_id * 2 AS VARCHAR) END AS tracking_id) FROM tracking_events)"


@query("k4_apply_opens", "tracking_events email_engagements", f"""
SELECT e.id, e.email_opened OR n IS NOT NULL AS email_opened, coalesce(e.email_opened_date, x.f) AS email_opened_date, coalesce(n, 0)::BIGINT AS email_opened_count FROM email_engagements e LEFT JOIN (SELECT tracking_id, min(ts) AS f, count(*) AS n FROM {HITS} WHERE event_type = 'open' GROUP BY 1) x ON x.tracking_id = e.email_id""")
def _(t):
    return E.apply_opens(t.email_engagements, _hits(t).filter("event_type = 'open'")).select(
        "id", "email_opened", "email_opened_date", "email_opened_count")


@query("k5_apply_clicks_to_links", "tracking_events shortened_urls", f"""
SELECT l.short_id, (l.clicks + coalesce(n, 0))::BIGINT AS clicks, x.f AS last_clicked FROM shortened_urls l LEFT JOIN (SELECT tracking_id, max(ts) AS f, count(*) AS n FROM {HITS} WHERE event_type = 'click' GROUP BY 1) x ON x.tracking_id = l.short_id""")
def _(t):
    return E.apply_clicks_to_links(t.shortened_urls, _hits(t).filter("event_type = 'click'")).select("short_id", "clicks", "last_clicked")


@query("k5_apply_clicks_to_mails", "tracking_events shortened_urls email_engagements", f"""
SELECT e.id, e.clicked_link OR n IS NOT NULL AS clicked_link, coalesce(e.clicked_link_date, x.f) AS clicked_link_date, coalesce(n, 0)::BIGINT AS clicked_link_count FROM email_engagements e
LEFT JOIN (SELECT l.email_id, min(ts) AS f, count(*) AS n FROM {HITS} h JOIN shortened_urls l ON l.short_id = h.tracking_id WHERE event_type = 'click' GROUP BY 1) x ON x.email_id = e.email_id""")
def _(t):
    return E.apply_clicks_to_mails(t.email_engagements, t.shortened_urls, _hits(t).filter("event_type = 'click'")).select(
        "id", "clicked_link", "clicked_link_date", "clicked_link_count")


@query("k9_device_breakdown", "tracking_events", """
SELECT CASE event_id % 4 WHEN 1 THEN 'mobile' WHEN 2 THEN 'mobile' ELSE 'desktop' END AS device_type, CASE event_id % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' WHEN 2 THEN 'Firefox' ELSE 'unknown' END AS browser,
 CASE event_id % 4 WHEN 0 THEN 'Windows' WHEN 1 THEN 'macOS' WHEN 2 THEN 'Linux' ELSE 'unknown' END AS os, count(*)::BIGINT AS n FROM tracking_events WHERE event_type = 'click' GROUP BY 1, 2, 3""")
def _(t):
    return K.device_breakdown(t.tracking_events.filter("event_type = 'click'"))


@query("k10_outcome_counts", "tracking_events shortened_urls email_engagements", f"""
SELECT event_type, outcome, count(*)::BIGINT AS n, outcome LIKE '%recorded' AS accepted FROM (SELECT e.event_type, CASE WHEN e.event_type = 'open' AND m.contact_id IS NULL THEN 'Email not found' WHEN e.event_type = 'click' AND l.short_id IS NULL THEN 'Link not found' WHEN e.event_type = 'open' THEN 'Open recorded' ELSE 'Click recorded' END AS outcome
FROM {HITS} e LEFT JOIN shortened_urls l ON e.event_type = 'click' AND l.short_id = e.tracking_id LEFT JOIN email_engagements m ON e.event_type = 'open' AND m.email_id = e.tracking_id) GROUP BY 1, 2""")
def _(t):
    return K.outcome_counts(J.resolve_tracking(_hits(t), t.shortened_urls, t.email_engagements))
