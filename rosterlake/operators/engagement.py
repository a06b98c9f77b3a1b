"""Engagement of contacts with mails: folds, scores, status polls, replies."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.operators.predicates import ts

# ---- fixed values ---------------------------------------------------------------------------
POINTS = {"opens": 10, "replies": 30, "clicks": 20, "conversions": 50}
DAILY_DECAY = 0.9
WEIGHTS = {"base": 0.2, "recency": 0.3, "frequency": 0.2, "depth": 0.15, "conversion": 0.15}
# ---- end of fixed values --------------------------------------------------------------------

FLAGS = {"opens": "email_opened", "replies": "email_replied", "clicks": "clicked_link", "conversions": "converted"}


def whole_days(later: Column, earlier: Column) -> Column:
    us = [F.unix_micros(c.cast("timestamp")) for c in (later, earlier)]
    return F.floor((us[0] - us[1]) / F.lit(86_400_000_000)).cast("long")


def contact_fold(engagements: DataFrame) -> DataFrame:
    """Totals, first and last mail and the last interaction of the newest mail per contact: one aggregate."""
    counts = [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(k) for k, c in FLAGS.items()]
    seen = F.greatest("email_opened_date", "email_replied_date", "clicked_link_date", "conversion_date")
    g = engagements.groupBy("contact_id").agg(
        F.count("*").alias("mails"), *counts, F.min("email_sent_date").alias("first_sent"), F.max("email_sent_date").alias("last_sent"),
        F.max_by(F.struct(seen.alias("seen")), F.struct("email_sent_date", "id")).alias("_newest"))
    total = F.col("opens") + F.col("replies") + F.col("clicks") + F.col("conversions")
    base = sum((F.col(k) * v for k, v in POINTS.items()), F.lit(0))
    return g.select("contact_id", "mails", *FLAGS, total.alias("interactions"), base.alias("base_score"), "first_sent", "last_sent",
                    F.col("_newest.seen").alias("last_interaction"))


def engagement_scores(engagements: DataFrame, as_of: dt.datetime) -> DataFrame:
    f = contact_fold(engagements)
    zero = F.lit(0.0)
    days = whole_days(ts(as_of), F.col("last_interaction"))
    recency = F.coalesce(F.lit(100.0) * F.pow(F.lit(DAILY_DECAY), days), zero)
    span = F.greatest(F.lit(1), whole_days(F.col("last_sent"), F.col("first_sent")))
    frequency = F.when(F.col("mails") > 1, F.least(F.lit(100.0), F.col("interactions") * 30 / span * 20)).otherwise(zero)
    deeper = F.col("replies") + F.col("clicks") + F.col("conversions")
    depth = F.when(F.col("opens") > 0, F.least(F.lit(100.0), deeper / F.col("opens") * 100)).otherwise(zero)
    conv = F.when(F.col("interactions") > 0, F.least(F.lit(100.0), F.col("conversions") / F.col("interactions") * 100)).otherwise(zero)
    q = (f.withColumn("recency_score", recency).withColumn("frequency_score", frequency).withColumn("depth_score", depth)
          .withColumn("conversion_score", conv))
    total = (F.col("base_score") * WEIGHTS["base"] + F.col("recency_score") * WEIGHTS["recency"] + F.col("frequency_score") * WEIGHTS["frequency"]
             + F.col("depth_score") * WEIGHTS["depth"] + F.col("conversion_score") * WEIGHTS["conversion"])
    scores = ["recency_score", "frequency_score", "depth_score", "conversion_score"]
    return q.select("contact_id", F.round(F.least(F.lit(100.0), total), 6).alias("engagement_score"), "base_score",
                    *[F.round(c, 6).alias(c) for c in scores], ts(as_of).alias("last_calculated"))


def refresh_scores(stored: DataFrame, engagements: DataFrame, touched: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Recompute only the contacts in ``touched``; all other scores stay."""
    from rosterlake.operators.merge import replace_scores
    mine = engagements.join(touched.select("contact_id").distinct(), "contact_id", "left_semi")
    return replace_scores(stored, engagement_scores(mine, as_of).select(*stored.columns))


def top_contacts(scores: DataFrame, contacts: DataFrame, n: int = 10) -> DataFrame:
    """Highest scores first. Cut before the join, so the join sees n rows (a score needs a stored contact)."""
    known = scores.join(contacts.select(F.col("id").alias("contact_id")), "contact_id", "left_semi")
    top = known.orderBy(F.desc("engagement_score"), F.asc("contact_id")).limit(n)
    return top.join(contacts.withColumnRenamed("id", "contact_id"), "contact_id")


def apply_status_poll(engagements: DataFrame, status: DataFrame, as_of: dt.datetime, days_back: int | None = None) -> DataFrame:
    """Flags only ever go from false to true; new ones are marked. ``status`` holds one row per mail with
    opened / replied / clicked and their dates. Mails outside the period are left alone."""
    e = engagements
    recent = F.lit(True) if days_back is None else F.col("email_sent_date") >= ts(as_of - dt.timedelta(days=days_back))
    s = status.groupBy("email_id").agg(*[F.bool_or(c).alias(f"_{c}") for c in ("opened", "replied", "clicked")],
                                       *[F.min(f"{c}_date").alias(f"_{c}_date") for c in ("opened", "replied", "clicked")])
    j = e.join(s, "email_id", "left")
    polled = F.col("_opened").isNotNull() & recent
    out = {"opened": ("email_opened", "email_opened_date"), "replied": ("email_replied", "email_replied_date"),
           "clicked": ("clicked_link", "clicked_link_date")}
    for name, (flag, date) in out.items():
        fresh = polled & F.coalesce(F.col(f"_{name}"), F.lit(False)) & ~F.coalesce(F.col(flag), F.lit(False))
        j = j.withColumn(f"new_{name}", fresh)
    for name, (flag, date) in out.items():
        j = j.withColumn(date, F.when(F.col(f"new_{name}"), F.col(f"_{name}_date")).otherwise(F.col(date))).withColumn(
            flag, F.col(f"new_{name}") | F.coalesce(F.col(flag), F.lit(False)))
    j = j.withColumn("last_tracked", F.when(polled, ts(as_of)))
    return j.drop(*[c for c in j.columns if c.startswith("_")])


def poll_metrics(polled: DataFrame) -> DataFrame:
    return polled.agg(F.count_if(F.col("last_tracked").isNotNull()).alias("emails_processed"),
                      *[F.count_if(F.col(f"new_{n}")).alias(f"new_{p}") for n, p in (("opened", "opens"), ("replied", "replies"), ("clicked", "clicks"))])


def replied_conversations(messages: DataFrame, conversation: str = "conversation_id") -> DataFrame:
    """Conversations with more than one message."""
    return messages.groupBy(conversation).agg(F.count("*").alias("messages")).withColumn("replied", F.col("messages") > 1)


# ---- effect of tracking events on the stored tables -----------------------------------------

def apply_opens(engagements: DataFrame, opens: DataFrame) -> DataFrame:
    """First open date is kept, the counter grows. ``opens`` = accepted open events; unknown mails change nothing."""
    g = opens.groupBy(F.col("tracking_id").alias("email_id")).agg(F.min("ts").alias("_first"), F.count("*").alias("_n"))
    first_row = engagements.groupBy("email_id").agg(F.min("id").alias("id"))
    j = engagements.join(g.join(first_row, "email_id").select("id", "_first", "_n"), "id", "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    count = F.coalesce(F.col("email_opened_count"), F.lit(0)) if "email_opened_count" in engagements.columns else F.lit(0)
    return (j.withColumn("email_opened", F.coalesce(F.col("email_opened"), F.lit(False)) | (n > 0))
            .withColumn("email_opened_date", F.coalesce("email_opened_date", "_first"))
            .withColumn("email_opened_count", (count + n).cast("long")).drop("_first", "_n"))


def apply_clicks_to_links(links: DataFrame, clicks: DataFrame) -> DataFrame:
    g = clicks.groupBy(F.col("tracking_id").alias("short_id")).agg(F.max("ts").alias("_last"), F.count("*").alias("_n"))
    j = links.join(g, "short_id", "left")
    last = F.col("last_clicked") if "last_clicked" in links.columns else F.lit(None).cast(clicks.schema["ts"].dataType)
    return (j.withColumn("clicks", (F.coalesce(F.col("clicks"), F.lit(0)) + F.coalesce(F.col("_n"), F.lit(0))).cast("long"))
            .withColumn("last_clicked", F.greatest(last, F.col("_last"))).drop("_last", "_n"))


def apply_clicks_to_mails(engagements: DataFrame, links: DataFrame, clicks: DataFrame) -> DataFrame:
    """Clicks counted per link first, then per mail: the hot link is one row when it meets the links."""
    per_link = clicks.groupBy(F.col("tracking_id").alias("short_id")).agg(F.min("ts").alias("_first"), F.count("*").alias("_n"))
    link = links.groupBy("short_id").agg(F.min("email_id").alias("email_id"))
    g = per_link.join(link, "short_id").groupBy("email_id").agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"))
    first_row = engagements.groupBy("email_id").agg(F.min("id").alias("id"))
    j = engagements.join(g.join(first_row, "email_id").select("id", "_first", "_n"), "id", "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    count = F.coalesce(F.col("clicked_link_count"), F.lit(0)) if "clicked_link_count" in engagements.columns else F.lit(0)
    return (j.withColumn("clicked_link", F.coalesce(F.col("clicked_link"), F.lit(False)) | (n > 0))
            .withColumn("clicked_link_date", F.coalesce("clicked_link_date", "_first"))
            .withColumn("clicked_link_count", (count + n).cast("long")).drop("_first", "_n"))


def touched_contacts(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("outcome").endswith("recorded") & F.col("contact_id").isNotNull()).select("contact_id").distinct()
