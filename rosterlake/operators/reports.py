"""Dashboard and report aggregates. Each is one grouped pass; nothing is collected into lists."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.text import col, lookup
from rosterlake.operators.predicates import has_value, ts


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part/whole in percent, 0 when there is nothing to divide by."""
    v = F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))
    return v if digits is None else F.round(v, digits)


def n_if(cond: Column, name: str) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).alias(name)


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side: a union with the missing columns NULL, then the one value of each."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def overview(orgs: DataFrame, contacts: DataFrame, urls: DataFrame, start: dt.datetime,
             org_high: float = 0.8, contact_high: float = 7.0) -> DataFrame:
    s = ts(start)
    o = orgs.agg(F.count("*").alias("organizations"), n_if(F.col("date_added") >= s, "new_organizations"),
                 n_if(F.col("relevance_score") >= org_high, "relevant_organizations"))
    c = contacts.agg(F.count("*").alias("contacts"), n_if(F.col("date_added") >= s, "new_contacts"),
                     n_if(F.col("contact_relevance_score") >= contact_high, "relevant_contacts"))
    u = urls.agg(n_if(F.col("last_crawled") >= s, "urls_crawled"))
    return one_row(o, c, u)


def email_overview(contacts: DataFrame, start: dt.datetime, high_confidence: float = 0.8) -> DataFrame:
    drafted = F.col("email_draft_created")
    return contacts.agg(
        n_if(drafted, "drafts"), n_if(drafted & (F.col("email_draft_date") >= ts(start)), "new_drafts"),
        n_if(F.col("email_valid"), "valid_emails"),
        n_if(F.col("contact_confidence_score") >= high_confidence, "confident"), F.count("*").alias("contacts"),
    ).withColumn("draft_rate", percent(F.col("drafts"), F.col("contacts")))


def growth(df: DataFrame, column: str, since: dt.datetime, digits: int = 1) -> DataFrame:
    return df.agg(F.count("*").alias("total"), n_if(F.col(column) >= ts(since), "new")).withColumn(
        "growth", percent(F.col("new"), F.col("total"), digits))


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def count_by_state(orgs: DataFrame) -> DataFrame:
    return count_by(orgs.filter(has_value("state")), "state")


def daily_counts(parts: dict[str, tuple[DataFrame, str]], start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Rows per day and label over several tables; a table without rows simply adds none."""
    out = None
    for label, (df, c) in parts.items():
        p = (df.filter(F.col(c).between(ts(start), ts(end))).groupBy(F.to_date(c).alias("day"))
             .agg(F.count("*").alias("n")).withColumn("kind", F.lit(label)))
        out = p if out is None else out.unionByName(p)
    return out


def drafts_per_user(contacts: DataFrame, since: dt.datetime) -> DataFrame:
    q = contacts.filter(F.col("email_draft_created") & (F.col("email_draft_date") >= ts(since)) & has_value("assigned_to"))
    return count_by(q, "assigned_to", name="drafts")


def daily_sent(engagements: DataFrame) -> DataFrame:
    return engagements.groupBy(F.to_date("email_sent_date").alias("day")).agg(F.count("*").alias("sent"))


def daily_performance(orgs: DataFrame, contacts: DataFrame, fanout: bool = False) -> DataFrame:
    """Per day: average relevance x 10, organizations and contacts. ``fanout`` repeats an organization once per
    contact in average and count, as a plain outer join does; done by weights, the join itself stays one row each."""
    n = contacts.groupBy("organization_id").agg(F.count("id").alias("contacts")).withColumnRenamed("organization_id", "id")
    q = orgs.join(n, "id", "left").withColumn("contacts", F.coalesce("contacts", F.lit(0)).cast("long"))
    q = q.withColumn("w", F.greatest(F.col("contacts"), F.lit(1)) if fanout else F.lit(1).cast("long"))
    rel = F.col("relevance_score")
    return q.filter(F.col("date_added").isNotNull()).groupBy(F.to_date("date_added").alias("day")).agg(
        F.try_divide(F.sum(rel * F.col("w")) * 10, F.sum(F.when(rel.isNotNull(), F.col("w")))).alias("avg_relevance"),
        F.sum("w").alias("organizations"), F.sum("contacts").alias("contacts"))


def metrics_long(metrics: DataFrame, labels: dict[str, str], date: str = "metric_date") -> DataFrame:
    """Wide run metrics -> (date, metric, label, value)."""
    long = metrics.unpivot([date], list(labels), "metric", "value")
    return long.withColumn("label", lookup("metric", labels))


def thin_organizations(orgs: DataFrame, contacts: DataFrame, below: int = 3, limit: int | None = None) -> DataFrame:
    n = contacts.groupBy("organization_id").agg(F.count("id").alias("contact_count")).withColumnRenamed("organization_id", "id")
    q = (orgs.join(n, "id", "left").withColumn("contact_count", F.coalesce("contact_count", F.lit(0)).cast("long"))
         .filter(F.col("contact_count") < below).orderBy(F.desc("relevance_score"), "id"))
    return q if limit is None else q.limit(limit)


def engagement_rates(df: DataFrame, *keys: str, clicks: bool = True) -> DataFrame:
    """Counts and rates in percent of mails sent, overall or per key."""
    aggs = [F.count("*").alias("sent"), n_if(F.col("email_opened"), "opened"), n_if(F.col("email_replied"), "replied"),
            n_if(F.col("clicked_link"), "clicked"), n_if(F.col("converted"), "conversions")]
    g = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    rates = {"open_rate": "opened", "reply_rate": "replied", "conversion_rate": "conversions"}
    if clicks:
        rates["click_rate"] = "clicked"
    for out, c in rates.items():
        g = g.withColumn(out, percent(F.col(c), F.col("sent")))
    return g if clicks else g.drop("clicked")


def engagement_summary(engagements: DataFrame, scores: DataFrame) -> DataFrame:
    avg = scores.agg(F.coalesce(F.avg("engagement_score"), F.lit(0.0)).alias("average_score"))
    return one_row(engagement_rates(engagements), avg)


def click_statistics(links: DataFrame, contact_id: int | None = None, email_id: str | None = None,
                     since: dt.datetime | None = None) -> DataFrame:
    """Links, clicks and clicks per link for every link type and, as `(all)`, in total: one rollup."""
    if contact_id is not None:
        links = links.filter(F.col("contact_id") == contact_id)
    if email_id is not None:
        links = links.filter(F.col("email_id") == email_id)
    if since is not None:
        links = links.filter(F.col("created_date") >= ts(since))
    typed = links.withColumn("link_type", F.coalesce("link_type", F.lit("general")))
    g = typed.rollup("link_type").agg(F.count("*").alias("links"), F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"))
    return g.withColumn("link_type", F.coalesce("link_type", F.lit("(all)"))).withColumn(
        "clicks_per_link", F.coalesce(F.try_divide(F.col("clicks").cast("double"), F.col("links")), F.lit(0.0)))


def validation_summary(reports: DataFrame) -> DataFrame:
    ok = F.col("auto_send_approved")
    return reports.agg(F.count("*").alias("total"), n_if(ok, "approved"), n_if(~ok, "rejected")).withColumn(
        "approval_rate", percent(F.col("approved"), F.col("total")))


def score_pairs(reports: DataFrame) -> DataFrame:
    return reports.filter(F.col("contact_score").isNotNull() & F.col("org_score").isNotNull()).select(
        "id", "contact_score", "org_score", "auto_send_approved")


def listing_with_totals(df: DataFrame, group: str, items: Sequence[str]) -> DataFrame:
    """Listing per group with the group's total on every row; items stay rows, so no group is ever gathered."""
    totals = df.groupBy(group).agg(F.count("*").alias("total"))
    return df.select(group, *items).join(totals, group)


def run_counters(results: DataFrame, *dims: str) -> DataFrame:
    """Counts by each of several dimensions in one pass (grouping sets of single columns)."""
    g = results.groupingSets([[d] for d in dims], *dims).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    top = 2 ** len(dims) - 1
    picks = [(top - 2 ** (len(dims) - 1 - i), d) for i, d in enumerate(dims)]
    name = value = None
    for gid, d in picks:
        hit = F.col("gid") == gid
        v = F.col(d).cast("string")
        name = F.when(hit, F.lit(d)) if name is None else name.when(hit, F.lit(d))
        value = F.when(hit, v) if value is None else value.when(hit, v)
    return g.select(name.alias("dimension"), value.alias("value"), "n")


def client_counts(orgs: DataFrame, high: float = 7.0) -> DataFrame:
    comp = F.coalesce(F.col("is_competitor"), F.lit(False))
    return orgs.agg(n_if(comp, "competitors"), n_if(~comp, "potential_clients"),
                    n_if(~comp & (F.col("relevance_score") >= high), "high_relevance"))


def page_evidence(urls: DataFrame) -> DataFrame:
    """Per organization over its pages: pages, pages with infrastructure, projects, automation projects."""
    projects = F.from_json("project_data", "array<struct<title:string,contains_automation:boolean>>")
    q = urls.withColumn("_p", projects)
    auto = F.size(F.filter("_p", lambda p: F.coalesce(p["contains_automation"], F.lit(False))))
    return q.groupBy("organization_id").agg(
        F.count("*").alias("pages"), n_if(F.col("contains_infrastructure"), "infrastructure_pages"),
        F.coalesce(F.sum(F.when(F.col("_p").isNotNull(), F.size("_p"))), F.lit(0)).alias("projects"),
        F.coalesce(F.sum(F.when(F.col("_p").isNotNull(), auto)), F.lit(0)).alias("automation_projects"))


def industry_maximum(urls: DataFrame) -> DataFrame:
    """Largest indicator per organization and industry over its pages, as rows."""
    m = F.from_json("industry_indicators", "map<string,double>")
    return (urls.select("organization_id", F.explode(m).alias("industry", "score"))
            .groupBy("organization_id", "industry").agg(F.max("score").alias("score")))


def industry_maps(urls: DataFrame) -> DataFrame:
    """The same as one map per organization; bounded by the number of industries."""
    return industry_maximum(urls).groupBy("organization_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("industry", "score")))).alias("industry_indicators"))


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    return df.filter(has_value(c)).select(c).distinct().orderBy(c)


def engaged_contacts(contacts: DataFrame, engagements: DataFrame) -> DataFrame:
    return contacts.join(engagements.select(F.col("contact_id").alias("id")), "id", "left_semi")


def rejection_rates(decisions: DataFrame, kind: str, rejected: Column) -> DataFrame:
    return decisions.groupBy(kind).agg(F.count("*").alias("validated"), n_if(rejected, "rejected")).withColumn(
        "rejection_rate", F.coalesce(F.try_divide(F.col("rejected").cast("double"), F.col("validated")), F.lit(0.0)))


def contact_run_metrics(contacts: DataFrame, generic: Column, valid: Column, high: float = 7.0) -> DataFrame:
    return contacts.agg(F.count("*").alias("contacts"), n_if(valid, "with_valid_email"),
                        n_if(F.col("contact_relevance_score") >= high, "relevant"), n_if(~generic, "actual"),
                        n_if(generic, "generic"))


def eligibility_by_type(contacts: DataFrame, orgs: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    ok = ((~F.col("email_draft_created")) & has_value("email") & (F.col("contact_confidence_score") >= min_confidence))
    per_org = contacts.groupBy("organization_id").agg(F.count("*").alias("total"), n_if(ok, "eligible"))
    o = orgs.select(F.col("id").alias("organization_id"), "org_type")
    return per_org.join(o, "organization_id").groupBy("org_type").agg(
        F.sum("total").alias("total"), F.sum("eligible").alias("eligible"))


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def table_page(df: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)


def ranked_lists(orgs: DataFrame, contacts: DataFrame, per_contact: int = 5) -> DataFrame:
    """Report section rows: best clients, competitors, and the contacts of the best organizations."""
    from rosterlake.operators.selection import rank_within
    comp = F.coalesce(F.col("is_competitor"), F.lit(False))
    order = [F.desc("relevance_score"), F.asc("id")]

    def section(df: DataFrame, name: str, n: int) -> DataFrame:
        top = df.orderBy(*order).limit(n)
        return top.select(F.lit(name).alias("section"), F.col("id").alias("organization_id"), "name",
                          F.col("relevance_score").alias("score"), F.lit(None).cast("long").alias("contact_id"))

    clients = section(orgs.filter(~comp & (F.col("relevance_score") >= 6)), "clients", 20)
    rivals = section(orgs.filter(comp), "competitors", 10)
    best = orgs.filter(~comp & (F.col("relevance_score") >= 7)).orderBy(*order).limit(10).select(
        F.col("id").alias("organization_id"), "name")
    people = rank_within(contacts.join(best, "organization_id"), ["organization_id"],
                         [F.coalesce("contact_relevance_score", F.lit(0.0)).desc(), F.asc("id")], per_contact)
    rows = people.select(F.lit("contacts").alias("section"), "organization_id", "name",
                         F.col("contact_relevance_score").alias("score"), F.col("id").alias("contact_id"))
    return clients.unionByName(rivals).unionByName(rows)


def report_rows(section: str, df: DataFrame, key: str | Column, value: str | Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), col(key).cast("string").alias("key"),
                     col(value).cast("double").alias("value"))
