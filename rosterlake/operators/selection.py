"""Best rows, quotas and ordered cuts.

``row_number() <= n`` is planned by Spark with a group limit below the shuffle, so each task sends at most n rows of
a group however large the group is. One-best with more needs than a rank uses an aggregate instead.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.text import any_word, blank_to_null, col, nonblank
from rosterlake.functions.urls import BLOCKED_RESULT_SITES
from rosterlake.operators.predicates import first_listed, has_value, in_list


GROUP_LIMIT = 1000  # default of spark.sql.optimizer.windowGroupLimitThreshold


def rank_within(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int,
                rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group; ``order`` must end in a unique column.

    Spark limits groups below the shuffle only up to ``GROUP_LIMIT`` rows; for more, each group is first cut in
    parts by input partition, so that a hot group is spread over many tasks before its final rank.
    """
    if n > GROUP_LIMIT:
        part = df.withColumn("_part", F.spark_partition_id() % 64)
        w = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = part.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank", "_part")
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("_rank", r).filter(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def eligible_contacts(contacts: DataFrame, orgs: DataFrame, min_confidence: float = 0.7,
                      org_types: Sequence[str] | None = None, assigned_types: Sequence[str] | None = None,
                      states: Sequence[str] | None = None) -> DataFrame:
    """Undrafted contacts with an e-mail and enough confidence, in the wanted types and states."""
    c = contacts.filter((~F.col("email_draft_created")) & has_value("email")
                        & (F.col("contact_confidence_score") >= min_confidence))
    o = in_list(in_list(orgs, "org_type", org_types, assigned_types), "state", states)
    o = o.select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name"), "org_type", "state")
    return c.join(o, "organization_id")


def best_contact_per_organization(contacts: DataFrame, orgs: DataFrame, limit: int | None = None,
                                  min_confidence: float = 0.7, org_types: Sequence[str] | None = None,
                                  assigned_types: Sequence[str] | None = None,
                                  states: Sequence[str] | None = None) -> DataFrame:
    """One contact per organization: relevance, then confidence, then newest; organizations with the newest
    eligible contact first. Both facts come from one aggregate with map-side merging, so no group is gathered."""
    c = eligible_contacts(contacts, orgs, min_confidence, org_types, assigned_types, states)
    key = F.struct(F.coalesce("contact_relevance_score", F.lit(0.0)).alias("r"),
                   F.coalesce("contact_confidence_score", F.lit(0.0)).alias("c"), F.col("date_added").alias("d"),
                   (-F.col("id")).alias("i"))
    row = F.struct("id", "first_name", "last_name", "email", "job_title", "contact_relevance_score",
                   "contact_confidence_score", "date_added", "organization_name", "org_type", "state")
    best = c.groupBy("organization_id").agg(F.max_by(row, key).alias("b"), F.max("date_added").alias("newest"))
    out = best.select("organization_id", "b.*", "newest")
    return out if limit is None else out.orderBy(F.desc("newest"), F.asc("organization_id")).limit(limit)


def survivor_order(confidence: str = "contact_confidence_score") -> list[Column]:
    """Best row of an e-mail group first: confidence, filled fields, newest, lowest id."""
    return [F.coalesce(F.col(confidence), F.lit(0.0)).desc(),
            *[nonblank(x).desc() for x in ("first_name", "last_name", "job_title", "phone")],
            F.col("date_added").desc_nulls_last(), F.asc("id")]


def latest_engagement(engagements: DataFrame) -> DataFrame:
    """Newest mail per contact (highest id among equals)."""
    row = F.struct(*engagements.columns)
    return engagements.groupBy("contact_id").agg(
        F.max_by(row, F.struct("email_sent_date", "id")).alias("r")).select("r.*")


def first_per_domain(results: DataFrame, domain: Column, order: str = "pos") -> DataFrame:
    return rank_within(results.withColumn("domain", domain), ["domain"], [F.asc(order)], 1)


def distinct_contacts(contacts: DataFrame, seq: str = "id", relevance: str = "contact_relevance_score",
                      first: str = "first_name", last: str = "last_name") -> DataFrame:
    """Two passes in one: best relevance per e-mail; rows without one, best per full name; no key, no row."""
    email = F.lower(F.trim(blank_to_null("email")))
    name = F.concat_ws(" ", F.lower(F.trim(blank_to_null(first))), F.lower(F.trim(blank_to_null(last))))
    keyed = (contacts.withColumn("_kind", F.when(email.isNotNull(), "email").otherwise("name"))
             .withColumn("_key", F.coalesce(email, F.when(name != "", name))).filter(F.col("_key").isNotNull()))
    return rank_within(keyed, ["_kind", "_key"],
                       [F.coalesce(F.col(relevance), F.lit(0.0)).desc(), F.asc(seq)], 1).drop("_kind", "_key")


def first_contact_per_key(contacts: DataFrame, seq: str = "id") -> DataFrame:
    """One pass: first row per lower-case e-mail, else per `first-last` as written."""
    email = F.lower(blank_to_null("email"))
    key = F.coalesce(F.concat(F.lit("e:"), email), F.concat(F.lit("n:"), F.coalesce("first_name", F.lit("")), F.lit("-"),
                                                            F.coalesce("last_name", F.lit(""))))
    return rank_within(contacts.withColumn("_key", key), ["_key"], [F.asc(seq)], 1).drop("_key")


def new_distinct_organizations(found: DataFrame, stored: DataFrame, seq: str = "seq") -> DataFrame:
    """First find per (name, state) without case, unless stored under exactly that name and state."""
    firsts = rank_within(found, [F.lower("name"), F.lower("state")], [F.asc(seq)], 1)
    return firsts.join(stored.select("name", "state"), ["name", "state"], "left_anti")


def quota_per_user(contacts: DataFrame, orgs: DataFrame, assignments: DataFrame, per_user: int) -> DataFrame:
    """First N open contacts by id for each user, over the organization types assigned to that user."""
    a = assignments.groupBy("org_type").agg(F.min_by("assigned_to", "rank").alias("user"))
    o = orgs.select(F.col("id").alias("organization_id"), "org_type")
    open_rows = contacts.filter((~F.col("email_draft_created")) & has_value("email"))
    j = open_rows.join(o, "organization_id").join(a, "org_type")
    return rank_within(j, ["user"], [F.asc("id")], per_user, "quota_rank")


def top_pages(urls: DataFrame, n: int = 5) -> DataFrame:
    return rank_within(urls, ["organization_id"], [F.desc("priority_score"), F.asc("id")], n)


def lowest_strategy(rows: DataFrame, page: str = "page_id", strategy: str = "strategy_rank") -> DataFrame:
    """Fallback chain: per page keep only the rows of its lowest strategy that found anything."""
    least = rows.groupBy(page).agg(F.min(strategy).alias("_least"))
    return rows.join(least, page).filter(F.col(strategy) == F.col("_least")).drop("_least")


def contact_quota(orgs: DataFrame, contacts: DataFrame, profiles: DataFrame, scale: float = 10.0) -> DataFrame:
    """Roles still wanted per organization: more for relevant ones, fewer the more contacts exist; best roles first.

    ``profiles`` holds (org_type, role_title, relevance_score); at most five roles are ever asked for.
    """
    n = contacts.groupBy("organization_id").agg(F.count("*").alias("existing")).withColumnRenamed("organization_id", "id")
    want = F.least(F.lit(5), F.greatest(F.lit(1), (F.col("relevance_score") * (10.0 / scale) / 2).cast("int")))
    q = orgs.join(n, "id", "left").withColumn(
        "quota", F.greatest(F.lit(0), want - F.coalesce("existing", F.lit(0)).cast("int")))
    ranked = rank_within(profiles.withColumnRenamed("relevance_score", "role_relevance"), ["org_type"],
                         [F.desc("role_relevance"), F.asc("role_title")], 5, "role_rank")
    return q.filter("quota > 0").join(ranked, "org_type").filter(F.col("role_rank") <= F.col("quota"))


def discovery_tiers(orgs: DataFrame, contacts: DataFrame, min_relevance: float, max_contacts: int) -> DataFrame:
    """Tier 1 no contacts, 2 partial, 3 attempted with few, 4 the rest below the maximum; an unknown status never
    reaches tier 4 because NULL is not unequal to anything."""
    n = contacts.groupBy("organization_id").agg(F.count("*").alias("contact_count")).withColumnRenamed("organization_id", "id")
    q = orgs.filter(F.col("relevance_score") >= min_relevance).join(n, "id", "left")
    c, s = F.col("contact_count"), F.col("contact_discovery_status")
    tier = (F.when(c.isNull(), 1).when(s == "partial", 2).when((s == "attempted") & (c < 3), 3)
            .when((s != "completed") & (c < max_contacts), 4))
    return q.withColumn("tier", tier).filter(F.col("tier").isNotNull()).orderBy("tier", "id")


def keyset_page(df: DataFrame, size: int, last: tuple[float, int] | None = None, score: str = "relevance_score") -> DataFrame:
    """Next page in (score descending, id) order after the last row seen; no offset is counted off."""
    if last is not None:
        s, i = last
        df = df.filter((F.col(score) < s) | ((F.col(score) == s) & (F.col("id") > i)))
    return df.orderBy(F.desc(score), F.asc("id")).limit(size)


def by_opportunity(orgs: DataFrame, limit: int | None = None, score: str = "integration_opportunity_score") -> DataFrame:
    """Organizations that are no competitors; with a limit the best by opportunity score, then id."""
    q = orgs.filter(~F.coalesce(F.col("is_competitor"), F.lit(False)))
    return q if limit is None else q.orderBy(F.desc(score), F.asc("id")).limit(limit)


def top_result_site(results: DataFrame, top: int = 3) -> DataFrame:
    """(query, website): the first of the top results of a query that is neither a blocked site nor a search page."""
    hits = rank_within(results, ["query"], [F.asc("pos")], top)
    ok = hits.filter(blank_to_null("url").isNotNull() & ~any_word(F.lower("url"), [*BLOCKED_RESULT_SITES, "search"]))
    return ok.groupBy("query").agg(F.min_by("url", "pos").alias("website"))


def by_type_priority(df: DataFrame, priority: Sequence[str], limit: int | None, seq: str) -> DataFrame:
    """The first ``limit`` rows by the type's place in the list; without a limit all rows with that place as ``type_rank``, unsorted."""
    place = first_listed(F.col("org_type"), priority)
    return df.withColumn("type_rank", place) if limit is None else df.orderBy(place, F.asc(seq)).limit(limit)


# ---- fixed values ---------------------------------------------------------------------------
PRIORITY_TYPES = ["water", "wastewater", "oil_gas", "utility", "agriculture"]
URL_PRIORITY_WORDS = ["directory", "staff", "contact", "team", "employees", "personnel", "leadership", "department",
                      "officials", "management", "admin", "about"]
URL_EXTRA = {"contact": 5, "directory": 10, "staff": 8}
RESULT_SUFFIXES = [".gov", ".edu", ".org", ".us"]
RESULT_TERMS = ["water", "wastewater", "utility", "municipal", "city of", "county of", "authority", "district",
                "department", "agency", "plant", "facility", "infrastructure", "engineering"]
RESULT_NEGATIVES = ["scada provider", "scada integrator", "integration services"]
# ---- end of fixed values --------------------------------------------------------------------


def url_priority(url: str | Column, words: Sequence[str] = URL_PRIORITY_WORDS, extra: dict[str, int] | None = None) -> Column:
    """Earlier listed words weigh more; some add a bonus on top."""
    u = F.lower(col(url))
    total = F.lit(0)
    for i, w in enumerate(words):
        total = total + F.when(u.contains(w), len(words) - i).otherwise(0)
    for w, v in (URL_EXTRA if extra is None else extra).items():
        total = total + F.when(u.contains(w), v).otherwise(0)
    return total


def result_priority(domain: Column, title: str | Column, snippet: str | Column, suffixes: Sequence[str] = RESULT_SUFFIXES,
                    terms: Sequence[str] = RESULT_TERMS, negatives: Sequence[str] = RESULT_NEGATIVES) -> Column:
    t = F.lower(F.coalesce(col(title), F.lit("")))
    s = F.lower(F.coalesce(col(snippet), F.lit("")))
    good = F.lit(False)
    for x in suffixes:
        good = good | domain.endswith(x)
    total = F.when(good, 5).otherwise(0)
    for x in terms:
        total = total + F.when(t.contains(x), 3).otherwise(0) + F.when(s.contains(x), 2).otherwise(0)
    for x in negatives:
        total = total - F.when(t.contains(x) | s.contains(x), 10).otherwise(0)
    return total
