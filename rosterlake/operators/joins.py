"""Joins between entities. No cross products: plans of (template x place) are explodes of array literals.

No broadcast hints either: Spark broadcasts a side only when its size is under the session's threshold, and the
same join runs as a shuffle join beyond it.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.text import blank_to_null, map_of, strings


def contacts_with_organization(contacts: DataFrame, orgs: DataFrame, org_columns: Sequence[str]) -> DataFrame:
    o = orgs.select(F.col("id").alias("organization_id"), *[F.col(c).alias(f"organization_{c}" if c in contacts.columns
                    else c) for c in org_columns])
    return contacts.join(o, "organization_id")


def contacts_per_organization(contacts: DataFrame) -> DataFrame:
    return contacts.filter(F.col("organization_id").isNotNull()).groupBy("organization_id").agg(
        F.count("id").alias("contact_count"))


def organizations_with_counts(orgs: DataFrame, contacts: DataFrame) -> DataFrame:
    """Left outer join to the pre-aggregated contact counts: a hot organization is one row in the join."""
    n = contacts_per_organization(contacts).withColumnRenamed("organization_id", "id")
    return orgs.join(n, "id", "left").withColumn("contact_count", F.coalesce("contact_count", F.lit(0)).cast("long"))


def engagement_with_organization(engagements: DataFrame, contacts: DataFrame, orgs: DataFrame) -> DataFrame:
    c = contacts.select(F.col("id").alias("contact_id"), "organization_id")
    o = orgs.select(F.col("id").alias("organization_id"), "org_type", F.col("name").alias("organization_name"))
    return engagements.join(c, "contact_id").join(o, "organization_id")


def organizations_without_contacts(orgs: DataFrame, contacts: DataFrame) -> DataFrame:
    return orgs.join(contacts.select(F.col("organization_id").alias("id")), "id", "left_anti")


def organizations_by_contact_count(orgs: DataFrame, contacts: DataFrame, low: int, high: int) -> DataFrame:
    """Organizations whose number of contacts lies in [low, high]; none at all never matches (inner join)."""
    n = contacts_per_organization(contacts).withColumnRenamed("organization_id", "id")
    return orgs.join(n.filter(F.col("contact_count").between(low, high)), "id")


def exclude_ids(df: DataFrame, *chosen: DataFrame, key: str = "id") -> DataFrame:
    for c in chosen:
        df = df.join(c.select(key), key, "left_anti")
    return df


def organization_name_or(contacts: DataFrame, orgs: DataFrame, default: str = "Unknown") -> DataFrame:
    o = orgs.select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name"))
    return contacts.join(o, "organization_id", "left").withColumn(
        "organization_name", F.coalesce("organization_name", F.lit(default)))


def through_bridge(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Many-to-many join through a link table of unique pairs."""
    return left.join(bridge.select(left_key, right_key).distinct(), left_key).join(right, right_key)


def first_url_match(rows: DataFrame, urls: DataFrame, source_url: str = "source_url") -> DataFrame:
    """URLs repeat; the lowest id stands for all of them, so the join never multiplies rows."""
    first = urls.groupBy("url").agg(F.min("id").alias("discovered_url_id"))
    return rows.join(first, rows[source_url] == first["url"]).drop(first["url"])


def first_matching_profile(df: DataFrame, profiles: Sequence[dict], title: str = "job_title",
                           default: float = 5.0, out: str = "relevance_score") -> DataFrame:
    """Relevance of the first profile whose role or one of whose synonyms occurs in the title."""
    t = F.lower(F.coalesce(F.col(title), F.lit("")))
    score: Column | None = None
    for p in profiles:
        words = [p["role_title"], *p.get("synonyms", [])]
        cond = F.exists(strings([w.lower() for w in words]), lambda w: t.contains(w))
        score = F.when(cond, F.lit(float(p["relevance_score"]))) if score is None else score.when(
            cond, F.lit(float(p["relevance_score"])))
    return df.withColumn(out, F.lit(default) if score is None else score.otherwise(F.lit(default)))


def search_plan(categories: DataFrame, templates: dict[str, Sequence[str]], states: Sequence[str],
                counties: Sequence[str] = (), county_state: str = "Illinois", seed: int = 42) -> DataFrame:
    """One search text per category row, template and place; counties replace their state when given.

    Templates hold ``{state}``. The order is a seeded hash, in place of a random shuffle.
    """
    state_places = [s for s in states if not (counties and s == county_state)]
    places = [F.struct(F.lit(s).alias("state"), F.lit(None).cast("string").alias("county"), F.lit(s).alias("place"))
              for s in state_places]
    if counties and county_state in states:
        places += [F.struct(F.lit(county_state).alias("state"), F.lit(c).alias("county"),
                            F.lit(f"{c} county {county_state}").alias("place")) for c in counties]
    q = (categories.withColumn("template", F.explode(map_of(templates)[F.col("category")]))
         .withColumn("p", F.explode(F.array(*places)))
         .select(*categories.columns, F.replace("template", F.lit("{state}"), F.col("p.place")).alias("query"),
                 F.col("p.state").alias("state"), F.col("p.county").alias("county")))
    return q.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "category", "query"))


# ---- fixed values: search patterns for one (organization, place, title) ---------------------
POSITION_PATTERNS = [
    '"{org}" {location} "{title}"',
    '{org} {location} "{title}"',
    '"{org}" {state} {title} contact',
    '{org} {state} {title} contact',
    '"{org}" {title} email',
    '{org} {title} email',
    '"{org}" {state} {title}',
    '{org} {state} {title}',
    '{title} at "{org}" {location}',
    '{title} at {org} {location}',
    '"{org}" staff directory',
    '{org} staff directory',
]
COMMON_TITLES = ["Project Manager", "Chief Engineer", "Operations Manager", "Estimator", "Director"]
FALLBACK_TITLES = ["Manager", "Director", "Supervisor", "Engineer"]
# ---- end of fixed values --------------------------------------------------------------------


def position_searches(orgs: DataFrame, titles_by_type: dict[str, Sequence[str]], used_patterns: int | None = None,
                      location: str = "city") -> DataFrame:
    """Search texts to find people by position: own titles, then common ones, times all patterns (or the first ``used_patterns``)."""
    patterns = POSITION_PATTERNS[:used_patterns]
    default = titles_by_type.get("municipal") or FALLBACK_TITLES
    own = F.coalesce(map_of(titles_by_type)[F.col("org_type")], strings(default))
    titles = F.array_distinct(F.concat(own, strings(COMMON_TITLES)))
    org = F.trim(F.regexp_replace("name", "[()]", ""))
    state = F.coalesce(F.col("state"), F.lit(""))
    loc = F.coalesce(F.col(location), F.lit(""))
    loc = F.when((state != "") & ~F.lower(loc).contains(F.lower(state)), F.concat(loc, F.lit(", "), state)).otherwise(loc)
    q = (orgs.select("id", "name", org.alias("_o"), state.alias("_s"), loc.alias("_l"),
                     F.posexplode(titles).alias("title_rank", "title"))
         .withColumn("p", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(patterns) - 1)).alias("n"),
                                                 strings(patterns).alias("pattern")))))
    text = F.col("p.pattern")
    for mark, c in (("{org}", "_o"), ("{location}", "_l"), ("{state}", "_s"), ("{title}", "title")):
        text = F.replace(text, F.lit(mark), F.col(c))
    return q.select("id", "title_rank", "title", F.col("p.n").alias("pattern_rank"), text.alias("query"))


def campaign_log(engagements: DataFrame, contacts: DataFrame) -> DataFrame:
    """Engagement rows with their contact; mails of unknown contacts are left out."""
    c = contacts.select(F.col("id").alias("contact_id"), "first_name", "last_name", "email", "organization_id")
    return engagements.join(c, "contact_id")


def resolve_tracking(events: DataFrame, links: DataFrame, mails: DataFrame) -> DataFrame:
    """Open -> mail; click -> link -> mail. Outcome column says what could not be found.

    Works on a batch and, with static sides, on a stream.
    """
    first_link = links.groupBy("short_id").agg(F.min(F.struct("email_id", "contact_id")).alias("link"))
    first_mail = mails.groupBy("email_id").agg(F.min("contact_id").alias("contact_id"))
    e = events.join(first_link, (events["event_type"] == "click") & (events["tracking_id"] == first_link["short_id"]), "left")
    target = F.when(F.col("event_type") == "open", F.col("tracking_id")).otherwise(F.col("link.email_id"))
    e = e.withColumn("mail_id", target)
    j = e.join(first_mail, e["mail_id"] == first_mail["email_id"], "left").drop(first_mail["email_id"])
    outcome = (F.when((F.col("event_type") == "open") & F.col("contact_id").isNull(), F.lit("Email not found"))
               .when((F.col("event_type") == "click") & F.col("short_id").isNull(), F.lit("Link not found"))
               .when(~F.col("event_type").isin("open", "click"), F.lit("Unknown tracking type"))
               .otherwise(F.concat(F.initcap("event_type"), F.lit(" recorded"))))
    return j.withColumn("outcome", outcome).drop("link")


def not_blank_key(df: DataFrame, key: str) -> DataFrame:
    return df.filter(blank_to_null(key).isNotNull())
