"""Row filters and decisions. Each takes a DataFrame and returns a DataFrame; filters reach the scan."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.text import any_word, blank_to_null, col, first_case, strings

# ---- fixed values ---------------------------------------------------------------------------
IGNORED_URL_PATTERNS = [
    r"\.pdf$", r"\.docx?$", r"\.xlsx?$", r"\.pptx?$", r"\.zip$", "login", "signin", "register", "cart",
    "shop", "store", "privacy", "terms", "careers", "jobs",
]
BLOCKED_DOMAINS = [
    "linkedin.com", "indeed.com", "ziprecruiter.com", "monster.com", "glassdoor.com", "wikipedia.org",
    "yelp.com", "yellowpages.com",
]
BLOCKED_COMPANY_DOMAINS = [
    "linkedin.com", "indeed.com", "glassdoor.com", "monster.com", "ziprecruiter.com", "facebook.com",
    "twitter.com", "instagram.com",
]
GENERIC_MAILBOXES = ["info", "contact", "general", "admin", "webmaster"]
GENERIC_MAILBOXES_DIRECTORY = ["info", "contact", "hello", "support", "sales", "service"]
CRAWLABLE_PAGE_TYPES = ["homepage", "about", "contact", "team"]
RANGES = {"24h": dt.timedelta(hours=24), "7d": dt.timedelta(days=7), "30d": dt.timedelta(days=30)}
ALL_SINCE = dt.datetime(2000, 1, 1)
# ---- end of fixed values --------------------------------------------------------------------


def ts(value: dt.datetime | str) -> Column:
    return F.to_timestamp(F.lit(value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")))


def lookup_equal(df: DataFrame, **equals: object) -> DataFrame:
    """Point lookup: every given column equals its value; None matches NULL."""
    for k, v in equals.items():
        df = df.filter(F.col(k).eqNullSafe(F.lit(v)))
    return df


def lookup_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Batch point lookup for a table of keys."""
    return df.join(keys.select(*on), list(on), "left_semi")


def flag_existing(df: DataFrame, existing: DataFrame, on: Sequence[str], flag: str = "already_known") -> DataFrame:
    """Existence test as a column. Keys of ``existing`` are made unique first, so rows never multiply."""
    known = existing.select(*on).dropna().distinct().withColumn(flag, F.lit(True))
    return df.join(known, list(on), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def known_contacts(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Contacts already stored, by (first, last, organization) or by e-mail."""
    by_name = flag_existing(df, existing, ["first_name", "last_name", "organization_id"], "known_by_name")
    return flag_existing(by_name, existing, ["email"], "known_by_email")


def reject_edu(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.filter(~F.coalesce(F.lower(c).contains(".edu"), F.lit(False)))
    return df


def has_value(c: str | Column) -> Column:
    return col(c).isNotNull() & (col(c) != "")


def score_at_least(df: DataFrame, column: str, threshold: float) -> DataFrame:
    return df.filter(F.col(column) >= threshold)


def displayed_relevance_at_least(df: DataFrame, minimum: float, column: str = "relevance_score",
                                 scale: float = 10.0) -> DataFrame:
    """Slider filter: the shown 0-10 minimum applies to the stored score only above 1."""
    return df.filter(F.col(column) >= minimum / scale) if minimum > 1 else df


def allowed_values(requested: Sequence[str] | None, assigned: Sequence[str] | None) -> list[str] | None:
    """None = no filter. ``["all"]`` keeps everything assigned; otherwise the overlap in requested order."""
    wants_all = not requested or (len(requested) == 1 and requested[0].lower() == "all")
    if wants_all:
        return None if assigned is None else list(assigned)
    return list(requested) if assigned is None else [r for r in requested if r in assigned]


def in_list(df: DataFrame, column: str, requested: Sequence[str] | None,
            assigned: Sequence[str] | None = None) -> DataFrame:
    values = allowed_values(requested, assigned)
    if values is None:
        return df
    return df.filter(F.col(column).isin(values)) if values else df.filter(F.lit(False))


def in_time_range(df: DataFrame, column: str, range_name: str, as_of: dt.datetime) -> DataFrame:
    """Closed interval ending at ``as_of``; any other name means everything since the epoch of the data."""
    start = as_of - RANGES[range_name] if range_name in RANGES else ALL_SINCE
    return df.filter(F.col(column).between(ts(start), ts(as_of)))


def since_midnight(df: DataFrame, column: str, as_of: dt.datetime) -> DataFrame:
    return df.filter(F.col(column) >= ts(as_of.replace(hour=0, minute=0, second=0, microsecond=0)))


def in_target_states(df: DataFrame, states: Sequence[str], counties: Sequence[str] = (),
                     county_state: str = "Illinois", state: str = "state",
                     description: str = "description") -> DataFrame:
    """Keep rows of a target state; a missing one is read from the description, first listed state wins.

    A county name counts for its own state only when that state is mentioned. Every row appears once.
    """
    text = F.coalesce(F.col(description), F.lit(""))
    from_county = text.contains(county_state) & any_word(text, counties)
    named = first_case([(text.contains(s), s) for s in states], None)
    found = F.when(F.col(state).isin(list(states)), F.col(state)).otherwise(
        F.coalesce(named, F.when(from_county, F.lit(county_state))))
    return df.withColumn(state, found).filter(F.col(state).isNotNull())


def drop_ignored_urls(df: DataFrame, url: str = "url", patterns: Sequence[str] = IGNORED_URL_PATTERNS) -> DataFrame:
    return df.filter(~F.lower(url).rlike("|".join(patterns)))


def drop_blocked_domains(df: DataFrame, url: str = "url", blocked: Sequence[str] = BLOCKED_DOMAINS) -> DataFrame:
    return df.filter(~any_word(F.lower(url), blocked))


def with_flag(df: DataFrame, choice: str, column: str = "auto_send_approved") -> DataFrame:
    """Three-way switch: all, approved or rejected."""
    if choice == "approved":
        return df.filter(F.col(column))
    return df.filter(~F.col(column)) if choice == "rejected" else df


def generic_mailbox(email: str | Column, names: Sequence[str] = GENERIC_MAILBOXES) -> Column:
    return F.coalesce(F.lower(col(email)).rlike("^(" + "|".join(names) + ")@"), F.lit(False))


def validation_gate(df: DataFrame, org_hurdle: float = 0.7, name_hurdle: float = 0.7,
                    email: str = "email", organization: str = "organization_id", first: str = "first_name",
                    org_score: str = "org_score", name_score: str = "name_score") -> DataFrame:
    """Accept, accept without a name, or reject, with the reason in words."""
    o = F.coalesce(F.col(org_score), F.lit(0.0))
    n = F.col(name_score)
    org_ok = o >= org_hurdle
    name_ok = n.isNotNull() & (n >= name_hurdle)
    low_org = F.concat(F.lit("Low org confidence ("), F.format_string("%.2f", o), F.lit(")"))
    low_name = F.when(n.isNull(), F.lit("Missing name confidence")).otherwise(
        F.concat(F.lit("Low name confidence ("), F.format_string("%.2f", n), F.lit(")")))
    missing = blank_to_null(email).isNull() | F.col(organization).isNull()
    no_name = org_ok & n.isNull() & blank_to_null(first).isNull()
    decision = first_case([(missing, "rejected"), (no_name, "no_name"), (org_ok & name_ok, "accepted")], "rejected")
    reason = first_case([
        (missing, "Email and organization are required"),
        (no_name, "Passed org validation, no name"),
        (org_ok & name_ok, "Passed"),
        (org_ok, low_name),
        (name_ok, low_org),
    ], F.concat_ws("; ", low_name, low_org))
    return df.withColumn("decision", decision).withColumn("reason", reason)


def validation_bypass(df: DataFrame, confidence: str = "confidence_score", above: float = 0.9) -> DataFrame:
    return df.withColumn("validation", F.when(F.col(confidence) > above, F.lit("skipped")).otherwise(F.lit("required")))


def needs_revalidation(old: DataFrame, new: DataFrame, key: str = "id",
                       columns: Sequence[str] = ("name", "website")) -> DataFrame:
    """Keys of updated rows whose checked columns really changed."""
    o = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns])
    j = new.join(o, key)
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return j.filter(changed).select(key, *columns)


def crawl_queue(urls: DataFrame, limit: int | None, page_types: Sequence[str] | None = CRAWLABLE_PAGE_TYPES,
                min_priority: float | None = None) -> DataFrame:
    """Pages never crawled, best priority first; either by page type or by a least priority. Without a limit all, unsorted."""
    q = urls.filter(F.col("last_crawled").isNull())
    if page_types is not None:
        q = q.filter(F.col("page_type").isin(list(page_types)))
    if min_priority is not None:
        q = q.filter(F.col("priority_score") >= min_priority)
    return q if limit is None else q.orderBy(F.desc("priority_score"), F.asc("id")).limit(limit)


def without_website(orgs: DataFrame, limit: int | None = None) -> DataFrame:
    q = orgs.filter(F.col("website").isNull() | (F.col("website") == "")).orderBy(F.desc("relevance_score"), "id")
    return q if limit is None else q.limit(limit)


def send_or_draft(df: DataFrame, auto_send: bool, sandbox_to: str | None = None,
                  subject: str = "Introduction") -> DataFrame:
    """Decide what happens to each validated contact.

    Needs email, organization_id, organization_name, validation_error, approved, no_name. A sandbox address
    redirects the recipient, marks the subject and turns a send into a draft.
    """
    skip = F.col("validation_error").isNotNull() | F.col("organization_id").isNull()
    nameless = F.coalesce(F.col("no_name"), F.lit(False))
    may_send = F.coalesce(F.col("approved"), F.lit(False)) & F.lit(auto_send)
    boxed = F.lit(sandbox_to is not None)
    action = first_case([(skip, "skip"), (nameless, "draft"), (may_send & ~boxed, "send")], "draft")
    template = first_case([(skip, None), (nameless, "no_name")], "default")
    reason = first_case([
        (F.col("validation_error").isNotNull(), "Validation error"),
        (F.col("organization_id").isNull(), "Organization missing"),
        (nameless, "No name"),
        (may_send & boxed, "Sandbox"),
        (may_send, "Approved"),
        (~F.coalesce(F.col("approved"), F.lit(False)), "Below confidence hurdle"),
    ], "Auto-send disabled")
    base = F.when(nameless, F.concat(F.lit(f"{subject} (Organization: "), F.coalesce(F.col("organization_name"), F.lit("")),
                                     F.lit(")"))).otherwise(F.lit(subject))
    mark = first_case([
        (boxed & nameless, F.concat(F.lit("[TEST - NoName - to: "), F.col("email"), F.lit("] "))),
        (boxed & may_send, F.concat(F.lit("[TEST - to: "), F.col("email"), F.lit("] "))),
    ], "")
    to = F.when(boxed & (nameless | may_send), F.lit(sandbox_to)).otherwise(F.col("email"))
    return (df.withColumn("action", action).withColumn("template", template).withColumn("reason", reason)
            .withColumn("subject", F.when(~skip, F.concat(mark, base))).withColumn("recipient", F.when(~skip, to)))


def first_listed(c: Column, values: Sequence[str], last: int = 999) -> Column:
    """Position in a fixed list (0-based); unlisted values come last."""
    pos = F.array_position(strings(values), c)
    return F.when(F.coalesce(pos, F.lit(0)) > 0, pos - 1).otherwise(F.lit(last)).cast("int")
