"""Upserts, merges and other changes as pure functions: (stored, new) -> stored.

Plain Parquet has no MERGE, so the result is the whole new table; ``streaming.changes`` keeps only the rows that changed.
Groups are reduced by aggregates that merge on the map side, never gathered; "first filled value in order" is
``min_by`` over an explicit order, so no result depends on partitioning.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.people import EMAIL_SYNTAX
from rosterlake.functions.text import blank_to_null, nonblank
from rosterlake.operators.similar import similar_names
from rosterlake.session import cut_lineage
from rosterlake.session import stored as written

CONTACT_FIELDS = ["first_name", "last_name", "job_title", "phone"]


def filled(df: DataFrame, c: str) -> Column:
    """The value, or NULL when it counts as missing: NULL, blank text or zero."""
    kind = df.schema[c].dataType.typeName()
    if kind == "string":
        return blank_to_null(c)
    return F.col(c) if kind in ("boolean", "timestamp", "timestamp_ntz", "date") else F.when(F.col(c) != 0, F.col(c))


def first_filled(df: DataFrame, c: str, order: Column) -> Column:
    v = filled(df, c)
    return F.min_by(v, F.when(v.isNotNull(), order)).alias(c)


def email_key(c: str = "email") -> Column:
    return F.lower(F.trim(blank_to_null(c)))


def attach_notes(df: DataFrame, lines: DataFrame, notes: str | None = None) -> DataFrame:
    """Join all note lines (id, ord, line) of a row into its text, after its old text. The text is as long as the group: where
    groups are unbounded use the line table itself (:func:`merge_note_lines`, :func:`crawled_note_lines`)."""
    text = lines.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("_text"))
    old = blank_to_null(notes) if notes and notes in df.columns else F.lit(None).cast("string")
    joined = F.concat_ws("\n", old, F.col("_text"))
    return df.join(text, "id", "left").withColumn("notes", F.when(joined != "", joined)).drop("_text")


# ---- contacts -------------------------------------------------------------------------------

def upsert_contacts_by_email(stored: DataFrame, found: DataFrame, as_of: Column, seq: str = "seq") -> DataFrame:
    """Fill only what is missing on the first stored row of an e-mail; its organization never changes. Unknown
    e-mails, and finds without one, become new rows. `.edu` finds are refused."""
    from rosterlake.operators.predicates import reject_edu
    cols = [c for c in found.columns if c in stored.columns and c not in ("id", "email", "organization_id")]
    f = reject_edu(found, "email").withColumn("_k", email_key())
    with_key = f.filter(F.col("_k").isNotNull())
    order = F.col(seq)
    news = with_key.groupBy("_k").agg(F.min_by("email", order).alias("email"),
                                      F.min_by("organization_id", order).alias("organization_id"),
                                      *[first_filled(found, c, order) for c in cols])
    target = stored.withColumn("_k", email_key()).filter("_k IS NOT NULL").groupBy("_k").agg(F.min("id").alias("id"))
    patch = news.join(target, "_k").select("id", *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_hit"))
    kept = stored.join(patch, "id", "left")
    for c in cols:
        kept = kept.withColumn(c, F.coalesce(filled(stored, c), F.col(f"_n_{c}"), F.col(c)))
    if "last_updated" not in kept.columns:
        kept = kept.withColumn("last_updated", F.lit(None).cast("timestamp"))
    kept = kept.withColumn("last_updated", F.when(F.col("_hit"), as_of).otherwise(F.col("last_updated"))).select(
        *stored.columns, *([] if "last_updated" in stored.columns else ["last_updated"]))
    fresh = news.join(target, "_k", "left_anti").drop("_k")
    bare = f.filter(F.col("_k").isNull()).select("email", "organization_id", *cols)
    return kept.unionByName(fresh, allowMissingColumns=True).unionByName(bare, allowMissingColumns=True)


def match_finds(stored: DataFrame, found: DataFrame, within_organization: bool = False) -> DataFrame:
    """Give each find the stored row it belongs to: by e-mail, else by (organization, first, last), else none."""
    s = stored.select("id", "organization_id", "first_name", "last_name", email_key().alias("_k"))
    ekeys = ["_k", "organization_id"] if within_organization else ["_k"]
    by_email = s.filter("_k IS NOT NULL").groupBy(*ekeys).agg(F.min("id").alias("_by_email"), F.min_by("organization_id", "id").alias("_org")).withColumn("_salt", F.lit(0).cast("bigint"))
    by_name = (s.withColumn("last_name", F.coalesce("last_name", F.lit("")))
               .groupBy("organization_id", "first_name", "last_name").agg(F.min("id").alias("_by_name")))
    f = (found.filter(nonblank("first_name") & F.col("organization_id").isNotNull()).withColumn("_k", email_key())
         .withColumn("last_name", F.coalesce("last_name", F.lit(""))))
    # finds without an e-mail match nothing in that join; they are dealt by their name, so that no task gets them all under one NULL key
    f = f.withColumn("_salt", F.when(F.col("_k").isNull(), F.xxhash64("organization_id", "first_name", "last_name")).otherwise(0))
    j = f.join(by_email, [*ekeys, "_salt"], "left").drop("_salt")
    j = j.join(by_name, ["organization_id", "first_name", "last_name"], "left")
    return (j.withColumn("target_id", F.coalesce("_by_email", "_by_name"))
            .withColumn("matched_by", F.when(F.col("_by_email").isNotNull(), "email").when(F.col("_by_name").isNotNull(), "name"))
            .drop("_by_email", "_by_name"))


def new_from_finds(matched: DataFrame, seq: str, defaults: dict[str, Column]) -> DataFrame:
    """Unmatched finds, one per e-mail, else one per (organization, first, last); the first one wins."""
    from rosterlake.operators.selection import rank_within
    key = F.when(F.col("_k").isNull(), F.struct("organization_id", "first_name", "last_name"))
    fresh = rank_within(matched.filter("target_id IS NULL").withColumn("_key", key), ["_k", "_key"], [F.asc(seq)], 1)
    for c, v in defaults.items():
        fresh = fresh.withColumn(c, v)
    return fresh.drop("_key", "_k", "_org", "target_id", "matched_by")


def crawled_note_lines(stored: DataFrame, found: DataFrame, seq: str = "seq") -> DataFrame:
    """(id, ord, line): what :func:`upsert_crawled_contacts` notes about finds of another organization, one row per note."""
    return _organization_notes(match_finds(stored, found), seq)


def _organization_notes(matched: DataFrame, seq: str) -> DataFrame:
    hits = matched.filter((F.col("matched_by") == "email")).withColumn("id", F.col("target_id"))
    return (hits.filter(~F.col("organization_id").eqNullSafe(F.col("_org")))
            .select("id", F.col(seq).alias("ord"), F.concat(F.lit("Also associated with organization ID: "), F.col("organization_id")).alias("line")))


def upsert_crawled_contacts(stored: DataFrame, found: DataFrame, seq: str = "seq", decision_maker: str = "is_decision_maker") -> DataFrame:
    """E-mail match: fill blanks, raise relevance to 7 (decision makers) or 5, note another organization.
    Name match inside the organization: fill e-mail, phone and title. Otherwise a new row."""
    # matched once and written: fills, notes and new rows all read it
    m = written(match_finds(stored, found).withColumn("_rel", F.when(F.col(decision_maker), 7.0).otherwise(5.0)))
    order = F.col(seq)
    by_email, by_name = F.col("matched_by") == "email", F.col("matched_by") == "name"
    hits = m.filter("target_id IS NOT NULL").withColumn("id", F.col("target_id"))
    patch = hits.groupBy("id").agg(
        *[F.min_by(F.when(by_email, blank_to_null(c)), F.when(by_email & nonblank(c), order)).alias(f"_n_{c}") for c in ("first_name", "last_name")],
        *[first_filled(found, c, order).alias(f"_n_{c}") for c in ("job_title", "phone")],
        F.min_by(F.when(by_name, blank_to_null("email")), F.when(by_name & nonblank("email"), order)).alias("_n_email"),
        F.max(F.when(by_email, F.col("_rel"))).alias("_rel"))
    kept = stored.join(patch, "id", "left")
    for c in ("first_name", "last_name", "job_title", "phone", "email"):
        kept = kept.withColumn(c, F.coalesce(blank_to_null(c), F.col(f"_n_{c}"), F.col(c)))
    rel = F.col("contact_relevance_score")
    kept = kept.withColumn("contact_relevance_score", F.when(F.col("_rel") > F.coalesce(rel, F.lit(0.0)), F.col("_rel")).otherwise(rel))
    kept = attach_notes(kept.select(*stored.columns), _organization_notes(m, seq), "notes")
    fresh = new_from_finds(m, seq, {"contact_relevance_score": F.col("_rel"), "contact_confidence_score": F.lit(0.7)})
    fresh = fresh.select([c for c in fresh.columns if c in kept.columns])
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert_contacts_within_organization(stored: DataFrame, found: DataFrame, seq: str = "seq") -> DataFrame:
    m = match_finds(stored, found, within_organization=True)
    order = F.col(seq)
    patch = m.filter("target_id IS NOT NULL").groupBy(F.col("target_id").alias("id")).agg(
        *[first_filled(found, c, order).alias(f"_n_{c}") for c in ("email", "phone", "job_title")])
    kept = stored.join(patch, "id", "left")
    for c in ("email", "phone", "job_title"):
        kept = kept.withColumn(c, F.coalesce(blank_to_null(c), F.col(f"_n_{c}"), F.col(c)))
    kept = kept.select(*stored.columns)
    fresh = new_from_finds(m, seq, {"contact_confidence_score": F.lit(0.7)})
    return kept.unionByName(fresh.select([c for c in fresh.columns if c in stored.columns]), allowMissingColumns=True)


def add_or_fill_by_position(stored: DataFrame, found: DataFrame, seq: str = "seq") -> DataFrame:
    """Vendor people: need first name, last name and title; known as (organization, title, first, last) -> fill
    blanks, else a new row with confidence 0.85."""
    keys = ["organization_id", "job_title", "first_name", "last_name"]
    f = found.filter(nonblank("first_name") & nonblank("last_name") & nonblank("job_title"))
    news = f.groupBy(*keys).agg(first_filled(found, "email", F.col(seq)), first_filled(found, "phone", F.col(seq)))
    target = stored.filter(nonblank("job_title")).groupBy(*keys).agg(F.min("id").alias("id"))
    patch = news.join(target, keys).select("id", F.col("email").alias("_e"), F.col("phone").alias("_p"))
    kept = stored.join(patch, "id", "left").withColumn("email", F.coalesce(blank_to_null("email"), "_e", "email")).withColumn(
        "phone", F.coalesce(blank_to_null("phone"), "_p", "phone")).select(*stored.columns)
    fresh = news.join(target, keys, "left_anti").withColumn("contact_confidence_score", F.lit(0.85))
    return kept.unionByName(fresh, allowMissingColumns=True)


def survivor_rank(confidence: str = "contact_confidence_score") -> Column:
    """Sort key as one struct, smallest = best."""
    def no(c: str) -> Column:
        return F.when(nonblank(c), 0).otherwise(1)
    return F.struct((-F.coalesce(F.col(confidence), F.lit(0.0))).alias("conf"), *[no(c).alias(c) for c in CONTACT_FIELDS],
                    F.coalesce(-F.unix_micros(F.col("date_added").cast("timestamp")), F.lit(2**62)).alias("newest"),
                    F.col("id"))


def merge_duplicate_contacts(contacts: DataFrame) -> DataFrame:
    """One row per e-mail: the best row survives, its gaps are filled in rank order, scores take the maximum.

    ``merged_count`` is the number of rows taken in. Rows without an e-mail pass through. Note lines are a table
    of their own, :func:`merge_note_lines`, to be attached with :func:`attach_notes`.
    """
    keyed = contacts.withColumn("_k", email_key())
    rank = survivor_rank()
    scores = ["contact_confidence_score", "contact_relevance_score"]
    g = keyed.filter("_k IS NOT NULL").groupBy("_k").agg(
        F.min_by(F.struct(*contacts.columns), rank).alias("r"), F.count("*").alias("n"),
        *[first_filled(contacts, c, rank).alias(f"_f_{c}") for c in CONTACT_FIELDS],
        *[F.max(F.coalesce(F.col(c), F.lit(0.0))).alias(f"_m_{c}") for c in scores])
    several = F.col("n") > 1
    cols = []
    for c in contacts.columns:
        old = F.col(f"r.{c}")
        if c in CONTACT_FIELDS:
            cols.append(F.when(several, F.coalesce(f"_f_{c}", old)).otherwise(old).alias(c))
        elif c in scores:
            cols.append(F.when(several, F.col(f"_m_{c}")).otherwise(old).alias(c))
        else:
            cols.append(old.alias(c))
    merged = g.select(*cols, (F.col("n") - 1).alias("merged_count"))
    return merged.unionByName(keyed.filter("_k IS NULL").drop("_k").withColumn("merged_count", F.lit(0).cast("long")))


def merge_note_lines(contacts: DataFrame) -> DataFrame:
    """One line per merged row that has a name: (surviving id, order, line, merged id)."""
    keyed = contacts.withColumn("_k", email_key()).filter("_k IS NOT NULL").withColumn("_r", survivor_rank())
    best = keyed.groupBy("_k").agg(F.min("_r").alias("_b"))
    name = F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit("")))
    dup = keyed.join(best, "_k").filter((F.col("_r.id") != F.col("_b.id")) & (F.trim(name) != ""))
    return dup.select(F.col("_b.id").alias("id"), F.col("_r").alias("ord"),
                      F.concat(F.lit("Merged with duplicate contact: "), name).alias("line"), F.col("_r.id").alias("merged_id"))


def merge_statistics(contacts: DataFrame) -> DataFrame:
    k = email_key()
    per = contacts.groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("email").isNotNull()).alias("given"))
    has = F.col("k").isNotNull()
    return per.agg(F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("total_emails_processed"),
                   F.count_if(has).alias("unique_emails_kept"),
                   F.coalesce(F.sum(F.when(has, F.col("n") - 1)), F.lit(0)).alias("duplicate_contacts_merged"),
                   F.coalesce(F.sum(F.when(~has, F.col("given"))), F.lit(0)).alias("contacts_without_email"))


# ---- organizations --------------------------------------------------------------------------

def upsert_organizations(stored: DataFrame, found: DataFrame, seq: str = "seq", raise_confidence: bool = False,
                         fill_description: bool = False, default_confidence: float = 0.7,
                         default_relevance: float = 7.0, default_type: str | None = None) -> DataFrame:
    """Get or create by (name, state); relevance only rises. Optionally confidence too, and a blank description is
    filled. A find without a state is always new; unknown scores never lower a known one."""
    order = F.col(seq)
    f = (found.withColumn("confidence_score", F.coalesce("confidence_score", F.lit(default_confidence)))
         .withColumn("relevance_score", F.coalesce("relevance_score", F.lit(default_relevance))))
    keys = ["name", "state"]
    firsts = f.filter(nonblank("name")).groupBy(*keys).agg(
        F.min_by("org_type", order).alias("org_type"), F.min_by("confidence_score", order).alias("_first_conf"),
        F.min_by("description", order).alias("_first_desc"), first_filled(found, "description", order).alias("_fill_desc"),
        F.max("confidence_score").alias("_conf"), F.max("relevance_score").alias("_rel"))
    target = stored.groupBy(*keys).agg(F.min("id").alias("id"))
    patch = firsts.join(target, keys).select("id", "_conf", "_rel", "_fill_desc")
    kept = stored.join(patch, "id", "left").withColumn("relevance_score", F.greatest("relevance_score", "_rel"))
    if raise_confidence:
        kept = kept.withColumn("confidence_score", F.greatest("confidence_score", "_conf"))
    if fill_description:
        kept = kept.withColumn("description", F.coalesce(blank_to_null("description"), "_fill_desc", "description"))
    kept = kept.select(*stored.columns)
    fresh = firsts.join(target, keys, "left_anti").select(
        "name", "state", (F.coalesce("org_type", F.lit(default_type)) if default_type else F.col("org_type")).alias("org_type"),
        (F.coalesce("_fill_desc", "_first_desc") if fill_description else F.col("_first_desc")).alias("description"),
        (F.col("_conf") if raise_confidence else F.col("_first_conf")).alias("confidence_score"), F.col("_rel").alias("relevance_score"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def best_duplicate(orgs: DataFrame, percent: int | None = None) -> DataFrame:
    """For every organization the best row it duplicates: (id, match_id), only where that is another row.

    Duplicates share state and type, and one name equals or starts with the other (no case), or with ``percent`` is
    at least so similar to it by edits. Better = higher relevance, then lower id. Names are first reduced to one best row per distinct name; a prefix relation is found
    by joining each name's own prefixes to the names, so work grows with the text of the distinct names and
    no pairs of rows are formed.
    """
    return _group_targets(orgs, percent).select("id", "match_id").filter("id <> match_id")


def _rank(relevance: str = "relevance_score") -> Column:
    return F.struct((-F.coalesce(F.col(relevance), F.lit(0.0))).alias("r"), F.col("id").alias("id"))


def _name_groups(orgs: DataFrame) -> DataFrame:
    q = orgs.filter(nonblank("name") & F.col("state").isNotNull() & F.col("org_type").isNotNull()
                    & (F.coalesce(F.col("relevance_score"), F.lit(0.0)) >= 0))
    return q.groupBy("state", "org_type", F.lower("name").alias("lname")).agg(F.min(_rank()).alias("best"))


def _group_links(groups: DataFrame, percent: int | None = None) -> DataFrame:
    """Best row reachable from each name group over equality, prefix and, with ``percent``, similarity, one step."""
    prefixes = groups.select("state", "org_type", F.col("lname").alias("long"), F.col("best").alias("long_best"), F.explode(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length("lname") - 1, F.lit(1))), lambda i: F.substr("lname", F.lit(1), i))).alias("lname"))
    prefixes = prefixes.filter(F.col("lname") != F.col("long"))
    edges = prefixes.join(groups.hint("merge"), ["state", "org_type", "lname"])  # an exploded side looks as small as its source, so none is broadcast
    both = edges.select("state", "org_type", F.col("long").alias("lname"), "best").unionByName(
        edges.select("state", "org_type", "lname", F.col("long_best").alias("best"))).unionByName(
        groups.select("state", "org_type", "lname", "best"))
    if percent is not None:
        pairs = similar_names(groups, ["state", "org_type"], "lname", percent)
        pairs = pairs.select("state", "org_type", F.col("a").alias("other"), F.col("b").alias("lname")).union(pairs.select("state", "org_type", "b", "a"))
        there = groups.select("state", "org_type", F.col("lname").alias("other"), "best")
        both = both.unionByName(pairs.join(there.hint("merge"), ["state", "org_type", "other"]).select("state", "org_type", "lname", "best"))
    return both.groupBy("state", "org_type", "lname").agg(F.min("best").alias("reach"))


def _group_targets(orgs: DataFrame, percent: int | None = None) -> DataFrame:
    links = _group_links(_name_groups(orgs), percent)
    rows = orgs.filter(F.coalesce(F.col("relevance_score"), F.lit(0.0)) >= 0).withColumn("lname", F.lower("name"))
    return rows.join(links, ["state", "org_type", "lname"]).select("id", F.col("reach.id").alias("match_id"))


def duplicate_roots(orgs: DataFrame, percent: int | None = None) -> DataFrame:
    """(id, root_id) with every chain of duplicates, those of :func:`best_duplicate`, followed to its end by pointer jumping over name groups.

    The best row of a group stands for it. Each round halves the longest chain; the small table is checkpointed to
    the shared folder, so a lost executor costs one round.
    """
    groups = _name_groups(orgs)
    links = _group_links(groups, percent)
    # node = best row of a name group; parent = best row it reaches, which is the best row of its own group or better
    nodes = cut_lineage(groups.join(links, ["state", "org_type", "lname"]).select(
        F.col("best.id").alias("node"), F.col("reach.id").alias("parent")))
    while True:  # a parent is better than its node, so there are no rings
        up = nodes.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        step = nodes.join(up, "parent", "left").select("node", "parent", F.coalesce("grand", "parent").alias("next"))
        step = cut_lineage(step)
        moved = step.filter("next <> parent").limit(1).count()
        nodes = step.select("node", F.col("next").alias("parent"))
        if not moved:
            break
    rows = orgs.withColumn("lname", F.lower("name")).join(
        groups.select("state", "org_type", "lname", F.col("best.id").alias("node")), ["state", "org_type", "lname"])
    rows = rows.filter(F.coalesce(F.col("relevance_score"), F.lit(0.0)) >= 0)
    return rows.join(nodes, "node").select("id", F.col("parent").alias("root_id"))


def merge_duplicate_organizations(orgs: DataFrame, roots: DataFrame) -> DataFrame:
    """Flag the merged rows and give each survivor the longest description of its group."""
    j = orgs.join(roots, "id", "left").withColumn("root_id", F.coalesce("root_id", "id"))
    own = F.when(~F.coalesce(F.col("description").startswith("MERGED into ID "), F.lit(False)), blank_to_null("description"))
    longest = j.select("root_id", own.alias("d"), (F.col("id") != F.col("root_id")).alias("other"), "id").filter("d IS NOT NULL").groupBy("root_id").agg(
        F.min_by("d", F.struct((-F.length("d")).alias("l"), F.col("other"), F.col("id"))).alias("_long")).withColumnRenamed("root_id", "id")
    out = j.join(longest, "id", "left")
    lost = F.col("root_id") != F.col("id")
    return (out.withColumn("description", F.when(lost, F.concat(F.lit("MERGED into ID "), F.col("root_id")))
                           .otherwise(F.coalesce("_long", "description")))
            .withColumn("relevance_score", F.when(lost, F.lit(-1.0)).otherwise(F.col("relevance_score")))
            .select(*orgs.columns))


def move_contacts(contacts: DataFrame, moves: DataFrame) -> DataFrame:
    """Re-point contacts by an (old_id, new_id) table of unique old ids."""
    m = moves.select(F.col("old_id").alias("organization_id"), "new_id")
    return contacts.join(m, "organization_id", "left").withColumn(
        "organization_id", F.coalesce("new_id", "organization_id")).select(*contacts.columns)


def remove_edu(orgs: DataFrame, contacts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(organizations kept, contacts kept, counts): `.edu` mail, `.edu` sites and the contacts of such sites go."""
    edu_org = F.coalesce(F.col("website").ilike("%.edu%"), F.lit(False))
    edu_mail = F.coalesce(F.col("email").ilike("%.edu%"), F.lit(False))
    gone = orgs.filter(edu_org).select(F.col("id").alias("organization_id"))
    kept = contacts.filter(~edu_mail).join(gone, "organization_id", "left_anti")
    from rosterlake.operators.reports import one_row
    removed = contacts.join(gone.withColumn("_g", F.lit(True)), "organization_id", "left").agg(
        F.count_if(edu_mail | F.coalesce(F.col("_g"), F.lit(False))).alias("contacts_removed"))
    stats = one_row(removed, orgs.agg(F.count_if(edu_org).alias("organizations_removed")))
    return orgs.filter(~edu_org), kept, stats


# ---- status, assignment, patches ------------------------------------------------------------

def apply_mail_actions(contacts: DataFrame, actions: DataFrame) -> DataFrame:
    """Draft and sent actions (contact_id, action, message_id, acted_at): each sets its own flag and date, the latest one
    sets message and status."""
    a = actions.filter(F.col("action").isin("draft", "sent"))
    is_draft = F.col("action") == "draft"
    g = a.groupBy(F.col("contact_id").alias("id")).agg(
        F.max(F.when(is_draft, F.col("acted_at"))).alias("_draft_at"), F.max(F.when(~is_draft, F.col("acted_at"))).alias("_sent_at"),
        F.max_by(F.struct("action", "message_id", "acted_at"), F.struct("acted_at", "action", "message_id")).alias("_last"))
    j = contacts.join(g, "id", "left")
    base = {"email_draft_date": "timestamp", "email_draft_id": "string", "email_sent": "boolean", "email_sent_date": "timestamp",
            "status": "string", "status_date": "timestamp"}
    for c, tp in base.items():
        if c not in j.columns:
            j = j.withColumn(c, F.lit(None).cast(tp))
    status = F.when(F.col("_last.action") == "sent", "emailed").when(F.col("_last.action") == "draft", "email_draft")
    return (j.withColumn("email_draft_created", F.col("_draft_at").isNotNull() | F.coalesce(F.col("email_draft_created"), F.lit(False)))
            .withColumn("email_draft_date", F.coalesce("_draft_at", "email_draft_date"))
            .withColumn("email_sent", F.col("_sent_at").isNotNull() | F.coalesce(F.col("email_sent"), F.lit(False)))
            .withColumn("email_sent_date", F.coalesce("_sent_at", "email_sent_date"))
            .withColumn("email_draft_id", F.coalesce("_last.message_id", "email_draft_id"))
            .withColumn("status", F.coalesce(status, "status"))
            .withColumn("status_date", F.coalesce("_last.acted_at", "status_date")).drop("_draft_at", "_sent_at", "_last"))


def assign_by_type(contacts: DataFrame, orgs: DataFrame, assignments: DataFrame) -> DataFrame:
    """User of the organization's type; the first listed user wins. No match leaves NULL."""
    a = assignments.groupBy("org_type").agg(F.min_by("assigned_to", "rank").alias("_user"))
    o = orgs.select(F.col("id").alias("organization_id"), "org_type").join(a, "org_type", "left").select("organization_id", "_user")
    return contacts.join(o, "organization_id", "left").withColumn("assigned_to", F.col("_user")).drop("_user")


def clear_assignment(contacts: DataFrame, user: str) -> DataFrame:
    return contacts.withColumn("assigned_to", F.when(~F.col("assigned_to").eqNullSafe(F.lit(user)), F.col("assigned_to")))


def patch_by_id(stored: DataFrame, patch: DataFrame, columns: Sequence[str], nulls: str = "set_null") -> DataFrame:
    """Overwrite given columns by id; a NULL in the patch means "leave", unless the column is listed in ``set_null``."""
    p = patch.select("id", F.col(nulls).alias("_nulls"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    j = stored.join(p, "id", "left")
    for c in columns:
        wipe = F.coalesce(F.array_contains("_nulls", c), F.lit(False))
        j = j.withColumn(c, F.when(~wipe, F.coalesce(f"_n_{c}", c)))
    return j.select(*stored.columns)


def add_missing_links(links: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return links.select(*keys).unionByName(wanted.select(*keys).distinct().join(links.select(*keys), list(keys), "left_anti"))


def scores_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(0.0, subset=list(columns))


def engagements_from_drafts(contacts: DataFrame) -> DataFrame:
    return contacts.filter(blank_to_null("email_draft_id").isNotNull()).select(
        F.col("id").alias("contact_id"), F.col("email_draft_id").alias("email_id"), F.col("email_draft_date").alias("email_sent_date"))


def upsert_url_records(stored: DataFrame, crawled: DataFrame, facts: Sequence[str] = ()) -> DataFrame:
    """Latest crawl per URL replaces content, links, time and depth, and the ``facts`` found on the page, of its first stored
    record; new URLs are added with priority 0.7 when they came from a search, else 0.5."""
    fields = ["html_content", "extracted_links", "last_crawled", "crawl_depth", *facts]
    latest = crawled.groupBy("url").agg(F.max_by(F.struct(*fields, "source"), F.struct("last_crawled", "crawl_depth")).alias("c"))
    target = stored.groupBy("url").agg(F.min("id").alias("id"))
    patch = latest.join(target, "url").select("id", "c")
    kept = stored.join(patch, "id", "left")
    for f in fields:
        old = F.col(f) if f in stored.columns else F.lit(None).cast(crawled.schema[f].dataType)
        kept = kept.withColumn(f, F.when(F.col("c").isNotNull(), F.col(f"c.{f}")).otherwise(old))
    kept = kept.drop("c")
    fresh = latest.join(target, "url", "left_anti").select("url", *[F.col(f"c.{f}").alias(f) for f in fields],
        F.when(F.col("c.source") == "search", 0.7).otherwise(0.5).alias("priority_score"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def initial_pages(orgs: DataFrame) -> DataFrame:
    """First pages to visit for every organization with a website."""
    site = F.regexp_replace("website", "/+$", "")

    def page(path: str, kind: str, prefix: str, priority: float, contact: bool) -> Column:
        return F.struct(F.concat(site, F.lit(path)).alias("url"), F.lit(kind).alias("page_type"),
                        F.concat(F.lit(prefix), F.col("name")).alias("title"), F.lit(priority).alias("priority_score"),
                        F.lit(contact).alias("contains_contact_info"))

    pages = F.array(page("", "homepage", "", 1.0, False), page("/about", "about", "About ", 0.9, False),
                    page("/contact", "contact", "Contact ", 0.9, True), page("/team", "team", "Team at ", 0.8, True))
    return orgs.filter(nonblank("website")).select(F.col("id").alias("organization_id"), F.explode(pages).alias("p")).select(
        "organization_id", "p.*")


UNCERTAIN_METHODS = ["generic_role_contact", "inferred", "title_based_pattern"]


def discovery_status(orgs: DataFrame, contacts: DataFrame, enough: int = 5) -> DataFrame:
    """completed / partial / attempted by the number of contacts with both names and a sure method."""
    actual = nonblank("first_name") & nonblank("last_name") & ~F.coalesce(F.col("discovery_method").isin(UNCERTAIN_METHODS), F.lit(False))
    n = contacts.groupBy(F.col("organization_id").alias("id")).agg(F.count_if(actual).alias("_n"))
    c = F.coalesce(F.col("_n"), F.lit(0))
    return orgs.join(n, "id", "left").withColumn("contact_discovery_status", F.when(c >= enough, "completed").when(
        c > 0, "partial").otherwise("attempted")).drop("_n")


def replace_scores(stored: DataFrame, computed: DataFrame, key: str = "contact_id") -> DataFrame:
    """Fresh scores replace old ones; contacts that were not recomputed keep theirs."""
    return computed.unionByName(stored.join(computed.select(key), key, "left_anti"), allowMissingColumns=True)


def record_conversions(engagements: DataFrame, conversions: DataFrame) -> DataFrame:
    """Mark each converting contact's newest mail; (contact_id, conversion_type, acted_at), the latest one wins."""
    c = conversions.groupBy("contact_id").agg(F.max_by(F.struct("conversion_type", "acted_at"), F.struct("acted_at", "conversion_type")).alias("_c"))
    newest = engagements.groupBy("contact_id").agg(F.max_by("id", F.struct("email_sent_date", "id")).alias("id"))
    hit = newest.join(c, "contact_id").select("id", "_c")
    j = engagements.join(hit, "id", "left")
    return (j.withColumn("converted", F.col("_c").isNotNull() | F.col("converted"))
            .withColumn("conversion_date", F.coalesce("_c.acted_at", "conversion_date"))
            .withColumn("conversion_type", F.col("_c.conversion_type")).drop("_c"))


def unlink_mismatched_urls(urls: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Clear the organization of URLs whose validation said it belongs to another one."""
    v = verdicts.groupBy("id").agg(F.bool_and("valid").alias("_ok"))
    return urls.join(v, "id", "left").withColumn("organization_id", F.when(F.coalesce("_ok", F.lit(True)), F.col("organization_id"))).drop("_ok")


def fill_known_websites(orgs: DataFrame, overrides: DataFrame) -> DataFrame:
    o = overrides.groupBy("name", "state").agg(F.min("website").alias("_w"))
    return orgs.join(o, ["name", "state"], "left").withColumn("website", F.coalesce(blank_to_null("website"), "_w", "website")).drop("_w")


def valid_email_flag(contacts: DataFrame) -> DataFrame:
    return contacts.withColumn("email_valid", F.coalesce(F.col("email").rlike(EMAIL_SYNTAX), F.lit(False)))
