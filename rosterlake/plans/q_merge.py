"""Upserts, merges and changes."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rosterlake.operators import merge as M
from rosterlake.operators.similar import similar_names
from rosterlake.operators.predicates import ts
from rosterlake.plans.bindings import VIEWS
from rosterlake.plans.registry import query

AS_OF = dt.datetime(2001, 8, 2)
KEY = "lower(trim(CASE WHEN trim(email) <> '' THEN email END))"


@query("m1_upsert_contacts_by_email", "contacts incoming_contacts", f"""
SELECT id, organization_id, first_name, last_name, job_title, email, phone, round(contact_relevance_score, 6) AS contact_relevance_score, updated FROM (
WITH f AS (SELECT *, {KEY} AS k FROM incoming_contacts WHERE NOT coalesce(contains(lower(email), '.edu'), false)),
n AS (SELECT k, arg_min(email, seq) AS email, arg_min(organization_id, seq) AS organization_id, arg_min(first_name, seq) FILTER (trim(first_name) <> '') AS first_name,
 arg_min(last_name, seq) FILTER (trim(last_name) <> '') AS last_name, arg_min(job_title, seq) FILTER (trim(job_title) <> '') AS job_title, arg_min(phone, seq) FILTER (trim(phone) <> '') AS phone,
 arg_min(contact_relevance_score, seq) FILTER (contact_relevance_score <> 0) AS contact_relevance_score FROM f WHERE k IS NOT NULL GROUP BY k),
t AS (SELECT {KEY} AS k, min(id) AS id FROM contacts WHERE trim(email) <> '' GROUP BY 1)
SELECT c.id, c.organization_id, coalesce(nullif(trim(c.first_name), ''), p.first_name, c.first_name) AS first_name, coalesce(nullif(c.last_name, ''), p.last_name) AS last_name,
 coalesce(nullif(c.job_title, ''), p.job_title) AS job_title, c.email, coalesce(nullif(c.phone, ''), p.phone) AS phone, coalesce(nullif(c.contact_relevance_score, 0), p.contact_relevance_score, c.contact_relevance_score) AS contact_relevance_score, p.id IS NOT NULL AS updated
FROM contacts c LEFT JOIN (SELECT n.*, t.id FROM n JOIN t USING (k)) p ON p.id = c.id
UNION ALL SELECT NULL, organization_id, first_name, last_name, job_title, email, phone, contact_relevance_score, false FROM n WHERE k NOT IN (SELECT k FROM t)
UNION ALL SELECT NULL, organization_id, first_name, last_name, job_title, email, phone, contact_relevance_score, false FROM f WHERE k IS NULL)""")
def _(t):
    return M.upsert_contacts_by_email(t.contacts, t.incoming_contacts, ts(AS_OF)).select(
        "id", "organization_id", "first_name", "last_name", "job_title", "email", "phone",
        F.round("contact_relevance_score", 6).alias("contact_relevance_score"), F.col("last_updated").isNotNull().alias("updated"))


FINDS = ("SELECT seq, CASE WHEN seq % 3 = 0 THEN c.organization_id ELSE i.organization_id END AS organization_id, CASE WHEN seq % 2 = 0 AND c.first_name <> '' THEN c.first_name ELSE i.first_name END AS first_name, "
         "CASE WHEN seq % 2 = 0 THEN c.last_name ELSE i.last_name END AS last_name, i.job_title, CASE WHEN seq % 5 = 0 THEN c.email ELSE i.email END AS email, i.phone, (i.job_title = 'Plant Director') AS is_decision_maker "
         "FROM {i} i JOIN {c} c ON c.id = i.order_id")


def finds(t):
    # dealt by order, the lines need no other shuffle for their groups and for the join to the orders
    incoming = t.spark.sql(VIEWS["incoming_contacts"][0], lineitem=t.lineitem.repartition("l_orderkey"))
    return t.spark.sql(FINDS, i=incoming, c=t.contacts)


FINDS_CTE = f"finds AS ({FINDS.format(i='incoming_contacts', c='contacts')})"
MATCH = """m AS (SELECT f.*, coalesce(e.id, n.id) AS target_id, CASE WHEN e.id IS NOT NULL THEN 'email' WHEN n.id IS NOT NULL THEN 'name' END AS matched_by FROM (
 SELECT seq, organization_id, first_name, coalesce(last_name, '') AS last_name, job_title, email, phone, is_decision_maker, {key} AS k FROM finds WHERE trim(first_name) <> '') f
 LEFT JOIN (SELECT {key} AS k, {org} AS o, min(id) AS id FROM contacts WHERE trim(email) <> '' GROUP BY 1, 2) e ON e.k = f.k AND (e.o = 0 OR e.o = f.organization_id)
 LEFT JOIN (SELECT organization_id, first_name, coalesce(last_name, '') AS last_name, min(id) AS id FROM contacts GROUP BY 1, 2, 3) n ON n.organization_id = f.organization_id AND n.first_name = f.first_name AND n.last_name = f.last_name)"""
FRESH = """SELECT NULL AS id, organization_id, first_name, last_name, job_title, email, phone, {rel} AS rel, NULL AS notes FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('e:' || k, 'n:|' || organization_id || '|' || first_name || '|' || last_name) ORDER BY seq) AS rn FROM m WHERE target_id IS NULL) WHERE rn = 1"""


@query("m2_upsert_crawled_contacts", "contacts incoming_contacts", f"""
WITH {FINDS_CTE}, {MATCH.format(key=KEY, org='0')},
p AS (SELECT target_id AS id, arg_min(first_name, seq) FILTER (matched_by = 'email' AND trim(first_name) <> '') AS first_name, arg_min(last_name, seq) FILTER (matched_by = 'email' AND trim(last_name) <> '') AS last_name,
 arg_min(job_title, seq) FILTER (trim(job_title) <> '') AS job_title, arg_min(phone, seq) FILTER (trim(phone) <> '') AS phone, arg_min(email, seq) FILTER (matched_by = 'name' AND trim(email) <> '') AS email,
 max(CASE WHEN matched_by = 'email' THEN CASE WHEN is_decision_maker THEN 7.0 ELSE 5.0 END END)::DOUBLE AS rel FROM m WHERE target_id IS NOT NULL GROUP BY 1),
l AS (SELECT target_id AS id, string_agg('Also associated with organization ID: ' || m.organization_id, chr(10) ORDER BY seq) AS notes FROM m JOIN contacts c ON c.id = m.target_id WHERE matched_by = 'email' AND m.organization_id IS DISTINCT FROM c.organization_id GROUP BY 1)
SELECT id, organization_id, first_name, last_name, job_title, email, phone, rel AS contact_relevance_score, notes FROM (
SELECT c.id, c.organization_id, coalesce(nullif(trim(c.first_name), ''), p.first_name, c.first_name) AS first_name, coalesce(nullif(c.last_name, ''), p.last_name) AS last_name, coalesce(nullif(c.job_title, ''), p.job_title) AS job_title,
 coalesce(nullif(trim(c.email), ''), p.email, c.email) AS email, coalesce(nullif(c.phone, ''), p.phone) AS phone, CASE WHEN p.rel > coalesce(c.contact_relevance_score, 0) THEN p.rel ELSE c.contact_relevance_score END AS rel, l.notes
FROM contacts c LEFT JOIN p ON p.id = c.id LEFT JOIN l ON l.id = c.id
UNION ALL {FRESH.format(rel="(CASE WHEN is_decision_maker THEN 7.0 ELSE 5.0 END)::DOUBLE")})""")
def _(t):
    return M.upsert_crawled_contacts(t.contacts, finds(t)).select(
        "id", "organization_id", "first_name", "last_name", "job_title", "email", "phone", "contact_relevance_score", "notes")


@query("m2b_upsert_within_organization", "contacts incoming_contacts", f"""
WITH {FINDS_CTE}, {MATCH.format(key=KEY, org='organization_id')},
p AS (SELECT target_id AS id, arg_min(job_title, seq) FILTER (trim(job_title) <> '') AS job_title, arg_min(phone, seq) FILTER (trim(phone) <> '') AS phone, arg_min(email, seq) FILTER (trim(email) <> '') AS email FROM m WHERE target_id IS NOT NULL GROUP BY 1)
SELECT id, organization_id, first_name, last_name, job_title, email, phone FROM (
SELECT c.id, c.organization_id, c.first_name, c.last_name, coalesce(nullif(c.job_title, ''), p.job_title) AS job_title, coalesce(nullif(trim(c.email), ''), p.email, c.email) AS email, coalesce(nullif(c.phone, ''), p.phone) AS phone
FROM contacts c LEFT JOIN p ON p.id = c.id UNION ALL SELECT id, organization_id, first_name, last_name, job_title, email, phone FROM ({FRESH.format(rel='0')}))""".replace("(e.o = 0 OR e.o = f.organization_id)", "e.o = f.organization_id"))
def _(t):
    return M.upsert_contacts_within_organization(t.contacts, finds(t)).select(
        "id", "organization_id", "first_name", "last_name", "job_title", "email", "phone")


ORG_NEW = """n AS (SELECT name, state, arg_min(org_type, seq) AS org_type, arg_min(confidence_score, seq) AS fc, arg_min(description, seq) AS fd, arg_min(description, seq) FILTER (trim(description) <> '') AS fill, max(confidence_score) AS mc, max(relevance_score) AS mr FROM incoming_organizations GROUP BY 1, 2),
t AS (SELECT name, state, min(id) AS id FROM organizations GROUP BY 1, 2)"""


@query("m3_upsert_organizations", "organizations incoming_organizations", f"""
WITH {ORG_NEW} SELECT o.id, o.name, o.state, o.org_type, round(o.confidence_score, 6) AS confidence_score, round(greatest(o.relevance_score, p.mr), 6) AS relevance_score FROM organizations o LEFT JOIN (SELECT n.*, t.id FROM n JOIN t USING (name, state)) p ON p.id = o.id
UNION ALL SELECT NULL, name, state, org_type, round(fc, 6), round(mr, 6) FROM n WHERE (name, state) NOT IN (SELECT (name, state) FROM t)""")
def _(t):
    return M.upsert_organizations(t.organizations, t.incoming_organizations).select(
        "id", "name", "state", "org_type", F.round("confidence_score", 6).alias("confidence_score"),
        F.round("relevance_score", 6).alias("relevance_score"))


@query("m4_upsert_organizations_max", "organizations incoming_organizations", f"""
WITH {ORG_NEW} SELECT o.id, o.name, o.state, md5(coalesce(nullif(trim(o.description), ''), p.fill, o.description, '')) AS description, round(greatest(o.confidence_score, p.mc), 6) AS confidence_score, round(greatest(o.relevance_score, p.mr), 6) AS relevance_score
FROM (SELECT * REPLACE (CASE WHEN trim(description) <> '' THEN description END AS description) FROM organizations) o LEFT JOIN (SELECT n.*, t.id FROM n JOIN t USING (name, state)) p ON p.id = o.id
UNION ALL SELECT NULL, name, state, md5(coalesce(fill, fd)), round(mc, 6), round(mr, 6) FROM n WHERE (name, state) NOT IN (SELECT (name, state) FROM t)""".replace("nullif(trim(o.description), '')", "o.description"))
def _(t):
    return M.upsert_organizations(t.organizations, t.incoming_organizations, raise_confidence=True, fill_description=True,
                                  default_type="water").select(
        "id", "name", "state", F.md5(F.coalesce("description", F.lit(""))).alias("description"),
        F.round("confidence_score", 6).alias("confidence_score"), F.round("relevance_score", 6).alias("relevance_score"))


RANKED = f"""r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY coalesce(contact_confidence_score, 0) DESC, (coalesce(trim(first_name), '') <> '')::INT DESC, (coalesce(trim(last_name), '') <> '')::INT DESC,
 (coalesce(trim(job_title), '') <> '')::INT DESC, (coalesce(trim(phone), '') <> '')::INT DESC, date_added DESC NULLS LAST, id) AS rn, count(*) OVER (PARTITION BY k) AS n FROM (SELECT *, {KEY} AS k FROM contacts) WHERE k IS NOT NULL)"""


def filled_sql(c: str) -> str:
    return f"arg_min({c}, rn) FILTER (coalesce(trim({c}), '') <> '')"


@query("m5_merge_duplicate_contacts", "contacts", f"""
WITH {RANKED}, g AS (SELECT k, max(n) AS n, arg_min(id, rn) AS id, {filled_sql('first_name')} AS first_name, {filled_sql('last_name')} AS last_name, {filled_sql('job_title')} AS job_title, {filled_sql('phone')} AS phone,
 arg_min(email, rn) AS email, arg_min(organization_id, rn) AS organization_id, max(coalesce(contact_confidence_score, 0)) AS mc, max(coalesce(contact_relevance_score, 0)) AS mr, arg_min(struct_pack(v := contact_confidence_score), rn) AS oc, arg_min(struct_pack(v := contact_relevance_score), rn) AS orr,
 arg_min(struct_pack(v := first_name), rn) AS ofn FROM r GROUP BY k)
SELECT id, organization_id, coalesce(first_name, ofn.v) AS first_name, last_name, job_title, phone, email, CASE WHEN n > 1 THEN mc ELSE oc.v END AS contact_confidence_score, CASE WHEN n > 1 THEN mr ELSE orr.v END AS contact_relevance_score, (n - 1)::BIGINT AS merged_count FROM g
UNION ALL SELECT id, organization_id, first_name, last_name, job_title, phone, email, contact_confidence_score, contact_relevance_score, 0 FROM contacts WHERE {KEY} IS NULL""")
def _(t):
    return M.merge_duplicate_contacts(t.contacts).select(
        "id", "organization_id", "first_name", "last_name", "job_title", "phone", "email", "contact_confidence_score",
        "contact_relevance_score", "merged_count")


@query("m5_merge_notes", "contacts", f"""
WITH {RANKED}, s AS (SELECT k, id FROM r WHERE rn = 1) SELECT c.id, x.notes FROM (SELECT id FROM s UNION ALL SELECT id FROM contacts WHERE {KEY} IS NULL) c LEFT JOIN (SELECT s.id, string_agg('Merged with duplicate contact: ' || coalesce(first_name, '') || ' ' || coalesce(last_name, ''), chr(10) ORDER BY rn) AS notes
 FROM r JOIN s USING (k) WHERE rn > 1 AND trim(coalesce(first_name, '') || coalesce(last_name, '')) <> '' GROUP BY s.id) x ON x.id = c.id""")
def _(t):
    kept = M.merge_duplicate_contacts(t.contacts).select("id")
    return M.attach_notes(kept, M.merge_note_lines(t.contacts))


@query("m5_merge_note_lines", "contacts", f"""
WITH {RANKED}, s AS (SELECT k, id FROM r WHERE rn = 1) SELECT s.id, 'Merged with duplicate contact: ' || coalesce(first_name, '') || ' ' || coalesce(last_name, '') AS line
FROM r JOIN s USING (k) WHERE rn > 1 AND trim(coalesce(first_name, '') || coalesce(last_name, '')) <> ''""")
def _(t):
    return M.merge_note_lines(t.contacts).select("id", "line")


@query("m2_crawled_note_lines", "contacts incoming_contacts", f"""
WITH {FINDS_CTE}, {MATCH.format(key=KEY, org='0')}
SELECT target_id AS id, seq AS ord, 'Also associated with organization ID: ' || m.organization_id AS line FROM m JOIN contacts c ON c.id = m.target_id WHERE matched_by = 'email' AND m.organization_id IS DISTINCT FROM c.organization_id""")
def _(t):
    return M.crawled_note_lines(t.contacts, finds(t))


@query("m5_merge_statistics", "contacts", f"""
SELECT count(k)::BIGINT AS total_emails_processed, count(DISTINCT k)::BIGINT AS unique_emails_kept, (count(k) - count(DISTINCT k))::BIGINT AS duplicate_contacts_merged,
 count(*) FILTER (k IS NULL AND email IS NOT NULL)::BIGINT AS contacts_without_email FROM (SELECT email, {KEY} AS k FROM contacts)""")
def _(t):
    return M.merge_statistics(t.contacts)


STEP = """step AS (SELECT a.id, arg_min(b.id, struct_pack(r := -b.relevance_score, i := b.id)) AS match_id FROM organizations a JOIN organizations b ON a.state = b.state AND a.org_type = b.org_type
 AND (starts_with(lower(a.name), lower(b.name)) OR starts_with(lower(b.name), lower(a.name))) GROUP BY a.id)"""


@query("j7_best_duplicate", "organizations", f"WITH {STEP} SELECT id, match_id FROM step WHERE id <> match_id")
def _(t):
    return M.best_duplicate(t.organizations)


ROOTS = f"WITH RECURSIVE {STEP}, walk AS (SELECT id, match_id AS cur, 1 AS d FROM step UNION ALL SELECT w.id, s.match_id, d + 1 FROM walk w JOIN step s ON s.id = w.cur WHERE s.match_id <> w.cur), roots AS (SELECT id, arg_max(cur, d) AS root_id FROM walk GROUP BY id)"


@query("m6_duplicate_roots", "organizations", f"{ROOTS} SELECT id, root_id FROM roots")
def _(t):
    return M.duplicate_roots(t.organizations)


@query("m6_merge_organizations", "organizations", f"""
{ROOTS}, best AS (SELECT root_id, arg_min(description, struct_pack(l := -length(description), o := o.id <> root_id, i := o.id)) AS d FROM organizations o JOIN roots USING (id) WHERE trim(description) <> '' GROUP BY 1)
SELECT o.id, o.name, CASE WHEN r.root_id <> o.id THEN -1 ELSE relevance_score END::DOUBLE AS relevance_score, md5(coalesce(CASE WHEN r.root_id <> o.id THEN 'MERGED into ID ' || r.root_id ELSE coalesce(b.d, o.description) END, '')) AS description
FROM organizations o LEFT JOIN roots r ON r.id = o.id LEFT JOIN best b ON b.root_id = o.id""")
def _(t):
    return M.merge_duplicate_organizations(t.organizations, M.duplicate_roots(t.organizations)).select(
        "id", "name", "relevance_score", F.md5(F.coalesce("description", F.lit(""))).alias("description"))


CLOSE = "levenshtein(lower(a.name), lower(b.name)) <= floor(greatest(length(a.name), length(b.name)) * 15 / 100)"
STEP_CLOSE = STEP.replace("(starts_with(", f"({CLOSE} OR starts_with(")


@query("j7_similar_names", "organizations", f"""
SELECT DISTINCT a.state, a.org_type, lower(a.name) AS a, lower(b.name) AS b FROM (SELECT DISTINCT state, org_type, name FROM organizations) a
JOIN (SELECT DISTINCT state, org_type, name FROM organizations) b ON a.state = b.state AND a.org_type = b.org_type AND lower(a.name) < lower(b.name) AND {CLOSE}""")
def _(t):
    return similar_names(t.organizations.withColumn("lname", F.lower("name")), ["state", "org_type"], "lname")


@query("j7_best_similar", "organizations", f"WITH {STEP_CLOSE} SELECT id, match_id FROM step WHERE id <> match_id")
def _(t):
    return M.best_duplicate(t.organizations, percent=85)


@query("m6_duplicate_roots_similar", "organizations", f"{ROOTS.replace(STEP, STEP_CLOSE)} SELECT id, root_id FROM roots")
def _(t):
    return M.duplicate_roots(t.organizations, percent=85)


@query("m7_move_contacts", "organizations contacts", f"""
{ROOTS} SELECT c.id, coalesce(r.root_id, c.organization_id) AS organization_id FROM contacts c LEFT JOIN roots r ON r.id = c.organization_id""")
def _(t):
    roots = M.duplicate_roots(t.organizations).select(F.col("id").alias("old_id"), F.col("root_id").alias("new_id"))
    return M.move_contacts(t.contacts, roots).select("id", "organization_id")


EDU = "SELECT id FROM organizations WHERE website ILIKE '%.edu%'"


@query("m8_remove_edu", "organizations contacts", f"""
SELECT 'contact' AS kind, id FROM contacts WHERE NOT coalesce(email ILIKE '%.edu%', false) AND organization_id NOT IN ({EDU}) UNION ALL SELECT 'organization', id FROM organizations WHERE id NOT IN ({EDU})""")
def _(t):
    o, c, _s = M.remove_edu(t.organizations, t.contacts)
    return c.select(F.lit("contact").alias("kind"), "id").unionByName(o.select(F.lit("organization").alias("kind"), "id"))


@query("m8_remove_edu_counts", "organizations contacts", f"""
SELECT (SELECT count(*) FROM contacts WHERE coalesce(email ILIKE '%.edu%', false) OR organization_id IN ({EDU}))::BIGINT AS contacts_removed, (SELECT count(*) FROM ({EDU}))::BIGINT AS organizations_removed""")
def _(t):
    return M.remove_edu(t.organizations, t.contacts)[2]


ACTIONS = "SELECT l_orderkey AS contact_id, CASE l_returnflag WHEN 'A' THEN 'draft' ELSE 'sent' END AS action, 'msg' || CAST(l_orderkey * 10 + l_linenumber AS {s}) AS message_id, l_shipdate AS acted_at FROM {li}"


@query("m9_apply_mail_actions", "contacts", f"""
WITH a AS ({ACTIONS.format(s='VARCHAR', li='lineitem')}), g AS (SELECT contact_id, max(acted_at) FILTER (action = 'draft') AS d, max(acted_at) FILTER (action = 'sent') AS s, max(struct_pack(at := acted_at, action := action, message_id := message_id)) AS l FROM a GROUP BY 1)
SELECT c.id, c.email_draft_created OR d IS NOT NULL AS email_draft_created, coalesce(s IS NOT NULL, false) AS email_sent, l.message_id AS email_draft_id, CASE l.action WHEN 'sent' THEN 'emailed' WHEN 'draft' THEN 'email_draft' END AS status, s::DATE AS sent_day
FROM contacts c LEFT JOIN g ON g.contact_id = c.id""")
def _(t):
    a = t.spark.sql(ACTIONS.format(s="STRING", li="{li}"), li=t.lineitem)
    return M.apply_mail_actions(t.contacts, a).select("id", "email_draft_created", "email_sent", "email_draft_id", "status",
                                                      F.to_date("email_sent_date").alias("sent_day"))


@query("m10_assign_by_type", "contacts organizations assignments", """
SELECT c.id, a.assigned_to FROM contacts c LEFT JOIN organizations o ON o.id = c.organization_id LEFT JOIN assignments a ON a.org_type = o.org_type""")
def _(t):
    return M.assign_by_type(t.contacts, t.organizations, t.assignments).select("id", "assigned_to")


@query("m11_clear_assignment", "contacts organizations assignments", """
SELECT c.id, nullif(a.assigned_to, 'ana') AS assigned_to FROM contacts c LEFT JOIN organizations o ON o.id = c.organization_id LEFT JOIN assignments a ON a.org_type = o.org_type""")
def _(t):
    return M.clear_assignment(M.assign_by_type(t.contacts, t.organizations, t.assignments), "ana").select("id", "assigned_to")


@query("m12_patch_by_id", "organizations", """
SELECT o.id, CASE WHEN s.s_suppkey % 5 = 0 THEN NULL ELSE coalesce(s.s_name, o.website) END AS website, coalesce('N' || s.s_nationkey::VARCHAR, o.state) AS state
FROM organizations o LEFT JOIN supplier s ON s.s_suppkey = o.id""")
def _(t):
    p = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("website"),
                          F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("state"),
                          F.expr("CASE WHEN s_suppkey % 5 = 0 THEN array('website') END").alias("set_null"))
    return M.patch_by_id(t.organizations, p, ["website", "state"]).select("id", "website", "state")


@query("m13_add_missing_links", "discovered_urls", """
SELECT id AS url_id, organization_id FROM discovered_urls UNION SELECT l_partkey, l_suppkey FROM lineitem""")
def _(t):
    have = t.discovered_urls.select(F.col("id").alias("url_id"), "organization_id")
    want = t.lineitem.select(F.col("l_partkey").alias("url_id"), F.col("l_suppkey").alias("organization_id"))
    return M.add_missing_links(have, want, ["url_id", "organization_id"])


@query("m14_scores_filled", "contacts", """
SELECT id, coalesce(contact_confidence_score, 0) AS contact_confidence_score, coalesce(contact_relevance_score, 0) AS contact_relevance_score FROM contacts""")
def _(t):
    s = ["contact_confidence_score", "contact_relevance_score"]
    return M.scores_filled(t.contacts, s).select("id", *s)


@query("m15_engagements_from_drafts", "contacts", """
SELECT id AS contact_id, 'd' || CAST(id AS STRING) AS email_id, date_added::DATE AS sent_day FROM contacts WHERE email_draft_created""")
def _(t):
    c = t.contacts.withColumn("email_draft_id", F.expr("CASE WHEN email_draft_created THEN 'd' || CAST(id AS STRING) ELSE '' END")).withColumn(
        "email_draft_date", F.col("date_added"))
    return M.engagements_from_drafts(c).select("contact_id", "email_id", F.to_date("email_sent_date").alias("sent_day"))


CRAWL = "SELECT CASE WHEN page_id % 2 = 0 THEN url ELSE url || '/new' END AS url, 'h' || CAST(page_id AS {s}) AS html_content, '[]' AS extracted_links, TIMESTAMP '2024-02-01 00:00:00' AS last_crawled, CAST(page_id % 4 AS INT) AS crawl_depth, CASE WHEN page_id % 3 = 0 THEN 'search' ELSE 'crawl' END AS source FROM {p}"


@query("m16_upsert_url_records", "discovered_urls", f"""
WITH c AS ({CRAWL.format(s='VARCHAR', p='pages')}), l AS (SELECT url, arg_max(struct_pack(h := html_content, d := crawl_depth, s := source), crawl_depth) AS c FROM c GROUP BY url), f AS (SELECT url, min(id) AS id FROM discovered_urls GROUP BY url)
SELECT u.id, u.url, md5(coalesce(x.c.h, u.html_content)) AS content, x.c.d AS crawl_depth, u.priority_score FROM discovered_urls u LEFT JOIN (SELECT f.id, l.c FROM l JOIN f USING (url)) x ON x.id = u.id
UNION ALL SELECT NULL, url, md5(l.c.h), l.c.d, CASE WHEN l.c.s = 'search' THEN 0.7 ELSE 0.5 END FROM l WHERE url NOT IN (SELECT url FROM f)""")
def _(t):
    c = t.spark.sql(CRAWL.format(s="STRING", p="{p}"), p=t.pages)
    return M.upsert_url_records(t.discovered_urls, c).select("id", "url", F.md5("html_content").alias("content"), "crawl_depth", "priority_score")


@query("m17_initial_pages", "organizations", """
SELECT id AS organization_id, website || p.path AS url, p.kind AS page_type, p.prefix || name AS title, p.pr::DOUBLE AS priority_score FROM organizations, (SELECT unnest([{'path': '', 'kind': 'homepage', 'prefix': '', 'pr': 1.0},
 {'path': '/about', 'kind': 'about', 'prefix': 'About ', 'pr': 0.9}, {'path': '/contact', 'kind': 'contact', 'prefix': 'Contact ', 'pr': 0.9}, {'path': '/team', 'kind': 'team', 'prefix': 'Team at ', 'pr': 0.8}]) AS p) WHERE website <> ''""")
def _(t):
    return M.initial_pages(t.organizations).select("organization_id", "url", "page_type", "title", "priority_score")


METHODS = "CASE id % 4 WHEN 0 THEN 'inferred' WHEN 1 THEN NULL ELSE 'website' END"


@query("m18_discovery_status", "organizations contacts", f"""
SELECT o.id, CASE WHEN coalesce(n, 0) >= 5 THEN 'completed' WHEN coalesce(n, 0) > 0 THEN 'partial' ELSE 'attempted' END AS contact_discovery_status FROM organizations o LEFT JOIN (
 SELECT organization_id, count(*) FILTER (trim(first_name) <> '' AND trim(last_name) <> '' AND coalesce(m, '') <> 'inferred') AS n FROM (SELECT *, {METHODS} AS m FROM contacts) GROUP BY 1) c ON c.organization_id = o.id""")
def _(t):
    return M.discovery_status(t.organizations, t.contacts.withColumn("discovery_method", F.expr(METHODS))).select(
        "id", "contact_discovery_status")


@query("m20_record_conversions", "email_engagements", """
WITH c AS (SELECT o_custkey AS contact_id, max(struct_pack(at := o_orderdate, t := o_orderpriority)) AS c FROM orders GROUP BY 1), n AS (SELECT contact_id, arg_max(id, struct_pack(d := email_sent_date, i := id)) AS id FROM email_engagements GROUP BY 1)
SELECT e.id, e.converted OR x.id IS NOT NULL AS converted, x.c.t AS conversion_type FROM email_engagements e LEFT JOIN (SELECT n.id, c.c FROM n JOIN c USING (contact_id)) x ON x.id = e.id""")
def _(t):
    c = t.orders.select(F.col("o_custkey").alias("contact_id"), F.col("o_orderpriority").alias("conversion_type"), F.col("o_orderdate").alias("acted_at"))
    return M.record_conversions(t.email_engagements, c).select("id", "converted", "conversion_type")


@query("m21_unlink_mismatched_urls", "discovered_urls validation_reports", """
SELECT u.id, CASE WHEN coalesce(v.auto_send_approved, true) THEN u.organization_id END AS organization_id FROM discovered_urls u LEFT JOIN validation_reports v ON v.id = u.id""")
def _(t):
    v = t.validation_reports.select("id", F.col("auto_send_approved").alias("valid"))
    return M.unlink_mismatched_urls(t.discovered_urls, v).select("id", "organization_id")


@query("m22_fill_known_websites", "organizations", """
SELECT o.id, coalesce(nullif(o.website, ''), x.w, o.website) AS website FROM organizations o LEFT JOIN (SELECT 'Org ' || (s_suppkey % 40)::VARCHAR AS name, 'NATION_' || s_nationkey::VARCHAR AS state, min('https://known' || s_suppkey::VARCHAR || '.gov') AS w FROM supplier GROUP BY 1, 2) x
ON x.name = o.name AND x.state = o.state""")
def _(t):
    o = t.supplier.select(F.expr("'Org ' || CAST(s_suppkey % 40 AS STRING)").alias("name"), F.expr("'NATION_' || CAST(s_nationkey AS STRING)").alias("state"),
                          F.expr("'https://known' || CAST(s_suppkey AS STRING) || '.gov'").alias("website"))
    return M.fill_known_websites(t.organizations, o).select("id", "website")
