"""Filters, existence tests and decisions."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rosterlake.operators import predicates as P
from rosterlake.plans.registry import query, sql_list

ORDERS_AS_OF = dt.datetime(2001, 8, 2)
EVENTS_AS_OF = dt.datetime(2024, 1, 31)


@query("f1_point_lookup", "organizations",
       "SELECT id, name, state FROM organizations WHERE name = 'Org 5 District' AND state = 'NATION_3'")
def _(t):
    return P.lookup_equal(t.organizations, name="Org 5 District", state="NATION_3").select("id", "name", "state")


@query("f1_key_set_lookup", "contacts email_engagements",
       "SELECT id, email FROM contacts WHERE id IN (SELECT contact_id FROM email_engagements WHERE converted)")
def _(t):
    keys = t.email_engagements.filter("converted").select(F.col("contact_id").alias("id"))
    return P.lookup_keys(t.contacts, keys, ["id"]).select("id", "email")


@query("f2_contact_exists", "contacts incoming_contacts", """
SELECT seq, (EXISTS (SELECT 1 FROM contacts c WHERE c.first_name = i.first_name AND c.last_name = i.last_name
   AND c.organization_id = i.organization_id)) AS known_by_name,
 (EXISTS (SELECT 1 FROM contacts c WHERE c.email = i.email)) AS known_by_email FROM (
   SELECT seq, organization_id, REPLACE(first_name, 'New', 'First') AS first_name, REPLACE(last_name, 'Fam', 'Last') AS last_name,
    REPLACE(REPLACE(email, 'p', 'P'), 'ORG', 'org') AS email FROM incoming_contacts) i""")
def _(t):
    inc = t.incoming_contacts.withColumn("first_name", F.expr("REPLACE(first_name, 'New', 'First')")).withColumn(
        "last_name", F.expr("REPLACE(last_name, 'Fam', 'Last')")).withColumn(
        "email", F.expr("REPLACE(REPLACE(email, 'p', 'P'), 'ORG', 'org')"))
    return P.known_contacts(inc, t.contacts).select("seq", "known_by_name", "known_by_email")


@query("f3_reject_edu", "organizations contacts", """
SELECT c.id, o.website, c.email FROM contacts c JOIN organizations o ON c.organization_id = o.id
WHERE NOT coalesce(contains(lower(o.website), '.edu'), false) AND NOT coalesce(contains(lower(c.email), '.edu'), false)""")
def _(t):
    o = P.reject_edu(t.organizations, "website").select(F.col("id").alias("organization_id"), "website")
    return P.reject_edu(t.contacts, "email").join(o, "organization_id").select("id", "website", "email")


@query("f4_has_value", "contacts", "SELECT id, email FROM contacts WHERE email IS NOT NULL AND email <> ''")
def _(t):
    return t.contacts.filter(P.has_value("email")).select("id", "email")


@query("f5_score_threshold", "organizations contacts", """
SELECT 'contact' AS kind, id FROM contacts WHERE contact_confidence_score >= 0.7
UNION ALL SELECT 'organization', id FROM organizations WHERE relevance_score >= 0.5""")
def _(t):
    c = P.score_at_least(t.contacts, "contact_confidence_score", 0.7).select(F.lit("contact").alias("kind"), "id")
    o = P.displayed_relevance_at_least(t.organizations, 5).select(F.lit("organization").alias("kind"), "id")
    return c.unionByName(o)


@query("f6_in_list_all_sentinel", "organizations",
       "SELECT id, org_type, state FROM organizations WHERE org_type IN ('water') AND state IN ('NATION_1','NATION_2')")
def _(t):
    q = P.in_list(t.organizations, "org_type", ["water", "engineering"], ["municipal", "water"])
    q = P.in_list(q, "org_type", ["all"], None)
    return P.in_list(q, "state", ["NATION_1", "NATION_2"]).select("id", "org_type", "state")


@query("f7_relative_time_range", "process_summaries", """
SELECT process_type, CAST(count(*) AS BIGINT) AS n FROM process_summaries
WHERE started_at BETWEEN TIMESTAMP '2001-07-03 00:00:00' AND TIMESTAMP '2001-08-02 00:00:00' GROUP BY process_type""")
def _(t):
    return P.in_time_range(t.process_summaries, "started_at", "30d", ORDERS_AS_OF).groupBy("process_type").agg(
        F.count("*").alias("n"))


@query("f8_since_midnight", "contacts",
       "SELECT id, email FROM contacts WHERE date_added >= TIMESTAMP '2001-07-20 00:00:00'")
def _(t):
    return P.since_midnight(t.contacts, "date_added", dt.datetime(2001, 7, 20, 15, 30)).select("id", "email")


STATES = ["Utah", "ention", "eau", "der"]
COUNTIES = ["thand", "leau", "ander"]


@query("f9_target_states", "search_results", f"""
SELECT pos, state FROM (SELECT pos, CASE WHEN state IN ('Utah','ention','eau','der') THEN state
 WHEN contains(snippet,'Utah') THEN 'Utah' WHEN contains(snippet,'ention') THEN 'ention'
 WHEN contains(snippet,'eau') THEN 'eau' WHEN contains(snippet,'der') THEN 'der'
 WHEN contains(snippet,'The') AND len(list_filter({sql_list(COUNTIES)}, lambda c: contains(snippet, c))) > 0 THEN 'The'
 END AS state FROM search_results) WHERE state IS NOT NULL""")
def _(t):
    return P.in_target_states(t.search_results, STATES, COUNTIES, county_state="The", description="snippet").select(
        "pos", "state")


@query("f10_ignored_urls", "discovered_urls",
       r"SELECT id, url FROM discovered_urls WHERE NOT regexp_matches(lower(url), "
       r"'\.pdf$|\.docx?$|\.xlsx?$|\.pptx?$|\.zip$|login|signin|register|cart|shop|store|privacy|terms|careers|jobs')")
def _(t):
    return P.drop_ignored_urls(t.discovered_urls).select("id", "url")


@query("f11_blocked_domains", "discovered_urls",
       "SELECT id, url FROM discovered_urls WHERE NOT contains(lower(url),'blog.') AND NOT contains(lower(url),'example.net')")
def _(t):
    return P.drop_blocked_domains(t.discovered_urls, blocked=["blog.", "example.net"]).select("id", "url")


@query("f12_flag_filter", "validation_reports", """
SELECT 'approved' AS choice, id FROM validation_reports WHERE auto_send_approved
UNION ALL SELECT 'rejected', id FROM validation_reports WHERE NOT auto_send_approved
UNION ALL SELECT 'all', id FROM validation_reports""")
def _(t):
    parts = [P.with_flag(t.validation_reports, c).select(F.lit(c).alias("choice"), "id")
             for c in ("approved", "rejected", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f13_generic_mailbox", "contacts",
       "SELECT id, email, coalesce(regexp_matches(lower(email), '^(p1|p3)@'), false) AS is_generic FROM contacts")
def _(t):
    return t.contacts.select("id", "email", P.generic_mailbox("email", ["p1", "p3"]).alias("is_generic"))


@query("f14_validation_gate", "contacts", """
SELECT id, CASE WHEN email IS NULL OR trim(email) = '' OR organization_id IS NULL THEN 'rejected'
 WHEN o >= 0.7 AND n IS NULL AND nullif(trim(first_name), '') IS NULL THEN 'no_name'
 WHEN o >= 0.7 AND n >= 0.7 THEN 'accepted' ELSE 'rejected' END AS decision,
 CASE WHEN email IS NULL OR trim(email) = '' OR organization_id IS NULL THEN 'Email and organization are required'
 WHEN o >= 0.7 AND n IS NULL AND nullif(trim(first_name), '') IS NULL THEN 'Passed org validation, no name'
 WHEN o >= 0.7 AND n >= 0.7 THEN 'Passed'
 WHEN o >= 0.7 THEN ln WHEN n >= 0.7 THEN lo ELSE ln || '; ' || lo END AS reason
FROM (SELECT *, CASE WHEN n IS NULL THEN 'Missing name confidence' ELSE printf('Low name confidence (%.2f)', n) END AS ln,
  printf('Low org confidence (%.2f)', o) AS lo FROM (SELECT *, coalesce(contact_confidence_score, 0.0) AS o,
  contact_relevance_score / 10 AS n FROM contacts))""")
def _(t):
    c = t.contacts.withColumn("org_score", F.col("contact_confidence_score")).withColumn(
        "name_score", F.col("contact_relevance_score") / 10)
    return P.validation_gate(c).select("id", "decision", "reason")


@query("f15_validation_bypass", "organizations",
       "SELECT id, CASE WHEN confidence_score > 0.9 THEN 'skipped' ELSE 'required' END AS validation FROM organizations")
def _(t):
    return P.validation_bypass(t.organizations).select("id", "validation")


@query("f16_needs_revalidation", "organizations", """
SELECT o.id, n.name, n.website FROM organizations o JOIN (SELECT id, CASE WHEN id % 6 = 0 THEN name || ' Inc' ELSE name END AS name,
 CASE WHEN id % 5 = 0 THEN NULL ELSE website END AS website FROM organizations) n ON o.id = n.id
WHERE o.name IS DISTINCT FROM n.name OR o.website IS DISTINCT FROM n.website""")
def _(t):
    new = t.organizations.selectExpr("id", "CASE WHEN id % 6 = 0 THEN name || ' Inc' ELSE name END AS name",
                                     "CASE WHEN id % 5 = 0 THEN NULL ELSE website END AS website")
    return P.needs_revalidation(t.organizations, new)


@query("f17_crawl_queue_all", "discovered_urls", """
SELECT 'types' AS variant, id, priority_score FROM discovered_urls WHERE last_crawled IS NULL AND page_type IN ('homepage','about','contact','team')
UNION ALL SELECT 'priority', id, priority_score FROM discovered_urls WHERE last_crawled IS NULL AND priority_score >= 0.5""")
def _(t):
    a = P.crawl_queue(t.discovered_urls, None).select(F.lit("types").alias("variant"), "id", "priority_score")
    return a.unionByName(P.crawl_queue(t.discovered_urls, None, None, 0.5).select(F.lit("priority").alias("variant"), "id", "priority_score"))


@query("f17_crawl_queue", "discovered_urls", """
SELECT * FROM (SELECT 'types' AS variant, id, priority_score FROM discovered_urls WHERE last_crawled IS NULL
 AND page_type IN ('homepage','about','contact','team') ORDER BY priority_score DESC, id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'priority' AS variant, id, priority_score FROM discovered_urls WHERE last_crawled IS NULL
 AND priority_score >= 0.5 ORDER BY priority_score DESC, id LIMIT 100)""")
def _(t):
    a = P.crawl_queue(t.discovered_urls, 20).select(F.lit("types").alias("variant"), "id", "priority_score")
    b = P.crawl_queue(t.discovered_urls, 100, None, 0.5).select(F.lit("priority").alias("variant"), "id", "priority_score")
    return a.unionByName(b)


@query("f18_without_website", "organizations",
       "SELECT id, name, relevance_score FROM organizations WHERE website IS NULL OR website = ''")
def _(t):
    return P.without_website(t.organizations).select("id", "name", "relevance_score")


SEND_VIEW = """(SELECT c.id, c.email, o.id AS organization_id, o.name AS organization_name,
  CASE WHEN c.id % 31 = 0 THEN 'timeout' END AS validation_error, (c.contact_confidence_score >= 0.7) AS approved,
  (c.first_name IS NULL) AS no_name FROM contacts c LEFT JOIN organizations o ON o.id = CASE WHEN c.id % 13 = 5 THEN -c.organization_id ELSE c.organization_id END)"""


@query("f19_send_or_draft", "contacts organizations", f"""
SELECT id, action, template, reason, subject, recipient FROM (SELECT *,
 CASE WHEN sk THEN 'skip' WHEN no_name THEN 'draft' WHEN coalesce(approved, false) AND mode = 'live' THEN 'send' ELSE 'draft' END AS action,
 CASE WHEN sk THEN NULL WHEN no_name THEN 'no_name' ELSE 'default' END AS template,
 CASE WHEN validation_error IS NOT NULL THEN 'Validation error' WHEN organization_id IS NULL THEN 'Organization missing'
  WHEN no_name THEN 'No name' WHEN coalesce(approved, false) AND mode = 'box' THEN 'Sandbox'
  WHEN coalesce(approved, false) THEN 'Approved' ELSE 'Below confidence hurdle' END AS reason,
 CASE WHEN NOT sk THEN (CASE WHEN mode = 'box' AND no_name THEN '[TEST - NoName - to: ' || email || '] '
   WHEN mode = 'box' AND coalesce(approved, false) THEN '[TEST - to: ' || email || '] ' ELSE '' END) ||
  CASE WHEN no_name THEN 'Introduction (Organization: ' || coalesce(organization_name, '') || ')' ELSE 'Introduction' END END AS subject,
 CASE WHEN NOT sk THEN CASE WHEN mode = 'box' AND (no_name OR coalesce(approved, false)) THEN 'box@test.org' ELSE email END END AS recipient
 FROM (SELECT *, (validation_error IS NOT NULL OR organization_id IS NULL) AS sk FROM {SEND_VIEW} v,
  (SELECT 'live' AS mode UNION ALL SELECT 'box') m WHERE (mode = 'live') = (v.id % 2 = 0)))""")
def _(t):
    o = t.organizations.select(F.col("id").alias("oid"), F.col("name").alias("organization_name"))
    lost = F.expr("CASE WHEN id % 13 = 5 THEN -organization_id ELSE organization_id END")  # contacts of organizations that are not there
    c = t.contacts.withColumn("organization_id", lost).join(o, F.col("organization_id") == F.col("oid"), "left").selectExpr(
        "id", "email", "oid AS organization_id", "organization_name",
        "CASE WHEN id % 31 = 0 THEN 'timeout' END AS validation_error",
        "(contact_confidence_score >= 0.7) AS approved", "(first_name IS NULL) AS no_name")
    out = ["id", "action", "template", "reason", "subject", "recipient"]
    live = P.send_or_draft(c.filter("id % 2 = 0"), True).select(*out)
    return live.unionByName(P.send_or_draft(c.filter("id % 2 <> 0"), True, "box@test.org").select(*out))
