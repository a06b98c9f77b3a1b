"""Best rows, quotas, ordered cuts."""
from __future__ import annotations


from pyspark.sql import functions as F

from rosterlake.functions import urls as U
from rosterlake.operators import reports as R
from rosterlake.operators import selection as S
from rosterlake.plans.q_scoring import C14, reranked
from rosterlake.plans.registry import query, sql_list

ELIGIBLE = """(SELECT c.*, o.name AS organization_name, o.org_type, o.state FROM contacts c JOIN organizations o ON c.organization_id = o.id
 WHERE NOT c.email_draft_created AND c.email IS NOT NULL AND c.email <> '' AND c.contact_confidence_score >= 0.5 AND o.org_type IN ('water','municipal','engineering'))"""


@query("w1_best_contact_per_organization", "contacts organizations", f"""
SELECT organization_id, id, email, organization_name, org_type, coalesce(contact_relevance_score, -1) AS relevance FROM (
 SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY coalesce(contact_relevance_score, 0) DESC, coalesce(contact_confidence_score, 0) DESC, date_added DESC, id) AS rn,
  max(date_added) OVER (PARTITION BY organization_id) AS newest FROM {ELIGIBLE}) WHERE rn = 1 ORDER BY newest DESC, organization_id LIMIT 200""")
def _(t):
    return S.best_contact_per_organization(
        t.contacts, t.organizations, 200, 0.5, ["all"], ["water", "municipal", "engineering"]).select(
        "organization_id", "id", "email", "organization_name", "org_type",
        F.coalesce("contact_relevance_score", F.lit(-1.0)).alias("relevance"))


@query("w1_best_contact_all_organizations", "contacts organizations", f"""
SELECT organization_id, id FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY coalesce(contact_relevance_score, 0) DESC,
 coalesce(contact_confidence_score, 0) DESC, date_added DESC, id) AS rn FROM {ELIGIBLE}) WHERE rn = 1""")
def _(t):
    return S.best_contact_per_organization(t.contacts, t.organizations, None, 0.5,
                                           ["water", "municipal", "engineering"]).select("organization_id", "id")


RANK_SQL = """row_number() OVER (PARTITION BY lower(trim(email)) ORDER BY coalesce(contact_confidence_score, 0) DESC,
 (coalesce(trim(first_name), '') <> '')::INT DESC, (coalesce(trim(last_name), '') <> '')::INT DESC, (coalesce(trim(job_title), '') <> '')::INT DESC,
 (coalesce(trim(phone), '') <> '')::INT DESC, date_added DESC NULLS LAST, id)"""


@query("w2_survivor_per_email", "contacts",
       f"SELECT id, email FROM (SELECT *, {RANK_SQL} AS rn FROM contacts WHERE trim(email) <> '') WHERE rn = 1")
def _(t):
    q = t.contacts.filter("trim(email) <> ''").withColumn("k", F.lower(F.trim("email")))
    return S.rank_within(q, ["k"], S.survivor_order(), 1).select("id", "email")


@query("w3_latest_engagement", "email_engagements", """
SELECT contact_id, id, converted FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY email_sent_date DESC, id DESC) AS rn FROM email_engagements) WHERE rn = 1""")
def _(t):
    return S.latest_engagement(t.email_engagements).select("contact_id", "id", "converted")


@query("w4_first_per_domain", "search_results", r"""
SELECT domain, arg_min(pos, pos) AS pos, arg_min(url, pos) AS url FROM (SELECT pos, url, regexp_extract(url, '://(?:www\.)?([^/]*)', 1) AS domain FROM search_results) GROUP BY domain""")
def _(t):
    return S.first_per_domain(t.search_results, U.registered_domain("url")).select("domain", "pos", "url")


@query("w5_distinct_contacts", "contacts", """
SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY k, v ORDER BY r DESC, id) AS rn FROM (
 SELECT id, coalesce(contact_relevance_score, 0) AS r, CASE WHEN trim(email) <> '' THEN 'e' ELSE 'n' END AS k,
  CASE WHEN trim(email) <> '' THEN lower(trim(email)) ELSE nullif(concat_ws(' ', lower(nullif(trim(first_name), '')), lower(nullif(trim(last_name), ''))), '') END AS v
 FROM contacts) WHERE v IS NOT NULL) WHERE rn = 1""")
def _(t):
    return S.distinct_contacts(t.contacts).select("id")


@query("w5b_first_contact_per_key", "contacts", """
SELECT min(id) AS id FROM contacts GROUP BY CASE WHEN trim(email) <> '' THEN 'e:' || lower(email) ELSE 'n:' || coalesce(first_name, '') || '-' || coalesce(last_name, '') END""")
def _(t):
    return S.first_contact_per_key(t.contacts).select("id")


@query("w6_new_distinct_organizations", "incoming_organizations organizations", """
SELECT seq, name, state FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), lower(state) ORDER BY seq) AS rn FROM incoming_organizations) i
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM organizations o WHERE o.name = i.name AND o.state = i.state)""")
def _(t):
    return S.new_distinct_organizations(t.incoming_organizations, t.organizations).select("seq", "name", "state")


@query("w7_quota_per_user", "contacts organizations assignments", """
SELECT assigned_to AS user, id, quota_rank FROM (SELECT a.assigned_to, c.id, row_number() OVER (PARTITION BY a.assigned_to ORDER BY c.id)::INT AS quota_rank
 FROM contacts c JOIN organizations o ON o.id = c.organization_id JOIN assignments a ON a.org_type = o.org_type
 WHERE NOT c.email_draft_created AND c.email <> '') WHERE quota_rank <= 50""")
def _(t):
    return S.quota_per_user(t.contacts, t.organizations, t.assignments, 50).select("user", "id", "quota_rank")


@query("w9_top_pages", "discovered_urls", """
SELECT organization_id, id FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY priority_score DESC, id) AS rn
 FROM (SELECT id, priority_score, organization_id % 30 AS organization_id FROM discovered_urls)) WHERE rn <= 5""")
def _(t):
    return S.top_pages(t.discovered_urls.withColumn("organization_id", F.expr("organization_id % 30"))).select(
        "organization_id", "id")


@query("w10_lowest_strategy", "", """
SELECT event_id AS row_id, user_id AS page_id, s AS strategy_rank FROM (SELECT event_id, user_id, s, min(s) OVER (PARTITION BY user_id) AS least FROM (
 SELECT event_id, user_id, (CASE WHEN user_id % 3 = 0 AND event_type = 'purchase' THEN 1 WHEN event_type = 'click' THEN 2 ELSE 3 END)::INT AS s FROM events)) WHERE s = least""")
def _(t):
    q = t.events.selectExpr("event_id AS row_id", "user_id AS page_id",
                            "CASE WHEN user_id % 3 = 0 AND event_type = 'purchase' THEN 1 WHEN event_type = 'click' THEN 2 ELSE 3 END AS strategy_rank")
    return S.lowest_strategy(q)


PROFILES = "SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'water' WHEN 1 THEN 'municipal' ELSE 'engineering' END AS org_type, 'role ' || CAST(p_size % 7 AS {s}) AS role_title, CAST(p_size % 7 AS DOUBLE) AS relevance_score FROM (SELECT l_suppkey AS p_size FROM {li})"


@query("w11_contact_quota", "organizations contacts", f"""
SELECT q.id, p.role_title FROM (SELECT o.id, o.org_type, greatest(0, least(5, greatest(1, trunc(o.relevance_score / 2)::INT)) - coalesce(n, 0)) AS quota
 FROM organizations o LEFT JOIN (SELECT organization_id, count(*) AS n FROM contacts GROUP BY 1) c ON c.organization_id = o.id) q
JOIN (SELECT *, row_number() OVER (PARTITION BY org_type ORDER BY relevance_score DESC, role_title) AS rr FROM ({PROFILES.format(s='VARCHAR', li='lineitem')})) p
ON p.org_type = q.org_type AND p.rr <= q.quota""")
def _(t):
    prof = t.spark.sql(PROFILES.format(s="STRING", li="{li}"), li=t.lineitem)
    return S.contact_quota(t.organizations, t.contacts, prof).select("id", "role_title")


@query("t1_recent_runs", "process_summaries", """
SELECT * FROM (SELECT 'any' AS scope, id, process_type, started_at::DATE AS day, items_processed FROM process_summaries ORDER BY started_at DESC, id, process_type, items_processed LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'org', id, process_type, started_at::DATE, items_processed FROM process_summaries WHERE process_type = 'org_building' ORDER BY started_at DESC, id, process_type, items_processed LIMIT 10)""")
def _(t):
    order = [F.desc("started_at"), F.asc("id"), F.asc("process_type"), F.asc("items_processed")]
    p = t.process_summaries

    def cols(scope):
        return [F.lit(scope).alias("scope"), F.col("id"), F.col("process_type"), F.to_date("started_at").alias("day"), F.col("items_processed")]
    a = R.top_n(p, 10, *order).select(*cols("any"))
    return a.unionByName(R.top_n(p.filter("process_type = 'org_building'"), 10, *order).select(*cols("org")))


@query("t3_top_states", "organizations", """
SELECT state, count(*)::BIGINT AS n FROM organizations WHERE state <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    return R.top_n(R.count_by_state(t.organizations), 10, F.desc("n"), F.asc("state"))


@query("t4_organization_table", "organizations",
       "SELECT id, name, relevance_score FROM organizations")
def _(t):
    return t.organizations.orderBy(F.desc("relevance_score"), F.asc("name"), F.asc("id")).select(
        "id", "name", "relevance_score")


@query("t5_contact_table", "contacts", """
SELECT id, contact_relevance_score FROM contacts""")
def _(t):
    return t.contacts.orderBy(F.desc("contact_relevance_score"), F.desc("date_added"), F.asc("id")).select(
        "id", "contact_relevance_score")


@query("t5_contacts_of_organization", "contacts", """
SELECT organization_id, id, rk FROM (SELECT organization_id, id, row_number() OVER (PARTITION BY organization_id ORDER BY contact_relevance_score DESC NULLS LAST, job_title NULLS FIRST, id)::INT AS rk FROM contacts) WHERE rk <= 10""")
def _(t):
    return S.rank_within(t.contacts, ["organization_id"], [F.desc("contact_relevance_score"), F.asc("job_title"), F.asc("id")],
                         10, "rk").select("organization_id", "id", "rk")


@query("t6_keyset_page", "organizations", """
SELECT id, relevance_score FROM organizations WHERE relevance_score < 7.5 OR (relevance_score = 7.5 AND id > 100) ORDER BY relevance_score DESC, id LIMIT 50""")
def _(t):
    return S.keyset_page(t.organizations, 50, (7.5, 100)).select("id", "relevance_score")


@query("t7_by_type_priority", "organizations", f"""
SELECT id, org_type FROM organizations ORDER BY CASE WHEN org_type IN ('water','wastewater','oil_gas','utility','agriculture') THEN list_position({sql_list(S.PRIORITY_TYPES)}, org_type) ELSE 999 END, id LIMIT 500""")
def _(t):
    return S.by_type_priority(t.organizations, S.PRIORITY_TYPES, 500, "id").select("id", "org_type")


@query("t7_by_type_priority_all", "organizations", f"""
SELECT id, CASE WHEN org_type IN ('water','wastewater','oil_gas','utility','agriculture') THEN list_position({sql_list(S.PRIORITY_TYPES)}, org_type) ELSE 1000 END::INT - 1 AS type_rank FROM organizations""")
def _(t):
    return S.by_type_priority(t.organizations, S.PRIORITY_TYPES, None, "id").select("id", "type_rank")


@query("t8_discovery_tiers", "organizations contacts", """
SELECT id, tier FROM (SELECT o.id, (CASE WHEN n IS NULL THEN 1 WHEN contact_discovery_status = 'partial' THEN 2 WHEN contact_discovery_status = 'attempted' AND n < 3 THEN 3
 WHEN contact_discovery_status <> 'completed' AND n < 10 THEN 4 END)::INT AS tier FROM organizations o LEFT JOIN (SELECT organization_id, count(*) AS n FROM contacts GROUP BY 1) c
 ON c.organization_id = o.id WHERE o.relevance_score >= 5) WHERE tier IS NOT NULL""")
def _(t):
    return S.discovery_tiers(t.organizations, t.contacts, 5, 10).select("id", "tier")


@query("t9_url_priority", "discovered_urls",
       "SELECT id, (" + " + ".join(f"CASE WHEN contains(u, '{w}') THEN {12 - i} ELSE 0 END" for i, w in enumerate(S.URL_PRIORITY_WORDS))
       + " + CASE WHEN contains(u, 'contact') THEN 5 ELSE 0 END + CASE WHEN contains(u, 'directory') THEN 10 ELSE 0 END + CASE WHEN contains(u, 'staff') THEN 8 ELSE 0 END)::INT AS score "
       "FROM (SELECT id, lower(url || '/' || page_type) AS u FROM discovered_urls)")
def _(t):
    return t.discovered_urls.select("id", S.url_priority(F.concat("url", F.lit("/"), F.col("page_type"))).alias("score"))


TERMS = ["the", "ention", "que", "der", "on th"]


@query("t11_result_priority", "search_results",
       "SELECT pos, (CASE WHEN regexp_matches(url, '\\.(gov|edu|org|us)/') THEN 5 ELSE 0 END + " + " + ".join(
           f"CASE WHEN contains(t, '{w}') THEN 3 ELSE 0 END + CASE WHEN contains(s, '{w}') THEN 2 ELSE 0 END" for w in TERMS)
       + " - CASE WHEN contains(t, 'ough') OR contains(s, 'ough') THEN 10 ELSE 0 END)::INT AS score "
       "FROM (SELECT pos, url, lower(title) AS t, lower(snippet) AS s FROM search_results)")
def _(t):
    return t.search_results.select("pos", S.result_priority(U.registered_domain("url"), "title", "snippet", terms=TERMS,
                                                            negatives=["ough"]).alias("score"))


@query("t12_ranked_lists", "organizations contacts", """
SELECT * FROM (SELECT 'clients' AS section, id AS organization_id, name, relevance_score AS score, NULL::BIGINT AS contact_id FROM organizations WHERE NOT is_competitor AND relevance_score >= 6 ORDER BY relevance_score DESC, id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'competitors', id, name, relevance_score, NULL FROM organizations WHERE is_competitor ORDER BY relevance_score DESC, id LIMIT 10)
UNION ALL SELECT 'contacts', organization_id, name, contact_relevance_score, id FROM (SELECT c.*, b.name, row_number() OVER (PARTITION BY c.organization_id ORDER BY coalesce(contact_relevance_score, 0) DESC, c.id) AS rn
 FROM contacts c JOIN (SELECT id, name FROM organizations WHERE NOT is_competitor AND relevance_score >= 7 ORDER BY relevance_score DESC, id LIMIT 10) b ON b.id = c.organization_id) WHERE rn <= 5""")
def _(t):
    return R.ranked_lists(t.organizations, t.contacts)


@query("t13_by_opportunity", "organizations discovered_urls", f"SELECT id, integration_opportunity_score FROM ({C14}) WHERE NOT is_competitor")
def _(t):
    return S.by_opportunity(reranked(t)).select("id", "integration_opportunity_score")


@query("t13_top_opportunities", "organizations discovered_urls", f"""
SELECT id, integration_opportunity_score FROM ({C14}) WHERE NOT is_competitor ORDER BY integration_opportunity_score DESC, id LIMIT 100""")
def _(t):
    return S.by_opportunity(reranked(t), 100).select("id", "integration_opportunity_score")


@query("t14_real_before_generic", "contacts", """
SELECT id, generic FROM (SELECT *, coalesce(regexp_matches(lower(email), '^(p1|p3)@'), false) AS generic FROM contacts)""")
def _(t):
    from rosterlake.operators.predicates import generic_mailbox
    q = t.contacts.withColumn("generic", generic_mailbox("email", ["p1", "p3"]))
    return q.orderBy(F.asc("generic"), F.desc("contact_confidence_score"), F.asc("id")).select("id", "generic")


@query("t15_table_page", "organizations", "SELECT id, name FROM organizations ORDER BY name, id LIMIT 10 OFFSET 30")
def _(t):
    return R.table_page(t.organizations, 3, 10, F.asc("name"), F.asc("id")).select("id", "name")


