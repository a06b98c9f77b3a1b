"""Dashboard and report aggregates."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rosterlake.operators import reports as R
from rosterlake.operators.predicates import generic_mailbox
from rosterlake.plans.registry import query

START = dt.datetime(2001, 1, 1)
END = dt.datetime(2001, 8, 2)


@query("a1_overview", "organizations contacts discovered_urls", """
SELECT o.*, c.*, u.* FROM (SELECT count(*)::BIGINT AS organizations, count(*) FILTER (date_added >= TIMESTAMP '2001-01-01')::BIGINT AS new_organizations, count(*) FILTER (relevance_score >= 0.8)::BIGINT AS relevant_organizations FROM organizations) o,
 (SELECT count(*)::BIGINT AS contacts, count(*) FILTER (date_added >= TIMESTAMP '2001-01-01')::BIGINT AS new_contacts, count(*) FILTER (contact_relevance_score >= 7)::BIGINT AS relevant_contacts FROM contacts) c,
 (SELECT count(*) FILTER (last_crawled >= TIMESTAMP '2001-01-01')::BIGINT AS urls_crawled FROM discovered_urls) u""")
def _(t):
    return R.overview(t.organizations, t.contacts, t.discovered_urls, START)


DRAFT = """(SELECT *, CASE WHEN email_draft_created THEN date_added END AS email_draft_date, (email LIKE '%@%') AS email_valid, 'u' || CAST(organization_id % 4 AS VARCHAR(9)) AS assigned_to FROM contacts)"""


def drafted(t):
    return (t.contacts.withColumn("email_draft_date", F.expr("CASE WHEN email_draft_created THEN date_added END"))
            .withColumn("email_valid", F.expr("email LIKE '%@%'"))
            .withColumn("assigned_to", F.expr("'u' || CAST(organization_id % 4 AS STRING)")))


@query("a2_email_overview", "contacts", f"""
SELECT drafts, new_drafts, valid_emails, confident, contacts, coalesce(drafts * 100.0::DOUBLE / contacts, 0) AS draft_rate FROM (SELECT count(*) FILTER (email_draft_created)::BIGINT AS drafts,
 count(*) FILTER (email_draft_created AND email_draft_date >= TIMESTAMP '2001-01-01')::BIGINT AS new_drafts, count(*) FILTER (email_valid)::BIGINT AS valid_emails,
 count(*) FILTER (contact_confidence_score >= 0.8)::BIGINT AS confident, count(*)::BIGINT AS contacts FROM {DRAFT})""")
def _(t):
    return R.email_overview(drafted(t), START)


@query("a3_growth", "organizations contacts", """
SELECT kind, total, new, round(coalesce(new * 100.0::DOUBLE / total, 0), 1) AS growth FROM (SELECT 'organizations' AS kind, count(*)::BIGINT AS total, count(*) FILTER (date_added >= TIMESTAMP '2001-01-01')::BIGINT AS new FROM organizations
UNION ALL SELECT 'contacts', count(*)::BIGINT, count(*) FILTER (date_added >= TIMESTAMP '2001-01-01')::BIGINT FROM contacts)""")
def _(t):
    a = R.growth(t.organizations, "date_added", START).withColumn("kind", F.lit("organizations"))
    return a.unionByName(R.growth(t.contacts, "date_added", START).withColumn("kind", F.lit("contacts")))


@query("a4_count_by_type", "organizations", "SELECT org_type, count(*)::BIGINT AS n FROM organizations GROUP BY 1")
def _(t):
    return R.count_by(t.organizations, "org_type").orderBy(F.desc("n"), "org_type")


@query("a5_count_by_state", "organizations", "SELECT state, count(*)::BIGINT AS n FROM organizations WHERE state <> '' GROUP BY 1")
def _(t):
    return R.count_by_state(t.organizations)


@query("a6_u1_daily_discoveries", "organizations contacts", """
SELECT date_added::DATE AS day, 'organizations' AS kind, count(*)::BIGINT AS n FROM organizations WHERE date_added BETWEEN TIMESTAMP '2001-01-01' AND TIMESTAMP '2001-08-02' GROUP BY 1
UNION ALL SELECT date_added::DATE, 'contacts', count(*)::BIGINT FROM contacts WHERE date_added BETWEEN TIMESTAMP '2001-01-01' AND TIMESTAMP '2001-08-02' GROUP BY 1""")
def _(t):
    return R.daily_counts({"organizations": (t.organizations, "date_added"), "contacts": (t.contacts, "date_added")}, START, END)


@query("a7_drafts_per_user", "contacts", f"""
SELECT assigned_to, count(*)::BIGINT AS drafts FROM {DRAFT} WHERE email_draft_created AND email_draft_date >= TIMESTAMP '2001-01-01' GROUP BY 1""")
def _(t):
    return R.drafts_per_user(drafted(t), START)


@query("a8_daily_sent", "email_engagements", "SELECT email_sent_date::DATE AS day, count(*)::BIGINT AS sent FROM email_engagements GROUP BY 1")
def _(t):
    return R.daily_sent(t.email_engagements)


@query("a9_daily_performance", "organizations contacts", """
SELECT o.date_added::DATE AS day, round(avg(relevance_score) * 10, 6) AS avg_relevance, count(*)::BIGINT AS organizations, sum(coalesce(n, 0))::BIGINT AS contacts FROM organizations o
LEFT JOIN (SELECT organization_id, count(id) AS n FROM contacts GROUP BY 1) c ON c.organization_id = o.id WHERE o.date_added IS NOT NULL GROUP BY 1""")
def _(t):
    return R.daily_performance(t.organizations, t.contacts).withColumn("avg_relevance", F.round("avg_relevance", 6))


@query("a9_daily_performance_fanout", "organizations contacts", """
SELECT o.date_added::DATE AS day, round(avg(relevance_score) * 10, 6) AS avg_relevance, count(o.id)::BIGINT AS organizations, count(c.id)::BIGINT AS contacts FROM organizations o
LEFT JOIN contacts c ON c.organization_id = o.id WHERE o.date_added IS NOT NULL GROUP BY 1""")
def _(t):
    return R.daily_performance(t.organizations, t.contacts, True).withColumn("avg_relevance", F.round("avg_relevance", 6))


METRIC_LABELS = {"urls_discovered": "URLs", "organizations_discovered": "Organizations", "emails_drafted": "Drafts"}


@query("a10_metrics_long", "system_metrics", """
SELECT metric_date, metric, value, CASE metric WHEN 'urls_discovered' THEN 'URLs' WHEN 'organizations_discovered' THEN 'Organizations' ELSE 'Drafts' END AS label
FROM (UNPIVOT system_metrics ON urls_discovered, organizations_discovered, emails_drafted INTO NAME metric VALUE value)""")
def _(t):
    return R.metrics_long(t.system_metrics, METRIC_LABELS)


@query("a11_thin_organizations_all", "organizations contacts", """
SELECT o.id, count(c.id)::BIGINT AS contact_count FROM organizations o LEFT JOIN contacts c ON c.organization_id = o.id GROUP BY o.id HAVING count(c.id) < 3""")
def _(t):
    return R.thin_organizations(t.organizations, t.contacts, 3, None).select("id", "contact_count")


@query("a11_thin_organizations", "organizations contacts", """
SELECT o.id, count(c.id)::BIGINT AS contact_count FROM organizations o LEFT JOIN contacts c ON c.organization_id = o.id GROUP BY o.id, o.relevance_score
HAVING count(c.id) < 3 ORDER BY o.relevance_score DESC, o.id LIMIT 300""")
def _(t):
    return R.thin_organizations(t.organizations, t.contacts, 3, 300).select("id", "contact_count")


@query("a14_click_statistics", "shortened_urls", """
SELECT coalesce(link_type, '(all)') AS link_type, count(*)::BIGINT AS links, sum(clicks)::BIGINT AS clicks, sum(clicks)::DOUBLE / count(*) AS clicks_per_link
FROM (SELECT coalesce(link_type, 'general') AS link_type, clicks FROM shortened_urls WHERE created_date >= TIMESTAMP '2023-12-02') GROUP BY ROLLUP(link_type)""")
def _(t):
    return R.click_statistics(t.shortened_urls, since=dt.datetime(2023, 12, 2))


@query("a15_validation_summary", "validation_reports", """
SELECT count(*)::BIGINT AS total, count(*) FILTER (auto_send_approved)::BIGINT AS approved, count(*) FILTER (NOT auto_send_approved)::BIGINT AS rejected,
 count(*) FILTER (auto_send_approved) * 100.0::DOUBLE / count(*) AS approval_rate FROM validation_reports""")
def _(t):
    return R.validation_summary(t.validation_reports)


@query("a16_score_pairs", "validation_reports",
       "SELECT id, contact_score, org_score, auto_send_approved FROM validation_reports WHERE contact_score IS NOT NULL AND org_score IS NOT NULL")
def _(t):
    return R.score_pairs(t.validation_reports)


@query("a17_listing_with_totals", "contacts organizations", """
SELECT o.org_type, c.id, c.email, count(*) OVER (PARTITION BY o.org_type)::BIGINT AS total FROM contacts c JOIN organizations o ON o.id = c.organization_id WHERE c.date_added >= TIMESTAMP '2001-07-01'""")
def _(t):
    o = t.organizations.select(F.col("id").alias("organization_id"), "org_type")
    q = t.contacts.filter("date_added >= TIMESTAMP '2001-07-01'").join(o, "organization_id")
    return R.listing_with_totals(q, "org_type", ["id", "email"])


@query("a18_run_counters", "search_results", """
SELECT 'query' AS dimension, query AS value, count(*)::BIGINT AS n FROM search_results GROUP BY 2 UNION ALL SELECT 'category', category, count(*)::BIGINT FROM search_results GROUP BY 2
UNION ALL SELECT 'state', state, count(*)::BIGINT FROM search_results GROUP BY 2""")
def _(t):
    return R.run_counters(t.search_results, "query", "category", "state")


@query("a19_client_counts", "organizations", """
SELECT count(*) FILTER (is_competitor)::BIGINT AS competitors, count(*) FILTER (NOT is_competitor)::BIGINT AS potential_clients,
 count(*) FILTER (NOT is_competitor AND relevance_score >= 7)::BIGINT AS high_relevance FROM organizations""")
def _(t):
    return R.client_counts(t.organizations)


PROJECTS = "CASE id % 3 WHEN 0 THEN '[{\"title\": \"a\", \"contains_automation\": true}, {\"title\": \"b\", \"contains_automation\": false}]' WHEN 1 THEN 'bad json' END"


@query("a20_page_evidence", "discovered_urls", """
SELECT organization_id, count(*)::BIGINT AS pages, count(*) FILTER (contains_infrastructure)::BIGINT AS infrastructure_pages,
 sum(CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END)::BIGINT AS projects, sum(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS automation_projects FROM discovered_urls GROUP BY 1""")
def _(t):
    return R.page_evidence(t.discovered_urls.withColumn("project_data", F.expr(PROJECTS)))


@query("a20_x30_industry_maximum", "discovered_urls", """
SELECT organization_id, k AS industry, max((industry_indicators->>k)::DOUBLE) AS score FROM discovered_urls, (SELECT unnest(['water','utility']) AS k) GROUP BY 1, 2""")
def _(t):
    return R.industry_maximum(t.discovered_urls)


@query("a21_distinct_states", "organizations", "SELECT DISTINCT state FROM organizations WHERE state <> ''")
def _(t):
    return R.distinct_values(t.organizations, "state")


@query("a22_engaged_contacts", "contacts email_engagements",
       "SELECT id FROM contacts WHERE id IN (SELECT contact_id FROM email_engagements)")
def _(t):
    return R.engaged_contacts(t.contacts, t.email_engagements).select("id")


@query("a24_rejection_rates", "validation_reports", """
SELECT kind, count(*)::BIGINT AS validated, count(*) FILTER (bad)::BIGINT AS rejected, count(*) FILTER (bad)::DOUBLE / count(*) AS rejection_rate FROM (
 SELECT CASE WHEN id % 2 = 0 THEN 'organizations' ELSE 'contacts' END AS kind, NOT auto_send_approved AS bad FROM validation_reports) GROUP BY 1""")
def _(t):
    q = t.validation_reports.withColumn("kind", F.expr("CASE WHEN id % 2 = 0 THEN 'organizations' ELSE 'contacts' END"))
    return R.rejection_rates(q, "kind", ~F.col("auto_send_approved"))


@query("a25_contact_run_metrics", "contacts", """
SELECT count(*)::BIGINT AS contacts, count(*) FILTER (email LIKE '%@%')::BIGINT AS with_valid_email, count(*) FILTER (contact_relevance_score >= 7)::BIGINT AS relevant,
 count(*) FILTER (NOT g)::BIGINT AS actual, count(*) FILTER (g)::BIGINT AS generic FROM (SELECT *, coalesce(regexp_matches(lower(email), '^(p1|p3)@'), false) AS g FROM contacts)""")
def _(t):
    return R.contact_run_metrics(t.contacts, generic_mailbox("email", ["p1", "p3"]), F.expr("email LIKE '%@%'"))


@query("a26_eligibility_by_type", "contacts organizations", """
SELECT o.org_type, count(*)::BIGINT AS total, count(*) FILTER (NOT email_draft_created AND email <> '' AND contact_confidence_score >= 0.7)::BIGINT AS eligible
FROM contacts c JOIN organizations o ON o.id = c.organization_id GROUP BY 1""")
def _(t):
    return R.eligibility_by_type(t.contacts, t.organizations)


@query("a27_count_by_state_and_type", "organizations", "SELECT state, org_type, count(*)::BIGINT AS n FROM organizations GROUP BY 1, 2")
def _(t):
    return R.count_by(t.organizations, "state", "org_type")
