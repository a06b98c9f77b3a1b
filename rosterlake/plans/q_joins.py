"""Joins between entities."""
from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.operators import joins as J
from rosterlake.operators.containment import contained_terms
from rosterlake.operators.predicates import has_value
from rosterlake.plans.registry import query, sql_list

PROFILES = [
    {"role_title": "Director", "synonyms": ["Head of"], "relevance_score": 9.0},
    {"role_title": "Operations Manager", "synonyms": ["Ops Lead"], "relevance_score": 8.0},
    {"role_title": "Engineer", "synonyms": ["Clerk"], "relevance_score": 6.0},
]
TEMPLATES = {"water": ["water utilities {state}", "treatment plants {state}"], "municipal": ["city of {state}"],
             "agriculture": ["farms {state}"]}


@query("j1_contact_organization_inner", "contacts organizations", """
SELECT c.id, c.email, o.name AS name, o.org_type FROM contacts c JOIN organizations o ON c.organization_id = o.id
WHERE c.email_draft_created = false AND c.email IS NOT NULL AND c.email <> '' AND o.org_type IN ('water','municipal')""")
def _(t):
    c = t.contacts.filter((~F.col("email_draft_created")) & has_value("email"))
    o = t.organizations.filter(F.col("org_type").isin("water", "municipal"))
    return J.contacts_with_organization(c, o, ["name", "org_type"]).select("id", "email", "name", "org_type")


@query("j2_contact_count_left", "contacts organizations", """
SELECT o.id, CAST(count(c.id) AS BIGINT) AS contact_count FROM organizations o LEFT JOIN contacts c ON c.organization_id = o.id GROUP BY o.id""")
def _(t):
    return J.organizations_with_counts(t.organizations, t.contacts).select("id", "contact_count")


@query("j3_engagement_contact_organization", "email_engagements contacts organizations", """
SELECT e.id, e.contact_id, o.org_type, o.name AS organization_name FROM email_engagements e JOIN contacts c ON e.contact_id = c.id
JOIN organizations o ON c.organization_id = o.id""")
def _(t):
    return J.engagement_with_organization(t.email_engagements, t.contacts, t.organizations).select(
        "id", "contact_id", "org_type", "organization_name")


@query("j4_organizations_without_contacts", "contacts organizations", """
SELECT o.id FROM organizations o LEFT JOIN (SELECT organization_id, count(*) AS n FROM (SELECT CASE WHEN organization_id % 37 = 0 THEN NULL ELSE organization_id END AS organization_id FROM contacts) GROUP BY 1) x
ON x.organization_id = o.id WHERE x.n IS NULL""")
def _(t):
    return J.organizations_without_contacts(t.organizations, t.contacts.withColumn("organization_id", F.expr("CASE WHEN organization_id % 37 = 0 THEN NULL ELSE organization_id END"))).select("id")


@query("j5_organizations_by_contact_count", "contacts organizations", """
SELECT o.id, x.n AS contact_count FROM organizations o JOIN (SELECT organization_id, CAST(count(id) AS BIGINT) AS n FROM contacts GROUP BY 1) x
ON x.organization_id = o.id WHERE x.n BETWEEN 1 AND 9""")
def _(t):
    return J.organizations_by_contact_count(t.organizations, t.contacts, 1, 9).select("id", "contact_count")


@query("j6_exclude_chosen", "organizations",
       "SELECT id FROM organizations WHERE id NOT IN (SELECT id FROM organizations WHERE relevance_score >= 8 OR is_competitor)")
def _(t):
    o = t.organizations
    return J.exclude_ids(o, o.filter("relevance_score >= 8"), o.filter("is_competitor")).select("id")


def with_strangers(contacts):
    """Contacts of which some belong to no stored organization."""
    return contacts.withColumn("organization_id", F.expr("CASE WHEN id % 5 = 0 THEN -organization_id ELSE organization_id END"))


@query("j8_organization_name_or_unknown", "contacts organizations", """
SELECT c.id, coalesce(o.name, 'Unknown') AS organization_name FROM (SELECT id, CASE WHEN id % 5 = 0 THEN -organization_id ELSE organization_id END AS organization_id FROM contacts) c
LEFT JOIN organizations o ON c.organization_id = o.id""")
def _(t):
    return J.organization_name_or(with_strangers(t.contacts), t.organizations).select("id", "organization_name")


@query("j8_validation_with_contact", "validation_reports contacts", """
SELECT v.id, c.email, v.auto_send_approved FROM validation_reports v JOIN contacts c ON v.contact_id = c.id""")
def _(t):
    return t.validation_reports.join(t.contacts.select(F.col("id").alias("contact_id"), "email"), "contact_id").select(
        "id", "email", "auto_send_approved")


@query("j9_bridge", "organizations discovered_urls", """
SELECT DISTINCT o.id AS organization_id, u.id AS url_id, u.url FROM organizations o
JOIN (SELECT l_suppkey AS organization_id, l_partkey AS url_id FROM lineitem) b ON b.organization_id = o.id
JOIN discovered_urls u ON u.id = b.url_id""")
def _(t):
    bridge = t.lineitem.select(F.col("l_suppkey").alias("organization_id"), F.col("l_partkey").alias("url_id"))
    o = t.organizations.select(F.col("id").alias("organization_id"))
    u = t.discovered_urls.select(F.col("id").alias("url_id"), "url")
    return J.through_bridge(o, bridge, u, "organization_id", "url_id").select("organization_id", "url_id", "url")


@query("j10_first_url_match", "discovered_urls organizations", """
SELECT o.id, x.uid AS discovered_url_id FROM (SELECT id, 'u' || CAST(id % 60 AS VARCHAR) AS source_url FROM organizations) o
JOIN (SELECT 'u' || CAST(id % 50 AS VARCHAR) AS url, min(id) AS uid FROM discovered_urls GROUP BY 1) x ON x.url = o.source_url""")
def _(t):
    urls = t.discovered_urls.selectExpr("id", "'u' || CAST(id % 50 AS STRING) AS url")
    o = t.organizations.selectExpr("id", "'u' || CAST(id % 60 AS STRING) AS source_url")
    return J.first_url_match(o, urls).select("id", "discovered_url_id")


LEXICON_SQL = """(SELECT DISTINCT 'cat' || CAST(item_id % 4 AS VARCHAR) AS category, word AS keyword, CAST(item_id % 3 + 1 AS DOUBLE) AS weight FROM
 (SELECT item_id, unnest(string_split(replace(lower(text), CHR(10), ' '), ' ')) AS word FROM benchmark) WHERE word <> '')"""


def lexicon(t):
    """Every word of the benchmark texts."""
    return t.benchmark.selectExpr(
        "'cat' || CAST(item_id % 4 AS STRING) AS category", "explode_outer(split(replace(lower(text), CHR(10), ' '), ' ')) AS keyword",
        "CAST(item_id % 3 + 1 AS DOUBLE) AS weight").filter("keyword <> ''").distinct()


J11_SQL = f"""SELECT d.doc_id, l.category, CAST(count(*) AS BIGINT) AS hits, sum(l.weight) AS score FROM documents d
JOIN {LEXICON_SQL} l ON contains(lower(d.text), l.keyword) GROUP BY 1, 2"""


@query("j11_contained_terms", "", J11_SQL)
def _(t):
    return contained_terms(t.documents, lexicon(t), "doc_id", "text").groupBy("doc_id", "category").agg(
        F.count("*").alias("hits"), F.sum("weight").alias("score"))


@query("j11_contained_terms_large_lexicon", "", J11_SQL)
def _(t):
    return contained_terms(t.documents, lexicon(t), "doc_id", "text", gram=2).groupBy("doc_id", "category").agg(
        F.count("*").alias("hits"), F.sum("weight").alias("score"))


MARKED = r"regexp_replace({}, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(1), 'g')"


@query("j11_contained_whole_words", "", f"""SELECT d.doc_id, l.category, CAST(count(*) AS BIGINT) AS hits, sum(l.weight) AS score FROM (SELECT doc_id, {MARKED.format('lower(text)')} AS t FROM documents) d
JOIN (SELECT category, weight, {MARKED.format('keyword')} AS k FROM {LEXICON_SQL}) l ON contains(d.t, l.k) GROUP BY 1, 2""")
def _(t):
    return contained_terms(t.documents, lexicon(t), "doc_id", "text", boundary=True).groupBy("doc_id", "category").agg(
        F.count("*").alias("hits"), F.sum("weight").alias("score"))


@query("j12_first_matching_profile", "contacts", """
SELECT id, CASE WHEN contains(t, 'director') OR contains(t, 'head of') THEN 9.0 WHEN contains(t, 'operations manager') OR contains(t, 'ops lead') THEN 8.0
 WHEN contains(t, 'engineer') OR contains(t, 'clerk') THEN 6.0 ELSE 5.0 END::DOUBLE AS relevance_score
FROM (SELECT id, lower(coalesce(job_title, '')) AS t FROM contacts)""")
def _(t):
    return J.first_matching_profile(t.contacts, PROFILES).select("id", "relevance_score")


@query("j13_resolve_tracking", "tracking_events shortened_urls email_engagements", """
SELECT e.event_id, coalesce(CASE WHEN e.event_type = 'open' THEN e.tid ELSE l.email_id END, '') AS mail_id, m.contact_id,
 CASE WHEN e.event_type = 'open' AND m.contact_id IS NULL THEN 'Email not found' WHEN e.event_type = 'click' AND l.short_id IS NULL THEN 'Link not found'
  WHEN e.event_type = 'open' THEN 'Open recorded' ELSE 'Click recorded' END AS outcome
FROM (SELECT *, CASE WHEN event_type = 'click' THEN 's' || CAST(event_id % 400 AS VARCHAR) ELSE 'm' || CAST(event_id * 2 AS VARCHAR) END AS tid FROM tracking_events) e
LEFT JOIN shortened_urls l ON e.event_type = 'click' AND l.short_id = e.tid
LEFT JOIN email_engagements m ON m.email_id = CASE WHEN e.event_type = 'open' THEN e.tid ELSE l.email_id END""")
def _(t):
    e = t.tracking_events.withColumn("tracking_id", F.expr(
        "CASE WHEN event_type = 'click' THEN 's' || CAST(event_id % 400 AS STRING) ELSE 'm' || CAST(event_id * 2 AS STRING) END"))
    return J.resolve_tracking(e, t.shortened_urls, t.email_engagements).select(
        "event_id", F.coalesce("mail_id", F.lit("")).alias("mail_id"), "contact_id", "outcome")


@query("j14_search_plan", "search_results", """
SELECT pos, category, replace(tpl, '{state}', place) AS query, state, county FROM search_results_base,
 unnest(CASE category WHEN 'water' THEN ['water utilities {state}', 'treatment plants {state}'] WHEN 'municipal' THEN ['city of {state}'] ELSE ['farms {state}'] END) AS x(tpl),
 (SELECT 'Utah' AS state, NULL AS county, 'Utah' AS place UNION ALL SELECT 'Illinois', 'Adams', 'Adams county Illinois' UNION ALL SELECT 'Illinois', 'Bond', 'Bond county Illinois')
""".replace("search_results_base", "(SELECT pos, category FROM search_results)"))
def _(t):
    cats = t.search_results.select("pos", "category")
    return J.search_plan(cats, TEMPLATES, ["Utah", "Illinois"], ["Adams", "Bond"]).select(
        "pos", "category", "query", "state", "county")


@query("j15_position_searches", "organizations", """
SELECT id, CAST(title_rank AS INTEGER) AS title_rank, title, CAST(pattern_rank AS INTEGER) AS pattern_rank,
 replace(replace(replace(replace(pattern, '{org}', name), '{location}', 'Town, ' || state), '{state}', state), '{title}', title) AS query
FROM (SELECT id, name, state, unnest(tt) AS title, generate_subscripts(tt, 1) - 1 AS title_rank FROM (SELECT id, name, state,
  CASE WHEN org_type = 'water' THEN ['Plant Manager','Director','Project Manager','Chief Engineer','Operations Manager','Estimator']
   ELSE ['Manager','Director','Supervisor','Engineer','Project Manager','Chief Engineer','Operations Manager','Estimator'] END AS tt FROM organizations)),
 (SELECT unnest(range({n})) AS pattern_rank, unnest({p}) AS pattern))""".replace("{n}", str(len(J.POSITION_PATTERNS))).replace("{p}", sql_list(J.POSITION_PATTERNS)).rstrip(")") + ")")
def _(t):
    o = t.organizations.withColumn("city", F.lit("Town"))
    return J.position_searches(o, {"water": ["Plant Manager", "Director"]})


@query("j16_campaign_log", "email_engagements contacts", """
SELECT e.email_id, c.id AS contact_id, c.email FROM email_engagements e JOIN contacts c ON c.id = e.contact_id""")
def _(t):
    return J.campaign_log(t.email_engagements, t.contacts).select("email_id", "contact_id", "email")
