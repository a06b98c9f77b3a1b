"""Sources, sinks' transforms, set operations, report tables and the cleanup of title-like organizations."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rosterlake.operators import cleanup as CL
from rosterlake.operators import merge as M
from rosterlake.operators import pages as P
from rosterlake.operators import reports as R
from rosterlake.operators import sets as U
from rosterlake.plans.q_pages import INF, PAGE_FACTS, PRO
from rosterlake.plans.q_scoring import LEX
from rosterlake.plans.registry import query
from rosterlake.sources import search as SE
from rosterlake.sources import tables as TB
from rosterlake.sources import tracking as TR
from rosterlake.streaming.tracking import run_to_table, shared_folder


@query("s1_full_scan", "organizations", "SELECT id, name, NULL::VARCHAR AS county, relevance_score FROM organizations")
def _(t):
    folder = shared_folder(t.spark, "s1")
    TB.conform(t.organizations, TB.ORGANIZATION_SCHEMA).write.parquet(folder)
    return TB.read_entities(t.spark, folder, TB.ORGANIZATION_SCHEMA).select("id", "name", "county", "relevance_score")


LOG = """
SELECT ts, event_type, tracking_id, ip_address, user_agent, '' AS referrer FROM tracking_events"""


def logged(t) -> str:
    """The tracking events as a log of one folder per day."""
    folder = shared_folder(t.spark, "log")
    TR.write_tracking(t.tracking_events.withColumn("referrer", F.lit("")), folder)
    return folder


@query("s2_k1_tracking_log", "tracking_events", LOG)
def _(t):
    return TR.read_tracking(t.spark, logged(t)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("s2_tracking_log_stream", "tracking_events", LOG)
def _(t):
    lines = TR.stream_tracking(t.spark, f"{logged(t)}/date=*", files_per_trigger=20)
    return run_to_table(lines, shared_folder(t.spark, "s2")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("s3_csv_export", "organizations", "SELECT id, name, org_type, nullif(website, '') AS website, relevance_score FROM organizations")
def _(t):
    folder = shared_folder(t.spark, "s3")
    o = t.organizations.select("id", "name", "org_type", "website", "relevance_score")
    TB.export_csv(o, folder)
    return t.spark.read.schema(o.schema).option("header", True).csv(folder)


@query("s4_assignments_file", "organizations", """
SELECT org_type, 'user ' || org_type AS assigned_to, (row_number() OVER (ORDER BY org_type) - 1)::INT AS rank FROM (SELECT DISTINCT org_type FROM organizations WHERE org_type IS NOT NULL)""")
def _(t):
    folder = shared_folder(t.spark, "s4")
    types = t.organizations.filter("org_type IS NOT NULL").select("org_type").distinct()
    entries = F.sort_array(F.collect_list(F.struct(F.col("org_type").alias("k"), F.concat(F.lit("user "), "org_type").alias("v"))))
    types.agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.text(folder)
    return TB.read_assignments(t.spark, folder)


@query("s5_bounded_settings", "organizations", """
SELECT id, CASE WHEN relevance_score BETWEEN 0 AND 1 THEN relevance_score ELSE 0.7 END::DOUBLE AS hurdle FROM organizations""")
def _(t):
    return t.organizations.select("id", TB.bounded_setting(F.col("relevance_score")).alias("hurdle"))


ANSWER = ("CASE pos % 3 WHEN 0 THEN '{\"items\": [{\"link\": \"' || url || '\", \"title\": \"T' || pos || '\", \"snippet\": \"s\"}, {\"snippet\": \"neither\"}]}' "
          "WHEN 1 THEN '[{\"formattedUrl\": \"' || url || '\", \"pagemap\": {\"metatags\": [{\"og:title\": \"M' || pos || '\"}]}}]' ELSE 'no json' END")


@query("s7_ingest_results", "search_results", """
SELECT pos AS answer, 0 AS pos, url, CASE WHEN pos % 3 = 0 THEN 'T' ELSE 'M' END || pos AS title, CASE WHEN pos % 3 = 0 THEN 's' ELSE '' END AS snippet FROM search_results WHERE pos % 3 IN (0, 1)""")
def _(t):
    a = t.search_results.withColumn("pos", F.col("pos").cast("string")).select(F.col("pos").cast("long").alias("answer"), F.expr(ANSWER.replace("pos % 3", "CAST(pos AS BIGINT) % 3")).alias("body"))
    return SE.ingest_results(a, keep=["answer"])


@query("s8_normalize_results", "search_results", r"""
SELECT query, pos, url, regexp_extract(url, '://(?:www\.)?([^/]*)', 1) AS domain, category, state, 'search' AS discovery_method FROM search_results""")
def _(t):
    return SE.normalize_results(t.search_results).drop("title", "snippet")


@query("s9_vendor_organizations", "organizations", """
SELECT id AS seq, name, org_type, website, state FROM organizations WHERE name <> ''""")
def _(t):
    body = F.to_json(F.struct(F.struct(F.col("id").cast("string").alias("id"), "name", F.col("website").alias("website_url"), "state").alias("organization")))
    return SE.vendor_organizations(t.organizations.select(F.col("id").alias("seq"), "org_type", body.alias("body"))).select("seq", "name", "org_type", "website", "state")


PEOPLE = "SELECT seq, organization_id, CASE WHEN seq % 2 = 0 THEN c.first_name ELSE i.first_name END AS first_name, CASE WHEN seq % 2 = 0 THEN c.last_name ELSE i.last_name END AS last_name, CASE WHEN seq % 2 = 0 THEN c.job_title ELSE i.job_title END AS job_title, i.email, i.phone FROM (SELECT seq, order_id, first_name, last_name, job_title, email, phone FROM {i}) i JOIN {c} c ON c.id = i.order_id"


@query("s10_vendor_people", "contacts incoming_contacts", f"""
WITH p AS ({PEOPLE.format(i='incoming_contacts', c='(SELECT id, organization_id, first_name, last_name, job_title FROM contacts)')}), n AS (SELECT organization_id, job_title, first_name, last_name, arg_min(email, seq) FILTER (trim(email) <> '') AS email, arg_min(phone, seq) FILTER (trim(phone) <> '') AS phone FROM p WHERE trim(first_name) <> '' AND trim(last_name) <> '' AND trim(job_title) <> '' GROUP BY 1, 2, 3, 4),
t AS (SELECT organization_id, job_title, first_name, last_name, min(id) AS id FROM contacts WHERE job_title <> '' GROUP BY 1, 2, 3, 4)
SELECT c.id, c.organization_id, c.job_title, coalesce(nullif(trim(c.email), ''), x.email, c.email) AS email, coalesce(nullif(c.phone, ''), x.phone) AS phone, contact_confidence_score FROM contacts c LEFT JOIN (SELECT t.id, n.email, n.phone FROM n JOIN t USING (organization_id, job_title, first_name, last_name)) x ON x.id = c.id
UNION ALL SELECT NULL, n.organization_id, n.job_title, n.email, n.phone, 0.85 FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.organization_id = n.organization_id AND t.job_title = n.job_title AND t.first_name = n.first_name AND t.last_name = n.last_name)""")
def _(t):
    c = t.contacts.select("id", "organization_id", "first_name", "last_name", "job_title")
    p = t.spark.sql(PEOPLE.format(i="{i}", c="{c}"), i=t.incoming_contacts, c=c)
    return M.add_or_fill_by_position(t.contacts, p).select("id", "organization_id", "job_title", "email", "phone", "contact_confidence_score")


@query("s11_run_metrics", "organizations", """
SELECT count(*) FILTER (is_competitor)::BIGINT AS competitors, count(*) FILTER (NOT is_competitor)::BIGINT AS potential_clients, 12 AS runtime_seconds, 0 AS errors_count FROM organizations""")
def _(t):
    return TB.run_metrics(R.client_counts(t.organizations).drop("high_relevance"), dt.datetime(2024, 1, 31), 12).drop("metric_date")


@query("s12_run_log", "", """
SELECT id, arg_max(status, struct_pack(d := started_at, s := status, i := items_processed, a := items_added)) AS status, min(started_at)::DATE AS started, max(started_at)::DATE AS completed FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS started_at, CASE l_linestatus WHEN 'F' THEN 'completed' ELSE 'failed' END AS status,
 CAST(l_quantity AS INT) AS items_processed, l_linenumber AS items_added FROM lineitem) GROUP BY 1""")
def _(t):
    runs = t.process_summaries.withColumn("status", F.expr("CASE status WHEN 'completed' THEN status ELSE 'failed' END"))
    log = TB.run_started(runs).unionByName(TB.run_finished(runs, "started_at", ["items_processed", "items_added"]))
    return TB.latest_runs(log).select("id", "status", F.to_date("started_at").alias("started"), F.to_date("completed_at").alias("completed"))


@query("s13_discovery_report", "organizations contacts", """
SELECT 'by_type' AS section, org_type AS key, count(*)::DOUBLE AS value FROM organizations GROUP BY 2 UNION ALL SELECT 'by_state', state, count(*)::DOUBLE FROM organizations WHERE state <> '' GROUP BY 2
UNION ALL SELECT 'metrics', unnest(['competitors', 'potential_clients', 'high_relevance']), unnest([count(*) FILTER (is_competitor), count(*) FILTER (NOT is_competitor), count(*) FILTER (NOT is_competitor AND relevance_score >= 7)])::DOUBLE FROM organizations
UNION ALL SELECT * FROM (SELECT 'clients', id::VARCHAR, relevance_score FROM organizations WHERE NOT is_competitor AND relevance_score >= 6 ORDER BY relevance_score DESC, id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'competitors', id::VARCHAR, relevance_score FROM organizations WHERE is_competitor ORDER BY relevance_score DESC, id LIMIT 10)""")
def _(t):
    o = t.organizations
    lists = R.ranked_lists(o, t.contacts).filter("section <> 'contacts'")
    counts = R.client_counts(o).unpivot([], ["competitors", "potential_clients", "high_relevance"], "key", "value")
    return U.union_all(R.report_rows("by_type", R.count_by(o, "org_type"), "org_type", "n"), R.report_rows("by_state", R.count_by_state(o), "state", "n"),
                       R.report_rows("metrics", counts, "key", "value"),
                       lists.select("section", F.col("organization_id").cast("string").alias("key"), F.col("score").alias("value")))


@query("s14_campaign_report", "contacts organizations assignments", """
SELECT 'contacts_by_type' AS section, o.org_type AS key, count(*)::DOUBLE AS value FROM contacts c JOIN organizations o ON o.id = c.organization_id GROUP BY 2
UNION ALL SELECT 'drafts_by_user', coalesce(a.assigned_to, 'Unknown'), count(*)::DOUBLE FROM contacts c JOIN organizations o ON o.id = c.organization_id LEFT JOIN assignments a ON a.org_type = o.org_type WHERE c.email_draft_created GROUP BY 2""")
def _(t):
    o = t.organizations.select(F.col("id").alias("organization_id"), "org_type")
    per_org = t.contacts.groupBy("organization_id").agg(F.count("*").alias("n"))
    by_type = per_org.join(o, "organization_id").groupBy("org_type").agg(F.sum("n").alias("n"))
    drafts = M.assign_by_type(t.contacts.filter("email_draft_created"), t.organizations, t.assignments).groupBy(F.coalesce("assigned_to", F.lit("Unknown")).alias("u")).agg(F.count("*").alias("n"))
    return U.union_all(R.report_rows("contacts_by_type", by_type, "org_type", "n"), R.report_rows("drafts_by_user", drafts, "u", "n"))


@query("u2_union_missing_columns", "contacts incoming_contacts", """
SELECT id, email, NULL AS seq FROM contacts UNION ALL SELECT NULL, email, seq FROM incoming_contacts""")
def _(t):
    return U.union_all(t.contacts.select("id", "email"), t.incoming_contacts.select("email", "seq"))


@query("u3_distinct_urls", "discovered_urls", """
SELECT DISTINCT CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'https://' || u END AS url FROM (SELECT regexp_replace(trim(url), '/+$', '') AS u FROM discovered_urls)""")
def _(t):
    return U.distinct_urls(t.discovered_urls)


@query("u4_except_known", "discovered_urls", "SELECT id, url FROM discovered_urls WHERE url NOT IN (SELECT url FROM discovered_urls WHERE last_crawled IS NOT NULL)")
def _(t):
    return U.except_known(t.discovered_urls, t.discovered_urls.filter("last_crawled IS NOT NULL")).select("id", "url")


@query("u5_intersect", "contacts organizations", "SELECT organization_id AS id FROM contacts WHERE email_draft_created INTERSECT SELECT id FROM organizations WHERE is_competitor")
def _(t):
    return U.in_both(t.contacts.filter("email_draft_created").select(F.col("organization_id").alias("id")), t.organizations.filter("is_competitor"), ["id"])


@query("u5_u6_title_lists", "contacts", """
SELECT id, job_title || '|Director|Engineer' AS titles, CASE WHEN job_title = 'Clerk' THEN 'Clerk' ELSE '' END AS shared FROM contacts WHERE job_title IS NOT NULL""")
def _(t):
    own = F.array("job_title", F.lit("Director"))
    q = t.contacts.filter("job_title IS NOT NULL")
    return q.select("id", F.array_join(U.ordered_union(own, F.array(F.lit("Director"), F.lit("Engineer"))), "|").alias("titles"),
                    F.array_join(U.overlap(own, F.array(F.lit("Clerk"))), "|").alias("shared"))


@query("x17_extracted_organizations", "organizations", """
SELECT 'u' || id AS source_url, name, CASE WHEN id % 2 = 0 THEN org_type ELSE 'water' END AS org_type, least(10, CASE WHEN id % 3 = 0 THEN 5 ELSE round(confidence_score, 6) * 10 END)::DOUBLE AS relevance_score FROM organizations""")
def _(t):
    rec = F.to_json(F.struct("name", F.expr("CASE WHEN id % 2 = 0 THEN org_type ELSE 'unheard' END").alias("org_type"), F.lit("some lake").alias("description"),
                             F.expr("CASE WHEN id % 3 <> 0 THEN confidence_score END").alias("confidence_score")))
    a = t.organizations.select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("Sure: ["), rec, F.lit("] done")).alias("body"))
    known = ["transportation", "engineering", "agriculture", "municipal", "water"]
    return SE.extracted_organizations(a, known_types=known, lexicon={"water": ["lake"], "farm": ["zzz"]}).select(
        "source_url", "name", "org_type", "relevance_score")


@query("t16_role_profiles", "contacts", """
SELECT job_title, CASE WHEN contains(job_title, 'Manager') OR contains(job_title, 'Director') THEN 8 ELSE 6 END::INT AS relevance_score, count(*)::BIGINT AS n FROM contacts WHERE job_title IS NOT NULL GROUP BY 1""")
def _(t):
    from rosterlake.operators.scoring import role_profile
    q = t.contacts.filter("job_title IS NOT NULL").groupBy("job_title").agg(F.count("*").alias("n"))
    return q.select("job_title", role_profile("job_title")["relevance_score"].alias("relevance_score"), "n").orderBy(F.desc("relevance_score"), "job_title")


@query("p23_url_enrichment", "discovered_urls", f"""
WITH facts AS (SELECT f.*, p.url, p.html FROM ({PAGE_FACTS}) f JOIN pages p USING (page_id)),
latest AS (SELECT url, max(page_id) AS page_id FROM pages WHERE page_id % 4 <> 1 GROUP BY url), first AS (SELECT url, min(id) AS id FROM discovered_urls GROUP BY url)
SELECT d.id, d.url, md5(CASE WHEN f.page_id IS NULL THEN d.html_content ELSE f.html END) AS content, CASE WHEN f.page_id IS NULL THEN d.last_crawled ELSE TIMESTAMP '2024-02-01' + to_minutes(f.page_id) END AS last_crawled,
 CASE WHEN f.page_id IS NOT NULL THEN f.page_id % 4 END::INT AS crawl_depth, coalesce(f.page_type, d.page_type) AS page_type, f.title, f.contains_contact_info, coalesce(f.contains_infrastructure, d.contains_infrastructure) AS contains_infrastructure, f.water
FROM discovered_urls d LEFT JOIN first ON first.id = d.id LEFT JOIN latest l ON l.url = first.url LEFT JOIN facts f ON f.page_id = l.page_id""")
def _(t):
    """Three of four pages are crawled again; their facts replace those of the stored record of the same URL."""
    crawled = t.pages.where("page_id % 4 <> 1")
    facts = P.page_facts(crawled, keep=("page_id", "url", "html"), infrastructure=INF, process=PRO, industries=LEX)
    rows = facts.select("url", F.col("html").alias("html_content"), F.lit("[]").alias("extracted_links"), (F.expr("TIMESTAMP_NTZ '2024-02-01' + make_interval(0, 0, 0, 0, 0, CAST(page_id AS INT), 0)")).alias("last_crawled"),
                        F.expr("CAST(page_id % 4 AS INT)").alias("crawl_depth"), F.lit("crawl").alias("source"), "title", "page_type", "contains_contact_info", "contains_infrastructure",
                        F.round(F.col("industry_indicators")["water"], 6).alias("water"))
    kept = M.upsert_url_records(t.discovered_urls, rows, ("title", "page_type", "contains_contact_info", "contains_infrastructure", "water"))
    return kept.select("id", "url", F.md5("html_content").alias("content"), F.col("last_crawled").cast("timestamp_ntz").alias("last_crawled"), "crawl_depth", "page_type", "title",
                       "contains_contact_info", "contains_infrastructure", "water")


REAL = "SELECT id AS title_id, 'Real ' || CAST(id % 9 AS {s}) AS name, state, 'water' AS org_type, 'found' AS description, CAST(0.9 AS DOUBLE) AS confidence_score, CAST(7.5 AS DOUBLE) AS relevance_score FROM {o}"


@query("p28_fix_title_organizations", "organizations", """
SELECT 'moved' AS kind, o.id AS old_id, r.name AS new_name FROM organizations o JOIN (SELECT id, 'Real ' || (id % 9) AS name FROM organizations) r USING (id) WHERE starts_with(o.name, 'How to')
UNION ALL SELECT DISTINCT 'new', NULL::BIGINT, 'Real ' || (id % 9) || ' ' || state FROM organizations WHERE starts_with(name, 'How to')""")
def _(t):
    real = t.spark.sql(REAL.format(s="STRING", o="{o}"), o=t.organizations)
    fixed = CL.fix_title_organizations(t.organizations, t.contacts, real)
    moved = fixed.moves.join(fixed.organizations.select(F.col("id").alias("new_id"), F.col("name").alias("new_name")), "new_id").select(
        F.lit("moved").alias("kind"), "old_id", "new_name")
    new = fixed.organizations.filter("name LIKE 'Real %'").select(F.lit("new").alias("kind"), F.lit(None).cast("long").alias("old_id"),
                                                                 F.concat_ws(" ", "name", "state").alias("new_name"))
    return moved.unionByName(new)


@query("p28_fix_title_counts", "organizations contacts", """
SELECT (SELECT count(*) FROM organizations)::BIGINT AS total_orgs, count(*)::BIGINT AS webpage_titles, count(*)::BIGINT AS fixed_orgs, coalesce(sum(n), 0)::BIGINT AS moved_contacts, 0::BIGINT AS skipped
FROM organizations o LEFT JOIN (SELECT organization_id, count(*) AS n FROM contacts GROUP BY 1) c ON c.organization_id = o.id WHERE starts_with(name, 'How to')""")
def _(t):
    real = t.spark.sql(REAL.format(s="STRING", o="{o}"), o=t.organizations)
    return CL.fix_title_organizations(t.organizations, t.contacts, real).statistics


