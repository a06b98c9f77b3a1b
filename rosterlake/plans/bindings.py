"""Binding views: the entity tables expressed over the given parquet tables, one text for both engines."""
from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

ORGANIZATIONS = """
SELECT c.c_custkey AS id,
 CASE WHEN c.c_custkey % 50 = 7 THEN 'How to size pumps ' || CAST(c.c_custkey AS STRING) || ' - Blog' ELSE 'Org ' || CAST(c.c_custkey % 40 AS STRING) || CASE c.c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' District' ELSE ' District Office' END END AS name,
 CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'transportation' WHEN 'BUILDING' THEN 'engineering' WHEN 'FURNITURE' THEN 'agriculture' WHEN 'HOUSEHOLD' THEN 'municipal' ELSE 'water' END AS org_type,
 n.n_name AS state,
 CASE WHEN c.c_custkey % 7 = 0 THEN NULL WHEN c.c_custkey % 11 = 0 THEN '' WHEN c.c_custkey % 13 = 0 THEN 'https://www.campus' || CAST(c.c_custkey AS STRING) || '.edu' ELSE 'https://www.org' || CAST(c.c_custkey AS STRING) || '.gov' END AS website,
 d.text AS description, o.first_seen AS date_added,
 CAST(c.c_custkey * 37 % 101 AS DOUBLE) / 10 AS relevance_score,
 CAST(c.c_custkey * 53 % 101 AS DOUBLE) / 100 AS confidence_score,
 CASE c.c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'completed' WHEN 2 THEN 'partial' ELSE 'attempted' END AS contact_discovery_status,
 (c.c_custkey % 10 = 3) AS is_competitor
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
LEFT JOIN {documents} d ON d.doc_id = c.c_custkey
LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_seen FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
"""
CONTACTS = """
SELECT o_orderkey AS id, o_custkey AS organization_id,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN '' ELSE 'First' || CAST(o_orderkey % 97 AS STRING) END AS first_name,
 CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE 'Last' || CAST(o_orderkey % 89 AS STRING) END AS last_name,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'Operations Manager' WHEN '2-HIGH' THEN 'Director of Public Works' WHEN '3-MEDIUM' THEN 'Process Engineer' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'Clerk' END AS job_title,
 CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'p' || CAST(o_orderkey AS STRING) || '@school.edu' ELSE 'P' || CAST(o_orderkey % 5 AS STRING) || '@org' || CAST(o_custkey AS STRING) || '.gov' END AS email,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '(555) 123-' || CAST(1000 + o_orderkey % 9000 AS STRING) END AS phone,
 (o_orderstatus = 'F') AS email_draft_created, o_orderdate AS date_added,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey * 41 % 101 AS DOUBLE) / 100 END AS contact_confidence_score,
 CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderkey * 43 % 101 AS DOUBLE) / 10 END AS contact_relevance_score
FROM {orders}
"""
EMAIL_ENGAGEMENTS = """
SELECT event_id AS id, user_id AS contact_id, 'm' || CAST(event_id AS STRING) AS email_id, ts AS email_sent_date,
 (event_type IN ('view','click','purchase')) AS email_opened, CASE WHEN event_type IN ('view','click','purchase') THEN ts END AS email_opened_date,
 (event_type = 'signup') AS email_replied, CASE WHEN event_type = 'signup' THEN ts END AS email_replied_date,
 (event_type = 'click') AS clicked_link, CASE WHEN event_type = 'click' THEN ts END AS clicked_link_date,
 (event_type = 'purchase') AS converted, CASE WHEN event_type = 'purchase' THEN ts END AS conversion_date
FROM {events}
"""
TRACKING_EVENTS = """
SELECT event_id, ts, CASE WHEN event_type = 'click' THEN 'click' ELSE 'open' END AS event_type,
 'm' || CAST(user_id % 20 AS STRING) AS tracking_id, '10.0.0.' || CAST(user_id % 5 AS STRING) AS ip_address,
 CASE event_id % 4 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/91.0' WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Mobile Safari/604.1' WHEN 2 THEN 'Mozilla/5.0 (Linux; Android 13; Tablet) Firefox/118.0' ELSE 'curl/8.0' END AS user_agent
FROM {events}
"""
DISCOVERED_URLS = """
SELECT page_id AS id, page_id % 150 AS organization_id, url, html AS html_content,
 CASE page_id % 5 WHEN 0 THEN 'homepage' WHEN 1 THEN 'about' WHEN 2 THEN 'contact' WHEN 3 THEN 'team' ELSE 'other' END AS page_type,
 CASE WHEN page_id % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_crawled,
 CAST(page_id * 29 % 101 AS DOUBLE) / 100 AS priority_score, (page_id % 4 = 1) AS contains_infrastructure,
 '{{"water": ' || CAST(CAST(page_id % 10 AS DOUBLE) / 10 AS STRING) || ', "utility": ' || CAST(CAST(page_id % 7 AS DOUBLE) / 10 AS STRING) || '}}' AS industry_indicators
FROM {pages}
"""
SHORTENED_URLS = """
SELECT CONCAT('s', CAST(page_id AS STRING)) AS short_id, page_id % 150 AS contact_id, 'm' || CAST(page_id % 20 AS STRING) AS email_id, url AS original_url,
 CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'contact' WHEN 2 THEN 'demo' ELSE 'cta' END AS link_type, page_id % 9 AS clicks,
 TIMESTAMP '2024-01-01 00:00:00' AS created_date
FROM {pages}
"""
SYSTEM_METRICS = """
SELECT CAST(o_orderdate AS DATE) AS metric_date, COUNT(*) AS urls_discovered, COUNT(DISTINCT o_custkey) AS organizations_discovered,
 CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS emails_drafted
FROM {orders} GROUP BY CAST(o_orderdate AS DATE)
"""
PROCESS_SUMMARIES = """
SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 'org_building' WHEN 'N' THEN 'contact_building' ELSE 'email_sending' END AS process_type,
 l_shipdate AS started_at, CASE l_linestatus WHEN 'F' THEN 'completed' ELSE 'running' END AS status,
 CAST(l_quantity AS INT) AS items_processed, l_linenumber AS items_added
FROM {lineitem}
"""
VALIDATION_REPORTS = """
SELECT doc_id AS id, doc_id AS contact_id, TIMESTAMP '2024-01-01 00:00:00' AS validation_date, (quality = 1) AS auto_send_approved,
 CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id * 17 % 101 AS DOUBLE) / 100 END AS contact_score,
 CAST(doc_id * 19 % 101 AS DOUBLE) / 100 AS org_score, '["r' || CAST(toxic AS STRING) || '"]' AS reasons
FROM {labels}
"""
# search hits: one per stored document, the document's own words as title and snippet
SEARCH_RESULTS = """
SELECT d.doc_id AS pos, 'q' || CAST(d.doc_id % 7 AS STRING) AS query,
 'https://' || CASE d.doc_id % 3 WHEN 0 THEN 'www.' ELSE '' END || 'site' || CAST(d.doc_id % 60 AS STRING) || CASE d.doc_id % 4 WHEN 0 THEN '.gov' WHEN 1 THEN '.co.uk' WHEN 2 THEN '.com' ELSE '.org' END || '/p/' || CAST(d.doc_id AS STRING) AS url,
 CASE WHEN d.doc_id % 9 = 0 THEN '' ELSE SPLIT_PART(d.text, CHR(10), 1) END AS title,
 REPLACE(d.text, CHR(10), ' ') AS snippet,
 CASE d.doc_id % 3 WHEN 0 THEN 'water' WHEN 1 THEN 'municipal' ELSE 'agriculture' END AS category,
 CASE d.doc_id % 4 WHEN 0 THEN 'Utah' WHEN 1 THEN 'Nevada' WHEN 2 THEN 'Illinois' ELSE NULL END AS state
FROM {documents} d
"""
# fresh finds offered to the upserts: some match a stored row, some do not, some are repeated
INCOMING_CONTACTS = """
SELECT l_orderkey * 10 + l_linenumber AS seq, l_suppkey AS organization_id,
 CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE 'New' || CAST(l_orderkey % 97 AS STRING) END AS first_name,
 'Fam' || CAST(l_orderkey % 89 AS STRING) AS last_name,
 CASE l_returnflag WHEN 'A' THEN 'Plant Director' WHEN 'N' THEN 'Clerk' ELSE NULL END AS job_title,
 CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber > 4 THEN 'new' || CAST(l_orderkey AS STRING) || '@fresh.org' ELSE 'p' || CAST(l_orderkey % 5 AS STRING) || '@ORG' || CAST(l_partkey AS STRING) || '.gov' END AS email,
 CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE '555-' || CAST(1000 + l_orderkey % 9000 AS STRING) END AS phone,
 l_discount * 10 AS contact_relevance_score, l_orderkey AS order_id
FROM (SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey, MIN(l_suppkey) AS l_suppkey, MIN(l_returnflag) AS l_returnflag, MIN(l_discount) AS l_discount, MIN(l_tax) AS l_tax
 FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l
"""
INCOMING_ORGANIZATIONS = """
SELECT s.l_orderkey * 10 + s.l_linenumber AS seq,
 'Org ' || CAST(s.l_partkey % 60 AS STRING) || CASE s.l_linenumber % 2 WHEN 0 THEN '' ELSE ' District' END AS name,
 'NATION_' || CAST(s.l_suppkey % 25 AS STRING) AS state, 'water' AS org_type,
 CASE WHEN s.l_linenumber % 3 = 0 THEN '' ELSE 'seen in ' || CAST(s.l_partkey % 10 AS STRING) END AS description,
 s.l_discount * 10 AS confidence_score, s.l_tax * 100 AS relevance_score
FROM (SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey, MIN(l_suppkey) AS l_suppkey, MIN(l_returnflag) AS l_returnflag, MIN(l_discount) AS l_discount, MIN(l_tax) AS l_tax
 FROM {lineitem} GROUP BY l_orderkey, l_linenumber) s
"""
ASSIGNMENTS = """
SELECT 'ana' AS assigned_to, 'municipal' AS org_type, 0 AS rank UNION ALL SELECT 'ana', 'water', 1
UNION ALL SELECT 'ben', 'engineering', 2 UNION ALL SELECT 'ben', 'transportation', 3
"""
# one staff member per page; queries lay them out as cards, tables, lists and so on
STAFF = """
SELECT o_orderkey AS page_id, 'https://www.town' || CAST(o_custkey AS STRING) || '.gov/' || CASE o_orderkey % 3 WHEN 0 THEN 'staff' WHEN 1 THEN 'contact' ELSE 'about' END AS url,
 CASE o_orderkey % 4 WHEN 0 THEN 'Anna' WHEN 1 THEN 'Bert' WHEN 2 THEN 'Clara' ELSE 'Dirk' END AS fn, CASE o_orderkey % 5 WHEN 0 THEN 'Adams' WHEN 1 THEN 'Brown' WHEN 2 THEN 'Clark' WHEN 3 THEN 'Dunn' ELSE 'Evans' END AS ln,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'Operations Manager' WHEN '2-HIGH' THEN 'Director of Public Works' WHEN '3-MEDIUM' THEN 'Process Engineer' WHEN '4-NOT SPECIFIED' THEN 'City Clerk' ELSE 'Water Supervisor' END AS title,
 CASE o_orderpriority WHEN '1-URGENT' THEN 10.0 WHEN '2-HIGH' THEN 9.0 WHEN '3-MEDIUM' THEN 8.0 WHEN '4-NOT SPECIFIED' THEN 5.0 ELSE 10.0 END AS rel,
 'staff' || CAST(o_orderkey AS STRING) || '@town.gov' AS email, '555-123-' || CAST(1000 + o_orderkey % 9000 AS STRING) AS phone, o_custkey AS town
FROM {orders}
"""

VIEWS = {
    "staff": (STAFF, "orders"),
    "organizations": (ORGANIZATIONS, "customer nation documents orders"),
    "contacts": (CONTACTS, "orders"),
    "email_engagements": (EMAIL_ENGAGEMENTS, "events"),
    "tracking_events": (TRACKING_EVENTS, "events"),
    "discovered_urls": (DISCOVERED_URLS, "pages"),
    "shortened_urls": (SHORTENED_URLS, "pages"),
    "system_metrics": (SYSTEM_METRICS, "orders"),
    "process_summaries": (PROCESS_SUMMARIES, "lineitem"),
    "validation_reports": (VALIDATION_REPORTS, "labels"),
    "search_results": (SEARCH_RESULTS, "documents"),
    "incoming_contacts": (INCOMING_CONTACTS, "lineitem"),
    "incoming_organizations": (INCOMING_ORGANIZATIONS, "lineitem"),
    "assignments": (ASSIGNMENTS, ""),
}
RAW = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
       "labels conversations").split()


class Tables:
    """Raw tables and binding views of one data folder as lazy DataFrames (attribute access)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._seen = spark, sf_dir.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in self._seen:
            return self._seen[name]
        if name in VIEWS:
            body, raw = VIEWS[name]
            df = self.spark.sql(body, **{r: getattr(self, r) for r in raw.split()}) if raw else self.spark.sql(body)
        elif name in RAW:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        else:
            raise AttributeError(name)
        self._seen[name] = df
        return df


def with_views(names: list[str], sql: str) -> str:
    """Prefix SQL with the named views as a WITH clause (for the checking engine)."""
    parts = []
    for n in names:
        body, raw = VIEWS[n]
        parts.append(f"{n} AS ({body.format(**{r: r for r in raw.split()}).strip()})")
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body
