"""Page jobs: over the stored pages, and over staff pages laid out from the order table."""
from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.operators import pages as P
from rosterlake.plans.q_scoring import LEX, LEX23, count_sql
from rosterlake.plans.q_text import HTML_TEXT_SQL
from rosterlake.plans.registry import query, sql_list, sql_list
from rosterlake.sources import html as H

MARKUP = r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g')"
ENTS = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]


def plain_sql(m: str) -> str:
    t = rf"regexp_replace({m}, '<[^>]*>', '', 'g')"
    for a, b in ENTS:
        t = f"replace({t}, '{a}', '{b}')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


LINKS = rf"""(SELECT page_id, url, regexp_extract(x, '(?is)^<a\s[^>]*href=["'']?([^"''\s>]*)', 1) AS href, {plain_sql("regexp_replace(x, '(?s)^<[^>]*>', '')")} AS label FROM (
 SELECT page_id, url, unnest(regexp_extract_all({MARKUP}, '(?is)(<a\s[^>]*href=[^>]*>.*?)</a', 1)) AS x FROM pages))"""
ROOT = r"regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)', 1)"
ABS = rf"CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') THEN href WHEN href LIKE '/%' THEN {ROOT} || href ELSE '?' END"


@query("p1_extract_links", "", rf"""
SELECT DISTINCT page_id, {ABS} AS link FROM {LINKS} WHERE href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:)') AND starts_with({ABS}, {ROOT} || '/')
 AND NOT regexp_matches(lower({ABS}), '\.pdf$|\.docx?$|\.xlsx?$|\.pptx?$|\.zip$|login|signin|register|cart|shop|store|privacy|terms|careers|jobs')""")
def _(t):
    return P.extract_links(t.pages).select("page_id", "link")


TITLE = plain_sql(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")
H1 = plain_sql(r"regexp_extract(m, '(?is)<h1[^>]*>(.*?)</h1', 1)")
BODY = plain_sql(r"regexp_replace(m, '(?is)<title[^>]*>.*?</title\s*>', '', 'g')")


def has(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


INF, PRO = ["reon", "eauou"], ["nicht"]


PAGE_FACTS = rf"""
SELECT page_id, title, CASE WHEN regexp_matches(u, '(about|about-us|aboutus)$') THEN 'about' WHEN regexp_matches(u, '(contact|contact-us|contactus)$') THEN 'contact' WHEN {has('lower(url)', P.TEAM_WORDS)} THEN 'team'
 WHEN regexp_matches(u, '(locations|offices|branches)$') THEN 'locations' WHEN regexp_matches(u, '(services|solutions|products|capabilities)$') THEN 'services' WHEN regexp_matches(u, '(projects|portfolio|case-studies|work)$') THEN 'projects'
 WHEN {has('lt', P.ABOUT_WORDS)} OR {has('lh', P.ABOUT_WORDS)} THEN 'about' WHEN {has('lt', P.CONTACT_WORDS)} OR {has('lh', P.CONTACT_WORDS)} THEN 'contact' WHEN {has('lt', P.TEAM_WORDS)} OR {has('lh', P.TEAM_WORDS)} THEN 'team'
 WHEN regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', ''), '/+$', '') IN ('', '/index.html', '/index.php') THEN 'homepage' ELSE 'other' END AS page_type,
 (regexp_matches(body, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}') OR regexp_matches(body, '(?:\+\d{{1,2}}\s?)?\(?\d{{3}}\)?[\s.-]?\d{{3}}[\s.-]?\d{{4}}') OR regexp_matches(body, '[A-Z][a-z]+\s[A-Z][a-z]+,?\s+[\w\s]+') OR regexp_matches(m, '(?i)<(form|div|section)\s[^>]*(?:id|class)=["''][^"'']*contact') OR {has('lower(body)', P.CONTACT_PHRASES)}) AS contains_contact_info,
 {has('lower(body)', INF + PRO)} AS contains_infrastructure, round({count_sql('lower(body)', LEX['water'])} / 4, 6)::DOUBLE AS water
FROM (SELECT *, regexp_replace(lower(url), '/+$', '') AS u, lower(title) AS lt, lower(h1) AS lh FROM (SELECT page_id, url, m, {TITLE} AS title, {H1} AS h1, {BODY} AS body FROM (SELECT *, {MARKUP} AS m FROM pages)))"""


@query("p2_p3_p4_p5_page_facts", "", PAGE_FACTS)
def _(t):
    f = P.page_facts(t.pages, infrastructure=INF, process=PRO, industries=LEX)
    return f.select("page_id", "title", "page_type", "contains_contact_info", "contains_infrastructure",
                    F.round(F.col("industry_indicators")["water"], 6).alias("water"))


@query("p12_emails_in_pages", "", rf"""
SELECT DISTINCT page_id, unnest(regexp_extract_all({HTML_TEXT_SQL}, '[\w.-]+@[\w.-]+\.\w+')) AS email FROM pages""")
def _(t):
    return P.emails_in_pages(t.pages).select("page_id", "email")


@query("p19_staff_links", "", rf"""
SELECT DISTINCT page_id, {ABS} AS link FROM {LINKS} WHERE href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:)') AND (regexp_matches(lower(label), '{P.DIRECTORY_LINK_TEXT}') OR {has('lower(href)', P.DIRECTORY_LINK_HREF)})""")
def _(t):
    return P.staff_links(t.pages).select("page_id", "link")


# guessed addresses of a page without a hit: each path pattern, numbered for the directories, and each query pattern on each base
GUESSED = [x for p in P.STAFF_URL_PATTERNS for x in ([f"{b}{p}" for b in P.STAFF_QUERY_BASES] if p[0] == "?" else
           [p, *(f"{p}?{k}={i}" for k in ("id", "did", "dept") for i in (1, 2, 3, 4) if "staff" in p or "directory" in p)])]


@query("p19b_staff_page_candidates", "", rf"""
WITH l AS (SELECT page_id, {ABS} AS link, label FROM {LINKS} WHERE href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:)')),
hit AS (SELECT DISTINCT page_id, link FROM l WHERE {has("regexp_replace(lower(regexp_replace(link, '^[a-zA-Z]+://[^/?#]*', '')), '[?].*$', '')", [p.lower() for p in P.STAFF_URL_PATTERNS])} OR {has('lower(label)', P.STAFF_LINK_WORDS)})
SELECT page_id, link, false AS generated FROM hit UNION ALL SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)', 1) || g, true FROM (SELECT page_id, url, unnest({sql_list(GUESSED)}) AS g FROM pages WHERE page_id NOT IN (SELECT page_id FROM hit))""")
def _(t):
    return P.staff_page_candidates(t.pages).select("page_id", "link", "generated")


@query("p21_official_title", "", f"""
SELECT page_id, {has('t', P.OFFICIAL_PHRASES)} AS official_phrase, contains(t, 'ention') AS name_in_title FROM (SELECT page_id, lower({TITLE}) || CASE WHEN page_id % 3 = 0 THEN ' official site' ELSE '' END AS t FROM pages)""")
def _(t):
    title = F.concat(H.page_title("html"), F.expr("CASE WHEN page_id % 3 = 0 THEN ' Official Site' ELSE '' END"))
    return t.pages.select("page_id", P.official_title(title, F.lit("Ention")).alias("o")).select("page_id", "o.*")


EDGES = "SELECT 'http://h' || CAST(o_custkey % 7 AS {s}) || '.org/p' || CAST(o_custkey AS {s}) AS src, 'http://h' || CAST(o_custkey % 7 AS {s}) || '.org/' || CASE WHEN o_totalprice > 300000 THEN 'shop' ELSE 'p' END || CAST(o_orderkey {div} 10 AS {s}) AS dst, o_orderpriority AS prio FROM {o}"


HOST_OF = "regexp_extract({}, '://([^/]*)', 1)"


def frontier_sql(levels: int = 3, quota: int | None = 500) -> str:
    """The walk written out level by level."""
    few = f"r <= {quota}" if quota else "true"
    out = [f"e AS MATERIALIZED ({EDGES.format(s='VARCHAR', div='//', o='orders')}), w AS MATERIALIZED (SELECT DISTINCT src, dst FROM e WHERE NOT contains(dst, 'shop'))",
           f"s0 AS (SELECT url, host, 0 AS depth FROM (SELECT url, host, row_number() OVER (PARTITION BY host ORDER BY url) AS r FROM (SELECT DISTINCT src AS url, {HOST_OF.format('src')} AS host FROM e WHERE prio = '1-URGENT')) WHERE {few})"]
    for d in range(1, levels + 1):
        out.append(f"n{d} AS MATERIALIZED (SELECT DISTINCT dst AS url, {HOST_OF.format('dst')} AS host FROM w JOIN s{d - 1} s ON s.url = w.src AND s.depth = {d - 1} WHERE dst NOT IN (SELECT url FROM s{d - 1}))")
        out.append(f"s{d} AS MATERIALIZED (SELECT * FROM s{d - 1} UNION ALL SELECT url, host, {d} FROM (SELECT n.*, row_number() OVER (PARTITION BY n.host ORDER BY url) + coalesce(u.c, 0) AS r FROM n{d} n LEFT JOIN (SELECT host, count(*) AS c FROM s{d - 1} GROUP BY 1) u ON u.host = n.host) WHERE {few})")
    return "WITH " + ", ".join(out) + " SELECT url, depth FROM s" + str(levels)


@query("p22_crawl_frontier", "", frontier_sql())
def _(t):
    e = t.spark.sql(EDGES.format(s="STRING", div="DIV", o="{o}"), o=t.orders)
    return P.crawl_frontier(e.filter("prio = '1-URGENT'").select(F.col("src").alias("url")), e, 3, 500).select("url", "depth")


@query("p22_crawl_frontier_whole", "", frontier_sql(24, None))
def _(t):
    e = t.spark.sql(EDGES.format(s="STRING", div="DIV", o="{o}"), o=t.orders)
    return P.crawl_frontier(e.filter("prio = '1-URGENT'").select(F.col("src").alias("url")), e).select("url", "depth")


@query("p24_local_organizations", "", rf"""
SELECT page_id, coalesce(CASE WHEN title <> '' AND length(title) < 60 AND title NOT LIKE 'Welcome%' AND NOT contains(lower(title), 'page') THEN nullif(trim(split_part(split_part(title, '|', 1), '-', 1)), '') END, array_to_string(list_transform(string_split(replace(h, '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ')) AS name,
 CASE {' '.join(rf"WHEN regexp_matches(html, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(ws)})(?:$|[^\p{{L}}\p{{N}}_])') THEN '{k}'" for k, ws in LEX23.items())} ELSE CASE WHEN contains(hh, 'water') THEN 'water' WHEN contains(hh, 'eng') OR contains(hh, 'design') THEN 'engineering' WHEN contains(hh, 'gov') OR contains(hh, 'city') OR contains(hh, 'town') THEN 'government' WHEN contains(hh, 'ag') OR contains(hh, 'farm') THEN 'agriculture' ELSE 'water' END END AS org_type
FROM (SELECT page_id, html, {TITLE} AS title, regexp_extract(url, '://(?:www\.)?([^./]*)', 1) AS h, regexp_extract(url, '://(?:www\.)?([^/?#]*)', 1) AS hh FROM pages)""")
def _(t):
    return P.local_organizations(t.pages, lexicon=LEX23).select("page_id", "name", "org_type")


@query("p27_website_text", "discovered_urls", f"""
SELECT organization_id, id AS page, md5({HTML_TEXT_SQL}) AS digest FROM (SELECT id, organization_id, html_content AS html FROM discovered_urls)""")
def _(t):
    return P.website_text(t.discovered_urls).select("organization_id", F.col("id").alias("page"), F.md5("text").alias("digest"))


@query("p27_site_digest", "discovered_urls", f"""
SELECT organization_id, count(*)::BIGINT AS pages, sum(length(x))::BIGINT AS characters, sum(('0x' || substr(md5(id || ':' || x), 1, 10))::BIGINT)::BIGINT AS digest
FROM (SELECT organization_id, id, {HTML_TEXT_SQL} AS x FROM (SELECT id, organization_id % 30 AS organization_id, html_content AS html FROM discovered_urls)) WHERE trim(x) <> '' GROUP BY 1""")
def _(t):
    return P.website_digest(P.website_text(t.discovered_urls.withColumn("organization_id", F.expr("organization_id % 30"))))


# ---- staff pages ----------------------------------------------------------------------------
FULL = "fn || ' ' || ln"
LAYOUTS = {
    "cards": "'<div class=\"wrap\"><div class=\"staff-card\"><h3>' || fn || ' ' || ln || '</h3><span class=\"job-title\">' || title || '</span><a href=\"mailto:' || email || '?subject=x\">write</a><br>Tel ' || phone || '</div></div>'",
    "tables": "'<table><tr><th>Name</th><th>Department</th><th>Email</th><th>Phone</th></tr><tr><td>' || fn || ' ' || ln || '</td><td>' || title || '</td><td>' || email || '</td><td>' || phone || '</td></tr></table>'",
    "json_ld": "'<script type=\"application/ld+json\">{\"@type\": \"Organization\", \"name\": \"Town\", \"employee\": [{\"@type\": \"Person\", \"name\": \"' || fn || ' ' || ln || '\", \"jobTitle\": \"' || title || '\", \"email\": \"' || email || '\", \"telephone\": \"' || phone || '\"}, {\"@type\": \"Thing\", \"name\": \"no person\"}]}</script>'",
    "deep_json_ld": "'<script type=\"application/ld+json\">' || repeat('{\"@type\": \"Organization\", \"member\": [', 5) || repeat('{\"type\": \"Organization\", \"employee\": ', 5) || '{\"@type\": \"Person\", \"name\": \"' || fn || ' ' || ln || '\", \"jobTitle\": \"' || title || '\", \"email\": \"' || email || '\", \"telephone\": \"' || phone || '\"}' || repeat('}', 5) || repeat(']}', 5) || '</script>'",
    "microdata": "'<div itemscope itemtype=\"http://schema.org/Person\"><b itemprop=\"name\">' || fn || ' ' || ln || '</b><span itemprop=\"jobTitle\">' || title || '</span><a itemprop=\"email\" href=\"mailto:' || email || '\">m</a><span itemprop=\"telephone\">' || phone || '</span></div>'",
    "vcard": "'<div class=\"vcard\"><span class=\"fn\">' || fn || ' ' || ln || '</span><span class=\"title\">' || title || '</span><span class=\"email\">' || email || '</span><span class=\"tel\">' || phone || '</span></div>'",
    "text": "'<p>We are happy to have you. ' || fn || ' ' || ln || ', ' || title || '. Call ' || phone || ' or mail ' || email || ' today</p>'",
    "mailto": "'<ul><li>' || fn || ' ' || ln || ', ' || title || ', ' || phone || ' <a href=\"mailto:' || email || '\">mail</a></li><li><a href=\"mailto:info@town.gov\">office</a></li></ul>'",
    "sections": "'<h2>Water Department</h2><div><p>' || fn || ' ' || ln || ', ' || title || ', ' || phone || ', ' || email || '</p><p>short</p></div><h2>News</h2><p>Nobody Here, really nobody</p>'",
    "departments": "'<div><h3>Water Department</h3><p><strong>' || fn || ' ' || ln || '</strong> ' || title || ' <a href=\"mailto:' || email || '\"></a><a href=\"tel:' || phone || '\"></a></p></div>'",
    "definitions": "'<dl><dt>' || fn || ' ' || ln || '</dt><dd>' || title || chr(10) || '<a href=\"mailto:' || email || '\">m</a> <a href=\"tel:' || phone || '\">t</a></dd><dt>X</dt><dd>y</dd></dl>'",
    "grids": "'<table><tr class=\"head\"><td>a</td></tr><tr class=\"GridRow\"><td>' || fn || ' ' || ln || '</td><td>' || title || '</td><td>Water</td><td>' || phone || '</td><td>' || email || '</td></tr></table>'",
    "paragraphs": "'<p>' || fn || ' ' || ln || ', ' || replace(title, ' of ', ' in ') || '. ' || phone || ' ' || email || '</p><p>no</p><a href=\"mailto:water@town.gov\">w</a>'",
}


def laid_out(t, layout: str):
    return t.staff.select("page_id", "url", F.expr(LAYOUTS[layout]).alias("html"))


PEOPLE = ["page_id", "first_name", "last_name", "job_title", "email", "phone", "relevance", "confidence"]


def people_sql(confidence: float, title: str = "title", rel: str = "rel", email: str = "email", phone: str = "phone") -> str:
    return f"SELECT page_id, fn AS first_name, ln AS last_name, {title} AS job_title, {email} AS email, {phone} AS phone, ({rel})::DOUBLE AS relevance, {confidence}::DOUBLE AS confidence FROM staff"


@query("p7_people_from_json_ld", "staff", people_sql(0.95))
def _(t):
    return P.people_from_json_ld(laid_out(t, "json_ld")).select(*PEOPLE)


@query("p7_people_from_deep_json_ld", "staff", people_sql(0.95))
def _(t):
    return P.people_from_json_ld(laid_out(t, "deep_json_ld")).select(*PEOPLE)


@query("p7_people_from_microdata", "staff", people_sql(0.95))
def _(t):
    return P.people_from_microdata(H.parse_pages(laid_out(t, "microdata"))).select(*PEOPLE)


@query("p7_people_from_vcards", "staff", people_sql(0.95))
def _(t):
    return P.people_from_vcards(H.parse_pages(laid_out(t, "vcard"))).select(*PEOPLE)


@query("p8_people_from_cards", "staff", people_sql(0.9))
def _(t):
    return P.people_from_cards(H.parse_pages(laid_out(t, "cards"))).select(*PEOPLE)


STAFF_REL = "CASE title WHEN 'City Clerk' THEN 5 ELSE rel END"


@query("p9_people_from_tables", "staff", people_sql(0.85, "title || ' Staff'", STAFF_REL))
def _(t):
    return P.people_from_tables(H.parse_pages(laid_out(t, "tables"))).select(*PEOPLE)


@query("p10_people_from_text", "staff", "SELECT page_id, fn AS first_name, ln AS last_name, title AS job_title, email, phone FROM staff WHERE title NOT IN ('City Clerk')")
def _(t):
    return P.people_from_text(H.parse_pages(laid_out(t, "text"))).select(*PEOPLE[:6])


@query("p11_people_from_mailto", "staff", people_sql(0.75))
def _(t):
    return P.people_from_mailto(H.parse_pages(laid_out(t, "mailto"))).select(*PEOPLE)


@query("p13_people_from_sections", "staff", people_sql(0.8))
def _(t):
    return P.people_from_sections(H.parse_pages(laid_out(t, "sections"))).select(*PEOPLE)


DEPT_REL = "CASE title WHEN 'Operations Manager' THEN 10 WHEN 'Director of Public Works' THEN 10 WHEN 'Process Engineer' THEN 9 WHEN 'City Clerk' THEN 8 ELSE 10 END"
ALONE_REL = "CASE title WHEN 'Operations Manager' THEN 10 WHEN 'Director of Public Works' THEN 10 WHEN 'Process Engineer' THEN 8 WHEN 'City Clerk' THEN 7 ELSE 9 END"


@query("p13b_people_from_departments", "staff", people_sql(0.75, rel=DEPT_REL))
def _(t):
    return P.people_from_departments(H.parse_pages(laid_out(t, "departments"))).select(*PEOPLE)


@query("p13c_people_from_definitions", "staff", people_sql(0.7, rel=ALONE_REL))
def _(t):
    return P.people_from_definitions(H.parse_pages(laid_out(t, "definitions"))).select(*PEOPLE)


@query("p13d_people_from_grids", "staff", people_sql(0.75, rel=DEPT_REL))
def _(t):
    return P.people_from_grids(H.parse_pages(laid_out(t, "grids"))).select(*PEOPLE)


@query("p14_people_from_paragraphs", "staff", """
SELECT page_id, fn AS first_name, replace(title, ' of ', ' in ') AS job_title, CASE WHEN title LIKE 'Director%' THEN 9.0 WHEN title LIKE '%Manager' THEN 8.0 ELSE 5.0 END::DOUBLE AS relevance, 'text_extraction' AS method FROM staff
UNION ALL SELECT page_id, NULL, 'Water Department Manager', 8.0, 'role_mailbox' FROM staff""")
def _(t):
    prof = [{"role_title": "Director", "relevance_score": 9.0}, {"role_title": "Manager", "relevance_score": 8.0}]
    return P.people_from_paragraphs(H.parse_pages(laid_out(t, "paragraphs")), prof).select("page_id", "first_name", "job_title", "relevance", "method")


MIXED = "CASE page_id % 4 WHEN 0 THEN " + LAYOUTS["cards"] + " WHEN 1 THEN " + LAYOUTS["tables"] + " WHEN 2 THEN " + LAYOUTS["sections"] + " ELSE " + LAYOUTS["mailto"] + " END"


@query("p15_directory_pages", "staff", "SELECT page_id, page_id % 4 IN (0, 1) AS is_directory FROM staff")
def _(t):
    return P.directory_pages(H.parse_pages(t.staff.select("page_id", "url", F.expr(MIXED).alias("html")))).select("page_id", "is_directory")


@query("p15b_directory_tables", "staff", "SELECT page_id, page_id % 2 = 0 AS is_directory FROM staff")
def _(t):
    html = F.expr("CASE WHEN page_id % 2 = 0 THEN " + LAYOUTS["tables"] + " ELSE '<table><tr><td>a</td></tr><tr><td>b</td></tr><tr><td>c</td></tr></table>' END")
    return P.directory_tables(H.parse_pages(t.staff.select("page_id", "url", html.alias("html")))).select("page_id", "is_directory")


@query("p16_extract_people", "staff", """
SELECT page_id, fn AS first_name, ln AS last_name, CASE WHEN page_id % 4 = 0 THEN 'cards' WHEN page_id % 4 = 1 THEN 'tables' WHEN page_id % 4 = 2 THEN 'sections' ELSE 'mailto' END AS method FROM staff
WHERE page_id % 4 IN (0, 1, 3) OR (page_id % 4 = 2 AND url LIKE '%contact')""")
def _(t):
    pages = t.staff.select("page_id", "url", F.expr(MIXED).alias("html"))
    return P.extract_people(pages).select("page_id", "first_name", "last_name", "method")


LISTING = ("CASE page_id % 4 WHEN 0 THEN '<table><tr><td><a href=\"https://a' || town || '.org\">Org ' || town || '</a></td><td>Reno, Nevada</td></tr></table><ul><li><a href=\"/x\">Not this</a></li></ul>' "
           "WHEN 1 THEN '<ul><li><a href=\"/m/' || town || '\">Org ' || town || '</a> Provo, Utah</li><li><a href=\"/\">Home</a></li></ul>' WHEN 2 THEN '<div class=\"member-box\"><h3>Org ' || town || '</h3> Mesa, Arizona <a href=\"https://b.org/' || town || '\"></a></div>' "
           "ELSE '<p>see <a href=\"https://c.org/' || town || '\">Org ' || town || '</a></p>' END")


@query("p17_p18_organizations_from_listing", "staff", """
SELECT page_id, (page_id % 4 + 1)::INT AS strategy_rank, 'Org ' || town AS name, CASE page_id % 4 WHEN 0 THEN 'https://a' || town || '.org' WHEN 1 THEN regexp_extract(url, '^(https://[^/]*)', 1) || '/m/' || town WHEN 2 THEN 'https://b.org/' || town ELSE 'https://c.org/' || town END AS website,
 CASE page_id % 4 WHEN 0 THEN 'Nevada' WHEN 1 THEN 'Utah' WHEN 2 THEN 'Arizona' END AS state FROM staff""")
def _(t):
    pages = t.staff.select("page_id", "url", F.expr(LISTING.replace("|| town ||", "|| CAST(town AS STRING) ||")).alias("html"))
    return P.organizations_from_listing(H.parse_pages(pages), ["Utah", "Nevada", "Arizona"]).select(
        "page_id", "strategy_rank", "name", "website", "state")


SITE = ("CASE page_id % 5 WHEN 0 THEN '<script type=\"application/ld+json\">{\"@type\": \"Organization\", \"name\": \"Ld ' || t || '\"}</script>' WHEN 1 THEN '<meta property=\"og:site_name\" content=\"Site ' || t || '\">' "
        "WHEN 2 THEN '<img class=\"logo\" alt=\"Town ' || t || ' Logo\">' WHEN 3 THEN '<header><h2>Head ' || t || '</h2></header>' ELSE '' END || '<title>Title ' || t || ' | Home</title>'")


@query("x27_organization_name", "staff", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Ld ' WHEN 1 THEN 'Site ' WHEN 2 THEN 'Town ' WHEN 3 THEN 'Head ' ELSE 'Title ' END || town AS name FROM staff""")
def _(t):
    pages = t.staff.withColumn("t", F.col("town").cast("string")).select("page_id", "url", F.expr(SITE).alias("html"))
    return P.organization_name(H.parse_pages(pages), pages).select("page_id", "name")


@query("p6_page_projects", "staff", """
SELECT page_id, 'Plant ' || town AS title, title || CASE page_id % 6 WHEN 0 THEN ' with SCADA' WHEN 2 THEN ', Automation of pumps' WHEN 4 THEN ' and remote monitoring' ELSE '' END AS description, page_id % 2 = 0 AS contains_automation FROM staff""")
def _(t):
    words = "CASE page_id % 6 WHEN 0 THEN ' with SCADA' WHEN 2 THEN ', Automation of pumps' WHEN 4 THEN ' and remote monitoring' ELSE '' END"
    html = F.expr(f"'<section class=\"Project-Item\"><h3>Plant ' || CAST(town AS STRING) || '</h3><p class=\"desc\">' || title || {words} || '</p></section>'")
    q = P.page_projects(H.parse_pages(t.staff.select("page_id", "url", html.alias("html"))))
    return q.select("page_id", "title", "description", "contains_automation")


@query("p20_sitemap_contact_pages", "staff", """
SELECT DISTINCT 'https://town' || town || '.gov/index.xml' AS top, 'https://town' || town || '.gov/contact/' || page_id AS page FROM staff UNION
SELECT DISTINCT 'https://town' || town || '.gov/map' || page_id || '.xml', 'https://town' || town || '.gov/contact/' || page_id FROM staff""")
def _(t):
    s = t.staff.withColumn("t", F.col("town").cast("string")).withColumn("p", F.col("page_id").cast("string"))
    leaf = s.select(F.expr("'https://town' || t || '.gov/map' || p || '.xml'").alias("url"),
                    F.expr("'<?xml version=\"1.0\"?><urlset><url><loc>https://town' || t || '.gov/contact/' || p || '</loc></url><url><loc>https://town' || t || '.gov/news</loc></url></urlset>'").alias("body"))
    index = s.select(F.expr("'https://town' || t || '.gov/index.xml'").alias("url"),
                     F.expr("'<?xml version=\"1.0\"?><sitemapindex><sitemap><loc>https://town' || t || '.gov/map' || p || '.xml</loc></sitemap></sitemapindex>'").alias("body"))
    return P.sitemap_contact_pages(leaf.unionByName(index))


@query("p20_html_and_deep_sitemaps", "staff", """
SELECT 'https://town' || town || '.gov/deep' || k || '.xml' AS top, 'https://town' || town || '.gov/staff/' || page_id AS page FROM staff, (SELECT unnest(range(10)) AS k) UNION
SELECT 'https://town' || town || '.gov/site' || page_id || '.html', 'https://town' || town || '.gov/staff/' || page_id FROM staff""")
def _(t):
    """Ten index documents in a ring lead to HTML sitemaps, whose foreign and other links do not count."""
    s = t.staff.select(F.expr("'https://town' || town || '.gov'").alias("base"), F.col("page_id").cast("string").alias("p"))
    leaf = s.selectExpr("base || '/site' || p || '.html' AS url", "'<html><a href=\"/staff/' || p || '\">Our people</a><a href=\"https://other.org/staff\">x</a><a href=\"/news\">News</a></html>' AS body")
    ring = s.select("base", "p", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).selectExpr(
        "base || '/deep' || CAST(k AS STRING) || '.xml' AS url",
        "'<?xml version=\"1.0\"?><sitemapindex><loc>' || base || '/deep' || CAST((k + 1) % 10 AS STRING) || '.xml</loc>' || IF(k = 9, '<loc>' || base || '/site' || p || '.html</loc>', '') || '</sitemapindex>' AS body")
    return P.sitemap_contact_pages(leaf.unionByName(ring))


@query("p25_evidence_from_results", "search_results", f"""
SELECT h.domain, h.pos, least(10.0, len(list_filter({sql_list(['the', 'ention', 'que'])}, lambda w: contains(lower(d.text), w))))::DOUBLE AS infrastructure_score, {has('lower(d.text)', ['whorth'])} OR len(list_filter({sql_list(['sch', 'los'])}, lambda w: contains(lower(d.text), w))) >= 2 AS is_likely_competitor
FROM (SELECT regexp_extract(url, '://(?:www\\.)?([^/]*)', 1) AS domain, min(pos) AS pos FROM search_results GROUP BY 1) h JOIN documents d ON d.doc_id = h.pos""")
def _(t):
    stored = t.search_results.select("pos", "url").join(t.documents.select(F.col("doc_id").alias("pos"), "text"), "pos").select("url", "text")
    words = {k: ["the", "Ention", "que"] for k in ("water", "municipal", "agriculture")}
    q = P.evidence_from_results(t.search_results, stored, competitor=(["sch", "los"], ["whorth"]), processes=words, challenges=[], regulatory=[], sector_infra={}, sector_proc={})
    return q.select("domain", "pos", "infrastructure_score", "is_likely_competitor")


MAIL = "'<html><body><a href=\"https://town.gov/contact\">Contact us</a><p>Dear ' || fn || '</p><a href=\"mailto:' || email || '\">m</a><a href=\"https://town.gov/' || page_id || '\">see</a><footer><a href=\"https://town.gov/demo\">Demo</a></footer></body></html>'"


def mails(t):
    m = t.staff.withColumn("k", F.col("page_id").cast("string"))
    return m.select(F.col("town").alias("contact_id"), F.concat(F.lit("m"), "k").alias("email_id"), F.expr(MAIL.replace("|| page_id ||", "|| k ||")).alias("body"))


@query("p26_w8_outgoing_links", "staff", """
SELECT town AS contact_id, 'm' || page_id AS email_id, pos::INT AS pos, CASE pos WHEN 0 THEN 'https://town.gov/contact' WHEN 2 THEN 'https://town.gov/' || page_id ELSE 'https://town.gov/demo' END AS original_url, CASE pos WHEN 0 THEN 'header' WHEN 2 THEN 'body' ELSE 'footer' END AS link_position,
 CASE pos WHEN 0 THEN 'contact' WHEN 2 THEN 'general' ELSE 'demo' END AS link_type FROM staff, (SELECT unnest([0, 2, 3]) AS pos)""")
def _(t):
    parsed = H.parse_pages(mails(t), "body", ("contact_id", "email_id"))
    return P.outgoing_links(parsed).select("contact_id", "email_id", "pos", "original_url", "link_position", "link_type")


@query("p26_tracked_body", "staff", """
SELECT 'm' || page_id AS email_id, '<html><body><a href="T0">Contact us</a><p>Dear ' || fn || '</p><a href="mailto:' || email || '">m</a><a href="T2">see</a><footer><a href="T3">Demo</a></footer><img src="https://t.org/track/open/m' || page_id || '" width="1" height="1" alt="" style="display:none;"></body></html>' AS body FROM staff""")
def _(t):
    m = mails(t).withColumn("body", P.tracked_body("https://t.org"))
    for i in (0, 2, 3):  # ids checked by x22; here their places
        from rosterlake.functions.urls import short_id, tracking_url
        m = m.withColumn("body", F.replace("body", tracking_url("https://t.org", short_id("contact_id", "email_id", F.lit(i))), F.lit(f"T{i}")))
    return m.select("email_id", "body")


@query("p19_staff_links_on_staff_pages", "staff", """
SELECT page_id, regexp_extract(url, '^(https://[^/]*)', 1) || unnest(['/x' || town, '/our-directory']) AS link FROM staff""")
def _(t):
    html = F.expr("'<a href=\"/x' || CAST(town AS STRING) || '\">Department  Heads</a><a href=\"/news\">News</a><a href=\"/our-directory#top\">all</a><a href=\"mailto:staff@x\">staff</a>'")
    return P.staff_links(t.staff.select("page_id", "url", html.alias("html"))).select("page_id", "link")


@query("t10_link_priority", "", rf"""
SELECT DISTINCT page_id, {ABS} AS link, {has('lower(' + ABS + ')', P.PRIORITY_PAGES)} AS high FROM {LINKS} WHERE href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:)') AND starts_with({ABS}, {ROOT} || '/')
 AND NOT regexp_matches(lower({ABS}), '\.pdf$|\.docx?$|\.xlsx?$|\.pptx?$|\.zip$|login|signin|register|cart|shop|store|privacy|terms|careers|jobs')""")
def _(t):
    return P.prioritized_links(P.extract_links(t.pages)).select("page_id", "link", "high")
