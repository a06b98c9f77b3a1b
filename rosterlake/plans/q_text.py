"""String, URL, JSON and label columns over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.functions import content as C
from rosterlake.functions import people as N
from rosterlake.functions import urls as U
from rosterlake.functions.text import rows_of
from rosterlake.operators import selection as SEL
from rosterlake.plans.registry import query, sql_list

HOST = r"lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)', 1))"


def host_sql(u: str) -> str:
    return HOST.replace("{u}", u)


@query("x1_normalize_url", "discovered_urls", """
SELECT id, CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'https://' || u END AS url FROM (
 SELECT id, regexp_replace(trim(CASE WHEN id % 3 = 0 THEN ' ' || replace(url, 'https://', '') || '/' ELSE url END), '/+$', '') AS u FROM discovered_urls)""")
def _(t):
    raw = F.expr("CASE WHEN id % 3 = 0 THEN ' ' || replace(url, 'https://', '') || '/' ELSE url END")
    return t.discovered_urls.select("id", U.normalize_url(raw).alias("url"))


@query("x2_domains", "search_results", rf"""
SELECT pos, h AS host, regexp_replace(h, '^www\.', '') AS bare, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)', 1) AS root,
 CASE WHEN array_to_string(l[-2:], '.') IN ('co.uk') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS registered
FROM (SELECT pos, url, h, string_split(h, '.') AS l FROM (SELECT pos, url, {host_sql('url')} AS h FROM search_results))""")
def _(t):
    return t.search_results.select("pos", U.host("url").alias("host"), U.host_without_www("url").alias("bare"),
                                   U.site_root("url").alias("root"), U.registered_domain("url", ["co.uk"]).alias("registered"))


SUFFIX_RULES = ["com", "org", "gov", "uk", "co.uk", "*.ck", "!www.ck", "k12.ca.us", "pvt.k12.ma.us", "*.town.jp", "!city.town.jp"]
SUFFIX_HOSTS = ["a.b.example.com", "x.shop.co.uk", "www.ck", "a.b.other.ck", "lib.school.k12.ca.us", "deep.own.pvt.k12.ma.us", "a.city.town.jp", "q.r.s.town.jp", "co.uk", "plain.zone", "10.0.0.1", "WWW.Example.ORG:8080"]
ENDING = r"array_to_string(l[-k:], '.')"


@query("x2_registered_domains", "search_results", rf"""
WITH h AS (SELECT pos, regexp_replace(lower(regexp_extract(u, '://([^/?#]*)', 1)), ':[0-9]*$', '') AS host FROM (SELECT pos, CASE WHEN pos % 2 = 0 THEN 'http://' || ({sql_list(SUFFIX_HOSTS)})[1 + (pos // 2 % {len(SUFFIX_HOSTS)})::INT] || '/x' ELSE url END AS u FROM search_results)),
d AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM h WHERE NOT regexp_matches(host, '^[0-9.]+$')),
r AS (SELECT unnest({sql_list(SUFFIX_RULES)}) AS rule),
m AS (SELECT host, l, max(CASE WHEN rule = '!' || {ENDING} THEN k END) AS ex, max(CASE WHEN rule = {ENDING} OR k > 1 AND rule = '*.' || array_to_string(l[-(k - 1):], '.') THEN k END) AS k0
 FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS k FROM d), r GROUP BY host, l),
n AS (SELECT host, l, CASE WHEN ex IS NOT NULL THEN ex ELSE coalesce(k0, 1) + 1 END AS size FROM m)
SELECT h.pos, CASE WHEN len(l) >= size THEN array_to_string(l[-size:], '.') END AS registered_domain FROM h LEFT JOIN n ON n.host = h.host""")
def _(t):
    hosts = F.array(*[F.lit(h) for h in SUFFIX_HOSTS])
    url = F.expr("pos % 2 = 0")
    made = F.concat(F.lit("http://"), F.element_at(hosts, F.expr(f"CAST(pos div 2 % {len(SUFFIX_HOSTS)} AS INT) + 1")), F.lit("/x"))
    rows = t.search_results.select("pos", F.when(url, made).otherwise(F.col("url")).alias("url"))
    rules = t.spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")
    return U.with_registered_domain(rows, rules).select("pos", "registered_domain")


@query("x3_valid_email", "contacts", r"""
SELECT id, coalesce(regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$'), false) AS email_valid FROM contacts""")
def _(t):
    return t.contacts.select("id", N.valid_email("email").alias("email_valid"))


@query("x4_emails_in_text", "", r"""
SELECT doc_id, count(*)::BIGINT AS n, min(e) AS least FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text,
 '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'))) AS e FROM documents) GROUP BY 1""")
def _(t):
    return t.documents.select("doc_id", F.explode(N.all_emails("text")).alias("e")).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("e").alias("least"))


@query("x4_first_email", "",
       r"SELECT doc_id, nullif(regexp_extract(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), '') AS email FROM documents")
def _(t):
    return t.documents.select("doc_id", N.first_email("text").alias("email"))


@query("x5_first_phone", "", r"""
SELECT doc_id, nullif(regexp_extract(text, '(?:\(\d{3}\)\s*\d{3}-\d{4}|\d{3}-\d{3}-\d{4})'), '') AS us,
 nullif(regexp_extract(text, '\(\d{3}\)\s*\d{3}-\d{4}'), '') AS paren,
 nullif(regexp_extract(text, '\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}'), '') AS card,
 nullif(regexp_extract(text, '(?:\+\d{1,2}\s?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}'), '') AS any_form FROM documents""")
def _(t):
    return t.documents.select("doc_id", *[N.first_phone("text", p).alias(a) for a, p in (
        ("us", N.PHONE_US), ("paren", N.PHONE_PAREN), ("card", N.PHONE_CARD), ("any_form", N.PHONE_ANY))])


NAMES_SQL = r"""(SELECT id AS doc_id, coalesce(first_name, '') || CASE WHEN id % 5 = 0 THEN ' B. ' WHEN id % 7 = 0 THEN ' Ann-Marie ' ELSE ' ' END || coalesce(last_name, '') AS full_name FROM contacts
 UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*'))) FROM documents)"""


def names(t):
    """Names of the contacts, and every run of capitalized words in the texts."""
    c = t.contacts.select(F.col("id").alias("doc_id"), F.expr(
        "coalesce(first_name, '') || CASE WHEN id % 5 = 0 THEN ' B. ' WHEN id % 7 = 0 THEN ' Ann-Marie ' ELSE ' ' END || coalesce(last_name, '')").alias("full_name"))
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*"), 0))
    return c.unionByName(t.documents.select("doc_id", rows_of(runs).alias("full_name")))


@query("x6_person_name", "contacts", rf"""
SELECT doc_id, CASE WHEN length(c) < 3 THEN NULL WHEN n >= 2 THEN p[1] END AS first, CASE WHEN length(c) < 3 THEN NULL WHEN n = 2 THEN p[2] WHEN n = 3 AND length(p[2]) = 1 THEN p[3]
 WHEN n = 3 THEN p[2] || ' ' || p[3] WHEN n > 3 THEN p[-1] END AS last
FROM (SELECT doc_id, c, list_filter(regexp_split_to_array(c, '\s+'), lambda x: x <> '') AS p, len(list_filter(regexp_split_to_array(c, '\s+'), lambda x: x <> '')) AS n
 FROM (SELECT doc_id, trim(regexp_replace(full_name, '[^\p{{L}}\p{{N}}_\s''-]', '', 'g')) AS c FROM {NAMES_SQL}))""")
def _(t):
    return names(t).select("doc_id", N.person_name("full_name").alias("p")).select("doc_id", "p.first", "p.last")


@query("x7_split_name", "contacts", f"""
SELECT doc_id, split_part(f, ' ', 1) AS first, CASE WHEN contains(f, ' ') THEN substr(f, strpos(f, ' ') + 1) ELSE '' END AS last
FROM (SELECT doc_id, trim(full_name) AS f FROM {NAMES_SQL})""")
def _(t):
    return names(t).select("doc_id", N.split_name("full_name").alias("p")).select("doc_id", "p.first", "p.last")


@query("x8_name_from_email", "contacts", """
SELECT id, upper(p[1][1]) || lower(p[1][2:]) AS first, upper(p[2][1]) || lower(p[2][2:]) AS last FROM (
 SELECT id, string_split(split_part(e, '@', 1), '.') AS p FROM (
  SELECT id, first_name || '.' || last_name || '@x.org' AS e FROM contacts WHERE first_name <> '' AND last_name IS NOT NULL))""")
def _(t):
    c = t.contacts.filter("first_name <> '' AND last_name IS NOT NULL").withColumn(
        "e", F.expr("first_name || '.' || last_name || '@x.org'"))
    return c.select("id", N.name_from_email("e").alias("p")).select("id", "p.first", "p.last")


@query("x9_webpage_title", "organizations search_results", rf"""
SELECT kind, id, (regexp_matches(name, '{N.WEBPAGE_TITLE}') OR len(list_filter(regexp_split_to_array(name, '\s+'), lambda w: w <> '')) > 10) AS is_title
FROM (SELECT 'org' AS kind, id, name FROM organizations UNION ALL SELECT 'hit', pos, title FROM search_results)""")
def _(t):
    q = t.organizations.selectExpr("'org' AS kind", "id", "name").unionByName(
        t.search_results.selectExpr("'hit' AS kind", "pos AS id", "title AS name"))
    return q.select("kind", "id", N.webpage_title("name").alias("is_title"))


HTML_TEXT_SQL = "trim(regexp_replace(" + "".join(
    "replace(" for _ in C.ENTITIES) + "regexp_replace(" + "".join("regexp_replace(" for _ in C.DROPPED_ELEMENTS) + (
    r"regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')") + "".join(
    rf", '(?is)<{e}\b[^>]*>.*?</{e}\s*>', ' ', 'g')" for e in C.DROPPED_ELEMENTS) + r", '<[^>]*>', ' ', 'g')" + "".join(
    ", '{}', '{}')".format(a, b.replace("'", "''")) for a, b in C.ENTITIES) + r", '\s+', ' ', 'g'))"


@query("x10_html_to_text", "", f"SELECT page_id, md5({HTML_TEXT_SQL}) AS digest, length({HTML_TEXT_SQL})::BIGINT AS chars FROM pages")
def _(t):
    return t.pages.select("page_id", C.html_to_text("html").alias("x")).select(
        "page_id", F.md5("x").alias("digest"), F.length("x").cast("long").alias("chars"))


TOKENS_SQL = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '([^\p{L}\p{N}\s''-])', ' \1 ', 'g'), '\s+'), lambda x: x <> '')"


@query("x11_tokens", "", f"SELECT doc_id, len({TOKENS_SQL})::BIGINT AS n_tokens, md5(array_to_string({TOKENS_SQL}, ' ')) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", C.tokens("text").alias("k")).select(
        "doc_id", F.size("k").cast("long").alias("n_tokens"), F.md5(F.array_join("k", " ")).alias("digest"))


@query("x12_labels", "organizations process_summaries", """
SELECT 'type' AS kind, coalesce(org_type, '') AS code, CASE org_type WHEN 'engineering' THEN 'Engineering' WHEN 'municipal' THEN 'Municipal' WHEN 'water' THEN 'Water & WW'
 WHEN 'transportation' THEN 'Transportation' WHEN 'agriculture' THEN 'Agriculture' ELSE org_type END AS label, count(*)::BIGINT AS n FROM organizations GROUP BY ALL
UNION ALL SELECT 'process', process_type, CASE process_type WHEN 'org_building' THEN 'Organization Building' WHEN 'contact_building' THEN 'Contact Building' ELSE 'Email Sending' END, count(*)::BIGINT FROM process_summaries GROUP BY ALL
UNION ALL SELECT 'event', event_type, upper(event_type[1]) || event_type[2:], count(*)::BIGINT FROM events GROUP BY ALL""")
def _(t):
    a = t.organizations.select(F.lit("type").alias("kind"), F.col("org_type").alias("code"),
                               C.label("org_type", C.ORG_TYPE_LABELS).alias("label"))
    b = t.process_summaries.select(F.lit("process").alias("kind"), F.col("process_type").alias("code"),
                                   C.process_label("process_type").alias("label"))
    e = t.events.select(F.lit("event").alias("kind"), F.col("event_type").alias("code"), C.process_label("event_type").alias("label"))
    return a.unionByName(b).unionByName(e).groupBy("kind", "code", "label").agg(F.count("*").alias("n"))


@query("x13_full_name", "contacts", """
SELECT id, coalesce(nullif(concat_ws(' ', nullif(trim(first_name), ''), nullif(trim(last_name), '')), ''), 'Unknown') AS full_name FROM contacts""")
def _(t):
    return t.contacts.select("id", N.full_name("first_name", "last_name").alias("full_name"))


@query("x14_title_to_organization", "organizations", """
SELECT id, split_part(split_part(name || CASE WHEN id % 4 = 0 THEN ' | Home' ELSE '' END, ' - ', 1), ' | ', 1) AS organization FROM organizations""")
def _(t):
    title = F.concat("name", F.expr("CASE WHEN id % 4 = 0 THEN ' | Home' ELSE '' END"))
    return t.organizations.select("id", N.title_to_organization(title).alias("organization"))


@query("x15_city_in_text", "organizations", r"""
SELECT id, CASE WHEN c <> '' AND length(c) < 30 THEN c END AS city FROM (SELECT id, trim(regexp_extract(
 CASE id % 3 WHEN 0 THEN '12 Main St. ' ELSE 'Town Hall, ' END || 'Spring ' || CASE id % 2 WHEN 0 THEN 'Hill' ELSE 'Valley of the very long and winding river' END || ', ' || 'nation_' || (id % 5)::VARCHAR,
 '(?i)([A-Za-z\s.]+),\s*NATION_1', 1)) AS c FROM organizations)""")
def _(t):
    text = F.expr("CASE id % 3 WHEN 0 THEN '12 Main St. ' ELSE 'Town Hall, ' END || 'Spring ' || CASE id % 2 WHEN 0 THEN 'Hill' "
                  "ELSE 'Valley of the very long and winding river' END || ', ' || 'nation_' || CAST(id % 5 AS STRING)")
    return t.organizations.select("id", C.city_in_text(text, "NATION_1").alias("city"))


ANSWER = ("CASE id % 4 WHEN 0 THEN 'Here: [ {\"name\": \"' || name || '\"} ] end' WHEN 1 THEN '```json' || chr(10) || '[\"' || name || '\"]```' "
          "WHEN 2 THEN '{\"name\": \"' || name || '\"}' ELSE 'nothing usable' END")


@query("x16_salvage_json", "organizations", rf"""
SELECT id, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN c <> '' THEN c ELSE t END AS json_text, CASE WHEN id % 4 IN (0, 2) THEN name END AS found_name
FROM (SELECT id, name, t, regexp_extract(t, '(?s)(\[\s*\{{.*\}}\s*\])', 1) AS a, regexp_extract(t, '(?s)```(?:json)?\s*(\[.*\])```', 1) AS b,
 regexp_extract(regexp_replace(t, '(?s)```.*?```', '', 'g'), '(?s)(\[.*\])', 1) AS c FROM (SELECT id, name, {ANSWER} AS t FROM organizations))""")
def _(t):
    q = t.organizations.select("id", F.expr(ANSWER).alias("t"))
    rec = F.get(C.json_records("t"), F.lit(0))
    return q.select("id", C.salvage_json("t").alias("json_text"), rec["name"].alias("found_name"))


@query("x18_abbreviations", "organizations", """
SELECT id, array_to_string(list_transform(w, lambda x: x[1]), '') AS initials, array_to_string(list_transform(w, lambda x: x[1]), '') || lower(state[1:2]) AS with_state,
 array_to_string(list_transform(list_filter(w, lambda x: length(x) > 1), lambda x: x[1]), '') AS acronym FROM (SELECT id, state, string_split(lower(name), ' ') AS w FROM organizations)""")
def _(t):
    w = U.words(F.col("name"))
    return t.organizations.select("id", U.initials(w).alias("initials"),
                                  F.concat(U.initials(w), F.lower(F.substring("state", 1, 2))).alias("with_state"),
                                  U.initials(F.filter(w, lambda x: F.length(x) > 1)).alias("acronym"))


SITE_NAME = ("CASE id % 5 WHEN 0 THEN 'City of Springfield' WHEN 1 THEN 'Boulder City' WHEN 2 THEN 'Clear Lake Water District' WHEN 3 THEN 'Aquaworks' "
             "ELSE 'Regional Board of Pumps' END")


@query("x19_candidate_websites", "organizations", """
SELECT id, 'https://www.' || unnest(CASE id % 5
 WHEN 0 THEN ['cityofspringfield.gov','cityofspringfield.org','springfield-city.gov','springfieldcity.gov','springfieldcity.org','springfield.nv.gov','springfield.nv.us','cityspringfield.org','city-springfield.org','cityspringfield.com','cityofspringfield.org','cos.org','cos.com','cos.gov']
 WHEN 1 THEN ['bouldercity.org','boulder-city.org','bouldercity.com','boulder-city.com','bouldercity.gov','boulder-city.gov']
 WHEN 2 THEN ['clearwater.org','clearwater.com','clearwd.org','clearwd.com','clearwater.gov','cleardistrict.org','clear-district.org','cleardistrict.com','clearlakewater.org','clwd.org','clwd.com','clwd.gov']
 WHEN 3 THEN ['aquaworks.org','aquaworks.com','aquaworks.gov']
 ELSE ['regionalpumps.org','regional-pumps.org','regionalpumps.com','regionalboardof.org','rbop.org','rbop.com','rbop.gov'] END) AS website
FROM organizations""")
def _(t):
    q = t.organizations.select("id", F.expr(SITE_NAME).alias("n"))
    return q.select("id", F.explode(U.candidate_websites("n", F.lit("Nevada"))).alias("website"))


@query("x20_mailbox_titles", "", """
SELECT event_id, mailbox, CASE mailbox WHEN 'director@x.org' THEN 'Director' WHEN 'water@x.org' THEN 'Water Department Manager' WHEN 'chief.plant@x.org' THEN 'Plant Manager'
 WHEN 'opsmanager@x.org' THEN 'Opsmanager Manager' END AS job_title,
 CASE mailbox WHEN 'director@x.org' THEN 'Director' WHEN 'opsmanager@x.org' THEN 'Manager' WHEN 'badmin@x.org' THEN 'Administrator' ELSE 'Unknown Position' END AS directory_title
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'director@x.org' WHEN 1 THEN 'water@x.org' WHEN 2 THEN 'chief.plant@x.org' WHEN 3 THEN 'opsmanager@x.org' ELSE 'badmin@x.org' END AS mailbox FROM events)""")
def _(t):
    q = t.events.select("event_id", F.expr("CASE event_id % 5 WHEN 0 THEN 'director@x.org' WHEN 1 THEN 'water@x.org' "
                                           "WHEN 2 THEN 'chief.plant@x.org' WHEN 3 THEN 'opsmanager@x.org' ELSE 'badmin@x.org' END").alias("mailbox"))
    return q.select("event_id", "mailbox", N.mailbox_title("mailbox").alias("job_title"),
                    N.directory_mailbox_title("mailbox").alias("directory_title"))


@query("x21_device", "tracking_events", """
SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'mobile' WHEN 2 THEN 'mobile' ELSE 'desktop' END AS device_type,
 CASE event_id % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' WHEN 2 THEN 'Firefox' ELSE 'unknown' END AS browser,
 CASE event_id % 4 WHEN 0 THEN 'Windows' WHEN 1 THEN 'macOS' WHEN 2 THEN 'Linux' ELSE 'unknown' END AS os FROM tracking_events""")
def _(t):
    return t.tracking_events.select("event_id", N.device("user_agent").alias("d")).select("event_id", "d.*")


SHORT_SQL = "||".join(f"substr('{U.SHORT_ID_ALPHABET}', (('0x' || substr(h, {s}, 12))::BIGINT // {57 ** k} % 57 + 1)::INT, 1)"
                      for s in (1, 13) for k in range(6))


@query("x22_x23_short_id", "shortened_urls", f"""
SELECT short_id AS source_id, k AS short_id, 'https://t.example.org/track/click/' || k AS tracking_url FROM (SELECT short_id, {SHORT_SQL} AS k FROM (
 SELECT short_id, md5(concat_ws('|', contact_id::VARCHAR, email_id, original_url)) AS h FROM shortened_urls))""")
def _(t):
    k = U.short_id("contact_id", "email_id", "original_url")
    return t.shortened_urls.select(F.col("short_id").alias("source_id"), k.alias("short_id"),
                                   U.tracking_url("https://t.example.org", k).alias("tracking_url"))


@query("x24_repaired_url", "shortened_urls", f"""
SELECT short_id, CASE WHEN contact_id % 7 = 0 THEN 'https://' || replace(replace(original_url, 'https://', ''), 'http://', '')
 WHEN contact_id % 11 = 0 THEN NULL ELSE original_url END AS url FROM shortened_urls""")
def _(t):
    raw = F.expr("CASE WHEN contact_id % 7 = 0 THEN replace(replace(original_url, 'https://', ''), 'http://', '') "
                 "WHEN contact_id % 11 = 0 THEN '' ELSE original_url END")
    return t.shortened_urls.select("short_id", U.repaired_url(raw).alias("url"))


@query("x25_link_type", "search_results", """
SELECT pos, CASE WHEN contains(u, 'site1') OR contains(x, 'site1') THEN 'ignored' END AS never, CASE WHEN contains(u, 'contact') OR contains(x, 'contact') THEN 'contact'
 WHEN contains(u, 'download') OR contains(x, 'download') THEN 'download' WHEN contains(u, 'demo') OR contains(x, 'demo') THEN 'demo'
 WHEN contains(x, 'get started') OR contains(x, 'sign up') THEN 'cta' ELSE 'general' END AS link_type
FROM (SELECT pos, lower(url) AS u, lower(CASE pos % 5 WHEN 0 THEN 'Contact us' WHEN 1 THEN 'Sign Up' WHEN 2 THEN 'see DEMO' WHEN 3 THEN 'Download' ELSE snippet END) AS x FROM search_results)
""".replace("CASE WHEN contains(u, 'site1') OR contains(x, 'site1') THEN 'ignored' END AS never, ", ""))
def _(t):
    text = F.expr("CASE pos % 5 WHEN 0 THEN 'Contact us' WHEN 1 THEN 'Sign Up' WHEN 2 THEN 'see DEMO' WHEN 3 THEN 'Download' ELSE snippet END")
    return t.search_results.select("pos", C.link_type("url", text).alias("link_type"))


@query("x26_render_message", "contacts organizations", """
SELECT c.id, CASE WHEN nullif(trim(c.first_name), '') IS NOT NULL AND c.id % 6 <> 0 THEN 'Hi ' || c.first_name || ', a note for ' || o.name ELSE 'A note for ' || o.name END AS body
FROM contacts c JOIN organizations o ON c.organization_id = o.id""")
def _(t):
    o = t.organizations.select(F.col("id").alias("organization_id"), "name")
    body = C.render_message(F.lit("Hi {first_name}, a note for {organization}"), F.lit("A note for {organization}"),
                            "first_name", {"organization": F.col("name")}, F.expr("id % 6 = 0"))
    return t.contacts.join(o, "organization_id").select("id", body.alias("body"))


RESULT_TITLE = "CASE pos % 3 WHEN 0 THEN 'Lisa Webster - City Planner' WHEN 1 THEN 'Staff page' ELSE title END"
RESULT_SNIPPET = "CASE pos % 4 WHEN 0 THEN snippet WHEN 1 THEN 'John Smith serves as the new Water Manager. Mail john@x.org or 555-123-4567' ELSE 'meet Anna Jones, Chief Engineer at (555) 123-4567' END"


@query("x28_person_in_result", "search_results", r"""
SELECT pos, CASE WHEN tn <> '' THEN split_part(tn, ' ', 1) ELSE split_part(CASE WHEN a <> '' THEN a ELSE b END, ' ', 1) END AS first,
 CASE WHEN tn <> '' THEN split_part(tn, ' ', 2) ELSE split_part(CASE WHEN a <> '' THEN a ELSE b END, ' ', 2) END AS last,
 CASE WHEN tn <> '' THEN CASE WHEN pos % 3 = 0 THEN 'City Planner' ELSE nullif(trim(regexp_extract(substr(t, strpos(t, tn) + length(tn)), '(?:[-:]\s*)([A-Za-z\s,]+)(?:\s+at|$)', 1)), '') END
  WHEN a <> '' THEN regexp_extract(s, '([A-Z][a-z]+ [A-Z][a-z]+)(?:\s+is|\s+serves as|\s+has been|\s+was named|\s+was appointed)(?:\s+the|\s+our|\s+as|\s+to)?(?:\s+new)?\s+([A-Za-z\s]+)', 2)
  ELSE regexp_extract(s, '([A-Z][a-z]+ [A-Z][a-z]+),?\s+([A-Za-z\s]+)', 2) END AS position,
 nullif(regexp_extract(s, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), '') AS email, nullif(regexp_extract(s, '(?:\(\d{3}\)\s*\d{3}-\d{4}|\d{3}-\d{3}-\d{4})'), '') AS phone
FROM (SELECT pos, t, s, regexp_extract(t, '([A-Z][a-z]+ [A-Z][a-z]+)(?:\s*-\s*|\s+at\s+|\s+from\s+|\s+with\s+)', 1) AS tn,
 regexp_extract(s, '([A-Z][a-z]+ [A-Z][a-z]+)(?:\s+is|\s+serves as|\s+has been|\s+was named|\s+was appointed)(?:\s+the|\s+our|\s+as|\s+to)?(?:\s+new)?\s+([A-Za-z\s]+)', 1) AS a,
 regexp_extract(s, '([A-Z][a-z]+ [A-Z][a-z]+),?\s+([A-Za-z\s]+)', 1) AS b
 FROM (SELECT pos, """ + RESULT_TITLE + " AS t, " + RESULT_SNIPPET + " AS s FROM search_results)) WHERE tn <> '' OR a <> '' OR b <> ''")
def _(t):
    q = t.search_results.select("pos", F.expr(RESULT_TITLE).alias("t"), F.expr(RESULT_SNIPPET).alias("s"))
    return q.select("pos", N.person_in_search_result("t", "s").alias("p")).filter("p IS NOT NULL").select("pos", "p.*")


@query("x29_title_match_relevance", "contacts",
       "SELECT id, CASE WHEN job_title = 'Operations Manager' THEN 8.0 ELSE 7.0 END::DOUBLE AS relevance FROM contacts")
def _(t):
    return t.contacts.select("id", N.title_match_relevance("job_title", F.lit("Operations Manager")).alias("relevance"))


@query("x31_reasons_text", "validation_reports", """
SELECT id, CASE WHEN id % 5 = 0 THEN 'No reasons given' ELSE (reasons->>0) || ', extra' END AS reasons FROM validation_reports""")
def _(t):
    raw = F.expr("CASE WHEN id % 5 = 0 THEN 'broken [' ELSE replace(reasons, ']', ', \"extra\"]') END")
    return t.validation_reports.select("id", C.json_texts(raw, "No reasons given").alias("reasons"))


@query("x32_display_values", "contacts", """
SELECT id, strftime(date_added, '%Y-%m-%d') AS day, CASE WHEN contact_confidence_score IS NULL THEN 'N/A' ELSE printf('%.2f', contact_confidence_score) END AS score FROM contacts""")
def _(t):
    return t.contacts.select("id", F.date_format("date_added", "yyyy-MM-dd").alias("day"),
                             C.two_decimals("contact_confidence_score").alias("score"))


SNIP = "'see http://www.linkedin.com/in/a and https://' || CASE pos % 3 WHEN 0 THEN 'google.com/x' ELSE 'www.town' || CAST(pos AS VARCHAR(20)) || '.gov' END || ' ' || snippet"


@query("x33_first_snippet_site", "search_results", r"""
SELECT pos, 'https://' || list_filter(regexp_extract_all(s, 'https?://(?:www\.)?([a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+)', 1),
 lambda u: len(list_filter(""" + sql_list(U.BLOCKED_SNIPPET_SITES) + """, lambda b: contains(u, b))) = 0)[1] AS website FROM (SELECT pos, """ + SNIP + " AS s FROM search_results)")
def _(t):
    return t.search_results.select("pos", U.first_snippet_site(F.expr(SNIP)).alias("website"))


@query("x34_top_result_site", "search_results", """
SELECT query, arg_min(url, pos) AS website FROM (SELECT query, pos, CASE WHEN pos < 7 THEN 'https://linkedin.com/x' ELSE url END AS url,
 row_number() OVER (PARTITION BY query ORDER BY pos) AS rn FROM search_results) WHERE rn <= 3 AND NOT contains(url, 'linkedin.com') GROUP BY query""")
def _(t):
    return SEL.top_result_site(t.search_results.withColumn("url", F.expr("CASE WHEN pos < 7 THEN 'https://linkedin.com/x' ELSE url END")))
