"""Page jobs: stored pages to links, page facts, people and organizations.

Flat facts (title, links, headings, text) are regular expressions in the JVM. People in cards, tables, lists and
sections come from the parsed row of ``sources.html``; each job picks elements with array expressions inside the
page's row and explodes only what it found, so no page meets another.
"""
from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.functions import people as N
from rosterlake.functions.content import html_to_text
from rosterlake.functions.text import any_word, blank_to_null, col, first_case, nonblank, rows_of
from rosterlake.functions.urls import host, registered_domain, short_id, tracking_url
from rosterlake.operators import scoring as S
from rosterlake.operators.predicates import IGNORED_URL_PATTERNS, generic_mailbox
from rosterlake.operators.selection import lowest_strategy, rank_within
from rosterlake.session import cut_lineage, stored
from rosterlake.sources import html as H

# ---- fixed values ---------------------------------------------------------------------------
TEAM_WORDS = ["team", "staff", "people", "leadership", "management", "executives", "directors", "board"]
URL_ENDINGS = {
    "about": ["about", "about-us", "aboutus"], "contact": ["contact", "contact-us", "contactus"],
    "locations": ["locations", "offices", "branches"], "services": ["services", "solutions", "products", "capabilities"],
    "projects": ["projects", "portfolio", "case-studies", "work"],
}
ABOUT_WORDS = ["about", "about us", "who we are", "our history"]
CONTACT_WORDS = ["contact", "contact us", "get in touch", "reach us"]
PRIORITY_PAGES = [
    "about", "team", "staff", "contact", "leadership", "management", "executives", "board", "directors", "people",
    "organization", "facilities", "infrastructure", "operations", "systems", "plants", "treatment", "processing",
    "monitoring", "automation", "technology", "projects", "portfolio", "case-studies", "clients", "services",
]
INFRASTRUCTURE_TERMS = [
    "treatment plant", "facility", "pump station", "lift station", "storage tank", "reservoir", "distribution system",
    "collection system", "transmission line", "substation", "control room", "operations center",
]
PROCESS_TERMS = [
    "plc", "controller", "automation", "monitoring", "telemetry", "remote monitoring", "control system",
    "process control", "distributed control", "instrumentation", "sensors", "actuators", "hmi",
    "human machine interface", "historian", "data acquisition",
]
IMAGE_TERMS = ["plant", "facility", "station", "system", "equipment"]
HEADING_TERMS = ["facilities", "operations", "systems", "solutions"]
CONTACT_PHRASES = [
    "contact us", "reach us", "get in touch", "connect with us", "our team", "team members", "staff directory",
    "meet the team", "about us", "leadership", "management team",
]
PROJECT_CLASSES = ["project", "case-study", "portfolio-item"]
AUTOMATION_WORDS = ["automation", "control", "scada", "monitoring"]
CARD_CLASSES = ["staff", "employee", "person", "member", "profile", "card", "contact"]
DIRECTORY_CLASSES = ["staff", "employee", "directory", "team", "personnel", "contact"]
TITLE_CLASSES = ["title", "position", "job", "role"]
TABLE_HEADERS = ["name", "title", "email", "phone", "department"]
DIRECTORY_TERMS = ["name", "title", "position", "email", "phone", "contact", "department"]
PRIORITY_POSITIONS = ["director", "manager", "supervisor", "chief", "superintendent", "engineer", "administrator", "clerk", "mayor"]
SECTION_WORDS = ["contact", "staff", "department", "division", "official"]
DEPARTMENT_WORDS = ["department", "division", "office"]
DIRECTORY_LINK_TEXT = (r"staff\s*directory|employee\s*directory|contact\s*us|directory|departments|staff|personnel|officials"
                       r"|elected\s*officials|department\s*heads|team|leadership")
DIRECTORY_LINK_HREF = ["directory", "staff", "contact", "departments", "officials", "personnel"]
STAFF_URL_PATTERNS = [
    "/directory", "/staff-directory", "/employee-directory", "/personnel", "/staff", "/our-staff", "/city-staff",
    "/town-staff", "/meet-our-staff", "/departments", "/elected-officials", "/city-council", "/town-council",
    "/board-of-supervisors", "/commissioners", "/mayor", "/administration", "/government", "/city-government",
    "/town-government", "/about-us", "/city-hall", "/town-hall", "/officials", "/leadership", "/directory.aspx",
    "/contacts.aspx", "/staff.aspx", "StaffDirectory", "ContactUs", "MeetTheStaff", "?did=", "?dept=", "?department=",
    "?ID=", "?dir=",
]
STAFF_QUERY_BASES = ["/directory", "/staff", "/departments", "/contact", "/government"]
STAFF_LINK_WORDS = ["contact", "directory", "staff", "department", "officials", "personnel", "employees", "team", "government"]
SITEMAP_WORDS = ["contact", "staff", "directory", "about", "team", "department"]
OFFICIAL_PHRASES = [
    "official website", "official site", "home - city of", "home - town of", "municipal government",
    "official home page", "city government", "town government", "county government", "official web site",
]
NAME_THEN_TITLE = (r"([A-Z][a-z]+(?:\s[A-Z][a-z]+)+)[\s,:-]+([A-Za-z\s&]+?(?:Director|Manager|Engineer|President|CEO|CTO|CFO|Officer"
                   r"|Supervisor|Lead|Head|Chief|Coordinator)(?:[A-Za-z\s&]*))(?:\s|,|\.|\n|$)")
TWO_WORD_NAME = r"([A-Z][a-z]+ [A-Z][a-z]+)"
NAVIGATION_WORDS = ["home", "about", "contact", "login", "search", "menu", "next", "previous", "read more", "learn more", "privacy"]
# ---- end of fixed values --------------------------------------------------------------------


def extract_links(pages: DataFrame, page: str = "page_id", ignore: Sequence[str] = IGNORED_URL_PATTERNS) -> DataFrame:
    """(page, url, link) for links inside the page's own host, resolved, without fragments, each once."""
    l = pages.select(page, "url", F.explode(H.links(H.visible_markup("html"))).alias("l"))
    l = l.filter((F.col("l.href") != "") & ~F.col("l.href").rlike("^(#|javascript:|mailto:|tel:)"))
    l = l.withColumn("link", H.absolute_url(F.col("l.href"), F.col("url")))
    return l.filter((host("link") == host("url")) & ~F.lower("link").rlike("|".join(ignore))).select(page, "url", "link").distinct()


def prioritized_links(links: DataFrame, page: str = "page_id", words: Sequence[str] = PRIORITY_PAGES) -> DataFrame:
    """Links with a priority word first."""
    return links.withColumn("high", any_word(F.lower("link"), words)).orderBy(page, F.desc("high"), "link")


def page_type(url: str | Column, title: Column, h1: Column) -> Column:
    """By the end of the address, then by title or first heading, then homepage, else other."""
    u = F.regexp_replace(F.lower(col(url)), "/+$", "")
    t, h = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(h1, F.lit("")))

    def ends(kind: str) -> Column:
        return u.rlike("(" + "|".join(URL_ENDINGS[kind]) + ")$")

    def said(words: Sequence[str]) -> Column:
        return any_word(t, words) | any_word(h, words)

    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(url), r"^[a-zA-Z]+://[^/?#]*", ""), "[?#].*$", ""), "/+$", "")
    return first_case([
        (ends("about"), "about"), (ends("contact"), "contact"), (any_word(F.lower(col(url)), TEAM_WORDS), "team"),
        (ends("locations"), "locations"), (ends("services"), "services"), (ends("projects"), "projects"),
        (said(ABOUT_WORDS), "about"), (said(CONTACT_WORDS), "contact"), (said(TEAM_WORDS), "team"),
        (path.isin("", "/index.html", "/index.php"), "homepage"),
    ], "other")


def page_facts(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), infrastructure: Sequence[str] = INFRASTRUCTURE_TERMS,
               process: Sequence[str] = PROCESS_TERMS, industries: dict | None = None) -> DataFrame:
    """Title, description, type, contact and infrastructure flags, industry map: one pass, no parse."""
    q = pages.withColumn("_m", H.visible_markup("html"))
    q = (q.withColumn("_text", H.plain(F.regexp_replace("_m", r"(?is)<title[^>]*>.*?</title\s*>", "")))
         .withColumn("title", H.page_title("html")).withColumn("description", H.meta_content("html", "description"))
         .withColumn("_h", H.headings("_m")).withColumn("_links", H.links("_m")))
    h1 = F.get(H.headings(F.col("_m"), "1"), F.lit(0))
    low = F.lower("_text")
    attr = r'=["\'][^"\']*contact'
    contact = (F.col("_text").rlike(N.EMAIL_IN_TEXT) | F.col("_text").rlike(N.PHONE_ANY)
               | F.col("_text").rlike(r"[A-Z][a-z]+\s[A-Z][a-z]+,?\s+[\w\s]+")
               | F.exists("_links", lambda x: x["href"].rlike(r"\.vcf$|^mailto:|^tel:"))
               | F.col("_m").rlike(rf"(?i)<(form|div|section)\s[^>]*(?:id|class){attr}")
               | F.exists("_h", lambda x: F.lower(x).contains("contact")) | any_word(low, CONTACT_PHRASES))
    alts = F.regexp_extract_all("_m", F.lit(r'(?is)<img\s[^>]*alt=["\']([^"\']*)["\']'), 1)
    infra = (any_word(low, [*process, *infrastructure])
             | F.exists(alts, lambda x: any_word(F.lower(x), IMAGE_TERMS))
             | F.exists(H.headings(F.col("_m"), "1-4"), lambda x: any_word(F.lower(x), HEADING_TERMS)))
    q = (q.withColumn("page_type", page_type("url", F.col("title"), h1)).withColumn("contains_contact_info", contact)
         .withColumn("contains_infrastructure", infra))
    q = q.withColumn("industry_indicators", S.industry_indicators("_text", industries) if industries else S.industry_indicators("_text"))
    return q.select(*keep, "title", "description", "page_type", "contains_contact_info", "contains_infrastructure", "industry_indicators")


def official_title(title: str | Column, name: str | Column) -> Column:
    t = F.lower(F.coalesce(col(title), F.lit("")))
    n = F.lower(col(name))
    return F.struct(any_word(t, OFFICIAL_PHRASES).alias("official_phrase"),
                    F.coalesce((n != "") & t.contains(n), F.lit(False)).alias("name_in_title"))


def page_projects(parsed: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    els = F.col("elements")
    blocks = F.filter(els, lambda e: e["tag"].isin("div", "section", "article") & H.has_class(e, PROJECT_CLASSES))
    found = F.transform(blocks, lambda b: F.struct(
        b["seq"].alias("seq"), H.text_of(H.first_inside(b, lambda e: e["tag"].isin("h2", "h3", "h4"))).alias("title"),
        F.coalesce(H.text_of(H.first_inside(b, lambda e: e["tag"].isin("p", "div") & e["cls"].contains("desc"))), F.lit("")).alias("description")))
    q = parsed.select(*keep, F.explode(found).alias("p")).select(*keep, "p.*").filter(nonblank("title"))
    return q.withColumn("contains_automation", any_word(F.lower(F.concat_ws(" ", "title", "description")), AUTOMATION_WORDS))


# ---- people ---------------------------------------------------------------------------------

def _people(df: DataFrame, keep: Sequence[str], confidence: float, method: str, name: str = "name", parse: bool = True) -> DataFrame:
    """Common tail: name split, relevance of the title, discovery facts."""
    q = df.withColumn("_n", N.person_name(name) if parse else N.split_name(name))
    if parse:
        q = q.filter(F.col("_n").isNotNull())
    for c in ("job_title", "email", "phone"):
        q = q.withColumn(c, blank_to_null(c)) if c in q.columns else q.withColumn(c, F.lit(None).cast("string"))
    return q.select(*keep, "seq", F.col("_n.first").alias("first_name"), F.col("_n.last").alias("last_name"), "job_title", "email", "phone",
                    S.municipal_title_score(F.coalesce("job_title", F.lit(""))).alias("relevance"), F.lit(confidence).alias("confidence"),
                    F.lit(method).alias("method"))


PERSON_LD = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "job_title", "email", "phone")]))


@F.pandas_udf(PERSON_LD)
def _people_of_blocks(blocks: pd.Series) -> pd.Series:
    """Persons of a page's JSON-LD blocks in document order, through members or employees of organizations to any depth."""
    def is_a(x: dict, kind: str) -> bool:
        return any(kind == v or isinstance(v, list) and kind in v for v in (x.get("@type"), x.get("type")))

    def text(v) -> str | None:
        return v if isinstance(v, str) else None if v is None or isinstance(v, (dict, list, bool)) else str(v)

    def people(block: str) -> list[dict]:
        try:
            todo, out = [json.loads(block)], []
        except (ValueError, RecursionError):
            return []
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo.extend(reversed(x))
            elif isinstance(x, dict) and is_a(x, "Person"):
                out.append({"name": text(x.get("name")), "job_title": text(x.get("jobTitle")), "email": text(x.get("email")), "phone": text(x.get("telephone"))})
            elif isinstance(x, dict) and is_a(x, "Organization"):
                todo.append(x.get("member") or x.get("employee"))
        return out

    return blocks.map(lambda page: [p for block in (page if page is not None else []) for p in people(block)])


def people_from_json_ld(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Persons in JSON-LD, alone, in a list, or as members or employees of organizations, however deep."""
    q = pages.select(*keep, F.posexplode(_people_of_blocks(H.json_ld("html"))).alias("seq", "p")).select(*keep, "seq", "p.*")
    return _people(q.filter(nonblank("name")), keep, 0.95, "structured_data")


def organizations_from_json_ld(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    recs = F.transform(H.json_ld("html"), lambda j: F.from_json(j, "name string, telephone string, email string, url string, `@type` string"))
    q = pages.select(*keep, F.explode(recs).alias("o")).filter("o.`@type` = 'Organization' AND o.name <> ''")
    return q.select(*keep, "o.name", "o.telephone", "o.email", F.col("o.url").alias("website"))


def people_from_microdata(parsed: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    def prop(b: Column, name: str) -> Column:
        return H.first_inside(b, lambda e: e["prop"] == name)

    boxes = F.filter("elements", lambda e: F.coalesce(e["itemtype"].contains("schema.org/Person"), F.lit(False)))
    found = F.transform(boxes, lambda b: F.struct(
        b["seq"].alias("seq"), H.text_of(prop(b, "name")).alias("name"), H.text_of(prop(b, "jobTitle")).alias("job_title"),
        F.coalesce(blank_to_null(H.mailto(prop(b, "email"))), H.text_of(prop(b, "email"))).alias("email"), H.text_of(prop(b, "telephone")).alias("phone")))
    q = parsed.select(*keep, F.explode(found).alias("p")).select(*keep, "p.*")
    return _people(q.filter(nonblank("name")), keep, 0.95, "structured_data")


def people_from_vcards(parsed: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """hCard markup: a `vcard` box with `fn`, `title`, `email` and `tel` inside."""
    def part(b: Column, cls: str) -> Column:
        return H.first_inside(b, lambda e: e["cls"].rlike(rf"(^|\s){cls}(\s|$)"))

    boxes = F.filter("elements", lambda e: e["cls"].rlike(r"(^|\s)vcard(\s|$)"))
    found = F.transform(boxes, lambda b: F.struct(b["seq"].alias("seq"), H.text_of(part(b, "fn")).alias("name"), H.text_of(part(b, "title")).alias("job_title"),
                                                  H.text_of(part(b, "email")).alias("email"), H.text_of(part(b, "tel")).alias("phone")))
    q = parsed.select(*keep, F.explode(found).alias("p")).select(*keep, "p.*")
    return _people(q.filter(nonblank("name")), keep, 0.95, "structured_data")


def people_from_cards(parsed: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    cards = F.filter("elements", lambda e: e["tag"].isin("div", "article", "section") & H.has_class(e, CARD_CLASSES))
    heads = ["h2", "h3", "h4", "h5", "strong"]

    def short_plain(e: Column) -> Column:
        t = H.text_of(e)
        return e["tag"].isin("div", "span", "p") & (t != "") & (F.length(t) < 100) & ~t.rlike(r"@|[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}")

    found = F.transform(cards, lambda b: F.struct(
        b["seq"].alias("seq"),
        H.text_of(H.first_inside(b, lambda e: e["tag"].isin(*heads, "div", "span", "a") & e["cls"].contains("name"),
                                 lambda e: e["tag"].isin(*heads))).alias("name"),
        H.text_of(H.first_inside(b, lambda e: e["tag"].isin("div", "span", "p") & H.has_class(e, TITLE_CLASSES), short_plain)).alias("job_title"),
        H.mailto(H.first_inside(b, lambda e: (e["tag"] == "a") & F.coalesce(e["href"].startswith("mailto:"), F.lit(False)))).alias("email"),
        H.text_of(b).alias("body")))
    q = parsed.select(*keep, F.explode(found).alias("p")).select(*keep, "p.*")
    q = q.withColumn("email", F.coalesce(blank_to_null("email"), N.first_email("body"))).withColumn("phone", N.first_phone("body", N.PHONE_CARD))
    return _people(q, keep, 0.9, "cards")


def table_rows(parsed: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """(table, row, cells, links, headers) for every table row; headers from `th`, else the first row."""
    els = F.col("elements")
    tables = F.filter(els, lambda e: e["tag"] == "table")

    def cells(r: Column) -> Column:
        return F.filter(H.descendants(r), lambda e: e["tag"].isin("td", "th"))

    def rows(t: Column) -> Column:
        return F.filter(H.descendants(t), lambda e: (e["tag"] == "tr"))

    def mail(c: Column) -> Column:
        return F.coalesce(H.mailto(H.first_inside(c, lambda e: (e["tag"] == "a") & F.coalesce(e["href"].startswith("mailto:"), F.lit(False)))), F.lit(""))

    found = F.transform(tables, lambda t: F.struct(
        t["seq"].alias("seq"), H.text_of(t).alias("body"),
        F.transform(F.filter(H.descendants(t), lambda e: (e["tag"] == "th")), lambda e: F.lower(H.text_of(e))).alias("th"),
        F.transform(rows(t), lambda r: F.struct(r["seq"].alias("seq"), r["cls"].alias("cls"), F.transform(cells(r), lambda c: H.text_of(c)).alias("cells"),
                                                F.transform(cells(r), mail).alias("mails"))).alias("rows")))
    q = parsed.select(*keep, rows_of(found).alias("t"))
    first = F.transform(F.get("t.rows", F.lit(0))["cells"], F.lower)
    q = q.select(*keep, F.col("t.seq").alias("table_seq"), F.col("t.body").alias("table_text"), F.size("t.rows").alias("n_rows"),
                 F.size("t.th").alias("n_th"), F.when(F.size("t.th") > 0, F.col("t.th")).otherwise(first).alias("headers"),
                 F.posexplode("t.rows").alias("row_no", "r"))
    return q.select(*keep, "table_seq", "table_text", "n_rows", "n_th", "headers", "row_no", "r.seq", "r.cls", "r.cells", "r.mails")


def _column(words: Sequence[str]) -> Column:
    """Index of the first header with one of the words, NULL when there is none."""
    hit = F.transform("headers", lambda h, i: F.when(any_word(h, words), i))
    return F.array_min(hit)


def people_from_tables(parsed: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    r = table_rows(parsed, keep).filter((F.col("row_no") > 0) & (F.size("cells") >= 2))
    for name, words in (("name", ["name"]), ("title", TITLE_CLASSES), ("email", ["email"]), ("phone", ["phone", "tel", "contact"]),
                        ("dept", ["department", "dept", "division"])):
        r = r.withColumn(f"_i_{name}", _column(words))

    def cell(name: str) -> Column:
        return F.get("cells", F.col(f"_i_{name}"))

    by_shape = F.get(F.filter("cells", lambda c: c.rlike(r"^[A-Z][a-z]+ [A-Z][a-z]+$")), F.lit(0))
    dept = blank_to_null(cell("dept"))
    any_mail = F.get(F.filter("mails", lambda m: m != ""), F.lit(0))
    own_mail = F.coalesce(blank_to_null(F.get("mails", F.col("_i_email"))), N.first_email(cell("email")))
    q = (r.withColumn("name", F.when(cell("name").isNotNull(), cell("name")).otherwise(by_shape))
         .withColumn("job_title", F.when(cell("title").isNotNull(), cell("title")).otherwise(F.concat(dept, F.lit(" Staff"))))
         .withColumn("email", F.when(cell("email").isNotNull(), own_mail).otherwise(any_mail))
         .withColumn("phone", N.first_phone(cell("phone"), N.PHONE_CARD)))
    return _people(q.filter(F.col("name").isNotNull()), keep, 0.85, "tables")


def directory_tables(parsed: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Is a table a staff directory? A directory word anywhere, or three rows with an `@` or a leading position."""
    r = table_rows(parsed, keep)
    line = F.lower(F.array_join("cells", " "))
    per = r.groupBy(*keep, "table_seq").agg(
        F.max(any_word(F.lower("table_text"), DIRECTORY_TERMS)).alias("_w"), F.max("n_rows").alias("_n"),
        F.max(line.contains("@") | any_word(line, PRIORITY_POSITIONS)).alias("_p"))
    return per.select(*keep, "table_seq", (F.col("_w") | ((F.col("_n") >= 3) & F.col("_p"))).alias("is_directory"))


def people_from_text(parsed: DataFrame, keep: Sequence[str] = ("page_id", "url"), around: int = 100) -> DataFrame:
    """"Name, Title" in running text, with mail and phone from the characters around it; first hit per name."""
    hits = F.regexp_extract_all("text", F.lit(NAME_THEN_TITLE), 0)
    # the text before each hit is found by walking over the hits in order
    places = F.aggregate(hits, F.struct(F.lit(1).alias("pos"), F.array().cast("array<struct<hit:string,at:int>>").alias("out")),
                         lambda a, h: F.struct(
                             (_locate(h, a["pos"]) + F.length(h)).alias("pos"),
                             F.concat(a["out"], F.array(F.struct(h.alias("hit"), _locate(h, a["pos"]).alias("at")))).alias("out")))
    q = parsed.select(*keep, "text", F.posexplode(places["out"]).alias("seq", "m"))
    start = F.greatest(F.lit(1), F.col("m.at") - around)
    ctx = F.substr("text", start, F.col("m.at") - start + F.length("m.hit") + around)
    q = (q.withColumn("name", F.trim(F.regexp_extract("m.hit", NAME_THEN_TITLE, 1))).withColumn("job_title", F.trim(F.regexp_extract("m.hit", NAME_THEN_TITLE, 2)))
         .withColumn("email", N.first_email(ctx)).withColumn("phone", N.first_phone(ctx, N.PHONE_ANY)))
    q = rank_within(q, [*keep, "name"], [F.asc("seq")], 1)
    return _people(q.withColumn("name", F.col("name")), keep, 0.7, "text", parse=False)


def _locate(needle: Column, start: Column) -> Column:
    return F.call_function("locate", needle, F.col("text"), start)


def people_from_mailto(parsed: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Personal mailto links; the name from the text around the link, else from `first.last@`."""
    els = F.col("elements")
    links = F.filter(els, lambda e: (e["tag"] == "a") & F.coalesce(e["href"].startswith("mailto:"), F.lit(False)))
    found = F.transform(links, lambda a: F.struct(a["seq"].alias("seq"), H.mailto(a).alias("email"),
                                                  H.text_of(F.get(els, a["parent"])).alias("around")))
    q = parsed.select(*keep, F.explode(found).alias("p")).select(*keep, "p.*").filter(~generic_mailbox("email"))
    named = N.person_name(N.found("around", TWO_WORD_NAME, 1))
    q = q.withColumn("_n", F.coalesce(named, N.name_from_email("email"))).filter(F.col("_n").isNotNull())
    title = F.trim(F.regexp_extract("around", TWO_WORD_NAME + r"[,:\s]+([^,\n]+?)(?:,|\n|$)", 2))
    q = (q.withColumn("name", F.concat_ws(" ", "_n.first", "_n.last"))
         .withColumn("job_title", F.when(~title.contains("@"), title))
         .withColumn("phone", N.first_phone("around", N.PHONE_CARD)))
    out = _people(q, [*keep, "_n"], 0.75, "mailto", parse=False)
    return out.withColumn("first_name", F.col("_n.first")).withColumn("last_name", F.col("_n.last")).drop("_n")


def emails_in_pages(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Bare contacts: every address in the visible text once per page."""
    e = F.array_distinct(F.regexp_extract_all(html_to_text("html"), F.lit(N.EMAIL_LOOSE), 0))
    return pages.select(*keep, F.explode(e).alias("email"), F.lit(0.75).alias("confidence"), F.lit(7.0).alias("relevance"))


def _section_of(e: Column) -> Column:
    """Nearest heading of level one to four before the element; the parse has noted its place."""
    return F.when(e["head"] >= 0, F.get("elements", e["head"]))


def people_from_sections(parsed: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Paragraphs under a contact or department heading; a department stands in for a missing title."""
    heads = ["h1", "h2", "h3", "h4"]
    paras = F.filter("elements", lambda e: e["tag"].isin("p", "div"))
    found = F.transform(paras, lambda p: F.struct(
        p["seq"].alias("seq"), H.text_of(p).alias("body"), H.text_of(_section_of(p)).alias("heading"),
        H.mailto(H.first_inside(p, lambda e: (e["tag"] == "a") & F.coalesce(e["href"].startswith("mailto:"), F.lit(False)))).alias("mail"),
        F.exists(H.descendants(p), lambda e: e["tag"].isin("p", "div", *heads)).alias("outer")))
    q = parsed.select(*keep, rows_of(found).alias("p")).select(*keep, "p.*")
    q = q.filter(~F.col("outer") & (F.length("body") >= 10) & any_word(F.lower("heading"), SECTION_WORDS))
    title = F.trim(F.regexp_extract("body", TWO_WORD_NAME + r"[,:\s]+([^,\n]+?)(?:,|\n|$)", 2))
    dept = F.when(any_word(F.lower("heading"), DEPARTMENT_WORDS), F.concat("heading", F.lit(" Staff")))
    q = (q.withColumn("name", N.found("body", TWO_WORD_NAME, 1)).withColumn("job_title", F.coalesce(F.when(title != "", title), dept))
         .withColumn("email", F.coalesce(blank_to_null("mail"), N.first_email("body"))).withColumn("phone", N.first_phone("body", N.PHONE_CARD)))
    return _people(q.filter(F.col("name").isNotNull()), keep, 0.8, "sections")


def people_from_departments(parsed: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Names set off in the block of a department heading, the text after the name as title."""
    els = F.col("elements")
    people = F.filter(els, lambda e: e["tag"].isin("h5", "h6", "strong", "b", "em"))
    # the few department headings, and the telephone links, are picked once for a page
    heads = F.filter(els, lambda h: h["tag"].isin("h2", "h3", "h4") & any_word(F.lower(H.text_of(h)), DEPARTMENT_WORDS))
    phones = F.filter(els, lambda e: F.coalesce(e["href"].startswith("tel:"), F.lit(False)))
    parsed = parsed.withColumn("_heads", heads).withColumn("_tel", phones)

    def department(p: Column) -> Column:
        # heading whose own block holds the name
        return F.get(F.filter("_heads", lambda h: (F.get(els, h["parent"])["last"] >= p["seq"]) & (h["parent"] < p["seq"])), F.lit(0))

    def block(p: Column) -> Column:
        return F.get(els, p["parent"])

    found = F.transform(people, lambda p: F.struct(
        p["seq"].alias("seq"), H.text_of(p).alias("name"), H.text_of(department(p)).alias("department"), H.text_of(block(p)).alias("around"),
        F.trim(F.regexp_extract(F.substr("text", p["t1"] + 1, block(p)["t1"] - p["t1"]), r"^[\s,:–-]*([^\n]*)", 1)).alias("after"),
        H.mailto(F.get(F.filter(H.descendants(block(p)), lambda e: (e["tag"] == "a") & F.coalesce(e["href"].startswith("mailto:"), F.lit(False))), F.lit(0))).alias("mail"),
        F.regexp_extract(F.get(F.filter("_tel", lambda e: e["seq"] > p["seq"]), F.lit(0))["href"], "^tel:(.*)$", 1).alias("tel")))
    q = parsed.select(*keep, rows_of(found).alias("p")).select(*keep, "p.*").filter(nonblank("department") & F.length("name").between(4, 40))
    q = (q.withColumn("job_title", F.trim(F.regexp_replace("after", N.EMAIL_IN_TEXT + "|" + N.PHONE_ANY, "")))
         .withColumn("email", F.coalesce(blank_to_null("mail"), N.first_email("around")))
         .withColumn("phone", F.coalesce(blank_to_null("tel"), N.first_phone("around", N.PHONE_ANY))))
    out = _people(q, [*keep, "department"], 0.75, "departments", parse=False)
    return out.withColumn("relevance", S.title_department_score("job_title", "department"))


def people_from_definitions(parsed: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """`dt` = name, next `dd` = title, mail, phone."""
    els = F.col("elements")

    def answer(d: Column) -> Column:
        return F.get(F.filter(els, lambda e: (e["seq"] > d["seq"]) & (e["tag"] == "dd")), F.lit(0))

    def link(d: Column, mark: str) -> Column:
        return F.get(F.filter(H.descendants(answer(d)), lambda e: F.coalesce(e["href"].startswith(mark), F.lit(False))), F.lit(0))["href"]

    found = F.transform(F.filter(els, lambda e: e["tag"] == "dt"), lambda d: F.struct(
        d["seq"].alias("seq"), H.text_of(d).alias("name"), H.text_of(answer(d)).alias("body"),
        F.trim(F.substring_index(F.trim(F.substr("text", answer(d)["t0"] + 1, answer(d)["t1"] - answer(d)["t0"])), "\n", 1)).alias("job_title"),
        F.regexp_extract(link(d, "mailto:"), r"^mailto:([^?]*)", 1).alias("mail"), F.regexp_extract(link(d, "tel:"), "^tel:(.*)$", 1).alias("tel")))
    q = parsed.select(*keep, F.explode(found).alias("p")).select(*keep, "p.*").filter(F.length("name").between(4, 40) & F.col("body").isNotNull())
    q = (q.withColumn("email", F.coalesce(blank_to_null("mail"), N.first_email("body")))
         .withColumn("phone", F.coalesce(blank_to_null("tel"), N.first_phone("body", N.PHONE_ANY))))
    out = _people(q, keep, 0.7, "definitions", parse=False)
    return out.withColumn("relevance", S.title_department_score("job_title", F.lit("")))


def people_from_grids(parsed: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Grid rows without a header: cells are told apart by content, then by place. Only for pages with an `@`."""
    els = F.col("elements")
    with_mail = F.exists(els, lambda e: (e["tag"] == "td") & F.coalesce(F.get(els, e["parent"])["cls"].contains("gridrow"), F.lit(False))
                         & H.text_of(e).contains("@"))
    r = table_rows(parsed.filter(with_mail), keep).filter(F.col("cls").contains("gridrow") & (F.size("cells") >= 2))
    mail = F.transform("cells", lambda c: N.first_email(c))
    phone = F.transform("cells", lambda c: F.when(N.first_email(c).isNull(), N.first_phone(c, N.PHONE_ANY)))

    def placed(i: int) -> Column:
        c = F.get("cells", F.lit(i))
        return F.when(N.first_email(c).isNull() & N.first_phone(c, N.PHONE_ANY).isNull(), c)

    q = (r.withColumn("name", F.coalesce(placed(0), F.lit("")))
         .withColumn("job_title", placed(1)).withColumn("department", F.coalesce(placed(2), F.lit("")))
         .withColumn("email", F.get(F.reverse(F.filter(mail, lambda x: x.isNotNull())), F.lit(0)))
         .withColumn("phone", F.get(F.reverse(F.filter(phone, lambda x: x.isNotNull())), F.lit(0))))
    q = q.filter(nonblank("name") | nonblank("email"))
    out = _people(q, [*keep, "department"], 0.75, "grids", parse=False)
    return out.withColumn("relevance", S.title_department_score("job_title", "department"))


def people_from_paragraphs(parsed: DataFrame, profiles: Sequence[dict], keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """"First Last, Title" paragraphs of 10-300 characters with a title of 4-50, and role mailboxes."""
    from rosterlake.operators.joins import first_matching_profile
    els = F.col("elements")
    paras = F.transform(F.filter(els, lambda e: e["tag"].isin("p", "div", "li")), lambda p: F.struct(p["seq"].alias("seq"), H.text_of(p).alias("body"),
        F.exists(H.descendants(p), lambda e: e["tag"].isin("p", "div", "li")).alias("outer")))
    q = parsed.select(*keep, F.explode(paras).alias("p")).select(*keep, "p.*").filter(~F.col("outer") & F.length("body").between(10, 300))
    shape = r"([A-Z][a-z]+)\s+([A-Z][a-z]+),\s*([A-Za-z\s&]+)"
    q = (q.withColumn("first_name", N.found("body", shape, 1)).withColumn("last_name", N.found("body", shape, 2))
         .withColumn("job_title", F.trim(N.found("body", shape, 3))).filter(F.length("job_title").between(4, 50)))
    named = first_matching_profile(q, profiles, "job_title", 5.0, "relevance").select(
        *keep, "seq", "first_name", "last_name", "job_title", N.first_email("body").alias("email"), N.first_phone("body", N.PHONE_ANY).alias("phone"),
        "relevance", F.lit(0.7).alias("confidence"), F.lit("text_extraction").alias("method"))
    links = F.transform(F.filter(els, lambda e: F.coalesce(e["href"].startswith("mailto:"), F.lit(False))), lambda e: F.struct(e["seq"].alias("seq"), H.mailto(e).alias("email")))
    m = parsed.select(*keep, F.explode(links).alias("p")).select(*keep, "p.*").withColumn("job_title", N.mailbox_title("email")).filter("job_title IS NOT NULL")
    roles = first_matching_profile(m, profiles, "job_title", 5.0, "relevance").select(
        *keep, "seq", F.lit(None).cast("string").alias("first_name"), F.lit(None).cast("string").alias("last_name"), "job_title", "email",
        F.lit(None).cast("string").alias("phone"), "relevance", F.lit(0.6).alias("confidence"), F.lit("role_mailbox").alias("method"))
    return named.unionByName(roles)


def directory_pages(parsed: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Does a page look like a staff directory?"""
    return parsed.select(*keep, _is_directory(F.col("elements")).alias("is_directory"))


def _is_directory(els: Column) -> Column:
    boxes = F.exists(els, lambda e: e["tag"].isin("div", "section") & H.has_class(e, DIRECTORY_CLASSES))
    heads = F.exists(els, lambda e: (e["tag"] == "th") & F.lower(H.text_of(e)).isin(TABLE_HEADERS))
    people = F.size(F.filter(els, lambda e: e["tag"].isin("h3", "h4", "h5", "strong") & H.text_of(e).rlike(TWO_WORD_NAME)))
    return boxes | heads | (people > 3)


def extract_people(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Strategy by page: directory (cards, else tables, else mail links), contact page (sections, else mail links),
    other pages mail links; structured data always. One parse, one union, lowest strategy that found something."""
    u = F.lower("url")
    kind = F.when(any_word(u, ["directory", "staff"]) | _is_directory(F.col("elements")), "directory").when(u.contains("contact"), "contact").otherwise("other")
    parsed = cut_lineage(H.parse_pages(pages, keep=tuple(keep)).withColumn("page_kind", kind))  # written once, read by every strategy

    def step(strategy, rank: int, *wanted: str) -> DataFrame:
        rows = parsed.filter(F.col("page_kind").isin(*wanted)) if wanted else parsed
        return strategy(rows, keep).withColumn("strategy_rank", F.lit(rank))

    chain = (step(people_from_cards, 1, "directory").unionByName(step(people_from_tables, 2, "directory"))
             .unionByName(step(people_from_sections, 1, "contact")).unionByName(step(people_from_mailto, 3)))
    found = lowest_strategy(chain, keep[0], "strategy_rank").drop("strategy_rank")
    return found.unionByName(people_from_json_ld(pages, keep)).unionByName(people_from_microdata(parsed, keep))


# ---- organizations and staff pages ----------------------------------------------------------

def organizations_from_listing(parsed: DataFrame, states: Sequence[str], terms: Sequence[str] = (), block_classes: Sequence[str] = ("member", "listing", "card", "item"),
                               min_cells: int = 1, min_rows: int = 1, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Listing page -> organizations: table rows, else list items, else blocks, else plain links.

    The first level that yields anything on a page decides. ``terms`` keeps only names or texts with one of the words.
    """
    els = F.col("elements")

    def pick(e: Column, rank: int) -> Column:
        link = H.first_inside(e, lambda x: (x["tag"] == "a") & F.coalesce(x["href"].rlike(r"^(https?:|/)"), F.lit(False)))
        title = H.first_inside(e, lambda x: (x["tag"] == "a") & (H.text_of(x) != ""), lambda x: x["tag"].isin("h2", "h3", "h4", "strong"),
                               lambda x: x["tag"] == "td")
        own = F.when(e["tag"].isin("a", "li"), H.text_of(e))
        return F.struct(e["seq"].alias("seq"), F.lit(rank).alias("strategy_rank"), F.coalesce(H.text_of(title), own).alias("name"),
                        F.coalesce(link["href"], e["href"]).alias("href"), H.text_of(e).alias("body"))

    def cells(e: Column) -> Column:
        return F.size(F.filter(H.descendants(e), lambda x: (x["tag"] == "td")))

    rows = F.filter(els, lambda e: (e["tag"] == "tr") & (cells(e) >= min_cells) & (cells(e) > 0))
    levels = [F.when(F.size(rows) >= min_rows, F.transform(rows, lambda e: pick(e, 1))),
              F.transform(F.filter(els, lambda e: (e["tag"] == "li")), lambda e: pick(e, 2)),
              F.transform(F.filter(els, lambda e: e["tag"].isin("div", "article", "section") & H.has_class(e, list(block_classes))), lambda e: pick(e, 3)),
              F.transform(F.filter(els, lambda e: (e["tag"] == "a") & F.coalesce(e["href"].rlike("^https?:"), F.lit(False))), lambda e: pick(e, 4))]
    q = parsed.select(*keep, F.explode(F.concat(F.coalesce(levels[0], F.array().cast("array<struct<seq:int,strategy_rank:int,name:string,href:string,body:string>>")),
                                                *levels[1:])).alias("o")).select(*keep, "o.*")
    q = q.filter(F.length("name").between(3, 100) & ~F.lower("name").isin(NAVIGATION_WORDS))
    if terms:
        q = q.filter(any_word(F.lower(F.concat_ws(" ", "name", "body")), terms))
    q = lowest_strategy(q, keep[0], "strategy_rank")
    state = first_case([(F.col("body").contains(s), s) for s in states], None)
    city = F.trim(F.regexp_extract("body", r"([A-Z][A-Za-z .]+),\s*(?:[A-Z]{2}\b|" + "|".join(states) + ")", 1))
    return q.select(*keep, "seq", "strategy_rank", "name", H.absolute_url(F.col("href"), F.col("url")).alias("website"), state.alias("state"),
                    F.when(F.length(city).between(1, 29), city).alias("city"))


def organization_name(parsed: DataFrame, pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """JSON-LD organization, site name, logo text, header heading, then the title without its suffix."""
    els = F.col("elements")
    heads = F.flatten(F.transform(F.filter(els, lambda h: h["tag"] == "header"), lambda h: F.filter(H.descendants(h), lambda e: e["tag"].isin("h1", "h2", "h3"))))
    heading = F.get(heads, F.lit(0))
    logo = F.get(F.filter(els, lambda e: (e["tag"] == "img") & nonblank(e["alt"]) & (e["cls"].contains("logo") | F.lower(e["alt"]).contains("logo"))), F.lit(0))["alt"]
    nested = parsed.select(keep[0], blank_to_null(H.text_of(heading)).alias("_head"), F.trim(F.regexp_replace(logo, r"(?i)\s*logo\s*", " ")).alias("_logo"))
    ld = F.get(F.filter(F.transform(H.json_ld("html"), lambda j: F.from_json(j, "name string, `@type` string")), lambda o: o["@type"].contains("Organization")), F.lit(0))["name"]
    flat = pages.select(*keep, ld.alias("_ld"), H.meta_content("html", "og:site_name").alias("_site"), N.title_to_organization(H.page_title("html")).alias("_title"))
    name = F.coalesce(*[blank_to_null(c) for c in ("_ld", "_site", "_logo", "_head", "_title")])
    return flat.join(nested, keep[0]).select(*keep, name.alias("name"))


def staff_links(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    l = pages.select(*keep, F.explode(H.links(H.visible_markup("html"))).alias("l"))
    l = l.filter((F.col("l.href") != "") & ~F.col("l.href").rlike("^(#|javascript:|mailto:|tel:)"))
    hit = F.lower("l.text").rlike(DIRECTORY_LINK_TEXT) | any_word(F.lower("l.href"), DIRECTORY_LINK_HREF)
    return l.filter(hit).select(*keep, H.absolute_url(F.col("l.href"), F.col("url")).alias("link")).distinct()


def staff_page_candidates(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Links that match a staff-page pattern or say so; pages without any get generated addresses."""
    l = pages.select(*keep, F.explode(H.links(H.visible_markup("html"))).alias("l"))
    l = l.filter((F.col("l.href") != "") & ~F.col("l.href").rlike("^(#|javascript:|mailto:|tel:)"))
    l = l.withColumn("link", H.absolute_url(F.col("l.href"), F.col("url")))
    path = F.lower(F.regexp_replace("link", r"^[a-zA-Z]+://[^/?#]*", ""))
    words = [p.lower() for p in STAFF_URL_PATTERNS]
    hit = (any_word(F.regexp_replace(path, r"\?.*$", ""), words) | any_word(F.regexp_extract(path, r"\?(.*)$", 1), words)
           | any_word(F.lower("l.text"), STAFF_LINK_WORDS))
    found = l.filter(hit).select(*keep, "link", F.lit(False).alias("generated")).distinct()
    made: list[str] = []
    for p in STAFF_URL_PATTERNS:
        if p.startswith("?"):
            made += [b + p for b in STAFF_QUERY_BASES]
        else:
            made.append(p)
            if "directory" in p or "staff" in p:
                made += [f"{p}?{k}={i}" for i in range(1, 5) for k in ("id", "did", "dept")]
    root = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    rest = pages.select(*keep).join(found.select(keep[0]), keep[0], "left_anti").select(
        *keep, F.explode(F.transform(F.array(*[F.lit(m) for m in made]), lambda m: F.concat(root, m))).alias("link"), F.lit(True).alias("generated"))
    return found.unionByName(rest)


def sitemap_contact_pages(documents: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """Contact-like pages of sitemaps. An index leads to the stored sitemaps it names, to any depth (cycles end, a pair counts once);
    a document that is no XML gives its links inside the same site whose address or text is contact-like."""
    xml = F.col(body).contains("<?xml")
    loc = F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)
    locs = documents.filter(xml).select(F.col(url).alias("src"), (F.col(body).contains("<sitemapindex") & ~F.col(body).contains("<urlset")).alias("is_index"), F.explode(loc).alias("loc"))
    leaf = locs.filter("NOT is_index")
    hits = leaf.filter(any_word(F.lower("loc"), SITEMAP_WORDS)).select(F.col("src").alias("map"), F.col("loc").alias("page"))
    site = F.regexp_extract("map", r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    links = documents.filter(~xml).select(F.col(url).alias("map"), F.explode(H.links(H.visible_markup(body))).alias("l"))
    inside = F.col("l.href").startswith("/") | ((site != "") & F.col("l.href").contains(site))
    said = any_word(F.lower("l.href"), SITEMAP_WORDS) | any_word(F.lower("l.text"), SITEMAP_WORDS)
    hits = hits.unionByName(links.filter(inside & said).select("map", H.absolute_url(F.col("l.href"), F.col("map")).alias("page")))
    hits = stored(hits.filter("map IS NOT NULL").distinct())
    index = stored(locs.filter("is_index AND src IS NOT NULL").select("src", "loc").distinct())
    # only indexes that name a map with pages are walked up from, over the links between indexes
    named = index.join(hits.withColumnRenamed("map", "loc"), "loc").select(F.col("src").alias("carrier"), "page")
    links_up = stored(index.join(index.select(F.col("src").alias("loc")).distinct(), "loc", "left_semi"))
    carriers = index.join(hits.select(F.col("map").alias("loc")).distinct(), "loc", "left_semi").select("src").distinct()
    level = reach = stored(carriers.select(F.col("src").alias("top"), F.col("src").alias("carrier")))
    rounds = 0
    while level.limit(1).count():
        level = stored(level.withColumnRenamed("top", "loc").join(links_up, "loc").select(F.col("src").alias("top"), "carrier").distinct().join(
            reach, ["top", "carrier"], "left_anti"))
        reach, rounds = reach.unionByName(level), rounds + 1
        if rounds % 16 == 0:  # keeps the plan short
            reach = stored(reach)
    return hits.withColumnRenamed("map", "top").unionByName(reach.join(named, "carrier").select("top", "page")).distinct()


def crawl_frontier(seeds: DataFrame, links: DataFrame, max_depth: int | None = None, max_per_host: int | None = None,
                   ignore: Sequence[str] = IGNORED_URL_PATTERNS, priority: Sequence[str] = PRIORITY_PAGES) -> DataFrame:
    """Breadth-first walk over stored links (src, dst): (url, host, depth), until nothing new is found.

    Optional limits: ``max_depth`` levels, and ``max_per_host`` pages of a host, priority pages first. Every level is checkpointed to
    the shared folder."""
    wanted = cut_lineage(links.filter(~F.lower("dst").rlike("|".join(ignore))).select("src", F.col("dst").alias("url")).distinct())
    order = [any_word(F.lower("url"), priority).desc(), F.asc("url")]

    def within_quota(urls: DataFrame, seen: DataFrame | None) -> DataFrame:
        if max_per_host is None:
            return urls
        ranked = rank_within(urls, ["host"], order, max_per_host, "_r")
        if seen is None:
            return ranked.drop("_r")
        used = seen.groupBy("host").agg(F.count("*").alias("_used"))
        return ranked.join(used, "host", "left").filter(F.col("_r") + F.coalesce(F.col("_used"), F.lit(0)) <= max_per_host).select("url", "host")

    level = cut_lineage(within_quota(seeds.select("url").distinct().withColumn("host", host("url")), None).withColumn("depth", F.lit(0)))
    seen, depth = level, 0
    while (max_depth is None or depth < max_depth) and level.limit(1).count():
        depth += 1
        nxt = wanted.join(level.select(F.col("url").alias("src")), "src", "left_semi").select("url").distinct()
        nxt = nxt.join(seen.select("url"), "url", "left_anti").withColumn("host", host("url"))
        level = cut_lineage(within_quota(nxt, seen).select("url", "host", F.lit(depth).alias("depth")))
        seen = seen.unionByName(level)
    return seen


def local_organizations(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), lexicon: dict | None = None) -> DataFrame:
    """One organization per page from title, first heading or host name; 0.7 confidence, 7.0 relevance."""
    first = F.initcap(F.replace(F.regexp_extract(F.regexp_replace(host("url"), r"^www\.", ""), r"^([^.]*)", 1), F.lit("-"), F.lit(" ")))
    title = H.page_title("html")
    short = (title != "") & (F.length(title) < 60) & ~title.startswith("Welcome") & ~F.lower(title).contains("page")
    from_title = F.trim(F.substring_index(F.substring_index(title, "|", 1), "-", 1))
    heads = F.transform(F.filter(H.headings("html", "1"), lambda x: x.rlike("About|Company")), lambda x: F.trim(F.regexp_replace(x, r"(?i)About Us|About|Company", "")))
    from_head = F.get(F.filter(heads, lambda x: F.length(x).between(1, 49)), F.lit(0))
    name = F.coalesce(from_head, F.when(short, blank_to_null(from_title)), first)
    kind = S.type_by_first_keyword("html", "url", None, lexicon) if lexicon else S.type_by_first_keyword("html", "url")
    return pages.select(*keep, name.alias("name"), kind.alias("org_type"), F.lit(0.7).alias("confidence_score"), F.lit(7.0).alias("relevance_score"))


def website_text(pages: DataFrame, key: str = "organization_id", page: str = "id", html: str = "html_content") -> DataFrame:
    """Text of each site as rows (key, page, text). Scoring counts over the rows, so no site's text is ever joined
    into one value and none is cut."""
    return pages.select(key, page, html_to_text(html).alias("text")).filter(nonblank("text"))


def website_digest(rows: DataFrame, key: str = "organization_id", page: str = "id") -> DataFrame:
    """(key, pages, characters, digest) over all pages of a site; it changes with any text and with the page a text is on."""
    part = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(page).cast("string"), "text")), 1, 10), 16, 10).cast("long")
    return rows.groupBy(key).agg(F.count("*").alias("pages"), F.sum(F.length("text")).cast("long").alias("characters"), F.sum(part).alias("digest"))


def evidence_from_results(results: DataFrame, pages: DataFrame, suffixes: Sequence[str] | None = None, competitor: Sequence = (), **lexicons) -> DataFrame:
    """Search hits joined to stored pages: first per registered domain, priority, category and state of the query,
    infrastructure evidence and competitor analysis, ready for the organization upsert."""
    from rosterlake.operators.selection import first_per_domain, result_priority
    hits = first_per_domain(results, registered_domain("url", suffixes) if suffixes else registered_domain("url")).withColumn(
        "priority", result_priority(F.col("domain"), "title", "snippet")).withColumn(
        "category", F.coalesce(blank_to_null("category"), blank_to_null(S.category_in_query("query")))).withColumn(
        "state", F.coalesce("state", blank_to_null(S.state_in_query("query"))))
    j = hits.join(pages.select("url", F.col("text").alias("page_text")), "url")
    j = S.infrastructure_evidence(j, "page_text", "category", **lexicons)
    return S.competitor_analysis(j, "page_text", *competitor)


# ---- outgoing mail --------------------------------------------------------------------------

def outgoing_links(parsed_mails: DataFrame, keys: Sequence[str] = ("contact_id", "email_id")) -> DataFrame:
    """Link rows of each mail: position, type, id. First link header, last footer, or by the element around it."""
    from rosterlake.functions.content import link_type
    els = F.col("elements")
    anchors = F.filter(els, lambda e: (e["tag"] == "a") & e["href"].isNotNull())
    q = parsed_mails.select(*keys, F.size(anchors).alias("_n"), F.posexplode(F.transform(anchors, lambda a: F.struct(
        a["href"].alias("href"), H.text_of(a).alias("text"), F.get(els, a["parent"])["tag"].alias("around")))).alias("pos", "l"))
    q = q.filter(~F.col("l.href").rlike("^(mailto:|tel:|#|javascript:)"))
    place = first_case([((F.col("l.around") == "header") | (F.col("pos") == 0), "header"),
                        ((F.col("l.around") == "footer") | (F.col("pos") == F.col("_n") - 1), "footer")], "body")
    return q.select(*keys, "pos", F.col("l.href").alias("original_url"), F.col("l.text").alias("link_text"), place.alias("link_position"),
                    link_type("l.href", "l.text").alias("link_type"), short_id(*keys, "pos").alias("short_id"))


def tracked_body(base: str, keys: Sequence[str] = ("contact_id", "email_id"), body: str = "body") -> Column:
    """Mail body with every web link replaced by its tracking address and the pixel before `</body>`; same ids as
    :func:`outgoing_links`. Pure column expression: the body is cut before each link and put together again."""
    parts = F.split(F.concat(F.lit("\u0001"), F.col(body)), r"(?i)(?=<a\s[^>]*href)")

    def swap(p: Column, i: Column) -> Column:
        href = F.regexp_extract(p, r'(?is)^<a\s[^>]*href=["\']([^"\']*)["\']', 1)
        skip = (i == 0) | (href == "") | href.rlike("^(mailto:|tel:|#|javascript:)")
        to = tracking_url(base, short_id(*keys, (i - 1)))
        return F.when(skip, p).otherwise(F.concat(F.regexp_extract(p, r'(?is)^(<a\s[^>]*href=["\'])', 1), to,
                                                  F.substr(p, F.length(F.regexp_extract(p, r'(?is)^(<a\s[^>]*href=["\'])', 1)) + F.length(href) + 1)))

    joined = F.substr(F.array_join(F.transform(parts, swap), ""), F.lit(2))
    pixel = F.concat(F.lit(f'<img src="{base.rstrip("/")}/track/open/'), F.col(keys[1]), F.lit('" width="1" height="1" alt="" style="display:none;">'))
    at = F.instr(F.lower(joined), F.lit("</body>"))
    with_pixel = F.when(at > 0, F.concat(F.substr(joined, F.lit(1), at - 1), pixel, F.substr(joined, at))).otherwise(F.concat(joined, pixel))
    return F.when(F.col(keys[1]).isNotNull(), with_pixel).otherwise(joined)
