"""URL and website columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.text import any_word, col, first_case, let, lookup, strings

# ---- fixed values ---------------------------------------------------------------------------
OFFICIAL_SUFFIXES = [".gov", ".org", ".us", ".edu"]
SOCIAL_SITES = ["facebook.com", "linkedin.com", "twitter.com", "instagram.com", "youtube.com"]
NEWS_SITES = ["news.", ".news.", "press.", "bloomberg.com", "reuters.com", "wsj.com"]
DIRECTORY_SITES = ["yellowpages", "yelp.com", "bbb.org", "glassdoor", "indeed"]
MORE_NEWS = ["article", "nytimes.com"]
MORE_DIRECTORIES = ["mapquest", "maps.google"]
NAME_FILLERS = ["city", "town", "of", "county", "village", "township", "department"]
WATER_NAME_FILLERS = ["water", "district", "authority", "treatment", "the", "of", "and"]
TARGET_STATE_CODES = {"arizona": "az", "utah": "ut", "illinois": "il", "missouri": "mo", "new mexico": "nm",
                      "nevada": "nv"}
STATE_CODES = {
    "Alabama": "al", "Alaska": "ak", "Arizona": "az", "Arkansas": "ar", "California": "ca", "Colorado": "co",
    "Connecticut": "ct", "Delaware": "de", "Florida": "fl", "Georgia": "ga", "Hawaii": "hi", "Idaho": "id",
    "Illinois": "il", "Indiana": "in", "Iowa": "ia", "Kansas": "ks", "Kentucky": "ky", "Louisiana": "la",
    "Maine": "me", "Maryland": "md", "Massachusetts": "ma", "Michigan": "mi", "Minnesota": "mn",
    "Mississippi": "ms", "Missouri": "mo", "Montana": "mt", "Nebraska": "ne", "Nevada": "nv",
    "New Hampshire": "nh", "New Jersey": "nj", "New Mexico": "nm", "New York": "ny", "North Carolina": "nc",
    "North Dakota": "nd", "Ohio": "oh", "Oklahoma": "ok", "Oregon": "or", "Pennsylvania": "pa",
    "Rhode Island": "ri", "South Carolina": "sc", "South Dakota": "sd", "Tennessee": "tn", "Texas": "tx",
    "Utah": "ut", "Vermont": "vt", "Virginia": "va", "Washington": "wa", "West Virginia": "wv",
    "Wisconsin": "wi", "Wyoming": "wy",
}
MUNICIPAL_TYPES = ["municipal", "government", "water", "utility"]
MUNICIPAL_NAME_TERMS = ["city of", "town of", "county of", "village of", "borough of", "municipality", "municipal",
                        "district"]
BLOCKED_RESULT_SITES = ["linkedin.com", "facebook.com", "twitter.com", "indeed.com", "glassdoor.com",
                        "ziprecruiter.com", "monster.com"]
BLOCKED_SNIPPET_SITES = ["linkedin.com", "indeed.com", "glassdoor.com", "monster.com", "ziprecruiter.com", "google.com",
                         "bing.com", "yahoo.com"]
# letters and digits that are hard to confuse
SHORT_ID_ALPHABET = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
# ---- end of fixed values --------------------------------------------------------------------

# two-part public suffixes used when none are supplied; callers pass their own list
COMMON_SUFFIXES = ["co.uk", "gov.uk", "org.uk", "nv.us", "ut.us", "az.us", "il.us", "mo.us", "nm.us"]


def normalize_url(url: str | Column) -> Column:
    """Trim, drop trailing slashes, add https:// when no http scheme is there."""
    u = F.regexp_replace(F.trim(col(url)), "/+$", "")
    return F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def host(url: str | Column) -> Column:
    """Network location in lower case; '' when there is none."""
    return F.lower(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def host_without_www(url: str | Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def site_root(url: str | Column) -> Column:
    return F.regexp_extract(col(url), r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)


SUFFIX_LABELS = 5  # a rule has no more labels


def with_registered_domain(df: DataFrame, rules: DataFrame, url: str = "url", out: str = "registered_domain") -> DataFrame:
    """Adds the registered domain by a table of public-suffix rules (column ``rule``): the suffix of the longest rule and one label more.

    A rule is a name (`co.uk`), a wildcard for exactly one label (`*.ck`) or an exception to a wildcard (`!www.ck`), which beats all
    others and whose suffix is the rule without its first label. Without a rule the suffix is the last label. The rules are joined to the
    distinct endings of distinct hosts, at most ``SUFFIX_LABELS`` each, by equality. A host that is itself a suffix, an address in
    digits and an empty host have no registered domain (NULL); rules are compared in lower case, a final dot of a host is ignored.
    """
    hosts = df.select(F.regexp_replace(host(url), r"(:\d*)?$", "").alias("_host")).distinct()
    labels = F.split(F.regexp_replace("_host", r"\.$", ""), r"\.")
    n = F.size(labels)
    ends = hosts.where(~F.col("_host").rlike(r"^$|^[\d.]+$|:")).select("_host", labels.alias("labels"), F.explode(F.sequence(F.lit(1), F.least(n, F.lit(SUFFIX_LABELS)))).alias("k"))
    ending = F.array_join(F.slice("labels", F.size("labels") - F.col("k") + 1, F.col("k")), ".")
    starred = F.concat(F.lit("*"), F.expr("substring(ending, instr(ending, '.'))"))
    ends = ends.withColumn("ending", ending).withColumn("forms", F.array(F.struct(F.lit(1).alias("rank"), F.col("ending").alias("rule")), F.struct(F.lit(0).alias("rank"), starred.alias("rule")),
                                                                                   F.struct(F.lit(2).alias("rank"), F.concat(F.lit("!"), "ending").alias("rule"))))
    ends = ends.select("_host", "labels", "k", F.inline("forms")).where("k > 1 OR rank <> 0")
    listed = rules.select(F.lower(F.trim("rule")).alias("rule")).distinct()
    # an exception beats every rule and gives one label away; otherwise the longest rule holds
    order = F.struct((F.col("rank") == 2).alias("exception"), F.col("k"))
    found = ends.join(listed, "rule").groupBy("_host").agg(F.max(order).alias("best"))
    size = F.when(F.col("best.exception"), F.col("best.k") - 1).otherwise(F.coalesce("best.k", F.lit(1))) + 1
    named = hosts.where(~F.col("_host").rlike(r"^$|^[\d.]+$|:")).join(found, "_host", "left").withColumn("labels", labels)
    named = named.select("_host", F.when(F.size("labels") >= size, F.array_join(F.slice("labels", F.size("labels") - size + 1, size), ".")).alias(out))
    return df.withColumn("_host", F.regexp_replace(host(url), r"(:\d*)?$", "")).join(named, "_host", "left").drop("_host")


def registered_domain(url: str | Column, suffixes: Sequence[str] = COMMON_SUFFIXES) -> Column:
    """Last two labels, or three when the last two form a listed public suffix."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    return F.when(two.isin(list(suffixes)), three).otherwise(two)


def repaired_url(url: str | Column) -> Column:
    """URL with a scheme if it lacked one; NULL when no host can be read even then."""
    u = F.trim(col(url))
    fixed = F.when(host(u) != "", u).otherwise(F.concat(F.lit("https://"), u))
    return F.when(host(fixed) != "", fixed)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def initials(ws: Column) -> Column:
    return F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")


def alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def website_confidence(url: str | Column, name: str | Column, state: str | Column | None = None) -> Column:
    """Heuristic 0-0.9 that a site belongs to the organization."""
    dom = host(url)
    first_label = F.split(dom, r"\.")[0]
    ws = words(col(name))
    core = initials(F.filter(ws, lambda w: ~w.isin(NAME_FILLERS)))
    abbr_hit = first_label.contains(core)
    if state is not None:
        st = col(state)
        abbr_hit = abbr_hit | F.coalesce(
            (st != "") & first_label.contains(F.concat(core, F.lower(F.substring(st, 1, 2)))), F.lit(False))
    part = F.exists(ws, lambda w: (F.length(w) > 3) & first_label.contains(w))
    official = F.lit(False)
    for s in OFFICIAL_SUFFIXES:
        official = official | dom.endswith(s)

    def points(cond: Column, value: float) -> Column:
        return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))

    total = (points(official, 0.3)
             + F.when(alnum(dom).contains(alnum(col(name))), F.lit(0.4)).otherwise(points(part, 0.2))
             + points(abbr_hit, 0.3)
             + points(first_label.contains("cityof") | first_label.contains("townof"), 0.2)
             + points(first_label.endswith("city") | first_label.endswith("county"), 0.2)
             - points(any_word(dom, SOCIAL_SITES), 0.5)
             - points(any_word(dom, NEWS_SITES), 0.4)
             - points(any_word(dom, DIRECTORY_SITES), 0.4))
    return F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.0), total)), 6)


def looks_official(url: str | Column, name: str | Column, state: str | Column | None = None) -> Column:
    """Name, initials or a city pattern in the host, and no social, news or directory site."""
    dom = host(url)
    d = alnum(dom)
    ws = words(col(name))
    n = F.size(ws)

    def w(i: int) -> Column:
        return F.get(ws, F.lit(i))

    last = F.try_element_at(ws, F.lit(-1))
    several = n >= 2
    hits = d.contains(alnum(col(name)))
    hits = hits | (several & d.contains(initials(ws)))
    place = w(2)
    hits = hits | ((n >= 3) & w(0).isin("city", "town") & (w(1) == "of")
                   & (d.contains(F.concat(F.lit("cityof"), place)) | d.contains(F.concat(place, F.lit("gov")))))
    hits = hits | (several & last.isin("city", "county", "town")
                   & d.contains(F.concat(w(0), F.substring(last, 1, 1))))
    if state is not None:
        st = col(state)
        hits = hits | (several & (st != "") & d.contains(
            F.concat(F.substring(w(0), 1, 1), F.substring(w(1), 1, 1), F.lower(F.substring(st, 1, 2)))))
    bad = any_word(dom, SOCIAL_SITES + NEWS_SITES + MORE_NEWS + DIRECTORY_SITES + MORE_DIRECTORIES)
    present = F.coalesce(col(url) != "", F.lit(False))
    return present & F.coalesce(hits, F.lit(False)) & ~bad


def municipal_domain(domain: str | Column, name: str | Column, state: str | Column) -> Column:
    """Official suffix, cityof-style host, name, abbreviation, first word or state code in the host."""
    dom = F.regexp_replace(F.lower(col(domain)), r"^www\.", "")
    d = alnum(dom)
    ws = words(col(name))
    n = F.size(ws)

    def w(i: int) -> Column:
        return F.get(ws, F.lit(i))

    hit = F.lit(False)
    for s in OFFICIAL_SUFFIXES:
        hit = hit | dom.endswith(s)
    hit = hit | any_word(dom, ["cityof", "townof", "countyof"])
    hit = hit | d.contains(alnum(col(name)))
    of_form = (n >= 3) & w(0).isin("city", "town", "county") & (w(1) == "of")
    place = w(2)
    of_hit = (d.contains(F.concat(F.substring(w(0), 1, 1), F.substring(w(1), 1, 1), F.substring(place, 1, 1)))
              | d.contains(place) | ((F.length(place) >= 3) & d.contains(F.substring(place, 1, 3))))
    plain_hit = ((n >= 2) & d.contains(initials(ws))) | ((n >= 1) & d.contains(w(0)))
    hit = hit | F.coalesce(F.when(of_form, of_hit).otherwise(plain_hit), F.lit(False))
    code = lookup(state, STATE_CODES)
    return F.coalesce(hit, F.lit(False)) | F.coalesce(dom.contains(code), F.lit(False))


def municipal_organization(org_type: str | Column, website: str | Column, name: str | Column) -> Column:
    """By type; by .gov/.us in the website; by a name term when there is a website."""
    site = F.coalesce(col(website), F.lit(""))
    return first_case([
        (F.coalesce(F.lower(col(org_type)).isin(MUNICIPAL_TYPES), F.lit(False)), True),
        (site == "", False),
        (site.contains(".gov") | site.contains(".us"), True),
    ], any_word(F.lower(col(name)), MUNICIPAL_NAME_TERMS))


def candidate_websites(name: str | Column, state: str | Column) -> Column:
    """Array of likely site addresses for a name, best guess first. Nothing is probed."""
    clean = F.regexp_replace(F.lower(col(name)), r"[^\p{L}\p{N}_\s]", "")
    ws = words(clean)
    n = F.size(ws)
    st = F.lower(F.coalesce(col(state), F.lit("")))
    code = F.coalesce(lookup(st, TARGET_STATE_CODES), F.when((st != "") & (F.length(st) <= 2), st))

    def w(i: int) -> Column:
        return F.get(ws, F.lit(i))

    def site(*parts: Column | str) -> Column:
        return F.concat(F.lit("https://www."), *[F.lit(p) if isinstance(p, str) else p for p in parts])

    def when_then(cond: Column, *sites: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.array(*sites)).otherwise(F.array().cast("array<string>"))

    of_form = (n >= 3) & w(0).isin("city", "town") & (w(1) == "of")
    kind, place, last = w(0), w(2), F.try_element_at(ws, F.lit(-1))
    main = F.get(F.filter(ws, lambda x: ~x.isin(WATER_NAME_FILLERS)), F.lit(0))
    water = clean.contains("water") & (clean.contains("district") | clean.contains("authority")) & main.isNotNull()
    a, b = w(0), w(1)
    acronym = initials(F.filter(ws, lambda x: F.length(x) > 1))
    groups = [
        when_then(of_form, site(kind, "of", place, ".gov"), site(kind, "of", place, ".org"), site(place, "-", kind, ".gov"),
                  site(place, kind, ".gov"), site(place, kind, ".org")),
        when_then(of_form & code.isNotNull(), site(place, ".", code, ".gov"), site(place, ".", code, ".us")),
        when_then(water, site(main, "water.org"), site(main, "water.com"), site(main, "wd.org"), site(main, "wd.com"),
                  site(main, "water.gov")),
        when_then(n == 1, site(a, ".org"), site(a, ".com"), site(a, ".gov")),
        when_then(n == 2, site(a, b, ".org"), site(a, "-", b, ".org"), site(a, b, ".com"), site(a, "-", b, ".com")),
        when_then((n == 2) & b.isin("city", "county", "town"), site(a, b, ".gov"), site(a, "-", b, ".gov")),
        when_then(n >= 3, site(a, last, ".org"), site(a, "-", last, ".org"), site(a, last, ".com"),
                  site(F.array_join(F.slice(ws, 1, 3), ""), ".org")),
        when_then((n >= 3) & (F.length(acronym) >= 2), site(acronym, ".org"), site(acronym, ".com"), site(acronym, ".gov")),
    ]
    return F.filter(F.concat(*groups), lambda x: x.isNotNull())


def first_snippet_site(snippet: str | Column, blocked: Sequence[str] = BLOCKED_SNIPPET_SITES) -> Column:
    found = F.regexp_extract_all(col(snippet), F.lit(r"https?://(?:www\.)?([a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+)"), 1)
    ok = F.filter(found, lambda u: ~F.exists(strings(blocked), lambda b: u.contains(b)))
    return F.concat(F.lit("https://"), F.get(ok, F.lit(0)))


def short_id(*parts: str | Column) -> Column:
    """12 easily read characters from a digest of the parts; the same link always gets the same id."""
    base = len(SHORT_ID_ALPHABET)

    def six(n: Column) -> Column:
        return F.concat(*[F.substring(F.lit(SHORT_ID_ALPHABET), (F.floor(n / F.lit(base ** k)) % base + 1).cast("int"), F.lit(1))
                          for k in range(6)])

    def halves(d: Column) -> Column:
        return F.concat(*[let(F.conv(F.substring(d, i, 12), 16, 10).cast("bigint"), six) for i in (1, 13)])

    return let(F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts])), halves)


def tracking_url(base: str, link_id: str | Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/track/click/"), col(link_id))
