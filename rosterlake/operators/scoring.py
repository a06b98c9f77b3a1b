"""Lexicon scoring and classification as column expressions.

Every rule table is an argument with the fixed values as default, so the same operator runs on any lexicon.
A text is lowered once in its own projection; Spark keeps that projection apart because it is used many times.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake import lexicons as L
from rosterlake.functions import people as N
from rosterlake.functions.text import (any_word, blank_to_null, col, count_words, first_case, found_words, let, lookup,
                                       map_of, mark, marked, nonblank, strings)
from rosterlake.functions.urls import host_without_www

# ---- fixed values ---------------------------------------------------------------------------
FIELD_WEIGHTS = {"name": 5.0, "description": 2.0, "website_text": 1.0}
DEFAULT_CATEGORY = "engineering"
QUERY_CATEGORY_WORDS = {
    "water": ["water", "wastewater", "utility", "utilities"], "engineering": ["engineer", "engineering", "design"],
    "government": ["government", "agency", "department"], "municipal": ["city", "town", "county", "municipal"],
    "utility": ["utility", "utilities", "power", "electric"], "transportation": ["transport", "transit", "traffic"],
    "oil_gas": ["oil", "gas", "petroleum", "pipeline"], "agriculture": ["agriculture", "farm", "irrigation"],
}
DOMAIN_CLUES = [("water", ["water", "wtp", "wwtp", "utility"]), ("engineering", ["eng", "engineer", "design"]),
                ("government", ["gov", "city", "town", "county"]), ("agriculture", ["ag", "farm", "irrigation"])]
ENGINEERING_SUBTYPES = ["civil", "electrical", "environmental", "mechanical"]
# per organization type: (score, role words); words in brackets must all occur; 7.0 marks roles merely accepted
TITLE_RULES = {
    "water": [(9.0, ["operations", "operator", "manager", "director"]), (7.0, ["engineer"])],
    "utility": [(9.0, ["operations", "operator"]), (8.5, ["engineer"]), (8.0, [["manager", "technical"], ["director", "technical"]]),
                (7.0, ["manager", "director", "president", "chief", "officer"])],
    "oil_gas": [(9.0, ["operations", "operator"]), (8.5, ["field", "production", "wellsite", "drilling", "well"]),
                (8.0, ["technical", "engineer", "pipeline"])],
    "transportation": [(9.0, ["operations", "operator", "traffic"]), (8.5, ["system", "its"]), (8.0, ["engineer"]),
                       (7.0, ["manager", "director"])],
    "agriculture": [(9.0, ["water", "irrigation"]), (8.5, ["operations", "operator"]), (8.0, ["manager", "director"]),
                    (7.0, ["board", "president"])],
    "municipal": [(9.0, ["public works", "utility", "utilities", "water"]), (7.0, ["engineer", "planner", "planning"])],
    "government": [(9.0, ["technical", "engineer", "director", "facilities", "infrastructure"]),
                   (7.0, ["operations", "operator"])],
}
TITLE_PREFIX_SYNONYMS = {
    "Director": ["Head of", "Chief", "Lead", "Senior"], "Manager": ["Lead", "Head", "Supervisor", "Coordinator"],
    "Engineer": ["Specialist", "Technician", "Analyst", "Technologist"],
    "Technician": ["Specialist", "Operator", "Technologist"],
}
TITLE_SUFFIX_SYNONYMS = {
    "Operations": ["Systems", "Facilities", "Plant", "Production"], "Manager": ["Supervisor", "Lead", "Coordinator"],
    "Engineer": ["Specialist", "Professional", "Officer"], "Director": ["Manager", "Supervisor", "Head", "Chief"],
}
LAST_WORD_SYNONYMS = {
    "Manager": ["Director", "Supervisor", "Lead", "Head"], "Director": ["Manager", "Supervisor", "Head", "Chief"],
    "Supervisor": ["Manager", "Coordinator", "Lead"], "Engineer": ["Specialist", "Technician", "Officer"],
    "Technician": ["Specialist", "Engineer", "Operator"],
}
GENERIC_NOTE = "Generic role-based contact (no specific individual identified)"
FOUND_NOTE = "Discovered using fallback discovery methods"
# ---- end of fixed values --------------------------------------------------------------------


def normalized(text: str | Column) -> Column:
    """Tokens joined by single spaces, with a space at both ends, so a word test is a substring test."""
    spaced = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"([^\p{L}\p{N}\s'-])", " $1 ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(spaced, r"\s+", " ")), F.lit(" "))


def _probe(keyword: str, boundary: bool = False) -> str:
    k = keyword.lower()
    return k if len(k.split()) > 1 and not boundary else f" {k} "


def category_scores(df: DataFrame, lexicon: dict[str, Sequence[str]] = L.CATEGORY_KEYWORDS,
                    weights: dict[str, float] = FIELD_WEIGHTS, boundary: bool = False) -> DataFrame:
    """Adds ``scores``: an array of (category, score) in lexicon order. One word = exact token, phrase = substring, with ``boundary``
    of whole tokens."""
    def hit(field: str):
        return lambda w: F.col(f"_n_{field}").contains(w)

    out = df
    for f in weights:
        out = out.withColumn(f"_n_{f}", normalized(f))
    entries = []
    for cat, words in lexicon.items():
        probes = strings([_probe(w, boundary) for w in words])
        # an array test per field, not one CASE per keyword: the generated method stays small enough to be compiled
        parts = [F.size(F.filter(probes, hit(f))) * F.lit(float(p)) for f, p in weights.items()]
        entries.append(F.struct(F.lit(cat).alias("category"), reduce(lambda a, b: a + b, parts).alias("score")))
    return out.withColumn("scores", F.array(*entries)).drop(*[f"_n_{f}" for f in weights])


def website_category_scores(pages: DataFrame, key: str, text: str, lexicon: dict[str, Sequence[str]] = L.CATEGORY_KEYWORDS,
                            weight: float = 1.0) -> DataFrame:
    """(key, category, score) over all pages of a site, each keyword counted once per site.

    The site's text is never put together: pages report their keywords and distinct keywords are counted, so one site
    may hold any share of the pages.
    """
    lex = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(w.lower()).alias("keyword"),
                             F.lit(_probe(w)).alias("probe"))
                    for c, ws in lexicon.items() for w in ws])
    p = pages.select(key, normalized(text).alias("_n"))
    hits = p.select(key, F.explode(F.filter(lex, lambda r: F.col("_n").contains(r["probe"]))).alias("h"))
    distinct = hits.select(key, "h.category", "h.keyword").distinct()
    return distinct.groupBy(key, "category").agg((F.count("*") * F.lit(float(weight))).alias("score"))


def best_category(scores: str | Column, default: str = DEFAULT_CATEGORY) -> Column:
    """Struct(category, confidence): largest score, the earlier category among equals; nothing found -> 0.3."""
    s = col(scores)
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x["score"])
    ranked = F.transform(s, lambda x, i: F.struct(x["score"].alias("score"), (-i).alias("r"), x["category"].alias("category")))
    top = F.array_max(ranked)
    return F.when(total == 0, F.struct(F.lit(default).alias("category"), F.lit(0.3).alias("confidence"))).otherwise(
        F.struct(top["category"].alias("category"), F.least(top["score"] / total, F.lit(1.0)).alias("confidence")))


def known_category(category: str | Column, known: Sequence[str], default: str = DEFAULT_CATEGORY) -> Column:
    return F.when(col(category).isin(list(known)), col(category)).otherwise(F.lit(default))


def organization_relevance(df: DataFrame, out: str = "relevance_score", competitors: Sequence[str] = L.EXCLUDED_COMPETITORS,
                           sectors: Sequence[str] = L.EXCLUDED_SECTORS, services: Sequence[str] = L.EXCLUSION_SERVICES,
                           base: dict[str, float] = L.TYPE_BASE_RELEVANCE, criteria: dict[str, Sequence[str]] = L.TYPE_CRITERIA,
                           general: Sequence[str] = L.GENERAL_KEYWORDS, compat: bool = False,
                           fields: Sequence[str] = ("name", "description", "website_text")) -> DataFrame:
    """0-1. Competitors, other sectors or two services of a competitor give 0. ``compat`` leaves upper-case general
    words out, which lower-cased text can never contain."""
    words = [w for w in general if not compat or w == w.lower()]
    q = df.withColumn("_t", F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])))
    t = F.col("_t")
    excluded = any_word(t, competitors) | any_word(t, sectors) | (count_words(t, services) >= 2)
    specific = first_case([(F.col("org_type") == k, count_words(t, v)) for k, v in criteria.items()], 0)
    score = (F.coalesce(lookup("org_type", base), F.lit(0.4)) + F.least(F.lit(0.4), F.lit(0.1) * specific)
             + F.least(F.lit(0.3), F.lit(0.05) * count_words(t, [w.lower() for w in words])))
    return q.withColumn(out, F.when(excluded, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.round(score, 6)))).drop("_t")


def data_quality(df: DataFrame, out: str = "data_quality_score") -> DataFrame:
    """Share of filled fields: essential (weight 1), important (0.5), helpful (0.25); absent columns count as blank."""
    def share(fields: Sequence[str]) -> Column:
        have = [f for f in fields if f in df.columns]
        return reduce(lambda a, b: a + b, [nonblank(f).cast("int") for f in have], F.lit(0)) / F.lit(float(len(fields)))
    total = (share(["name", "org_type", "state"]) + share(["website", "city", "description"]) * 0.5
             + share(["phone", "address", "zip_code", "county"]) * 0.25) / F.lit(1.75)
    return df.withColumn(out, F.round(F.least(F.lit(1.0), total), 6))


def title_fit(title: str | Column, org_type: str | Column, targets: dict[str, Sequence[str]] = L.TARGET_TITLES,
              industry: dict[str, Sequence[str]] = L.INDUSTRY_ROLE_WORDS, general: Sequence[str] = L.GENERAL_ROLE_WORDS) -> Column:
    """0.2 - 1.0; a blank title is contained in every target and so scores 0.8."""
    t = F.lower(F.coalesce(col(title), F.lit("")))
    out = F.lit(0.3)
    for kind, titles in targets.items():
        low = [x.lower() for x in titles]
        either = F.exists(strings(low), lambda x: t.contains(x) | x.contains(t))
        score = first_case([(t.isin(low), 1.0), (either, 0.8), (any_word(t, industry.get(kind, [])), 0.7),
                            (any_word(t, general), 0.5)], 0.2)
        out = F.when(col(org_type) == kind, score).otherwise(out)
    return out


def classify_contacts(contacts: DataFrame, orgs: DataFrame, assignments: DataFrame) -> DataFrame:
    """E-mail check, title fit for the organization's type, and the user in charge of that type."""
    from rosterlake.operators.merge import assign_by_type
    o = orgs.select(F.col("id").alias("organization_id"), F.col("org_type").alias("_type"))
    q = assign_by_type(contacts, orgs, assignments).join(o, "organization_id", "left")
    return (q.withColumn("email_valid", N.valid_email("email"))
            .withColumn("title_fit", title_fit("job_title", "_type")).drop("_type"))


def municipal_title_score(title: str | Column, weights: dict[str, int] = L.ROLE_WEIGHTS,
                          leadership: Sequence[str] = L.LEADERSHIP_WORDS) -> Column:
    t = F.lower(col(title))
    best = F.greatest(F.lit(5.0), *[F.when(t.contains(k), F.lit(float(v))) for k, v in weights.items()])
    score = F.least(F.lit(10.0), best + F.when(any_word(t, leadership), 1.0).otherwise(0.0))
    return F.when(F.coalesce(col(title), F.lit("")) == "", F.lit(5.0)).otherwise(score)


def title_department_score(title: str | Column, department: str | Column) -> Column:
    t = F.lower(F.coalesce(col(title), F.lit("")))
    d = F.lower(F.coalesce(col(department), F.lit("")))
    base = first_case([(any_word(t, ws), v) for v, ws in L.TITLE_CLASSES], 6.0)
    bonus = first_case([(any_word(d, ws), v) for v, ws in L.DEPARTMENT_BONUS], 0.0)
    extra = first_case([(any_word(t, ws), v) for v, ws in L.POSITION_BONUS], 0.0)
    return F.when((t == "") & (d == ""), F.lit(5.0)).otherwise(F.least(F.lit(10.0), base + bonus + extra))


def role_flags(title: str | Column) -> Column:
    t = F.lower(F.coalesce(col(title), F.lit("")))
    return F.struct(any_word(t, L.INFRASTRUCTURE_ROLE_WORDS).alias("is_infrastructure_role"),
                    any_word(t, L.DECISION_MAKER_WORDS).alias("is_decision_maker"),
                    any_word(t, L.TECHNICAL_ROLE_WORDS).alias("is_technical_role"))


def industry_indicators(text: str | Column, terms: dict[str, Sequence[str]] = L.INDUSTRY_TERMS, boundary: bool = False) -> Column:
    """Map industry -> share of its terms found, with ``boundary`` as whole words."""
    def shares(t: Column) -> Column:
        hits = [reduce(lambda a, b: a + b, [t.contains(mark(w) if boundary else w).cast("int") for w in ws]) for ws in terms.values()]
        return F.array(*[h / F.lit(float(len(ws))) for h, ws in zip(hits, terms.values())])
    low = F.lower(col(text))
    return F.map_from_arrays(strings(list(terms)), let(marked(low) if boundary else low, shares))


def infrastructure_evidence(df: DataFrame, text: str, industry: str, processes: dict[str, Sequence[str]] = L.PROCESS_KEYWORDS,
                            challenges: Sequence[str] = L.CHALLENGE_KEYWORDS, regulatory: Sequence[str] = L.REGULATORY_KEYWORDS,
                            sector_infra: dict[str, Sequence[str]] = L.SECTOR_INFRASTRUCTURE,
                            sector_proc: dict[str, Sequence[str]] = L.SECTOR_PROCESSES) -> DataFrame:
    """Lists of matches and a 0-10 score; other sectors' words count only below three matches of the own sector."""
    q = df.withColumn("_t", F.lower(F.coalesce(F.col(text), F.lit(""))))
    t, ind = F.col("_t"), F.col(industry)
    empty = F.array().cast("array<string>")

    def of(table: dict[str, Sequence[str]]) -> Column:
        return F.coalesce(map_of(table)[ind], empty)

    def hits(words: Column) -> Column:
        return F.filter(words, lambda w: t.contains(F.lower(w)))

    own = hits(of(processes))
    tagged = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, ws in processes.items() for w in ws])
    others = F.transform(F.filter(tagged, lambda x: ~x["k"].eqNullSafe(ind) & t.contains(F.lower(x["w"]))), lambda x: x["w"])
    q = q.withColumn("_own", own)
    wide = F.when(ind.isNull() | (F.size("_own") < 3), F.array_union("_own", others)).otherwise(F.col("_own"))
    q = (q.withColumn("infrastructure_matches", F.array_union(wide, hits(of(sector_infra))))
         .withColumn("process_matches", hits(of(sector_proc)))
         .withColumn("operational_challenges", found_words(t, challenges))
         .withColumn("regulatory_requirements", found_words(t, regulatory)))
    raw = (F.size("infrastructure_matches") + F.size("process_matches") + F.size("operational_challenges") * 1.5
           + F.size("regulatory_requirements"))
    return q.withColumn("infrastructure_score", F.least(F.lit(10.0), raw.cast("double"))).drop("_t", "_own")


def competitor_analysis(df: DataFrame, text: str, indicators: Sequence[str] = L.COMPETITOR_INDICATORS,
                        phrases: Sequence[str] = L.COMPETITOR_PHRASES) -> DataFrame:
    q = df.withColumn("_t", F.lower(F.coalesce(F.col(text), F.lit(""))))
    q = q.withColumn("competitor_indicators", found_words("_t", indicators))
    q = q.withColumn("competitor_score", F.least(F.lit(10.0), F.size("competitor_indicators") * F.lit(2.0)))
    return q.withColumn("is_likely_competitor", (F.col("competitor_score") >= 4) | any_word("_t", phrases)).drop("_t")


def type_multiplier(org_type: str | Column) -> Column:
    return F.coalesce(lookup(F.lower(col(org_type)), L.TYPE_MULTIPLIER), F.lit(0.7))


def client_rank(infra: str | Column, confidence: str | Column, org_type: str | Column, competitor: str | Column,
                competitor_score: str | Column) -> Column:
    raw = (F.coalesce(col(infra), F.lit(0.0)) * 0.6 + F.coalesce(col(confidence), F.lit(0.0)) * 10 * 0.4) * type_multiplier(org_type)
    penalty = F.when(col(competitor), F.least(F.lit(8.0), col(competitor_score) * 0.8)).otherwise(F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw - penalty)), 6)


EXTENDED = ("struct<infrastructure_indicators:struct<infrastructure_matches:array<string>,process_matches:array<string>>,"
            "competitor_analysis:struct<competitor_indicators:array<string>,is_likely_competitor:boolean>>")


def opportunity_rerank(orgs: DataFrame, urls: DataFrame) -> DataFrame:
    """Integration opportunity of every organization from its pages and stored evidence, and the blended relevance."""
    from rosterlake.operators.reports import page_evidence
    q = orgs.join(page_evidence(urls).withColumnRenamed("organization_id", "id"), "id", "left")
    q = q.withColumn("_x", F.from_json("extended_data", EXTENDED))

    def n(path: str) -> Column:
        return F.greatest(F.coalesce(F.size(path), F.lit(0)), F.lit(0))

    def z(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    infra = F.least(F.lit(1.0), z("infrastructure_pages") / F.greatest(z("pages"), F.lit(1))
                    + n("_x.infrastructure_indicators.infrastructure_matches") / F.lit(10.0))
    process = F.least(F.lit(1.0), n("_x.infrastructure_indicators.process_matches") / F.lit(8.0))
    automation = F.when(z("projects") > 0, F.least(F.lit(1.0), z("automation_projects") / z("projects"))).otherwise(F.lit(0.3))
    flag = F.coalesce(F.col("_x.competitor_analysis.is_likely_competitor"), F.col("is_competitor"), F.lit(False))
    q = (q.withColumn("infrastructure_score", infra).withColumn("process_complexity_score", process)
         .withColumn("automation_level", automation).withColumn("is_competitor", flag))
    penalty = F.when(F.col("is_competitor"), F.least(F.lit(0.9), n("_x.competitor_analysis.competitor_indicators") * 0.2)).otherwise(F.lit(0.0))
    opp = F.greatest(F.lit(0.0), F.col("infrastructure_score") * 0.4 + F.col("process_complexity_score") * 0.3
                     + (F.lit(1.0) - F.col("automation_level")) * 0.3 - penalty)
    q = q.withColumn("integration_opportunity_score", F.round(opp, 6))
    return q.withColumn("relevance_score", F.round(F.coalesce(F.col("relevance_score"), F.lit(0.0)) * 0.2
                                                   + F.col("integration_opportunity_score") * 0.8, 6)).drop(
        "_x", "pages", "infrastructure_pages", "projects", "automation_projects")


def cleanup_rescore(orgs: DataFrame, contacts: DataFrame, states: Sequence[str] = L.TARGET_STATES) -> DataFrame:
    """New relevance for rows that were not merged away, and whether it changed."""
    n = contacts.groupBy(F.col("organization_id").alias("id")).agg(F.count("*").alias("_n"))
    q = orgs.filter(F.col("relevance_score") >= 0).join(n, "id", "left")
    score = (F.lit(5.0) + F.when(F.col("state").isin(list(states)), 2.0).otherwise(0.0)
             + F.when(F.col("org_type") == "water", 1.0).otherwise(0.0)
             + F.least(F.lit(2.0), F.coalesce(F.col("_n"), F.lit(0)) * 0.5)
             + F.when(F.length("description") > 100, 1.0).otherwise(0.0))
    return q.withColumn("new_relevance", F.least(F.lit(10.0), score)).withColumn(
        "changed", F.col("new_relevance") != F.col("relevance_score")).drop("_n")


def relevance_floor(orgs: DataFrame, states: Sequence[str] = L.TARGET_STATES, floor: float = 8.0) -> DataFrame:
    ok = ~N.webpage_title("name") & F.col("state").isin(list(states))
    return orgs.withColumn("relevance_score", F.when(ok, F.greatest(F.col("relevance_score"), F.lit(floor))).otherwise(F.col("relevance_score")))


def contact_confidence(first: str, last: str, title: str, email: str, phone: str, method: str, email_confidence: str) -> Column:
    def plus(cond: Column, v: float) -> Column:
        return F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    s = (F.lit(0.5) + plus(nonblank(first) & nonblank(last), 0.1) + plus(nonblank(title), 0.1) + plus(nonblank(email), 0.15)
         + plus(nonblank(phone), 0.05) + plus(F.coalesce(F.col(method).contains("position_search"), F.lit(False)), 0.1))
    e = F.col(email_confidence)
    return F.round(F.least(F.lit(1.0), F.when(e.isNotNull(), (s + e) / 2).otherwise(s)), 6)


def type_by_keyword_count(text: str | Column, lexicon: dict[str, Sequence[str]] = L.CATEGORY_KEYWORDS, default: str = "water", boundary: bool = False) -> Column:
    """The first category among those with most keywords found, with ``boundary`` as whole words."""
    t = marked(F.lower(col(text))) if boundary else F.lower(col(text))
    counts = [(k, count_words(t, [mark(w.lower()) if boundary else w.lower() for w in ws])) for k, ws in lexicon.items()]
    top = F.greatest(*[c for _, c in counts], F.lit(0))
    return first_case([(top == 0, default), *[(c == top, k) for k, c in counts]], default)


def type_by_first_keyword(text: str | Column, url: str | Column, hint: Column | None = None,
                          lexicon: dict[str, Sequence[str]] = L.CATEGORY_KEYWORDS, default: str = "water") -> Column:
    """Hint, else first lexicon keyword found as whole words, else a clue in the host name."""
    t = col(text)
    edge = r"[^\p{L}\p{N}_]"
    pairs = [(t.rlike(rf"(?i)(?:^|{edge})(?:" + "|".join(ws) + rf")(?:$|{edge})"), k) for k, ws in lexicon.items()]
    dom = host_without_www(url)
    pairs += [(any_word(dom, ws), k) for k, ws in DOMAIN_CLUES]
    found = first_case(pairs, default)
    return found if hint is None else F.coalesce(F.when(hint != "unknown", hint), found)


def category_in_query(query: str | Column, words: dict[str, Sequence[str]] = QUERY_CATEGORY_WORDS) -> Column:
    q = F.lower(col(query))
    return first_case([(any_word(q, ws), k) for k, ws in words.items()], "")


def state_in_query(query: str | Column, states: Sequence[str] = L.TARGET_STATES) -> Column:
    q = F.lower(col(query))
    return first_case([(F.coalesce(q.contains(s.lower()), F.lit(False)), s) for s in states], "")


def engineering_subtype(name: str | Column, text: str | Column) -> Column:
    n, t = F.lower(F.coalesce(col(name), F.lit(""))), F.lower(F.coalesce(col(text), F.lit("")))
    return first_case([(n.contains(s), s) for s in ENGINEERING_SUBTYPES]
                      + [(t.contains(f"{s} engineering"), s) for s in ENGINEERING_SUBTYPES], "multidisciplinary")


def title_rule_score(title: str | Column, org_type: str | Column, rules: dict = TITLE_RULES,
                     targets: dict[str, Sequence[str]] = L.TARGET_TITLES) -> Column:
    """Score of a title for the organization's type; NULL = not a wanted title. A target title alone gives 7."""
    t = F.lower(F.coalesce(col(title), F.lit("")))

    def hit(rule: str | list[str]) -> Column:
        return reduce(lambda a, b: a & b, [t.contains(w) for w in ([rule] if isinstance(rule, str) else rule)])

    out = F.lit(None).cast("double")
    for kind, steps in rules.items():
        pairs = [(reduce(lambda a, b: a | b, [hit(w) for w in ws]), v) for v, ws in steps]
        pairs.append((any_word(t, [x.lower() for x in targets.get(kind, [])]), 7.0))
        out = F.when(col(org_type) == kind, first_case(pairs, None)).otherwise(out)
    return out


def role_profile(title: str | Column) -> Column:
    t = col(title)
    return F.struct(F.when(any_word(t, ["Manager", "Director"]), 8).otherwise(6).alias("relevance_score"),
                    F.when(any_word(t, ["Director", "VP"]), 8).otherwise(6).alias("decision_making_level"),
                    F.when(any_word(t, ["Engineer", "Technical"]), 9).otherwise(5).alias("technical_knowledge"))


def title_synonyms(title: str | Column) -> Column:
    """Variants by replacing a leading or trailing word, in rule order."""
    t = col(title)
    groups = [F.when(t.startswith(k), F.transform(strings(v), lambda a: F.concat(a, F.trim(F.substr(t, F.lit(len(k) + 1))))))
              .otherwise(F.array().cast("array<string>")) for k, v in TITLE_PREFIX_SYNONYMS.items()]
    groups += [F.when(t.endswith(k), F.transform(strings(v), lambda a: F.concat(F.trim(F.substr(t, F.lit(1), F.length(t) - len(k))), a)))
               .otherwise(F.array().cast("array<string>")) for k, v in TITLE_SUFFIX_SYNONYMS.items()]
    return F.concat(*groups)


def last_word_synonyms(title: str | Column, table: dict[str, Sequence[str]] = LAST_WORD_SYNONYMS) -> Column:
    w = F.split(col(title), r"\s+")
    head = F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), " ")
    alts = F.coalesce(map_of(table)[F.try_element_at(w, F.lit(-1))], F.array().cast("array<string>"))
    return F.when(F.size(w) > 1, F.transform(alts, lambda a: F.concat(head, F.lit(" "), a))).otherwise(F.array().cast("array<string>"))


def expanded_roles(roles: DataFrame, title: str, table: dict[str, Sequence[str]]) -> DataFrame:
    """Each role and every variant with one of its words replaced by a synonym, without repeats."""
    keys = [c for c in roles.columns if c != title]
    w = F.split(F.col(title), r"\s+")
    variant = F.flatten(F.transform(w, lambda x, i: F.transform(
        F.coalesce(map_of(table)[x], F.array().cast("array<string>")),
        lambda a: F.array_join(F.concat(F.slice(w, 1, i), F.array(a), F.slice(w, i + 2, F.size(w))), " "))))
    return roles.select(*keys, F.explode(F.array_union(F.array(title), variant)).alias(title)).distinct()


def mailbox_person(email: str | Column, website: str | Column, org_name: str | Column, org_type: str | Column) -> Column:
    """Contact type, person, title and relevance read from an address: role mailboxes get a stand-in person."""
    e = F.lower(col(email))
    box = F.substring_index(e, "@", 1)
    is_role = any_word(e, N.ROLE_MARKS)
    own = F.substring_index(e, "@", -1) == host_without_www(website)
    generic = is_role & F.coalesce(own, F.lit(False)) & e.rlike("^(" + "|".join(m[:-1] for m in N.GENERIC_MARKS) + ")@")

    def pick(i: int, director: Column, other: Column, plain: Column) -> Column:
        pairs = [(is_role & box.contains(r[0]), r[i]) for r in N.ROLE_MAILBOXES]
        return first_case([*pairs, (is_role & box.contains("director"), director), (is_role, other)], plain)

    parts = F.split(box, r"\.")
    kind = F.coalesce(blank_to_null(org_type), F.lit("Department"))
    return F.struct(
        F.when(generic, "generic").otherwise("actual").alias("contact_type"),
        pick(1, F.lit("Director"), F.initcap(box), F.initcap(parts[0])).alias("first_name"),
        pick(2, F.substring_index(F.coalesce(col(org_name), F.lit("")), " ", 1), F.lit("Office"),
             F.coalesce(F.initcap(F.get(parts, F.lit(1))), F.lit(""))).alias("last_name"),
        pick(3, F.concat(F.initcap(kind), F.lit(" Director")), F.concat(F.initcap(box), F.lit(" Contact")), F.lit("Staff Member")).alias("job_title"),
        pick(4, F.lit(7.5), F.lit(5.5), F.lit(5.0)).alias("relevance"))


def generic_caps(df: DataFrame) -> DataFrame:
    """Contacts without a person: confidence at most 0.5, their own method and a note."""
    g = F.coalesce(F.col("is_generic"), F.lit(False)) | ~(nonblank("first_name") & nonblank("last_name"))
    conf = F.coalesce(F.col("contact_confidence_score"), F.lit(0.6))
    return (df.withColumn("contact_confidence_score", F.when(g, F.least(conf, F.lit(0.5))).otherwise(conf))
            .withColumn("discovery_method", F.when(g, F.lit("generic_role_contact")).otherwise(F.coalesce(F.col("discovery_method"), F.lit("fallback_discovery"))))
            .withColumn("notes", F.coalesce(blank_to_null("notes"), F.when(g, F.lit(GENERIC_NOTE)).otherwise(F.lit(FOUND_NOTE)))))


def display_score(score: str | Column, scale: float = 1.0) -> Column:
    """Stored score shown as a whole number 0-10, cut off, 0 when unknown."""
    return F.coalesce((col(score) * (10.0 / scale)).cast("int"), F.lit(0))
