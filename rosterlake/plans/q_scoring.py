"""Lexicon scoring and classification. Stand-in lexicons are words that really occur in the given texts."""
from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake import lexicons as L
from rosterlake.functions import urls as U
from rosterlake.functions.text import mark, rows_of
from rosterlake.operators import scoring as S
from rosterlake.plans.registry import query, sql_list
from rosterlake.sources import lexicon as LX

LEX = {"water": ["the", "of the", "ention", "and"], "agriculture": ["de", "la", "que", "de la"], "healthcare": ["der", "und", "sch"],
       "emergency": ["los", "para", "zzz"]}


def plus(items: list[str]) -> str:
    return "(" + " + ".join(items or ["0"]) + ")"


def count_sql(t: str, words) -> str:
    return plus([f"CASE WHEN contains({t}, '{w.lower()}') THEN 1 ELSE 0 END" for w in words])


def any_sql(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


def norm_sql(c: str) -> str:
    return rf"' ' || trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '([^\p{{L}}\p{{N}}\s''-])', ' \1 ', 'g'), '\s+', ' ', 'g')) || ' '"


def probe(w: str) -> str:
    return w if " " in w else f" {w} "


def score_sql(words) -> str:
    return plus([f"CASE WHEN contains({f}, '{probe(w)}') THEN {p} ELSE 0 END" for f, p in (("a", 5), ("b", 2), ("c", 1)) for w in words]) + "::DOUBLE"


C1 = f"""(SELECT doc_id AS id, {', '.join(f"{score_sql(ws)} AS {k}" for k, ws in LEX.items())} FROM (SELECT doc_id, {norm_sql('split_part(text, chr(10), 1)')} AS a, {norm_sql('lang')} AS b, {norm_sql('text')} AS c FROM documents))"""


def texts(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("name"), F.col("lang").alias("description"),
                              F.col("text").alias("website_text"))


@query("c1_category_scores", "", " UNION ALL ".join(f"SELECT id, '{k}' AS category, {k} AS score FROM {C1}" for k in LEX))
def _(t):
    return S.category_scores(texts(t), LEX).select("id", rows_of("scores").alias("s")).select("id", "s.category", "s.score")


def whole(sql: str) -> str:
    """The SQL of a phrase test with whole tokens only."""
    for ws in LEX.values():
        for w in ws:
            sql = sql.replace(f"'{w}'", f"' {w} '")
    return sql


@query("c1_category_scores_whole_words", "", " UNION ALL ".join(f"SELECT id, '{k}' AS category, {k} AS score FROM {whole(C1)}" for k in LEX))
def _(t):
    return S.category_scores(texts(t), LEX, boundary=True).select("id", rows_of("scores").alias("s")).select("id", "s.category", "s.score")


@query("c1_website_category_scores", "", f"""
SELECT page_id % 20 AS site, category, count(DISTINCT w)::DOUBLE AS score FROM pages, ({' UNION ALL '.join(f"SELECT '{k}' AS category, '{w}' AS w, '{probe(w)}' AS p" for k, ws in LEX.items() for w in ws)}) l
WHERE contains({norm_sql('html')}, l.p) GROUP BY ALL""")
def _(t):
    return S.website_category_scores(t.pages.withColumn("site", F.expr("page_id % 20")), "site", "html", LEX)


@query("c2_best_category", "", f"""
SELECT id, CASE WHEN tot = 0 THEN 'engineering' WHEN water = m THEN 'water' WHEN agriculture = m THEN 'agriculture' WHEN healthcare = m THEN 'healthcare' ELSE 'emergency' END AS category,
 round(CASE WHEN tot = 0 THEN 0.3 ELSE m / tot END, 6) AS confidence FROM (SELECT *, water + agriculture + healthcare + emergency AS tot, greatest(water, agriculture, healthcare, emergency) AS m FROM {C1})""")
def _(t):
    q = S.category_scores(texts(t), LEX).select("id", S.best_category("scores").alias("b"))
    return q.select("id", "b.category", F.round("b.confidence", 6).alias("confidence"))


C3 = {"competitors": ["thand", "zscada"], "sectors": ["eaulle", "schund"], "services": ["ention", "onthat", "quela"],
      "criteria": {"water": ["the ", "and ", "there", "or", "ing"], "municipal": ["de ", "que"]}, "general": ["en", "is", "ou", "RT", "a b", "x"]}


@query("c3_organization_relevance", "organizations", f"""
SELECT id, CASE WHEN {any_sql('t', C3['competitors'])} OR {any_sql('t', C3['sectors'])} OR {count_sql('t', C3['services'])} >= 2 THEN 0 ELSE
 least(1.0, round(CASE org_type WHEN 'water' THEN 0.8 WHEN 'agriculture' THEN 0.7 WHEN 'engineering' THEN 0.6 WHEN 'municipal' THEN 0.6 WHEN 'transportation' THEN 0.5 ELSE 0.4 END::DOUBLE
 + least(0.4, 0.1::DOUBLE * CASE org_type WHEN 'water' THEN {count_sql('t', C3['criteria']['water'])} WHEN 'municipal' THEN {count_sql('t', C3['criteria']['municipal'])} ELSE 0 END)
 + least(0.3, 0.05::DOUBLE * {count_sql('t', C3['general'])}), 6)) END::DOUBLE AS relevance_score FROM (SELECT id, org_type, lower(coalesce(name, '') || ' ' || coalesce(description, '') || ' ' || coalesce(website, '')) AS t FROM organizations)""")
def _(t):
    o = t.organizations.withColumn("website_text", F.col("website"))
    return S.organization_relevance(o, **C3).select("id", "relevance_score")


@query("c4_data_quality", "organizations", """
SELECT id, round(((name <> '')::INT + (org_type <> '')::INT + coalesce(state <> '', false)::INT) / 3 / 1.75 + (coalesce(trim(website) <> '', false)::INT + coalesce(trim(description) <> '', false)::INT) / 3 * 0.5 / 1.75, 6)::DOUBLE AS data_quality_score FROM organizations""")
def _(t):
    return S.data_quality(t.organizations).select("id", "data_quality_score")


TG = {k: [x.lower() for x in v] for k, v in L.TARGET_TITLES.items()}


def fit_sql(kind: str) -> str:
    return (f"CASE WHEN t IN ({','.join(repr(x) for x in TG[kind])}) THEN 1.0 WHEN len(list_filter({sql_list(TG[kind])}, lambda x: contains(t, x) OR contains(x, t))) > 0 THEN 0.8 "
            f"WHEN {any_sql('t', L.INDUSTRY_ROLE_WORDS[kind])} THEN 0.7 WHEN {any_sql('t', L.GENERAL_ROLE_WORDS)} THEN 0.5 ELSE 0.2 END")


@query("c5_c6_classify_contacts", "contacts organizations assignments", rf"""
SELECT c.id, coalesce(regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}$'), false) AS email_valid, (CASE o.org_type WHEN 'water' THEN {fit_sql('water')} WHEN 'agriculture' THEN {fit_sql('agriculture')} ELSE 0.3 END)::DOUBLE AS title_fit, a.assigned_to
FROM (SELECT *, lower(coalesce(job_title, '')) AS t FROM contacts) c LEFT JOIN organizations o ON o.id = c.organization_id LEFT JOIN assignments a ON a.org_type = o.org_type""")
def _(t):
    return S.classify_contacts(t.contacts, t.organizations, t.assignments).select("id", "email_valid", "title_fit", "assigned_to")


TITLES = "lower(coalesce(job_title, '') || CASE WHEN id % 5 = 0 THEN ' of Water IT planning' ELSE '' END)"


@query("c7_municipal_title_score", "contacts", f"""
SELECT id, (CASE WHEN coalesce(job_title, '') = '' THEN 5 ELSE least(10, greatest(5, {', '.join(f"CASE WHEN contains(t, '{k}') THEN {v} ELSE 0 END" for k, v in L.ROLE_WEIGHTS.items())}) + CASE WHEN {any_sql('t', L.LEADERSHIP_WORDS)} THEN 1 ELSE 0 END) END)::DOUBLE AS score
FROM (SELECT id, job_title, lower(job_title) AS t FROM contacts)""")
def _(t):
    return t.contacts.select("id", S.municipal_title_score("job_title").alias("score"))


def ladder_sql(t: str, steps, default: float) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(t, ws)} THEN {v}" for v, ws in steps) + f" ELSE {default} END"


@query("c7b_title_department_score", "contacts organizations", f"""
SELECT id, (CASE WHEN t = '' AND d = '' THEN 5 ELSE least(10, {ladder_sql('t', L.TITLE_CLASSES, 6.0)} + {ladder_sql('d', L.DEPARTMENT_BONUS, 0.0)} + {ladder_sql('t', L.POSITION_BONUS, 0.0)}) END)::DOUBLE AS score
FROM (SELECT c.id, lower(coalesce(c.job_title, '')) AS t, lower(coalesce(o.org_type, '')) AS d FROM contacts c LEFT JOIN organizations o ON o.id = c.organization_id)""")
def _(t):
    o = t.organizations.select(F.col("id").alias("organization_id"), "org_type")
    return t.contacts.join(o, "organization_id", "left").select("id", S.title_department_score("job_title", "org_type").alias("score"))


@query("c8_role_flags", "contacts", f"""
SELECT id, {any_sql('t', L.INFRASTRUCTURE_ROLE_WORDS)} AS is_infrastructure_role, {any_sql('t', L.DECISION_MAKER_WORDS)} AS is_decision_maker, {any_sql('t', L.TECHNICAL_ROLE_WORDS)} AS is_technical_role
FROM (SELECT id, lower(coalesce(job_title, '')) AS t FROM contacts)""")
def _(t):
    return t.contacts.select("id", S.role_flags("job_title").alias("r")).select("id", "r.*")


@query("c9_industry_indicators", "", " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS industry, round({count_sql('t', ws)} / {len(ws)}, 6)::DOUBLE AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)" for k, ws in LEX.items()))
def _(t):
    return t.documents.select("doc_id", F.explode(S.industry_indicators("text", LEX)).alias("industry", "score")).withColumn("score", F.round("score", 6))


MARKED = r"regexp_replace(lower(text), '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(1), 'g')"


def count_whole_sql(words) -> str:
    return plus([f"CASE WHEN contains(t, '{mark(w.lower())}') THEN 1 ELSE 0 END" for w in words])


@query("c9_industry_indicators_whole_words", "", " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS industry, round({count_whole_sql(ws)} / {len(ws)}, 6)::DOUBLE AS score FROM (SELECT doc_id, {MARKED} AS t FROM documents)" for k, ws in LEX.items()))
def _(t):
    return t.documents.select("doc_id", F.explode(S.industry_indicators("text", LEX, boundary=True)).alias("industry", "score")).withColumn("score", F.round("score", 6))


PROC = {"en": ["the", "Ention", "whor"], "fr": ["eau", "Que", "de la"], "de": ["sch", "und", "nicht"], "es": ["los", "ción"]}
CH, REG = ["er the", "le ré", "ough"], ["ste", "para", "Nd the"]
SINF, SPRO = {"en": ["and", "the"], "fr": ["eaux"]}, {"en": ["tion", "ing"], "de": ["ein"]}


def list_sql(table: dict, key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in table.items()) + " ELSE []::VARCHAR[] END"


HIT = "lambda w: contains(t, lower(w))"
OTHERS = "list_distinct(" + " || ".join(f"(CASE WHEN lang = '{k}' THEN []::VARCHAR[] ELSE list_filter({sql_list(v)}, {HIT}) END)" for k, v in PROC.items()) + ")"


@query("c10_infrastructure_evidence", "", f"""
SELECT doc_id, len(infra)::INT AS n_infra, len(proc)::INT AS n_proc, len(ch)::INT AS n_ch, len(reg)::INT AS n_reg, least(10.0, len(infra) + len(proc) + 1.5 * len(ch) + len(reg))::DOUBLE AS score, array_to_string(ch, '|') AS challenges FROM (
 SELECT doc_id, list_distinct((CASE WHEN len(own) < 3 THEN own || {OTHERS} ELSE own END) || list_filter({list_sql(SINF, 'lang')}, {HIT})) AS infra, list_filter({list_sql(SPRO, 'lang')}, {HIT}) AS proc,
  list_filter({sql_list(CH)}, {HIT}) AS ch, list_filter({sql_list(REG)}, {HIT}) AS reg FROM (SELECT doc_id, lang, t, list_filter({list_sql(PROC, 'lang')}, {HIT}) AS own FROM (SELECT doc_id, lang, lower(text) AS t FROM documents)))""")
def _(t):
    q = S.infrastructure_evidence(t.documents, "text", "lang", PROC, CH, REG, SINF, SPRO)
    return q.select("doc_id", F.size("infrastructure_matches").alias("n_infra"), F.size("process_matches").alias("n_proc"),
                    F.size("operational_challenges").alias("n_ch"), F.size("regulatory_requirements").alias("n_reg"),
                    F.col("infrastructure_score").alias("score"), F.array_join("operational_challenges", "|").alias("challenges"))


RIV, RIVP = ["er the", "Ention", "le ré", "ough", "sch", "los"], ["whther", "eauxq"]


@query("c11_competitor_analysis", "", f"""
SELECT doc_id, least(10.0, 2.0 * n)::DOUBLE AS competitor_score, (least(10.0, 2.0 * n) >= 4 OR {any_sql('t', RIVP)}) AS is_likely_competitor FROM (SELECT doc_id, t, {count_sql('t', RIV)} AS n FROM (SELECT doc_id, lower(text) AS t FROM documents))""")
def _(t):
    return S.competitor_analysis(t.documents, "text", RIV, RIVP).select("doc_id", "competitor_score", "is_likely_competitor")


MULT = "CASE org_type WHEN 'water' THEN 1.0 WHEN 'agriculture' THEN 0.9 WHEN 'municipal' THEN 0.9 WHEN 'transportation' THEN 0.85 WHEN 'engineering' THEN 0.75 ELSE 0.7 END::DOUBLE"


@query("c12_c13_client_rank", "organizations", f"""
SELECT id, {MULT} AS multiplier, round(greatest(0, least(10, (relevance_score * 0.6 + confidence_score * 10 * 0.4) * {MULT} - CASE WHEN is_competitor THEN least(8, confidence_score * 10 * 0.8) ELSE 0 END)), 6) AS score FROM organizations""")
def _(t):
    return t.organizations.select("id", S.type_multiplier("org_type").alias("multiplier"), S.client_rank(
        "relevance_score", "confidence_score", "org_type", "is_competitor", F.col("confidence_score") * 10).alias("score"))


EXT = ("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 7 = 0 THEN 'not json' ELSE '{\"infrastructure_indicators\": {\"infrastructure_matches\": [\"a\", \"b\", \"c\"], \"process_matches\": [\"p\", \"q\"]}, "
       "\"competitor_analysis\": {\"competitor_indicators\": [\"x\", \"y\"]' || CASE WHEN id % 4 = 0 THEN ', \"is_likely_competitor\": true' ELSE '' END || '}}' END")
PROJ = "CASE id % 3 WHEN 0 THEN '[{\"title\": \"a\", \"contains_automation\": true}, {\"title\": \"b\", \"contains_automation\": false}]' WHEN 1 THEN 'bad json' END"


C14 = """
SELECT id, round(infra, 6)::DOUBLE AS infrastructure_score, automation::DOUBLE AS automation_level, comp AS is_competitor, round(opp, 6)::DOUBLE AS integration_opportunity_score, round(relevance_score * 0.2 + round(opp, 6) * 0.8, 6)::DOUBLE AS relevance_score FROM (
 SELECT *, greatest(0, infra * 0.4 + process * 0.3 + (1 - automation) * 0.3 - CASE WHEN comp THEN 0.4 * ok ELSE 0 END) AS opp FROM (
  SELECT o.id, relevance_score, ok, least(1, coalesce(ip, 0)::DOUBLE / greatest(coalesce(pages, 0), 1) + 0.3 * ok) AS infra, 0.25 * ok AS process, CASE WHEN coalesce(pr, 0) > 0 THEN ap::DOUBLE / pr ELSE 0.3 END AS automation,
   CASE WHEN ok = 1 AND o.id % 4 = 0 THEN true ELSE coalesce(is_competitor, false) END AS comp FROM (SELECT *, CASE WHEN id % 3 = 0 OR id % 7 = 0 THEN 0 ELSE 1 END AS ok FROM organizations) o
  LEFT JOIN (SELECT organization_id, count(*) AS pages, count(*) FILTER (contains_infrastructure) AS ip, sum(CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END) AS pr, sum(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) AS ap FROM discovered_urls GROUP BY 1) u ON u.organization_id = o.id))"""


def reranked(t):
    """Organizations with their opportunity score of C14."""
    o = t.organizations.withColumn("extended_data", F.expr(EXT))
    u = t.discovered_urls.withColumn("project_data", F.expr(PROJ))
    return S.opportunity_rerank(o, u)


@query("c14_opportunity_rerank", "organizations discovered_urls", C14)
def _(t):
    return reranked(t).select("id", F.round("infrastructure_score", 6).alias("infrastructure_score"), "automation_level",
                              "is_competitor", "integration_opportunity_score", "relevance_score")


@query("c15_cleanup_rescore", "organizations contacts", """
SELECT id, n AS new_relevance, n <> relevance_score AS changed FROM (SELECT o.id, relevance_score, least(10.0, 5 + CASE WHEN state IN ('NATION_1','NATION_2') THEN 2 ELSE 0 END + CASE WHEN org_type = 'water' THEN 1 ELSE 0 END
 + least(2.0, coalesce(c.n, 0) * 0.5) + CASE WHEN length(description) > 100 THEN 1 ELSE 0 END)::DOUBLE AS n FROM organizations o LEFT JOIN (SELECT organization_id, count(*) AS n FROM contacts GROUP BY 1) c ON c.organization_id = o.id WHERE relevance_score >= 0)""")
def _(t):
    return S.cleanup_rescore(t.organizations, t.contacts, ["NATION_1", "NATION_2"]).select("id", "new_relevance", "changed")


@query("c16_relevance_floor", "organizations", """
SELECT id, CASE WHEN state IN ('NATION_1','NATION_2') AND NOT contains(name, ' - ') AND NOT starts_with(name, 'How to') THEN greatest(relevance_score, 8.0) ELSE relevance_score END::DOUBLE AS relevance_score FROM organizations""")
def _(t):
    return S.relevance_floor(t.organizations, ["NATION_1", "NATION_2"]).select("id", "relevance_score")


@query("c17_contact_confidence", "contacts", """
SELECT id, round(least(1.0, CASE WHEN contact_confidence_score IS NOT NULL THEN (s + contact_confidence_score) / 2 ELSE s END), 6)::DOUBLE AS confidence FROM (SELECT *, 0.5 + CASE WHEN trim(first_name) <> '' AND trim(last_name) <> '' THEN 0.1 ELSE 0 END
 + CASE WHEN job_title <> '' THEN 0.1 ELSE 0 END + CASE WHEN trim(email) <> '' THEN 0.15 ELSE 0 END + CASE WHEN phone <> '' THEN 0.05 ELSE 0 END + CASE WHEN id % 3 = 1 THEN 0.1 ELSE 0 END AS s FROM contacts)""")
def _(t):
    c = t.contacts.withColumn("m", F.expr("CASE id % 3 WHEN 1 THEN 'position_search_Director' WHEN 2 THEN 'website' END"))
    return c.select("id", S.contact_confidence("first_name", "last_name", "job_title", "email", "phone", "m", "contact_confidence_score").alias("confidence"))


PAIR = ("SELECT o.id, CASE o.id % 5 WHEN 0 THEN 'https://www.bouldercity.gov/x' WHEN 1 THEN 'https://cityofspring.org' WHEN 2 THEN 'https://www.facebook.com/org' WHEN 3 THEN 'https://' || replace(lower(o.name), ' ', '') || '.com' ELSE o.website END AS url, "
        "CASE WHEN o.id % 5 = 0 THEN 'Boulder City' WHEN o.id % 5 = 1 THEN 'City of Spring' ELSE o.name END AS name, CASE o.id % 2 WHEN 0 THEN 'Nevada' ELSE o.state END AS state FROM {organizations} o")
W = "list_filter(string_split(lower(name), ' '), lambda w: w <> '')"
INI = f"array_to_string(list_transform({W}, lambda w: w[1]), '')"
CORE = f"array_to_string(list_transform(list_filter({W}, lambda w: w NOT IN ('city','town','of','county','village','township','department')), lambda w: w[1]), '')"
HOSTSQL = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)', 1))"


def pairs(t):
    return t.spark.sql(PAIR, organizations=t.organizations)


@query("c18_website_confidence", "organizations", rf"""
SELECT id, round(least(0.9, greatest(0, CASE WHEN regexp_matches(d, '\.(gov|org|us|edu)$') THEN 0.3 ELSE 0 END + CASE WHEN contains(cd, cn) THEN 0.4 WHEN len(list_filter(w, lambda x: length(x) > 3 AND contains(f, x))) > 0 THEN 0.2 ELSE 0 END
 + CASE WHEN contains(f, core) OR contains(f, core || lower(state[1:2])) THEN 0.3 ELSE 0 END + CASE WHEN contains(f, 'cityof') OR contains(f, 'townof') THEN 0.2 ELSE 0 END + CASE WHEN f LIKE '%city' OR f LIKE '%county' THEN 0.2 ELSE 0 END
 - CASE WHEN {any_sql('d', U.SOCIAL_SITES)} THEN 0.5 ELSE 0 END - CASE WHEN {any_sql('d', U.NEWS_SITES)} THEN 0.4 ELSE 0 END - CASE WHEN {any_sql('d', U.DIRECTORY_SITES)} THEN 0.4 ELSE 0 END)), 6)::DOUBLE AS confidence
FROM (SELECT *, split_part(d, '.', 1) AS f, regexp_replace(d, '[^a-z0-9]', '', 'g') AS cd, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS cn, {W} AS w, {CORE} AS core FROM (SELECT *, {HOSTSQL} AS d FROM ({PAIR.format(organizations='organizations')})))""")
def _(t):
    return pairs(t).select("id", U.website_confidence("url", "name", "state").alias("confidence"))


@query("c19_looks_official", "organizations", f"""
SELECT id, coalesce(url <> '', false) AND coalesce(NOT {any_sql('d', U.SOCIAL_SITES + U.NEWS_SITES + U.MORE_NEWS + U.DIRECTORY_SITES + U.MORE_DIRECTORIES)} AND (contains(cd, cn) OR (n >= 2 AND (contains(cd, ini)
 OR (n >= 3 AND w[1] IN ('city','town') AND w[2] = 'of' AND (contains(cd, 'cityof' || w[3]) OR contains(cd, w[3] || 'gov'))) OR (w[-1] IN ('city','county','town') AND contains(cd, w[1] || w[-1][1])) OR contains(cd, w[1][1] || w[2][1] || lower(state[1:2]))))), false) AS official
FROM (SELECT *, regexp_replace(d, '[^a-z0-9]', '', 'g') AS cd, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS cn, {W} AS w, len({W}) AS n, {INI} AS ini FROM (SELECT *, {HOSTSQL} AS d FROM ({PAIR.format(organizations='organizations')})))""")
def _(t):
    return pairs(t).select("id", U.looks_official("url", "name", "state").alias("official"))


@query("c20_municipal_domain", "organizations", rf"""
SELECT id, coalesce(regexp_matches(d, '\.(gov|org|us|edu)$') OR {any_sql('d', ['cityof', 'townof', 'countyof'])} OR contains(cd, cn) OR (CASE WHEN n >= 3 AND w[1] IN ('city','town','county') AND w[2] = 'of' THEN contains(cd, w[1][1] || w[2][1] || w[3][1]) OR contains(cd, w[3]) OR (length(w[3]) >= 3 AND contains(cd, w[3][1:3]))
 ELSE (n >= 2 AND contains(cd, ini)) OR contains(cd, w[1]) END), false) OR coalesce(state = 'Nevada' AND contains(d, 'nv'), false) AS municipal
FROM (SELECT *, regexp_replace(d, '[^a-z0-9]', '', 'g') AS cd, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS cn, {W} AS w, len({W}) AS n, {INI} AS ini FROM (SELECT *, regexp_replace({HOSTSQL}, '^www\.', '') AS d FROM ({PAIR.format(organizations='organizations')})))""")
def _(t):
    return pairs(t).select("id", U.municipal_domain(U.host("url"), "name", "state").alias("municipal"))


@query("c21_municipal_organization", "organizations", """
SELECT id, CASE WHEN org_type IN ('municipal','government','water','utility') THEN true WHEN coalesce(website, '') = '' THEN false WHEN contains(website, '.gov') OR contains(website, '.us') THEN true ELSE contains(lower(name), 'district') END AS municipal FROM organizations""")
def _(t):
    return t.organizations.select("id", U.municipal_organization("org_type", "website", "name").alias("municipal"))


@query("c22_type_by_keyword_count", "", f"""
SELECT doc_id, CASE WHEN m = 0 THEN 'water' {' '.join(f"WHEN {k} = m THEN '{k}'" for k in LEX)} END AS org_type FROM (SELECT *, greatest({', '.join(LEX)}) AS m FROM (SELECT doc_id, {', '.join(f"{count_sql('t', ws)} AS {k}" for k, ws in LEX.items())} FROM (SELECT doc_id, lower(text) AS t FROM documents)))""")
def _(t):
    return t.documents.select("doc_id", S.type_by_keyword_count("text", LEX).alias("org_type"))


@query("c22_type_by_whole_word_count", "", f"""
SELECT doc_id, CASE WHEN m = 0 THEN 'water' {' '.join(f"WHEN {k} = m THEN '{k}'" for k in LEX)} END AS org_type FROM (SELECT *, greatest({', '.join(LEX)}) AS m FROM (SELECT doc_id, {', '.join(f"{count_whole_sql(ws)} AS {k}" for k, ws in LEX.items())} FROM (SELECT doc_id, {MARKED} AS t FROM documents)))""")
def _(t):
    return t.documents.select("doc_id", S.type_by_keyword_count("text", LEX, boundary=True).alias("org_type"))


LEX23 = {"healthcare": ["reh", "eauou"], "emergency": ["nicht", "sch"], "agriculture": ["ofth"]}


@query("c23_type_by_first_keyword", "search_results", rf"""
SELECT pos, CASE {' '.join(rf"WHEN regexp_matches(snippet, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(ws)})(?:$|[^\p{{L}}\p{{N}}_])') THEN '{k}'" for k, ws in LEX23.items())} WHEN contains(url, '.gov/') THEN 'government' ELSE 'water' END AS org_type FROM search_results""")
def _(t):
    return t.search_results.select("pos", S.type_by_first_keyword("snippet", "url", None, LEX23).alias("org_type"))


@query("c24_query_category_and_state", "search_results", """
SELECT pos, CASE category WHEN 'water' THEN 'water' WHEN 'municipal' THEN 'municipal' ELSE 'agriculture' END AS category, coalesce(state, '') AS state FROM search_results""")
def _(t):
    q = t.search_results.withColumn("q", F.expr("CASE category WHEN 'water' THEN 'Water plants ' WHEN 'municipal' THEN 'Town halls ' ELSE 'Farm co-ops ' END || coalesce(upper(state), 'anywhere')"))
    return q.select("pos", S.category_in_query("q").alias("category"), S.state_in_query("q").alias("state"))


@query("c25_engineering_subtype", "", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'civil' WHEN contains(lower(text), 'the engineering') THEN 'x' WHEN doc_id % 4 = 1 THEN 'mechanical' ELSE 'multidisciplinary' END AS subtype FROM documents""".replace("WHEN contains(lower(text), 'the engineering') THEN 'x' ", ""))
def _(t):
    name = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Acme Civil' ELSE 'Acme' END")
    text = F.expr("text || CASE doc_id % 4 WHEN 1 THEN ' Mechanical Engineering' ELSE '' END")
    return t.documents.select("doc_id", S.engineering_subtype(name, text).alias("subtype"))


@query("c26_title_rule_score", "contacts organizations", """
SELECT c.id, (CASE o.org_type WHEN 'water' THEN CASE WHEN regexp_matches(t, 'operations|operator|manager|director') THEN 9 WHEN contains(t, 'engineer') THEN 7 END
 WHEN 'agriculture' THEN CASE WHEN regexp_matches(t, 'water|irrigation') THEN 9 WHEN regexp_matches(t, 'operations|operator') THEN 8.5 WHEN regexp_matches(t, 'manager|director') THEN 8 END
 WHEN 'transportation' THEN CASE WHEN regexp_matches(t, 'operations|operator|traffic') THEN 9 WHEN regexp_matches(t, 'system|its') THEN 8.5 WHEN contains(t, 'engineer') THEN 8 WHEN regexp_matches(t, 'manager|director') THEN 7 END
 WHEN 'municipal' THEN CASE WHEN regexp_matches(t, 'public works|utility|utilities|water') THEN 9 WHEN regexp_matches(t, 'engineer|planner|planning') THEN 7 END END)::DOUBLE AS score
FROM (SELECT *, lower(coalesce(job_title, '')) AS t FROM contacts) c JOIN organizations o ON o.id = c.organization_id""")
def _(t):
    o = t.organizations.select(F.col("id").alias("organization_id"), "org_type")
    return t.contacts.join(o, "organization_id").select("id", S.title_rule_score("job_title", "org_type").alias("score"))


@query("c27_role_profile", "contacts", """
SELECT id, CASE WHEN contains(job_title, 'Manager') OR contains(job_title, 'Director') THEN 8 ELSE 6 END::INT AS relevance_score, CASE WHEN contains(job_title, 'Director') OR contains(job_title, 'VP') THEN 8 ELSE 6 END::INT AS decision_making_level,
 CASE WHEN contains(job_title, 'Engineer') THEN 9 ELSE 5 END::INT AS technical_knowledge FROM contacts WHERE job_title IS NOT NULL""")
def _(t):
    return t.contacts.filter("job_title IS NOT NULL").select("id", S.role_profile("job_title").alias("p")).select("id", "p.*")


@query("c28_title_synonyms", "contacts", """
SELECT job_title, unnest(CASE job_title WHEN 'Operations Manager' THEN ['OperationsSupervisor','OperationsLead','OperationsCoordinator','Operations Director','Operations Supervisor','Operations Lead','Operations Head']
 WHEN 'Director of Public Works' THEN ['Head ofof Public Works','Chiefof Public Works','Leadof Public Works','Seniorof Public Works'] WHEN 'Process Engineer' THEN ['ProcessSpecialist','ProcessProfessional','ProcessOfficer','Process Specialist','Process Technician','Process Officer'] ELSE [] END) AS synonym
FROM (SELECT DISTINCT job_title FROM contacts WHERE job_title IS NOT NULL)""")
def _(t):
    q = t.contacts.filter("job_title IS NOT NULL").select("job_title").distinct()
    return q.select("job_title", F.explode(F.concat(S.title_synonyms("job_title"), S.last_word_synonyms("job_title"))).alias("synonym"))


@query("c28_expanded_roles", "contacts", """
SELECT o, unnest(CASE job_title WHEN 'Operations Manager' THEN ['Operations Manager','Operations Lead','Plant Manager'] WHEN 'Process Engineer' THEN ['Process Engineer','Process Analyst'] ELSE [job_title] END) AS job_title
FROM (SELECT DISTINCT organization_id AS o, job_title FROM contacts WHERE job_title IS NOT NULL)""")
def _(t):
    q = t.contacts.filter("job_title IS NOT NULL").select(F.col("organization_id").alias("o"), "job_title").distinct()
    return S.expanded_roles(q, "job_title", {"Operations": ["Plant"], "Manager": ["Lead"], "Engineer": ["Analyst"]})


@query("c29_s6_taxonomy_for_organizations", "organizations", "SELECT o.id, l.kind, l.value FROM organizations o JOIN (" + " UNION ALL ".join(
    f"SELECT '{k}' AS org_type, 'job_title' AS kind, unnest({sql_list(v)}) AS value" for k, v in L.TARGET_TITLES.items()) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{k}', 'keyword', unnest({sql_list(v)})" for k, v in L.CATEGORY_KEYWORDS.items()) + ") l ON l.org_type = o.org_type")
def _(t):
    tax = LX.taxonomy(t.spark, {"job_title": L.TARGET_TITLES, "keyword": L.CATEGORY_KEYWORDS})
    return t.organizations.join(tax, "org_type").select("id", "kind", "value")


MAILS = "SELECT c.id, CASE c.id % 7 WHEN 0 THEN 'info' WHEN 1 THEN 'contact' WHEN 2 THEN 'admin' WHEN 3 THEN 'operations' WHEN 4 THEN 'director' WHEN 5 THEN 'jane.doe' ELSE 'myinfo' END || '@' || CASE WHEN c.id % 2 = 0 THEN 'org' || CAST(o.id AS {s}) || '.gov' ELSE 'else.org' END AS email, o.website, o.name, o.org_type FROM {c} c JOIN {o} o ON o.id = c.organization_id"


@query("c31_mailbox_person", "contacts organizations", f"""
SELECT id, CASE WHEN id % 7 < 4 AND id % 2 = 0 AND website LIKE '%.gov' THEN 'generic' ELSE 'actual' END AS contact_type, CASE id % 7 WHEN 0 THEN 'Information' WHEN 1 THEN 'Contact' WHEN 2 THEN 'Administration' WHEN 3 THEN 'Operations' WHEN 4 THEN 'Director' WHEN 5 THEN 'Jane' ELSE 'Information' END AS first_name,
 CASE id % 7 WHEN 3 THEN 'Manager' WHEN 4 THEN split_part(name, ' ', 1) WHEN 5 THEN 'Doe' ELSE 'Office' END AS last_name, CASE id % 7 WHEN 1 THEN 'Customer Service' WHEN 2 THEN 'Administrative Director' WHEN 3 THEN 'Operations Manager' WHEN 4 THEN upper(org_type[1]) || org_type[2:] || ' Director' WHEN 5 THEN 'Staff Member' ELSE 'General Contact' END AS job_title,
 CASE id % 7 WHEN 2 THEN 6.5 WHEN 3 THEN 7.0 WHEN 4 THEN 7.5 WHEN 5 THEN 5.0 ELSE 6.0 END::DOUBLE AS relevance FROM ({MAILS.format(s='VARCHAR', c='contacts', o='organizations')})""")
def _(t):
    q = t.spark.sql(MAILS.format(s="STRING", c="{c}", o="{o}"), c=t.contacts, o=t.organizations)
    return q.select("id", S.mailbox_person("email", "website", "name", "org_type").alias("p")).select("id", "p.*")


@query("c32_generic_caps", "contacts", f"""
SELECT id, CASE WHEN g THEN least(conf, 0.5) ELSE conf END::DOUBLE AS contact_confidence_score, CASE WHEN g THEN 'generic_role_contact' ELSE 'fallback_discovery' END AS discovery_method, CASE WHEN g THEN '{S.GENERIC_NOTE}' ELSE '{S.FOUND_NOTE}' END AS notes
FROM (SELECT id, coalesce(contact_confidence_score, 0.6) AS conf, id % 10 = 3 OR NOT coalesce(trim(first_name) <> '' AND trim(last_name) <> '', false) AS g FROM contacts)""")
def _(t):
    c = t.contacts.withColumn("is_generic", F.expr("id % 10 = 3")).withColumn("discovery_method", F.lit(None).cast("string")).withColumn("notes", F.lit(""))
    return S.generic_caps(c).select("id", "contact_confidence_score", "discovery_method", "notes")


@query("c33_display_score", "organizations", "SELECT id, trunc(confidence_score * 10)::INT AS shown FROM organizations")
def _(t):
    return t.organizations.select("id", S.display_score("confidence_score").alias("shown"))
