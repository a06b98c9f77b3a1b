"""HTML, JSON and label columns that stay inside the JVM."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlake.functions.text import any_word, blank_to_null, col, first_case, lookup

# ---- fixed values ---------------------------------------------------------------------------
DROPPED_ELEMENTS = ["script", "style", "header", "footer", "nav"]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
ORG_TYPE_LABELS = {
    "engineering": "Engineering", "government": "Government", "municipal": "Municipal", "water": "Water & WW",
    "utility": "Utility", "transportation": "Transportation", "oil_gas": "Oil & Gas", "agriculture": "Agriculture",
}
STATUS_LABELS = {
    "new": "New", "email_draft": "Draft Created", "emailed": "Email Sent", "responded": "Responded",
    "meeting_scheduled": "Meeting Scheduled", "not_interested": "Not Interested", "invalid": "Invalid",
}
CONTACT_TYPE_LABELS = {"actual": "Actual", "generic": "Generated", "inferred": "Inferred"}
PROCESS_LABELS = {"org_building": "Organization Building", "contact_building": "Contact Building",
                  "email_sending": "Email Sending"}
# ---- end of fixed values --------------------------------------------------------------------


def html_to_text(html: str | Column) -> Column:
    """Visible text: no script, style, header, footer or nav; one space between pieces."""
    h = F.regexp_replace(col(html), r"(?s)<!--.*?-->", " ")
    for e in DROPPED_ELEMENTS:
        h = F.regexp_replace(h, rf"(?is)<{e}\b[^>]*>.*?</{e}\s*>", " ")
    h = F.regexp_replace(h, r"<[^>]*>", " ")
    for a, b in ENTITIES:
        h = F.replace(h, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(h, r"\s+", " "))


def tokens(text: str | Column) -> Column:
    """Lower-case tokens: every sign except letters, digits, apostrophe and hyphen stands alone."""
    spaced = F.regexp_replace(F.lower(col(text)), r"([^\p{L}\p{N}\s'-])", " $1 ")
    return F.filter(F.split(spaced, r"\s+"), lambda t: t != "")


def salvage_json(text: str | Column) -> Column:
    """The JSON list hidden in free text, as text: a block of objects, a fenced block, the widest [...], else all."""
    t = col(text)
    block = F.regexp_extract(t, r"(?s)(\[\s*\{.*\}\s*\])", 1)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\[.*\])```", 1)
    widest = F.regexp_extract(F.regexp_replace(t, r"(?s)```.*?```", ""), r"(?s)(\[.*\])", 1)
    return first_case([(block != "", block), (fenced != "", fenced), (widest != "", widest)], t)


def json_records(text: str | Column, schema: str = "array<map<string,string>>") -> Column:
    """Salvaged records; a lone object becomes a list of one, anything unreadable becomes NULL."""
    j = F.trim(salvage_json(text))
    return F.from_json(F.when(j.startswith("{"), F.concat(F.lit("["), j, F.lit("]"))).otherwise(j), schema)


def json_texts(c: str | Column, default: str) -> Column:
    """JSON list of texts joined for display; the default when it cannot be read."""
    return F.coalesce(F.array_join(F.from_json(col(c), "array<string>"), ", "), F.lit(default))


def label(c: str | Column, labels: dict[str, str]) -> Column:
    return F.coalesce(lookup(c, labels), col(c))


def process_label(c: str | Column) -> Column:
    return F.coalesce(lookup(c, PROCESS_LABELS), F.initcap(F.replace(col(c), F.lit("_"), F.lit(" "))))


def contact_type_label(c: str | Column) -> Column:
    return F.coalesce(label(c, CONTACT_TYPE_LABELS), F.lit("Unknown"))


def two_decimals(c: str | Column) -> Column:
    return F.when(col(c).isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f", col(c)))


def city_in_text(text: str | Column, state: str) -> Column:
    """Words before `, State`; shorter than 30 characters."""
    city = F.trim(F.regexp_extract(col(text), rf"(?i)([A-Za-z\s.]+),\s*{state}", 1))
    return F.when((city != "") & (F.length(city) < 30), city)


def link_type(url: str | Column, text: str | Column) -> Column:
    """Purpose of an outgoing link, by words in its address or text."""
    u, t = F.lower(col(url)), F.lower(F.coalesce(col(text), F.lit("")))

    def either(w: str) -> Column:
        return u.contains(w) | t.contains(w)

    return first_case([(either("contact"), "contact"), (either("download"), "download"), (either("demo"), "demo"),
                       (any_word(t, ["get started", "sign up"]), "cta")], "general")


def render_message(named: str | Column, nameless: str | Column, first: str | Column, values: dict[str, Column],
                   force_nameless: Column | None = None) -> Column:
    """Fill `{field}` marks of the named template, or of the nameless one when there is no first name."""
    has = blank_to_null(first).isNotNull()
    if force_nameless is not None:
        has = has & ~force_nameless
    text = F.when(has, col(named)).otherwise(col(nameless))
    for k, v in {"first_name": F.coalesce(col(first), F.lit("")), **values}.items():
        text = F.replace(text, F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))
    return text
