"""Names, titles, mail addresses, phone numbers and user agents as columns."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlake.functions.text import any_word, blank_to_null, col, first_case

# ---- fixed values ---------------------------------------------------------------------------
EMAIL_SYNTAX = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
EMAIL_IN_TEXT = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAIL_LOOSE = r"[\w.-]+@[\w.-]+\.\w+"
PHONE_ANY = r"(?:\+\d{1,2}\s?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
PHONE_CARD = r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
PHONE_US = r"(?:\(\d{3}\)\s*\d{3}-\d{4}|\d{3}-\d{3}-\d{4})"
PHONE_PAREN = r"\(\d{3}\)\s*\d{3}-\d{4}"
WEBPAGE_PATTERNS = [
    r"^\d+ ",
    r" - .*?$",
    r"^[A-Z][a-z]+ [A-Z][a-z]+ \| ",
    r"^(Achieving|Understanding|How to|Why|What|When)",
    r"\b(vs|versus)\b",
    r"\d{1,2}/\d{1,2}/\d{2,4}",
    r"\[[^\]]+\]",
    r"\(\d{4}\)",
    r"^\w+ \d+, \d{4}",
    r"^\w+: .+",
    r"^The \d+ ",
    r" - YouTube$| - Wikipedia$| - LinkedIn$",
]
NAME_IN_RESULT_TITLE = r"([A-Z][a-z]+ [A-Z][a-z]+)(?:\s*-\s*|\s+at\s+|\s+from\s+|\s+with\s+)"
JOB_AFTER_NAME = r"(?:[-:]\s*)([A-Za-z\s,]+)(?:\s+at|$)"
NAME_THEN_ROLE = [
    r"([A-Z][a-z]+ [A-Z][a-z]+)(?:\s+is|\s+serves as|\s+has been|\s+was named|\s+was appointed)"
    r"(?:\s+the|\s+our|\s+as|\s+to)?(?:\s+new)?\s+([A-Za-z\s]+)",
    r"([A-Z][a-z]+ [A-Z][a-z]+),?\s+([A-Za-z\s]+)",
]
BROWSERS = [("Chrome", "Chrome"), ("Firefox", "Firefox"), ("Safari", "Safari"), ("Edge", "Edge"),
            ("MSIE", "Internet Explorer"), ("Trident", "Internet Explorer"), ("Opera", "Opera")]
SYSTEMS = [("Windows NT", "Windows"), ("Macintosh", "macOS"), ("Mac OS X", "macOS"), ("Linux", "Linux"),
           ("Android", "Android"), ("iPhone OS", "iOS"), ("iPad", "iOS")]
# role word in a mailbox -> first name, last name, job title, relevance
ROLE_MAILBOXES = [
    ("info", "Information", "Office", "General Contact", 6.0),
    ("contact", "Contact", "Office", "Customer Service", 6.0),
    ("admin", "Administration", "Office", "Administrative Director", 6.5),
    ("operations", "Operations", "Manager", "Operations Manager", 7.0),
]
ROLE_MARKS = ["info@", "contact@", "admin@", "operations@", "director@"]
GENERIC_MARKS = ["info@", "contact@", "admin@", "operations@"]
MAILBOX_TITLES = {
    "operations": "Operations Manager", "director": "Director", "manager": "Manager",
    "engineering": "Engineering Manager", "technical": "Technical Supervisor", "chief": "Chief Officer",
    "ceo": "Chief Executive Officer", "cto": "Chief Technical Officer", "coo": "Chief Operations Officer",
    "president": "President", "supervisor": "Supervisor", "water": "Water Department Manager",
    "facilities": "Facilities Manager", "maintenance": "Maintenance Manager", "plant": "Plant Manager",
    "systems": "Systems Manager", "info": "Information Services",
}
MAILBOX_ROLE_WORDS = ["operations", "director", "manager", "engineering", "technical", "chief", "ceo", "cto", "coo",
                      "president", "supervisor", "water", "facilities", "maintenance", "plant", "systems"]
DIRECTORY_MAILBOX_TITLES = [("director", "Director"), ("manager", "Manager"), ("admin", "Administrator"),
                            ("eng", "Engineer")]
# ---- end of fixed values --------------------------------------------------------------------

# an edge of a word in any script; Java's own \b knows ASCII only
WEBPAGE_TITLE = "|".join(re.sub(r"\\b$", r"(?:$|[^\\p{L}\\p{N}_])", re.sub(r"^\\b", r"(?:^|[^\\p{L}\\p{N}_])", x)) for x in WEBPAGE_PATTERNS)


def found(text: str | Column, pattern: str, group: int = 0) -> Column:
    """First match or NULL."""
    m = F.regexp_extract(col(text), pattern, group)
    return F.when(m != "", m)


def valid_email(c: str | Column) -> Column:
    return F.coalesce(col(c).rlike(EMAIL_SYNTAX), F.lit(False))


def first_email(text: str | Column, pattern: str = EMAIL_IN_TEXT) -> Column:
    return found(text, pattern)


def all_emails(text: str | Column, pattern: str = EMAIL_IN_TEXT) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(pattern), 0))


def first_phone(text: str | Column, pattern: str = PHONE_US) -> Column:
    return found(text, pattern)


def person_name(full: str | Column) -> Column:
    """Struct(first, last), NULL when no two-part name can be read."""
    clean = F.trim(F.regexp_replace(col(full), r"[^\p{L}\p{N}_\s'-]", ""))
    p = F.filter(F.split(clean, r"\s+"), lambda x: x != "")
    n = F.size(p)

    def pair(first: Column, last: Column) -> Column:
        return F.struct(first.alias("first"), last.alias("last"))

    def at(i: int) -> Column:
        return F.get(p, F.lit(i))

    return (F.when(clean.isNull() | (F.length(clean) < 3), None)
            .when(n == 2, pair(at(0), at(1)))
            .when((n == 3) & (F.length(at(1)) == 1), pair(at(0), at(2)))
            .when(n == 3, pair(at(0), F.concat_ws(" ", at(1), at(2))))
            .when(n > 3, pair(at(0), F.try_element_at(p, F.lit(-1)))))


def split_name(full: str | Column) -> Column:
    """First word and the rest."""
    p = F.split(F.trim(col(full)), " ", 2)
    return F.struct(p[0].alias("first"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("last"))


def name_from_email(email: str | Column) -> Column:
    """first.last@... -> Struct(First, Last); NULL without a dot."""
    p = F.split(F.substring_index(col(email), "@", 1), r"\.")
    return F.when(F.size(p) >= 2, F.struct(F.initcap(p[0]).alias("first"), F.initcap(F.get(p, F.lit(1))).alias("last")))


def webpage_title(name: str | Column) -> Column:
    """Does a name look like the title of a web page? Case-sensitive patterns, or more than ten words."""
    n = col(name)
    return n.rlike(WEBPAGE_TITLE) | (F.size(F.filter(F.split(n, r"\s+"), lambda w: w != "")) > 10)


def full_name(first: str | Column, last: str | Column, default: str = "Unknown") -> Column:
    both = F.concat_ws(" ", blank_to_null(first), blank_to_null(last))
    return F.when(both != "", both).otherwise(F.lit(default))


def title_to_organization(title: str | Column) -> Column:
    return F.substring_index(F.substring_index(col(title), " - ", 1), " | ", 1)


def device(agent: str | Column) -> Column:
    """Struct(device_type, browser, os); the first listed mark found decides."""
    a = col(agent)
    kind = first_case([(any_word(a, ["Mobile", "Android", "iPhone"]), "mobile"),
                       (any_word(a, ["iPad", "Tablet"]), "tablet")], "desktop")
    return F.struct(kind.alias("device_type"),
                    first_case([(F.coalesce(a.contains(k), F.lit(False)), v) for k, v in BROWSERS], "unknown").alias("browser"),
                    first_case([(F.coalesce(a.contains(k), F.lit(False)), v) for k, v in SYSTEMS], "unknown").alias("os"))


def person_in_search_result(title: str | Column, snippet: str | Column) -> Column:
    """Struct(first, last, position, email, phone) read from a hit; NULL when no name is found."""
    t, s = col(title), col(snippet)
    in_title = found(t, NAME_IN_RESULT_TITLE, 1)
    rest = F.substr(t, F.instr(t, in_title) + F.length(in_title))
    title_job = F.trim(F.regexp_extract(rest, JOB_AFTER_NAME, 1))
    a, b = found(s, NAME_THEN_ROLE[0], 1), found(s, NAME_THEN_ROLE[1], 1)
    name = F.coalesce(in_title, a, b)
    job = (F.when(in_title.isNotNull(), F.when(title_job != "", title_job))
           .when(a.isNotNull(), F.regexp_extract(s, NAME_THEN_ROLE[0], 2))
           .otherwise(F.regexp_extract(s, NAME_THEN_ROLE[1], 2)))
    p = F.split(name, " ", 2)
    return F.when(name.isNotNull(), F.struct(
        p[0].alias("first"), F.get(p, F.lit(1)).alias("last"), job.alias("position"),
        first_email(s).alias("email"), first_phone(s).alias("phone")))


def mailbox_title(email: str | Column) -> Column:
    """Job title for a role mailbox, `<Role> Manager` when the role is not listed, NULL when it is no role."""
    e = F.lower(col(email))
    role = found(e, "([a-z]+)@", 1)
    named = first_case([(role == k, v) for k, v in MAILBOX_TITLES.items()], F.concat(F.initcap(role), F.lit(" Manager")))
    return F.when(any_word(e, MAILBOX_ROLE_WORDS) & role.isNotNull(), named)


def directory_mailbox_title(email: str | Column) -> Column:
    e = F.lower(col(email))
    return first_case([(e.contains(k), v) for k, v in DIRECTORY_MAILBOX_TITLES], "Unknown Position")


def title_match_relevance(title: str, wanted: Column) -> Column:
    """8 for a person whose title is the one searched for, else 7."""
    return F.when(F.col(title) == wanted, 8.0).otherwise(7.0)
