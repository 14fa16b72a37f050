"""Text, title and e-mail functions as columns.

Everything stays in the JVM but two things Spark has no function for: Unicode
decomposition and character references.  Rows that need neither skip the Arrow
call's work: the native branch decides by a regular expression.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Title patterns, each list in the order in which it is tried.
EXCLUDED_TITLES = ["postdoc", "post-doctoral", "post doctoral", "graduate student", "student", "doctoral candidate", "staff", "administrator", "technician", "research scientist", "researcher", "lecturer", "instructor"]
AMBIGUOUS_TITLES = ["courtesy", "adjunct", "emeritus", "visiting", "research professor", "professor by courtesy"]
VERIFIED_TITLES = [("assistant professor", "assistant_professor"), ("associate professor", "associate_professor"), ("professor", "professor")]
# Query abbreviations, replaced one after the other.
QUERY_SYNONYMS = [("qm", "quantum materials"), ("cmb", "condensed matter"), ("astro", "astrophysics")]
# Words that say nothing about a person's field.
STOPWORDS = "about among assistant associate biology center centers current currently department departments engineering faculty focus focused focusing group includes including institute interests laboratory program programs professor research science sciences school studies study their university work works".split()
# Department names, the first that occurs decides.
DEPARTMENT_ALIASES = [
    ("physics", "physics"),
    ("applied physics", "applied_physics"),
    ("particle physics and astrophysics", "astronomy"),
    ("astronomy", "astronomy"),
    ("astrophysics", "astronomy"),
    ("astrophysical sciences", "astronomy"),
    ("materials science", "materials_science"),
    ("materials science and engineering", "materials_science"),
]

EMAIL = r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null gives ''."""
    return F.trim(F.regexp_replace(blank(text), r"(?U)\s+", " "))


def null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def normalize_email(text: Column) -> Column:
    """The first address in a text, in lower case, else null."""
    return null_if_empty(F.lower(F.regexp_extract(blank(text), EMAIL, 0)))


def _decompose(text: str | None) -> str | None:
    if text is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(_decompose)


#: For SQL: any text, decomposed.
unaccented = _decomposed


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without its combining marks."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_decomposed(F.when(~text.rlike(r"^[\x00-\x7F]*$"), text)))


def ascii_name(text: Column) -> Column:
    """Letters, digits, white space and hyphens of an unaccented text, lower case."""
    return F.lower(F.regexp_replace(text, r"[^A-Za-z0-9\s-]", ""))


def normalize_name(text: Column) -> Column:
    return ascii_name(strip_accents(normalize_whitespace(text)))


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def unescape_html(text: Column) -> Column:
    return F.when(~text.contains("&"), text).otherwise(_unescaped(F.when(text.contains("&"), text)))


def classify_title(title: Column) -> Column:
    """struct(normalized_title, status, reason) of a job title: the first pattern
    found in it decides, excluded ones before ambiguous before verified."""
    raw = F.lower(normalize_whitespace(title))
    decision = lambda kind, status, reason: F.struct(F.lit(kind).alias("normalized_title"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    out = F.when(raw == "", decision("ambiguous", "ambiguous", "missing_title"))
    for p in EXCLUDED_TITLES:
        out = out.when(raw.contains(p), decision("excluded", "excluded", p))
    for p in AMBIGUOUS_TITLES:
        out = out.when(raw.contains(p), decision("ambiguous", "ambiguous", p))
    for p, kind in VERIFIED_TITLES:
        out = out.when(raw.contains(p), decision(kind, "verified", p))
    return out.otherwise(decision("ambiguous", "ambiguous", "unrecognized_title"))


def normalize_department_type(value: Column) -> Column:
    raw = F.lower(normalize_whitespace(value))
    out = None
    for alias, kind in DEPARTMENT_ALIASES:
        out = F.when(raw.contains(alias), kind) if out is None else out.when(raw.contains(alias), kind)
    return out.otherwise(F.replace(raw, F.lit(" "), F.lit("_")))


def search_tokens(text: Column) -> Column:
    """Lower-case ASCII words, plurals cut: "ies" to "y" and a last "s" (not "ss")
    of words over four letters."""
    words = F.regexp_extract_all(F.lower(blank(text)), F.lit("[a-z0-9]+"), 0)
    long = lambda w: F.char_length(w) > 4
    return F.transform(
        words,
        lambda w: F.when(long(w) & w.endswith("ies"), F.concat(w.substr(F.lit(1), F.char_length(w) - 3), F.lit("y")))
        .when(long(w) & w.endswith("s") & ~w.endswith("ss"), w.substr(F.lit(1), F.char_length(w) - 1))
        .otherwise(w),
    )


def normalize_query(text: Column) -> Column:
    """Lower case with abbreviations spelt out.  Replacing goes by substring and
    one after the other, so "astrophysics" becomes "astrophysicsphysics"."""
    out = F.lower(normalize_whitespace(text))
    for short, spelt in QUERY_SYNONYMS:
        out = F.replace(out, F.lit(short), F.lit(spelt))
    return out


def title_key(title: Column) -> Column:
    """What titles that differ in markup, case and punctuation have in common."""
    plain = F.regexp_replace(unescape_html(blank(title)), "<[^>]+>", " ")
    return F.array_join(search_tokens(plain), " ")


def is_preprint(source_name: Column, doi: Column) -> Column:
    return F.lower(blank(source_name)).contains("arxiv") | F.lower(blank(doi)).contains("10.48550/arxiv")


def informative_terms(text: Column) -> Column:
    """Words of four letters or more with plurals cut, stop words left out."""
    words = F.regexp_extract_all(F.lower(blank(text)), F.lit("[a-z][a-z0-9-]{2,}"), 0)
    long = lambda w: F.char_length(w) > 5
    singular = F.transform(
        words,
        lambda w: F.when(w.endswith("ies") & long(w), F.concat(w.substr(F.lit(1), F.char_length(w) - 3), F.lit("y")))
        .when(w.endswith("s") & long(w), w.substr(F.lit(1), F.char_length(w) - 1))
        .otherwise(w),
    )
    return F.filter(singular, lambda w: (F.char_length(w) >= 4) & ~w.isin(STOPWORDS))


def truncate(text: Column, limit: int = 900) -> Column:
    """Trimmed; a longer text is cut at ``limit``, loses its last, perhaps partial
    word and ends in an ellipsis."""
    whole = F.regexp_replace(blank(text), r"(?U)^\s+|\s+$", "")
    cut = F.regexp_replace(F.substring(whole, 1, limit), r" [^ ]*$", "")
    return F.when(F.char_length(whole) <= limit, whole).otherwise(F.concat(cut, F.lit("…")))


def after_marker(haystack: Column, marker: str) -> Column:
    """What follows a marker up to the line's end, without quotes."""
    at = F.instr(haystack, marker)
    rest = F.substring_index(haystack.substr(at + len(marker), F.char_length(haystack)), "\n", 1)
    return F.when(at > 0, F.trim(F.regexp_replace(F.trim(rest), "^\"+|\"+$", ""))).otherwise("")


def host_allowed(url: Column, domains: Column) -> Column:
    """Whether a URL's host is one of the domains or below one of them."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.exists(domains, lambda d: (host == F.lower(d)) | host.endswith(F.concat(F.lit("."), F.lower(d)))), F.lit(False))
