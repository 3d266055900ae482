"""Column functions on plain strings: cleaning, IRIs, tokens, names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablegraph.config import IRI_REPLACEMENTS

# White space as Python's str.strip sees it, Unicode spaces and separators.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = f"[{_BLANKS}]"
NOT_SPACE = f"[^{_BLANKS}]"
_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"


def py_strip(c: Column) -> Column:
    """Text without white space around it. A native trim: no regular expression per cell."""
    return F.btrim(c, F.lit(_BLANKS))


def safe_value(c: Column) -> Column:
    """Stripped text, null for missing or blank."""
    return F.nullif(py_strip(c.cast("string")), F.lit(""))


def norm(c: Column) -> Column:
    """Stripped, lower case, runs of white space as one blank."""
    return F.regexp_replace(F.lower(py_strip(c)), f"{SPACE}+", " ")


def tokenize(c: Column) -> Column:
    """Word tokens of at least three characters."""
    parts = F.split(norm(c), r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda t: F.length(t) >= 3)


def clean_for_iri(c: Column, replacements: dict[str, str] | None = None) -> Column:
    """Text that is safe as one IRI path part; null when nothing remains."""
    pairs = IRI_REPLACEMENTS if replacements is None else replacements
    text = reduce(
        lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), pairs.items(), py_strip(c)
    )
    text = F.regexp_replace(text, r"[^a-zA-Z0-9-]+", "_")
    text = F.regexp_replace(text, r"_+", "_")
    return F.nullif(F.regexp_replace(text, r"^_|_$", ""), F.lit(""))


def cleans_to_text(c: Column, replacements: dict[str, str] | None = None) -> Column:
    """Whether :func:`clean_for_iri` leaves anything: one cheap test, fit for a filter."""
    pairs = IRI_REPLACEMENTS if replacements is None else replacements
    useful = [k for k, v in pairs.items() if re.search(r"[a-zA-Z0-9-]", v)]
    pattern = "|".join(["[a-zA-Z0-9-]", *[r"\Q" + k + r"\E" for k in useful]])
    return F.coalesce(c.cast("string").rlike(pattern), F.lit(False))


def strip_angle(c: Column) -> Column:
    return F.regexp_replace(py_strip(c), r"^<+|>+$", "")


def is_absolute_iri(c: Column) -> Column:
    """Scheme and host both present; false for null."""
    return F.coalesce(c.rlike(_ABSOLUTE), F.lit(False))


def is_iri_like(c: Column) -> Column:
    """Looks like it could be an IRI: any text with a scheme, a path or a colon."""
    return F.coalesce(
        (F.length(c) > 0) & (~c.rlike(r"^(//[^/?#]*)?([?#].*)?$") | c.contains(":")), F.lit(False)
    )


def is_linkable_iri(c: Column) -> Column:
    """Web link fit for a spreadsheet cell: at most 255 characters, no blanks or controls."""
    t = py_strip(c)
    ok = (
        t.rlike(r"^https?://[^/?#]+")
        & (F.length(t) <= 255)
        & ~t.rlike(SPACE)
        & ~t.rlike(r"[\x00-\x1F\x7F]")
    )
    return F.coalesce(ok, F.lit(False))


def iri_label(c: Column) -> Column:
    """Fragment, else last path part, else host, else the text itself."""
    t = py_strip(c)
    fragment = F.regexp_extract(t, r"^[^#]*#(.+)$", 1)
    host = F.regexp_extract(t, r"://([^/?#]+)", 1)
    path = F.regexp_extract(t, r"://[^/?#]+([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), r"/+$", "")
    return F.when(
        is_absolute_iri(t),
        F.coalesce(
            F.nullif(fragment, F.lit("")),
            F.nullif(F.substring_index(path, "/", -1), F.lit("")),
            host,
        ),
    ).otherwise(t)


def local_name(c: Column) -> Column:
    return (
        F.when(c.contains("#"), F.substring_index(c, "#", -1))
        .when(c.contains("/"), F.substring_index(c, "/", -1))
        .otherwise(c)
    )


def namespace_of(c: Column) -> Column:
    """Up to the last ``#``, else up to the last ``/`` that has text behind it, else null."""
    hash_part = F.regexp_extract(c, r"(?s)^(.*#)", 1)
    slash_part = F.regexp_extract(c, r"(?s)^(.*/)[^/]+$", 1)
    return F.when(c.contains("#"), hash_part).otherwise(F.nullif(slash_part, F.lit("")))


def extract_iris(c: Column) -> Column:
    """All absolute web IRIs inside a text, in order."""
    pattern = f"""(https?://[^<>"'{_BLANKS}]+)"""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    return F.filter(found, is_absolute_iri)


def dataset_namespace(graph_iri: str) -> str:
    """``scheme://host/last-path-part/`` of a graph IRI (a driver-side setting)."""
    scheme, _, rest = graph_iri.partition("://")
    host, _, path = rest.partition("/")
    path = path.split("?")[0].split("#")[0]
    parts = [p for p in path.split("/") if p]
    return f"{scheme}://{host}/{parts[-1] if parts else 'default'}/"


def hashed_graph_iri(file_name: Column, run_time: str, base: str) -> Column:
    """Graph IRI from file name and an explicit run time, e.g. over ``_metadata.file_name``."""
    text = F.regexp_replace(F.concat(file_name, F.lit("-" + run_time)), r"[^a-zA-Z0-9_-]", "")
    return F.concat(F.lit(base.rstrip("/") + "/graph/da"), F.md5(text), F.lit("ta"))


def stable_graph_iri(file_name: Column, base: str) -> Column:
    """Graph IRI that depends on the file name without its extension only."""
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")
    root = base.removesuffix("/").removesuffix("/dataset").removesuffix("/")
    return F.concat(F.lit(root + "/dataset/da"), F.md5(stem), F.lit("ta"))


def subject_iri(id_col: Column, base: str, replacements: dict[str, str] | None = None) -> Column:
    """``base/clean(id)``; null when the id is missing or cleans to nothing."""
    return F.concat(F.lit(base.rstrip("/") + "/"), clean_for_iri(safe_value(id_col), replacements))


def entity_id(c: Column, letter: str = "", digits: int = 32) -> Column:
    """Hex digits of the md5, upper case, behind a type letter.

    All of them by default: at a million entities ten digits are likely to name two of them alike.
    """
    return F.concat(F.lit(letter), F.upper(F.substring(F.md5(c), 1, digits)))


def split_synonyms(c: Column) -> Column:
    parts = F.split(py_strip(c), f"{SPACE}*[|;,\t]{SPACE}*")
    return F.coalesce(
        F.filter(F.transform(parts, py_strip), lambda x: x != ""), F.array().cast("array<string>")
    )


def quote_plus(c: Column) -> Column:
    """Form encoding with blanks as ``+`` and ``~`` kept (``*`` escaped)."""
    return F.replace(
        F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def percent_encode(c: Column) -> Column:
    """Percent encoding of everything but unreserved characters."""
    return F.replace(quote_plus(c), F.lit("+"), F.lit("%20"))


def ui_link(template: Column, acronym: Column, iri: Column) -> Column:
    text = F.replace(template, F.lit("{acronym}"), acronym)
    text = F.replace(text, F.lit("{encoded_iri}"), quote_plus(iri))
    return F.replace(text, F.lit("{iri}"), iri)


def obo_acronym(iri: Column) -> Column:
    found = F.upper(F.regexp_extract(iri, r"/obo/([A-Za-z0-9]+)[_#/]", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("UNKNOWN"))


# Record page per database; {id} stands for the record.
REPOSITORY_PAGES = {
    "taxonomy": "https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id={id}",
    "bioproject": "https://www.ncbi.nlm.nih.gov/bioproject/{id}",
    "gene": "https://www.ncbi.nlm.nih.gov/gene/{id}",
    "protein": "https://www.ncbi.nlm.nih.gov/protein/{id}",
    "nuccore": "https://www.ncbi.nlm.nih.gov/nuccore/{id}",
    "biosample": "https://www.ncbi.nlm.nih.gov/biosample/{id}",
    "sra": "https://www.ncbi.nlm.nih.gov/sra?term={id}",
    "pubmed": "https://pubmed.ncbi.nlm.nih.gov/{id}/",
}


def repository_iri(db: Column, item: Column) -> Column:
    """Record page of a database entry; null when there is no id."""
    pages = F.create_map(*[F.lit(x) for kv in REPOSITORY_PAGES.items() for x in kv])
    generic = F.concat(F.lit("https://www.ncbi.nlm.nih.gov/"), db, F.lit("/{id}"))
    page = F.coalesce(F.try_element_at(pages, db), generic)
    return F.replace(page, F.lit("{id}"), F.nullif(item, F.lit("")))


def zero_padded_id(prefix: str, number: Column, total: Column) -> Column:
    width = F.length(total.cast("string"))
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(width, F.length(digits)), F.lit("0")))


def person_name(c: Column) -> Column:
    """``Last, First`` or ``First … Last`` to a struct of given and family name."""
    t = py_strip(c)
    words = F.split(t, f"{SPACE}+")
    inverted = F.struct(
        py_strip(F.regexp_extract(t, r"(?s)^[^,]*,(.*)$", 1)).alias("given"),
        py_strip(F.substring_index(t, ",", 1)).alias("family"),
    )
    straight = F.struct(
        F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ").alias("given"),
        F.element_at(words, -1).alias("family"),
    )
    return F.when(t.contains(","), inverted).otherwise(straight)


def person_names(c: Column) -> Column:
    """A ``;`` separated list of names, each parsed."""
    return F.transform(F.split(c, ";"), person_name)


def first_or_scalar(json_text: Column) -> Column:
    """First element of a JSON list, or the text itself when it is a plain string."""
    listed = F.get(F.from_json(json_text, "array<string>"), F.lit(0))
    unquoted = F.get_json_object(F.concat(F.lit('{"v":'), json_text, F.lit("}")), "$.v")
    return F.when(F.ltrim(json_text).startswith("["), listed).otherwise(
        F.coalesce(unquoted, json_text)
    )


def orcid_id(c: Column) -> Column:
    return F.replace(
        F.replace(c, F.lit("http://orcid.org/"), F.lit("")),
        F.lit("https://orcid.org/"),
        F.lit(""),
    )


def page_range(c: Column) -> Column:
    parts = F.split(c, "-")
    return F.struct(F.get(parts, F.lit(0)).alias("first"), F.get(parts, F.lit(1)).alias("last"))


def doi_iri(c: Column, encoded: bool = False) -> Column:
    return F.concat(F.lit("https://doi.org/"), percent_encode(c) if encoded else c)


def column_words(c: Column) -> Column:
    """Camel-case, digit and acronym words of a column name, lower case, longer than one."""
    words = F.regexp_extract_all(c, F.lit(r"([A-Z]?[a-z]+|\d+|[A-Z]+(?![a-z]))"), F.lit(1))
    return F.array_distinct(
        F.transform(F.filter(words, lambda w: F.length(w) > 1), lambda w: F.lower(w))
    )


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def rebuild_abstract(inverted: Column) -> Column:
    """Text from a word -> positions map; null for an empty or missing map."""
    placed = F.flatten(
        F.transform(
            F.map_entries(inverted),
            lambda e: F.transform(
                e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word"))
            ),
        )
    )
    words = F.transform(F.array_sort(placed), lambda x: x["word"])
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def hyperlink_cell(iri: Column, label: Column, target: Column | None = None) -> Column:
    """Spreadsheet link formula when IRI and target are linkable, else the plain label."""
    goal = iri if target is None else F.coalesce(target, iri)

    def quoted(x: Column) -> Column:
        return F.replace(x, F.lit('"'), F.lit('""'))

    formula = F.concat(
        F.lit('=HYPERLINK("'), quoted(goal), F.lit('", "'), quoted(label), F.lit('")')
    )
    linkable = is_linkable_iri(iri) & is_linkable_iri(goal) & (label != "")
    return F.when(linkable, formula).otherwise(label)
