"""Settings shared by the operators. Plain values, handled on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

# Markers read as missing cells in delimited files.
NA_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "-",
]

# Transliteration applied before a string becomes part of an IRI.
IRI_REPLACEMENTS = {
    "Ö": "Oe", "Ä": "Ae", "Ü": "Ue", "ö": "oe", "ä": "ae", "ü": "ue", "ß": "ss",
}

# Words that decide the literal datatype.
BOOLEAN_WORDS = ["true", "false", "ja", "nein", "yes", "no"]
TRUE_WORDS = ["true", "ja", "yes"]
YEAR_WORDS = ["jahr", "year"]

NO_MATCH = "No Match"
NO_MATCH_DISPLAY = "--- No Match ---"

# Column orders of the mapping tables.
MATCHING_COLUMNS = ["Term", "Source Column", "URI", "RDF Role", "Match Type"]
RECONCILED_COLUMNS = [
    "Term", "URI", "RDF Role", "Match Type", "Source Provider", "Confirmed Display String",
]
DOWNLOAD_COLUMNS = [
    "Term", "URI", "RDF Role", "Match Type", "Source Provider", "Provider Term",
    "Provider Description",
]
ENRICHED_COLUMNS = ["label", "ui_link", "acronym", "source", "message"]


@dataclass(frozen=True)
class Settings:
    """Everything that shapes a graph but is not data."""

    namespace: str = "https://example.org/"
    terms_graph: str = "https://example.org/voc/"
    replacements: dict[str, str] = field(default_factory=lambda: dict(IRI_REPLACEMENTS))
    boolean_words: list[str] = field(default_factory=lambda: list(BOOLEAN_WORDS))
    year_words: list[str] = field(default_factory=lambda: list(YEAR_WORDS))
    manual_prefixes: dict[str, list[str]] = field(
        default_factory=lambda: {"http://snomed.info/id/": ["snomed", "sct"]}
    )


@dataclass(frozen=True)
class Group:
    """Columns that hang off one node per row instead of off the row subject."""

    columns: list[str]
    connecting_predicate: str
    group_type: str | None = None


@dataclass(frozen=True)
class GraphSpec:
    """How the rows of one table become quads."""

    graph: str
    id_column: str
    subject_base: str | None = None
    subject_column: str | None = None
    class_iri: str | None = None
    groups: dict[str, Group] = field(default_factory=dict)
    templates: list[dict] = field(default_factory=list)
    active_template: str | None = None
    row_key: str | None = None
    column_order: bool = False
