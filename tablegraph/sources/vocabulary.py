"""Vocabularies read from tables: one entity per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegraph.functions.text import py_strip, split_synonyms
from tablegraph.operators.positions import global_positions

# Accepted column names, compared without case, in order of preference.
URI_NAMES = ["uri", "iri", "id", "identifier", "term_id", "concept_id"]
LABEL_NAMES = [
    "label", "term", "name", "prefLabel", "preferred_label", "preferredlabel", "title",
]
DESCRIPTION_NAMES = ["description", "definition", "comment", "notes", "note"]
SYNONYM_NAMES = ["synonym", "synonyms", "altLabel", "aliases", "alias"]


def choose_column(columns: list[str], names: list[str]) -> str | None:
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[n.lower()] for n in names if n.lower() in by_lower), None)


def vocabulary_entities(
    df: DataFrame, resource: str, order_by: list[str] | None = None
) -> DataFrame:
    """``uri, label, description, synonyms`` from a table with recognisable column names.

    Without a uri column each row gets ``urn:local:<resource>#<row>``, rows counted from 0 in
    the order given by ``order_by`` (all columns when not named).
    """
    label = choose_column(df.columns, LABEL_NAMES)
    if label is None:
        raise ValueError(f"no label column; expected one of {sorted(LABEL_NAMES)}")
    uri = choose_column(df.columns, URI_NAMES)
    description = choose_column(df.columns, DESCRIPTION_NAMES)
    synonyms = choose_column(df.columns, SYNONYM_NAMES)

    def text(name: str | None):
        return py_strip(F.coalesce(F.col(f"`{name}`"), F.lit(""))) if name else F.lit("")

    if uri is None:
        df = global_positions(df, order_by or df.columns, "_row")
        uri_col = F.concat(F.lit(f"urn:local:{resource}#"), (F.col("_row") - 1).cast("string"))
    else:
        uri_col = text(uri)
    names = split_synonyms(F.col(f"`{synonyms}`")) if synonyms else F.array().cast("array<string>")
    return df.select(
        uri_col.alias("uri"),
        text(label).alias("label"),
        text(description).alias("description"),
        names.alias("synonyms"),
    ).filter(F.col("label") != "")


def read_vocabulary_table(spark: SparkSession, path: str, resource: str | None = None) -> DataFrame:
    from tablegraph.sources.tables import read_table

    name = resource or path.rstrip("/").rsplit("/", 1)[-1]
    return vocabulary_entities(read_table(spark, path), name)
