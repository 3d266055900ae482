"""Matching tables: terms of a table, consolidation choices, reviewed decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegraph.config import (
    DOWNLOAD_COLUMNS,
    MATCHING_COLUMNS,
    NO_MATCH,
    NO_MATCH_DISPLAY,
    RECONCILED_COLUMNS,
)
from tablegraph.functions.text import py_strip
from tablegraph.functions.values import is_object_term
from tablegraph.operators.pages import Pages
from tablegraph.operators.profile import header_terms, native_kind
from tablegraph.operators.reshape import unpivot_rows


def distinct_terms(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct ``term, source_column`` over the given columns, object terms only.

    Columns with a native number, date or boolean type hold no object terms and are not read.
    Values are made distinct before the type tests, so each test runs once per value.
    """
    wanted = columns or df.columns
    kinds = {f.name: native_kind(f.dataType) for f in df.schema.fields}
    texts = [c for c in wanted if kinds[c] is None]
    if not texts:
        return df.sparkSession.createDataFrame([], "term string, source_column string")
    cells = unpivot_rows(df, [], texts)
    pairs = cells.groupBy(
        py_strip(F.col("value")).alias("term"), F.col("column").alias("source_column")
    ).agg(F.count(F.lit(1)).alias("_n"))
    # Tied to the count, so the optimizer cannot move the tests below the grouping.
    wanted = F.when(F.col("_n") > 0, is_object_term(F.col("term"), True))
    return pairs.filter(wanted).select("term", "source_column")


def drop_terms_equal_to_headers(terms: DataFrame, headers: list[str]) -> DataFrame:
    """Terms that equal no header, ignoring case; headers are bounded by the table's width."""
    lowered = sorted({h.lower() for h in headers})
    return terms.filter(~F.lower("term").isin(lowered)) if lowered else terms


def matching_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Header terms as predicates, then cell terms as objects, with their sort key ``_order``.

    ``columns`` limits the cells that count; headers always all count.
    """
    heads = header_terms(df.sparkSession, df.columns)
    names = [r["term"] for r in heads.collect()]  # bounded by the number of columns
    predicates = heads.select(
        F.col("term").alias("Term"),
        F.col("term").alias("Source Column"),
        F.lit("").alias("URI"),
        F.lit("predicate").alias("RDF Role"),
        F.lit("").alias("Match Type"),
        F.col("position").alias("_order"),
    )
    cells = drop_terms_equal_to_headers(distinct_terms(df, columns), names)
    objects = cells.select(
        F.col("term").alias("Term"),
        F.col("source_column").alias("Source Column"),
        F.lit("").alias("URI"),
        F.lit("object").alias("RDF Role"),
        F.lit("").alias("Match Type"),
        F.lit(len(df.columns)).alias("_order"),
    )
    return predicates.unionByName(objects)


def sort_matching_table(table: DataFrame) -> DataFrame:
    """Headers in column order, then terms by term and source column."""
    return table.orderBy("_order", "Term", "Source Column").select(*MATCHING_COLUMNS)


def unique_terms(table: DataFrame) -> DataFrame:
    return table.select("Term").distinct()


def apply_consolidation(table: DataFrame, groups: DataFrame, choices: DataFrame) -> DataFrame:
    """Replace members of a group by the chosen term, then drop duplicates.

    ``groups``: ``leader, member``. ``choices``: ``leader, choice`` with null to keep the group
    as it is; a group without a choice is replaced by its smallest member. Headers stay.
    """
    default = groups.groupBy("leader").agg(F.min("member").alias("_first"))
    picked = default.join(
        choices.select("leader", "choice", F.lit(True).alias("_listed")), "leader", "left"
    ).select(
        "leader", F.when(F.col("_listed"), F.col("choice")).otherwise(F.col("_first")).alias("new")
    )
    renames = groups.join(picked, "leader").select(
        F.col("member").alias("_old"), F.nullif(py_strip(F.col("new")), F.lit("")).alias("_new")
    )
    joined = table.join(
        renames, (table["Term"] == F.col("_old")) & (table["RDF Role"] == "object"), "left"
    )
    return joined.select(
        F.coalesce("_new", "Term").alias("Term"), *[c for c in table.columns if c != "Term"]
    ).distinct()


def apply_decisions(mapping: DataFrame, decisions: DataFrame, skos: bool = True) -> DataFrame:
    """Reviewed choices override the mapping rows with the same ``term_id``.

    ``decisions``: ``term_id, uri, source, display, label, description, match_type``; uri
    ``No Match`` clears the row, a null match type leaves the row's own.
    """
    d = decisions.select(
        F.col("term_id").alias("_id"), *[F.col(c).alias("_" + c) for c in (
            "uri", "source", "display", "label", "description", "match_type")]
    )
    joined = mapping.join(d, mapping["term_id"] == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    none = F.coalesce(F.col("_uri"), F.lit(NO_MATCH)) == NO_MATCH

    def pick(new: str, old: str, cleared: str):
        return (
            F.when(~hit, F.col(f"`{old}`"))
            .when(none, F.lit(cleared))
            .otherwise(F.coalesce(F.col(new), F.lit("")))
        )

    chosen = F.coalesce(F.col("_match_type"), F.col("`Match Type`"), F.lit(""))
    if skos:
        chosen = F.when(py_strip(chosen) == "", "skos:exactMatch").otherwise(chosen)
    new = {
        "URI": pick("_uri", "URI", NO_MATCH),
        "Source Provider": pick("_source", "Source Provider", ""),
        "Confirmed Display String": pick("_display", "Confirmed Display String", NO_MATCH_DISPLAY),
        "Provider Term": pick("_label", "Provider Term", ""),
        "Provider Description": pick("_description", "Provider Description", ""),
        "Match Type": F.when(~hit, F.col("`Match Type`")).when(none, "").otherwise(chosen),
    }
    return joined.select(
        *[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in mapping.columns]
    )


def unreconciled(mapping: DataFrame, skos: bool = False) -> DataFrame:
    """Rows without an IRI; with ``skos`` also rows without a match type."""
    uri = py_strip(F.coalesce(F.col("URI"), F.lit("")))
    missing = (uri == "") | (uri == NO_MATCH)
    if skos:
        missing = missing | (py_strip(F.coalesce(F.col("`Match Type`"), F.lit(""))) == "")
    return mapping.filter(missing)


def complete_missing_terms(mapping: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms the mapping lacks, appended as ``No Match`` rows; standard columns first."""
    known = mapping.select(F.col("Term").alias("_known")).distinct()
    missing = terms.select("Term").distinct()
    missing = missing.join(known, F.col("Term") == F.col("_known"), "left_anti")
    defaults = {
        "URI": NO_MATCH, "RDF Role": "predicate", "Match Type": NO_MATCH,
        "Source Provider": "", "Confirmed Display String": NO_MATCH_DISPLAY,
    }
    rows = missing.select("Term", *[F.lit(v).alias(k) for k, v in defaults.items()])
    for name in RECONCILED_COLUMNS:
        if name not in mapping.columns:
            mapping = mapping.withColumn(name, F.lit(None).cast("string"))
    extra = [c for c in mapping.columns if c not in RECONCILED_COLUMNS]
    merged = mapping.unionByName(rows, allowMissingColumns=True)
    return merged.select(*[F.col(f"`{c}`") for c in [*RECONCILED_COLUMNS, *extra]])


def pending_terms(
    terms: DataFrame, processed: DataFrame, provider: str, chunk: int | None = None
) -> DataFrame:
    """Terms a provider has not processed yet; the next ``chunk`` by id when one is given."""
    done = processed.filter(F.col("provider") == provider).select("term_id").distinct()
    left = terms.join(done, "term_id", "left_anti")
    return left if chunk is None else left.orderBy("term_id").limit(chunk)


def download_table(mapping: DataFrame) -> DataFrame:
    """The columns handed out, with ``No Match`` shown as empty."""
    names = [c for c in DOWNLOAD_COLUMNS if c in mapping.columns]
    return mapping.select(
        *[
            F.when(F.col("URI") == NO_MATCH, "").otherwise(F.col("URI")).alias("URI")
            if c == "URI" else F.col(f"`{c}`")
            for c in names
        ]
    )


def page(df: DataFrame, order_by: list[str], number: int, size: int) -> DataFrame:
    """One page in key order; a page beyond the last shows the last, below one the first.

    For several pages of a table keep its :class:`tablegraph.operators.pages.Pages`.
    """
    return Pages(df, order_by).page(number, size)
