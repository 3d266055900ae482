"""Resolving IRIs through ordered lookup tables and enriching the mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegraph.config import ENRICHED_COLUMNS

WIKI_PAGE = "https://www.wikidata.org/wiki/"


def resolve_cascade(
    iris: DataFrame,
    lookups: DataFrame,
    order: list[str],
    ignore: list[str] | None = None,
) -> DataFrame:
    """``iri, label, acronym, ui_link, source, message`` per input IRI row.

    ``lookups``: ``service, iri, label, acronym, ui_link``. The first service in ``order`` with
    a non-empty link wins; pages of the open knowledge base resolve to themselves; other text
    that is no web IRI is an error. Row ids and other columns of ``iris`` are kept.
    """
    skip = {s.lower() for s in ignore or []}
    services = [s for s in order if s.lower() not in skip]
    place = F.array_position(F.array(*[F.lit(s) for s in services]), F.col("service"))
    usable = lookups.filter(F.col("service").isin(services)) if services else lookups.limit(0)
    usable = usable.filter(F.coalesce(F.col("ui_link"), F.lit("")) != "")
    first = usable.groupBy(F.col("iri").alias("_iri")).agg(
        F.min_by(
            F.struct("label", "acronym", "ui_link", F.upper("service").alias("source")),
            F.struct(place, "ui_link", F.col("label").isNull(), "label", "acronym"),
        ).alias("hit")
    )
    joined = iris.join(first, iris["iri"] == F.col("_iri"), "left")
    valid = F.coalesce(F.col("iri").startswith("http"), F.lit(False))
    wiki = F.coalesce(F.col("iri").startswith(WIKI_PAGE), F.lit(False))
    found = F.col("hit").isNotNull()

    def pick(name: str, wiki_value):
        return (
            F.when(~valid, F.lit(None).cast("string"))
            .when(wiki, wiki_value)
            .when(found, F.col("hit." + name))
        )

    source = (
        F.when(~valid, "Error").when(wiki, "WIKIDATA").when(found, F.col("hit.source"))
        .otherwise("None")
    )
    message = F.when(~valid, "Invalid IRI provided.").when(
        ~wiki & ~found, "IRI not found in any source."
    )
    return joined.select(
        *iris.columns,
        pick("label", F.lit("Wikidata Entity")).alias("label"),
        pick("acronym", F.lit("WIKIDATA")).alias("acronym"),
        pick("ui_link", F.col("iri")).alias("ui_link"),
        source.alias("source"),
        message.alias("message"),
    )


def restore_input_order(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """Results in the order of ``row_id``; an input without a result is an error row.

    Of several results for one IRI the smallest by all its columns counts.
    """
    names = [c for c in results.columns if c not in ("iri", "row_id", "source", "message")]
    least = F.min(F.struct(*names, "source", "message")).alias("_r")
    r = results.groupBy(F.col("iri").alias("_iri")).agg(least).select("_iri", "_r.*")
    joined = inputs.join(r, inputs["iri"] == F.col("_iri"), "left")
    return joined.select(
        *inputs.columns,
        *names,
        F.coalesce("source", F.lit("Error")).alias("source"),
        F.when(F.col("source").isNull(), "Processing failed").otherwise(F.col("message"))
        .alias("message"),
    ).orderBy("row_id")


def enrich_mapping(mapping: DataFrame, resolved: DataFrame) -> DataFrame:
    """Mapping with label, link, acronym, source and message per IRI, new values preferred.

    The resolved side is reduced to one row per IRI, so no mapping row is multiplied.
    """
    value = F.struct(*ENRICHED_COLUMNS)
    filled = sum((F.col(c).isNull().cast("int") for c in ENRICHED_COLUMNS), F.lit(0))
    text = [F.coalesce(F.col(c), F.lit("")) for c in ENRICHED_COLUMNS]
    one = resolved.groupBy(F.col("iri").alias("_iri")).agg(
        F.min_by(value, F.struct(filled, *text)).alias("_new")
    )
    joined = mapping.join(one, mapping["URI"] == F.col("_iri"), "left")
    old = [c for c in mapping.columns if c not in ENRICHED_COLUMNS]
    new = [
        F.coalesce(F.col("_new." + c), F.col(c) if c in mapping.columns else F.lit("")).alias(c)
        for c in ENRICHED_COLUMNS
    ]
    return joined.select(*[F.col(f"`{c}`") for c in old], *new)
