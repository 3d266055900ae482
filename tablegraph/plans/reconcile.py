"""Matching table to reconciled mapping: search vocabularies, rank, fill in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegraph.operators import link, rank, terms
from tablegraph.sources.tables import validate_matching


def reconcile(
    table: DataFrame,
    vocabularies: dict[str, DataFrame],
    suggestions: list[DataFrame] | None = None,
    limit: int = 10,
    threshold: float = 0.7,
    skos: bool = True,
    decisions: DataFrame | None = None,
) -> DataFrame:
    """Every term of a matching table with ``term_id``, filled with its best candidate.

    ``vocabularies``: entity tables by name. ``suggestions``: rows from saved response bodies.
    """
    mapping = validate_matching(table)
    open_terms = terms.unreconciled(mapping).select("term_id", F.col("Term").alias("term"))
    found = []
    for name, entities in vocabularies.items():
        hits = link.search_vocabulary(open_terms, entities, limit, source=name)
        found.append(hits.select(
            "term_id", "term", F.lit(name).alias("provider"), "rank", "uri", "label",
            "description", "score", "source_provider", F.lit(None).cast("string").alias("ontology"),
        ))
    merged = rank.union_suggestions([*found, *(suggestions or [])])
    out = rank.prefill_best(mapping, merged, threshold, skos)
    return out if decisions is None else terms.apply_decisions(out, decisions, skos)
