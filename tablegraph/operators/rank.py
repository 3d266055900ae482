"""Ranking suggestions and filling the best match in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegraph.config import NO_MATCH, NO_MATCH_DISPLAY
from tablegraph.functions.similarity import cosine, hybrid_score, lev_score
from tablegraph.functions.text import first_filled, py_strip

# Providers whose suggestions an ontology selection applies to.
LOOKUP_PROVIDERS = ["BioPortal", "OLS (EBI)", "SemLookP", "AgroPortal", "EarthPortal"]

STRATEGIES = {"api": "score", "levenshtein": "levenshtein_score", "hybrid": "hybrid_score"}


def drop_malformed(suggestions: DataFrame) -> DataFrame:
    return suggestions.filter(F.col("uri").isNotNull() & F.col("label").isNotNull())


def filter_ontologies(suggestions: DataFrame, selected: dict[str, list[str]]) -> DataFrame:
    """Keep a lookup provider's suggestions only from its selected ontologies, if any."""
    ontology = F.upper(first_filled(F.col("ontology"), F.col("source_provider")))
    keep = F.lit(True)
    for provider, names in selected.items():
        if provider in LOOKUP_PROVIDERS and names:
            hit = F.coalesce(ontology.isin([n.upper() for n in names]), F.lit(False))
            keep = keep & ((F.col("provider") != provider) | hit)
    return suggestions.filter(keep)


def union_suggestions(parts: list[DataFrame]) -> DataFrame:
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def score_suggestions(suggestions: DataFrame) -> DataFrame:
    """Add ``levenshtein_score``, and ``hybrid_score`` when vector columns are present.

    Vectors are supplied by the caller: ``term_vector, label_vector, text_vector``.
    """
    out = suggestions.withColumn("levenshtein_score", lev_score(F.col("term"), F.col("label")))
    if {"term_vector", "label_vector", "text_vector"} <= set(out.columns):
        label_cos = cosine(F.col("term_vector"), F.col("label_vector"))
        text_cos = cosine(F.col("term_vector"), F.col("text_vector"))
        out = out.withColumn(
            "hybrid_score", hybrid_score(text_cos, label_cos, F.col("levenshtein_score"))
        )
    return out


def rank_suggestions(
    suggestions: DataFrame, top: int, strategy: str = "api", providers: list[str] | None = None
) -> DataFrame:
    """The ``top`` suggestions per term over all providers; ties keep provider order, then rank.

    A missing score sorts as -1. The row-number limit is applied in every task before the
    shuffle, so a term with very many suggestions never travels whole.
    """
    key = STRATEGIES[strategy]
    scored = score_suggestions(drop_malformed(suggestions))
    if key not in scored.columns:
        scored = scored.withColumn(key, F.col("levenshtein_score") if key == "hybrid_score"
                                   else F.lit(None).cast("double"))
    if providers:
        place = F.array_position(F.array(*[F.lit(p) for p in providers]), F.col("provider"))
        order = F.when(place > 0, place).otherwise(len(providers) + 1)
    else:
        order = F.lit(0)
    window = Window.partitionBy("term_id").orderBy(
        F.coalesce(F.col(key), F.lit(-1.0)).desc(), order, "provider", "rank", "uri"
    )
    return scored.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= top)


def rank_by_similarity(suggestions: DataFrame) -> DataFrame:
    """All suggestions of each term in hybrid-score order, as a global sort."""
    scored = score_suggestions(suggestions)
    if "hybrid_score" not in scored.columns:
        scored = scored.withColumn("hybrid_score", F.col("levenshtein_score"))
    return scored.orderBy("term_id", F.desc("hybrid_score"), "provider", "rank")


def suggestion_source(default: Column | None = None) -> Column:
    """First non-empty of the source columns, else the given default or ``Unknown``."""
    return F.coalesce(
        first_filled(F.col("source_provider"), F.col("ontology")),
        default if default is not None else F.lit("Unknown"),
    )


def suggestion_text(score: Column | None, prefix: str = "") -> Column:
    """``label [source] [Lev: 0.93] (description, at most 100 characters) <uri>``."""
    label = F.coalesce(F.col("label"), F.lit("N/A"))
    source = F.when(
        F.coalesce(F.col("source_provider"), F.lit("")) != "",
        F.concat(F.lit(" ["), "source_provider", F.lit("]")),
    ).otherwise("")
    shown = F.lit("")
    if score is not None:
        # rint rounds exact halves to even; the format alone would round them up.
        number = F.when(score.isNull(), "N/A").otherwise(
            F.format_string("%.2f", F.rint(score * 100) / 100)
        )
        shown = F.concat(F.lit(" [" + prefix), number, F.lit("]"))
    text = F.coalesce(F.col("description"), F.lit(""))
    clipped = F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 100), F.lit("...")))
    description = F.when(
        text != "", F.concat(F.lit(" ("), F.coalesce(clipped, text), F.lit(")"))
    ).otherwise("")
    uri = F.coalesce(F.nullif(F.col("uri"), F.lit("")), F.lit("No URI"))
    return F.concat(label, source, shown, description, F.lit(" <"), uri, F.lit(">"))


def prefill_best(
    mapping: DataFrame, suggestions: DataFrame, threshold: float = 0.7, skos: bool = False
) -> DataFrame:
    """Fill rows without an IRI with their best suggestion by edit similarity.

    Below the threshold the row becomes ``No Match``; rows that have an IRI and rows with a
    blank term stay as they are.
    """
    best = rank_suggestions(suggestions, 1, "levenshtein")
    best = best.filter(F.col("levenshtein_score") >= threshold).select(
        F.col("term_id").alias("_id"),
        F.col("uri").alias("_uri"),
        suggestion_source().alias("_source"),
        F.coalesce("label", F.lit("")).alias("_label"),
        F.coalesce("description", F.lit("")).alias("_description"),
        suggestion_text(F.col("levenshtein_score"), "Lev: ").alias("_display"),
    )
    joined = mapping.join(best, mapping["term_id"] == F.col("_id"), "left")
    uri = py_strip(F.coalesce(F.col("URI"), F.lit("")))
    term = py_strip(F.coalesce(F.col("Term"), F.lit("")))
    open_row = ((uri == "") | (uri == NO_MATCH)) & (term != "")
    found = F.col("_id").isNotNull()

    def fill(old: str, new: str, none: str) -> Column:
        return F.when(open_row, F.when(found, F.col(new)).otherwise(F.lit(none))).otherwise(
            F.col(f"`{old}`")
        )

    new_uri = fill("URI", "_uri", NO_MATCH)
    cols = {
        "URI": new_uri,
        "Source Provider": fill("Source Provider", "_source", ""),
        "Confirmed Display String": fill("Confirmed Display String", "_display", NO_MATCH_DISPLAY),
        "Provider Term": fill("Provider Term", "_label", ""),
        "Provider Description": fill("Provider Description", "_description", ""),
    }
    if skos:
        old_type = F.coalesce(F.col("`Match Type`"), F.lit(""))
        final = py_strip(F.coalesce(new_uri, F.lit("")))
        blank = (final != "") & (final != NO_MATCH) & (py_strip(old_type) == "")
        cols["Match Type"] = F.when(blank, "skos:exactMatch").otherwise(F.col("`Match Type`"))
    return joined.select(
        *[cols[c].alias(c) if c in cols else F.col(f"`{c}`") for c in mapping.columns]
    )


def with_suggestions(
    mapping: DataFrame, suggestions: DataFrame, provider: str | None = None
) -> DataFrame:
    """Mapping rows whose term has any suggestion, of one provider when named."""
    if provider:
        suggestions = suggestions.filter(F.col("provider") == provider)
    return mapping.join(suggestions.select("term_id").distinct(), "term_id", "left_semi")


def provider_hit_counts(suggestions: DataFrame) -> DataFrame:
    """``provider, terms``: terms with at least one suggestion."""
    pairs = suggestions.select("provider", "term_id").distinct()
    return pairs.groupBy("provider").agg(F.count(F.lit(1)).alias("terms"))
