"""Linking terms to vocabularies: entities, token index, candidate search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegraph import vocab as V
from tablegraph.functions.similarity import (
    CONTAINS_BONUS,
    contains_boost,
    lev_sim,
    normed_sim,
)
from tablegraph.functions.text import norm, py_strip, tokenize
from tablegraph.operators.nearest import nearest_entities
from tablegraph.session import checkpoint, dealt

# Entities that one task takes: it sorts the pairs that they make with all terms.
ENTITIES_PER_TASK = 10_000

# Label and description predicates in order of preference.
LABEL_PREDICATES = [V.RDFS_LABEL, V.PREF_LABEL, V.ALT_LABEL, V.DCT + "title", V.DC + "title"]
DESCRIPTION_PREDICATES = [
    V.DCT + "description", V.DC + "description", V.RDFS_COMMENT, V.SKOS + "definition",
    V.SKOS + "note",
]


def pick_literal(predicates: list[str], prefer=("en", "")) -> Column:
    """Aggregate over quads: the object in the best language, then by predicate, then smallest.

    Only quads with one of the predicates take part.
    """
    pred_rank = F.array_position(F.array(*[F.lit(p) for p in predicates]), F.col("p"))
    tags = F.array(*[F.lit(x) for x in prefer])
    found = F.array_position(tags, F.coalesce(F.col("o_lang"), F.lit("")))
    lang_rank = F.when(found > 0, found).otherwise(len(prefer) + 1)
    order = F.when(pred_rank > 0, F.struct(lang_rank, pred_rank, F.col("o")))
    return F.min_by(F.col("o"), order)


def extract_entities(quads: DataFrame, prefer=("en", "")) -> DataFrame:
    """``uri, label, description`` per subject that has a label; missing description is empty."""
    wanted = quads.filter(F.col("p").isin([*LABEL_PREDICATES, *DESCRIPTION_PREDICATES]))
    grouped = wanted.groupBy(F.col("s").alias("uri")).agg(
        pick_literal(LABEL_PREDICATES, prefer).alias("label"),
        pick_literal(DESCRIPTION_PREDICATES, prefer).alias("description"),
    )
    return grouped.filter(F.col("label") != "").fillna("", ["description"])


def entity_synonyms(quads: DataFrame) -> DataFrame:
    """``uri, name``: alternative labels, one row each, so no entity's list is ever built."""
    alt = quads.filter(F.col("p") == V.ALT_LABEL)
    return alt.select(F.col("s").alias("uri"), F.col("o").alias("name")).distinct()


def entity_names(entities: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """``uri, name, label, is_label``: every name an entity can be found by.

    Synonyms come from the in-row ``synonyms`` array of a vocabulary table, or as a long
    ``uri, name`` frame.
    """
    own = entities.select("uri", F.col("label").alias("name"), "label", F.lit(True).alias("is_label"))
    more = None
    if "synonyms" in entities.columns:
        more = entities.select("uri", F.explode("synonyms").alias("name"), "label")
    if synonyms is not None:
        extra = synonyms.join(entities.select("uri", "label"), "uri").select("uri", "name", "label")
        more = extra if more is None else more.unionByName(extra)
    if more is None:
        return own
    return own.unionByName(more.select("uri", "name", "label", F.lit(False).alias("is_label")))


def build_token_index(names: DataFrame) -> DataFrame:
    """Distinct ``token, uri`` over labels and synonyms."""
    tokens = F.array_distinct(tokenize(F.col("name")))
    return names.select(F.explode(tokens).alias("token"), "uri").distinct()


def token_candidates(terms: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct ``term_id, term, uri`` that share a token.

    A token that a third of all terms and entities use gives that many pairs by definition;
    the join's skewed partitions are split by adaptive execution.
    """
    asked = terms.select(
        "term_id", "term", F.explode(F.array_distinct(tokenize(F.col("term")))).alias("token")
    )
    return asked.join(index, "token").select("term_id", "term", "uri").distinct()


def texts_with_token(texts: DataFrame, entities: DataFrame, synonyms: DataFrame | None) -> DataFrame:
    """``text``: those that share a token with a name of any entity."""
    tokens = entity_names(entities, synonyms).select(F.explode(tokenize(F.col("name"))).alias("token")).distinct()
    asked = texts.select("text", F.explode(tokenize(F.col("text"))).alias("token"))
    return asked.join(tokens, "token", "left_semi").select("text").distinct()


def _score_in_row(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """``text, uri, raw``: each candidate pair scored once, straight out of the token join.

    An entity carries its names in its row. A pair that shares several tokens meets under each;
    only the first shared one counts, so nothing has to be made distinct afterwards.
    """
    # Names are normalised once per entity, not once per candidate pair.
    entities = entities.select(
        "uri", norm(F.col("label")).alias("label"), F.transform("names", norm).alias("names")
    )
    known = F.array_distinct(F.flatten(F.transform("names", tokenize)))
    side = entities.withColumn("tokens", F.array_sort(known))
    asked = texts.withColumn("tokens", F.array_sort(F.array_distinct(tokenize(F.col("text")))))
    left = asked.withColumn("token", F.explode("tokens")).alias("t")
    right = side.withColumn("token", F.explode("tokens")).alias("e")
    shared = F.get(F.array_intersect(F.col("t.tokens"), F.col("e.tokens")), F.lit(0))
    pairs = left.join(
        right, (F.col("t.token") == F.col("e.token")) & (F.col("t.token") == shared)
    ).select("t.text", "e.uri", "e.label", "e.names")
    text = F.col("text")
    sims = F.transform("names", lambda name: normed_sim(text, name))
    best = pairs.select("text", "uri", "label", F.array_max(sims).alias("sim"))
    boosted = F.least(F.lit(1.0), F.col("sim") + CONTAINS_BONUS)
    hit = (F.col("label") != "") & F.col("label").contains(text)
    return best.select("text", "uri", F.when(hit, boosted).otherwise(F.col("sim")).alias("raw"))


def _score_long(texts, entities, synonyms) -> DataFrame:
    """As :func:`_score_in_row` for names kept as rows, however many an entity has."""
    names = entity_names(entities, synonyms)
    asked = texts.select(F.col("text").alias("term_id"), F.col("text").alias("term"))
    hits = token_candidates(asked, build_token_index(names))
    sim = lev_sim(F.col("term"), F.col("name"))
    best = (
        hits.join(names, "uri").groupBy("term", "uri", "label").agg(F.max(sim).alias("sim"))
    )
    score = contains_boost(F.col("sim"), F.col("term"), F.col("label"))
    return best.select(F.col("term").alias("text"), "uri", score.alias("raw"))


def search_vocabulary(
    terms: DataFrame,
    entities: DataFrame,
    limit: int = 10,
    synonyms: DataFrame | None = None,
    source: str = "local",
) -> DataFrame:
    """Best ``limit`` entities per term by name similarity.

    ``term_id, term, rank, uri, label, description, score, source_provider``. The score is the
    best similarity over label and synonyms plus the bonus for a label that contains the term. Only
    entities that share a token are compared; a term that shares none with any entity is compared with
    all of them (:mod:`tablegraph.operators.nearest`).
    Terms with the same normalised text are searched once. Synonyms are an in-row array of
    ``entities`` or a long ``uri, name`` frame.
    """
    terms = terms.select("term_id", py_strip(F.col("term")).alias("term"))
    terms = terms.withColumn("text", norm(F.col("term"))).filter("text != ''")
    texts = terms.select("text").distinct()
    entities = dealt(entities, ENTITIES_PER_TASK)
    if synonyms is None:
        none = F.array().cast("array<string>")
        more = F.coalesce("synonyms", none) if "synonyms" in entities.columns else none
        names = F.array_distinct(F.concat(F.array("label"), more))
        rows = entities.select("uri", "label", names.alias("names"))
        scored = _score_in_row(texts, rows)
    else:
        scored = _score_long(texts, entities, synonyms)
        rows = None
    hit = texts_with_token(texts, entities, synonyms)
    lost = texts.join(hit, "text", "left_anti")
    names = entity_names(entities, synonyms) if rows is None else rows.select(
        "uri", F.explode("names").alias("name"), "label")
    names = names.select("uri", norm(F.col("name")).alias("name"), norm(F.col("label")).alias("label"))
    lost = checkpoint(lost)
    if not lost.isEmpty():
        scored = scored.unionByName(nearest_entities(lost, names, limit))
    # rank <= k on row_number keeps only k rows per text and task before the shuffle.
    order = Window.partitionBy("text").orderBy(F.desc("raw"), "uri")
    top = scored.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= max(limit, 1)
    )
    described = entities.select("uri", "label", "description")
    return top.join(described, "uri").join(terms, "text").select(
        "term_id", "term", "rank", "uri", "label",
        F.coalesce("description", F.lit("")).alias("description"),
        F.round("raw", 6).alias("score"), F.lit(source).alias("source_provider"),
    )


def merge_resources_topk(parts: list[DataFrame], limit: int = 10) -> DataFrame:
    """Best ``limit`` suggestions per term over several resources, earlier resources first."""
    merged = None
    for i, part in enumerate(parts):
        one = part.withColumn("_resource", F.lit(i))
        merged = one if merged is None else merged.unionByName(one)
    order = Window.partitionBy("term_id").orderBy(F.desc("score"), "_resource", "rank")
    top = merged.withColumn("_place", F.row_number().over(order))
    top = top.filter(F.col("_place") <= max(limit, 1))
    return top.withColumn("rank", F.col("_place")).drop("_place", "_resource")
