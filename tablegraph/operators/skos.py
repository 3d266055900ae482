"""Vocabulary graph of a mapping table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegraph import vocab as V
from tablegraph.config import Settings
from tablegraph.functions import text as T
from tablegraph.operators.quads import constant_quads, distinct_quads, explode_facts, fact
from tablegraph.session import dealt
from tablegraph.sources.tables import validate_mapping


def concept_iri(term: Column, settings: Settings) -> Column:
    """Concept IRI of a stripped term; a term that cleans to nothing gets a hash name."""
    name = F.coalesce(
        T.clean_for_iri(term, settings.replacements), F.concat(F.lit("concept_"), F.md5(term))
    )
    return F.concat(F.lit(settings.namespace.rstrip("/") + "/concepts/"), name)


def term_lookup(mapping: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``term, concept_iri``, one row per distinct term."""
    terms = mapping.select(T.safe_value(F.col("Term")).alias("term")).distinct()
    terms = terms.filter(F.col("term").isNotNull())
    return terms.withColumn("concept_iri", concept_iri(F.col("term"), settings))


def match_predicate(match_type: Column) -> Column:
    """Exact and close matches get their own property; other types give none."""
    t = F.lower(T.py_strip(match_type))
    return F.when(t == "skos:exactmatch", V.EXACT_MATCH).when(
        t == "skos:closematch", V.CLOSE_MATCH
    )


def skos_quads(
    mapping: DataFrame, data_graph: str, created: str, settings: Settings = Settings()
) -> DataFrame:
    """Concept scheme plus one concept per term. ``created`` is an explicit date-time text."""
    # Dealt before the explosion: the statements of a task wait in its memory to be made distinct.
    rows = dealt(validate_mapping(mapping))
    for name in ("label", "source", "ui_link"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    term = T.safe_value(F.col("Term"))
    rows = rows.select(
        term.alias("term"),
        concept_iri(term, settings).alias("concept"),
        T.strip_angle(T.safe_value(F.col("URI"))).alias("uri"),
        T.safe_value(F.col("`Match Type`")).alias("match"),
        T.safe_value(F.col("`Provider Term`")).alias("alt"),
        F.coalesce(
            T.safe_value(F.col("label")), T.safe_value(F.col("`Provider Description`"))
        ).alias("definition"),
        T.safe_value(F.col("source")).alias("source"),
        T.safe_value(F.col("ui_link")).alias("link"),
    ).filter(F.col("term").isNotNull())
    scheme = settings.namespace + "concept-scheme"
    c = F.col("concept")
    match = F.when(T.is_absolute_iri(F.col("uri")) & F.col("match").isNotNull(), F.col("uri"))
    link = F.when(T.is_absolute_iri(F.col("link")), F.col("link"))
    predicate = match_predicate(F.col("match"))
    facts = [
        fact(c, V.RDF_TYPE, F.lit(V.SKOS + "Concept"), "iri"),
        fact(c, V.SKOS + "inScheme", F.lit(scheme), "iri"),
        fact(c, V.PREF_LABEL, F.col("term")),
        fact(c, V.DCT + "created", F.lit(created), datatype=V.XSD + "dateTime"),
        fact(c, V.VOID + "inDataset", F.lit(data_graph), "iri"),
        fact(c, V.ALT_LABEL, F.col("alt")),
        fact(c, V.SKOS + "definition", F.col("definition")),
        fact(c, V.DCT + "source", F.col("source")),
        fact(c, V.RDFS_SEE_ALSO, link, "iri"),
        fact(c, V.RDFS_SEE_ALSO, match, "iri"),
        fact(c, predicate, F.when(predicate.isNotNull(), match), "iri"),
    ]
    graph = settings.terms_graph
    head = constant_quads(rows.sparkSession, graph, [
        (scheme, V.RDF_TYPE, V.SKOS + "ConceptScheme", "iri", None),
        (scheme, V.RDFS_LABEL, "Concept Scheme from Mapping Table", "lit", V.XSD + "string"),
    ])
    return distinct_quads(head.unionByName(explode_facts(rows, F.lit(graph), facts)))
