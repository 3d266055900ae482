"""A table and its mapping to all graphs: data, vocabulary, catalogue, publications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablegraph.config import GraphSpec, Settings
from tablegraph.operators import prefixes, publish, quads, resolve, skos
from tablegraph.session import checkpoint
from tablegraph.sources.tables import validate_mapping


@dataclass(frozen=True)
class Graphs:
    data: DataFrame
    terms: DataFrame
    catalogue: DataFrame | None
    publications: DataFrame | None

    def all(self) -> DataFrame:
        parts = [g for g in (self.data, self.terms, self.catalogue, self.publications)
                 if g is not None]
        return quads.union_graphs(*parts)


def build_graphs(
    table: DataFrame,
    mapping: DataFrame,
    spec: GraphSpec,
    run_time: str,
    settings: Settings = Settings(),
    resolved: DataFrame | None = None,
    dataset: DataFrame | None = None,
    works: DataFrame | None = None,
) -> Graphs:
    """Resolve, link, type and describe one table.

    ``run_time`` is an ISO date-time used wherever a graph states when it was made. ``resolved``
    enriches the mapping; ``dataset`` (one metadata row) adds the catalogue; ``works`` (parsed
    publication bodies) adds the publication graph.
    """
    mapping = validate_mapping(mapping)
    if resolved is not None:
        mapping = resolve.enrich_mapping(mapping, resolved)
    # The mapping feeds six joins and the data graph is both result and measured: each is
    # computed once and read back from the shared checkpoint folder.
    mapping = checkpoint(mapping)
    concepts = skos.term_lookup(mapping, settings)
    data = quads.rows_to_quads(table, mapping, spec, settings, concepts)
    if dataset is not None:
        data = checkpoint(data)
    terms = skos.skos_quads(mapping, spec.graph, run_time, settings)
    day = run_time[:10]
    catalogue = publications = None
    if works is not None:
        publications = publish.publication_quads(works, day, settings)
    if dataset is not None:
        catalogue = publish.dcat_quads(dataset, data, day, settings)
        if publications is not None:
            link = publish.link_dataset_to_publication(
                spec.graph + "dataset/main", publications, settings
            )
            catalogue = quads.union_graphs(catalogue, link)
    return Graphs(data, terms, catalogue, publications)


def prefix_bindings(
    table: DataFrame, mapping: DataFrame, catalogue: DataFrame, settings: Settings = Settings(),
    spec: GraphSpec | None = None,
) -> DataFrame:
    """``prefix, namespace`` a graph of this table needs, the standard ones included."""
    from tablegraph import vocab as V
    from tablegraph.functions.text import dataset_namespace
    from tablegraph.sources.prefixes import merge_prefix_overrides

    full = merge_prefix_overrides(catalogue, settings.manual_prefixes)
    own = [x for x in (spec.class_iri, spec.subject_base) if x] if spec else []
    found = prefixes.used_prefixes(prefixes.used_iris(mapping, table, own), full)
    fixed = [("ex", settings.namespace)]
    if spec:
        fixed.append(("dataset", dataset_namespace(spec.graph)))
    standard = [("rdfs", V.RDFS), ("rdf", V.RDF), ("xsd", V.XSD), ("skos", V.SKOS)]
    spark = table.sparkSession
    names = "prefix string, namespace string"
    return prefixes.merge_prefixes(
        [spark.createDataFrame(fixed, names), found, spark.createDataFrame(standard, names)]
    )
