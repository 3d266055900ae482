"""Quads back to tables: labels, values, wide rows, links and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegraph import vocab as V
from tablegraph.functions.text import hyperlink_cell, local_name
from tablegraph.operators.positions import global_positions
from tablegraph.operators.prefixes import distinct_namespaces
from tablegraph.operators.reshape import expand_multi_values, value_positions

# Labels that become columns of the wide table; beyond this the long form is the result.
MAX_COLUMNS = 10000


def is_metadata_graph() -> Column:
    g = F.coalesce(F.col("g"), F.lit(""))
    return g.endswith(V.DCAT_GRAPH_SUFFIX) | g.endswith(V.PUBLICATION_GRAPH_SUFFIX)


def data_graphs(quads: DataFrame) -> DataFrame:
    return quads.filter(~is_metadata_graph())


def metadata_graphs(quads: DataFrame) -> DataFrame:
    return quads.filter(is_metadata_graph())


def properties(quads: DataFrame) -> DataFrame:
    """``property``: IRIs declared as properties."""
    declared = (F.col("p") == V.RDF_TYPE) & (F.col("o") == V.RDF_PROPERTY)
    return quads.filter(declared).select(F.col("s").alias("property")).distinct()


def collect_labels(quads: DataFrame) -> DataFrame:
    """``iri, label``: preferred label, else plain label; the smallest where several exist."""
    wanted = quads.filter(F.col("p").isin(V.PREF_LABEL, V.RDFS_LABEL))
    order = F.struct(F.col("p") != V.PREF_LABEL, F.col("o"))
    return wanted.groupBy(F.col("s").alias("iri")).agg(F.min_by("o", order).alias("label"))


def collect_matches(quads: DataFrame) -> DataFrame:
    """``iri, exact, close``: one exact and one close match per IRI, the smallest of each."""
    wanted = quads.filter(F.col("p").isin(V.EXACT_MATCH, V.CLOSE_MATCH))
    return wanted.groupBy(F.col("s").alias("iri")).agg(
        F.min(F.when(F.col("p") == V.EXACT_MATCH, F.col("o"))).alias("exact"),
        F.min(F.when(F.col("p") == V.CLOSE_MATCH, F.col("o"))).alias("close"),
    )


def property_labels(quads: DataFrame) -> DataFrame:
    """``property, label`` of declared properties that have a label: one scan, one grouping."""
    declared = (F.col("p") == V.RDF_TYPE) & (F.col("o") == V.RDF_PROPERTY)
    named = F.col("p").isin(V.PREF_LABEL, V.RDFS_LABEL)
    order = F.when(named, F.struct(F.col("p") != V.PREF_LABEL, F.col("o")))
    rows = quads.filter(declared | named).groupBy(F.col("s").alias("property")).agg(
        F.bool_or(declared).alias("declared"), F.min_by("o", order).alias("label")
    )
    return rows.filter(F.col("declared") & F.col("label").isNotNull()).select("property", "label")


def main_rows(quads: DataFrame) -> DataFrame:
    """Quads of the row subjects: in a data graph, no property, ``/subjects/`` in the IRI.

    Without any such subject, all of the data graphs' subjects but properties; a probe that stops
    at the first row decides. Row by row, with the few properties joined out by size: the quads
    do not shuffle.
    """
    data = data_graphs(quads)
    rows = data.filter(F.col("s").contains("/subjects/"))
    base = data if rows.isEmpty() else rows
    return base.join(properties(quads), F.col("s") == F.col("property"), "left_anti")


def main_subjects(quads: DataFrame) -> DataFrame:
    """``subject``: the distinct subjects of :func:`main_rows`."""
    return main_rows(quads).select(F.col("s").alias("subject")).distinct()


def subject_values(quads: DataFrame) -> DataFrame:
    """Long form ``subject, property, label, value`` of the main subjects, types left out.

    The label is the property's, else its IRI. Property tables are bounded by the number of
    distinct predicates and joined by size; the quads never shuffle by predicate.
    """
    body = main_rows(quads).filter(F.col("p") != V.RDF_TYPE).select(
        F.col("s").alias("subject"), F.col("p").alias("property"), F.col("o").alias("value")
    )
    return attach_property_labels(body, property_labels(quads))


def attach_property_labels(values: DataFrame, labels: DataFrame) -> DataFrame:
    names = labels.select(F.col("property").alias("_p"), F.col("label").alias("_l"))
    joined = values.join(names, values["property"] == F.col("_p"), "left")
    return joined.select(
        *values.columns, F.coalesce("_l", "property").alias("label")
    )


def values_per_property(quads: DataFrame) -> DataFrame:
    """``subject, label, pos, value``: the values of each subject and label, sorted and numbered.

    One row per value instead of a list, so a subject with very many values stays distributed.
    """
    return value_positions(subject_values(quads).select("subject", "label", "value"))


def label_list(values: DataFrame) -> list[str]:
    """Distinct labels, sorted: the columns of the wide table."""
    found = values.select("label").distinct().orderBy("label").limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} labels: use the long form")
    return [r[0] for r in found]


def pivot_subjects(values: DataFrame, labels: list[str]) -> DataFrame:
    """One row per subject with the first value of each label; use when labels are single-valued."""
    return values.groupBy("subject").pivot("label", labels).agg(F.min("value"))


def quads_to_table(quads: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Wide table ``subject, pos, <labels>``; several values of a label give several rows."""
    values = values_per_property(quads)
    return expand_multi_values(values, labels or label_list(values))


# --- labels and links on cells --------------------------------------------------------------


def attach_match_targets(iris: DataFrame, matches: DataFrame, column: str = "iri") -> DataFrame:
    """Adds ``target``: exact match, else close match, else the IRI itself."""
    m = matches.select(F.col("iri").alias("_iri"), "exact", "close")
    joined = iris.join(m, iris[column] == F.col("_iri"), "left")
    return joined.select(*iris.columns, F.coalesce("exact", "close", column).alias("target"))


def attach_value_labels(values: DataFrame, labels: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``shown``: the value's label, the local name of an unlabelled internal IRI, or itself."""
    names = labels.select(F.col("iri").alias("_iri"), F.col("label").alias("_label"))
    joined = values.join(names, values[column] == F.col("_iri"), "left")
    v = F.col(column)
    internal = v.contains("/concepts/") | v.contains("/subjects/")
    shown = F.coalesce(F.col("_label"), F.when(internal, local_name(v)), v)
    return joined.select(*values.columns, shown.alias("shown"), F.col("_label").isNotNull().alias("labelled"))


def linked_values(quads: DataFrame, values: DataFrame) -> DataFrame:
    """``values`` with ``markdown`` and ``hyperlink`` text per cell."""
    shown = attach_value_labels(values, collect_labels(quads))
    shown = attach_match_targets(shown, collect_matches(quads), "value")
    return shown.select(
        *values.columns,
        markdown_link(F.col("value"), F.col("shown"), F.col("target")).alias("markdown"),
        F.when(F.col("labelled"), hyperlink_cell(F.col("value"), F.col("shown"), F.col("target")))
        .otherwise(F.col("shown")).alias("hyperlink"),
    )


def markdown_link(value: Column, shown: Column, target: Column) -> Column:
    """``[label](target)`` for web IRIs; internal concepts show the label, other text itself."""
    web = value.startswith("http://") | value.startswith("https://")
    link = F.concat(F.lit("["), shown, F.lit("]("), target, F.lit(")"))
    return (
        F.when(~web, value).when(value.contains("/concepts/"), shown).otherwise(link)
    )


def preview_table(quads: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Wide table of markdown cells with a ``Subject`` column in front."""
    return _linked_table(quads, labels, "markdown", "Subject")


def link_table(quads: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Wide table of spreadsheet link formulas, ready to be written as CSV."""
    return _linked_table(quads, labels, "hyperlink", None)


def _linked_table(quads, labels, kind: str, subject_column: str | None) -> DataFrame:
    values = values_per_property(quads)
    labels = labels or label_list(values)
    cells = linked_values(quads, values).select(
        "subject", "label", "pos", F.col(kind).alias("value")
    )
    wide = expand_multi_values(cells, labels)
    if subject_column is None:
        return wide
    subjects = linked_values(quads, wide.select("subject").distinct().select(
        "subject", F.col("subject").alias("value")))
    subjects = subjects.select(F.col("subject").alias("_s"), F.col("markdown").alias("_m"))
    wide = wide.toDF("_subject", "_pos", *[f"_c{i}" for i in range(len(labels))])
    joined = wide.join(subjects, F.col("_subject") == F.col("_s"), "left")
    cells = [F.col(f"_c{i}").alias(c) for i, c in enumerate(labels)]
    return joined.select(F.col("_m").alias(subject_column), F.col("_pos").alias("pos"), *cells)


def label_to_property(values: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, property``: the IRI behind a label, the smallest where labels repeat."""
    both = labels.select("label", "property").unionByName(
        values.filter(F.col("label") != F.col("property")).select("label", "property")
    )
    return both.groupBy("label").agg(F.min("property").alias("property"))


def link_headers(quads: DataFrame) -> DataFrame:
    """``label, property, linked, header``: which column headers link to an external match."""
    pairs = label_to_property(subject_values(quads), property_labels(quads))
    m = collect_matches(quads).withColumnRenamed("iri", "property")
    joined = pairs.join(m, "property", "left")
    target = F.coalesce("exact", "close")
    linked = target.isNotNull()
    header = F.when(linked, hyperlink_cell(F.col("property"), F.col("label"), target)).otherwise(
        F.col("label")
    )
    return joined.select("label", "property", linked.alias("linked"), header.alias("header"))


# --- statistics -------------------------------------------------------------------------


def property_usage(quads: DataFrame) -> DataFrame:
    """``label, usage``: table rows (after expansion) in which a label has a value.

    Counted without building the wide rows: a label that a subject has at all is filled in every
    row of that subject, so its usage is the sum of the row counts of its subjects.
    """
    counts = subject_values(quads).groupBy("subject", "label").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("subject").agg(F.max("n").alias("rows"))
    joined = counts.select("subject", "label").join(rows, "subject")
    return joined.groupBy("label").agg(F.sum("rows").alias("usage"))


def graph_statistics(quads: DataFrame) -> DataFrame:
    """One row ``triples, subjects, properties, exact_matches, close_matches``.

    ``subjects`` counts table rows. Exact distinct counts come from pre-grouped subjects, so one
    pass gives all figures about predicates.
    """
    per_subject = quads.groupBy("s").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or((F.col("p") == V.RDF_TYPE) & (F.col("o") == V.RDF_PROPERTY)).alias("prop"),
        F.bool_or(F.col("p").isin(V.PREF_LABEL, V.RDFS_LABEL)).alias("named"),
        F.bool_or(F.col("p") == V.EXACT_MATCH).alias("exact"),
        F.bool_or(F.col("p") == V.CLOSE_MATCH).alias("close"),
    )
    figures = per_subject.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("triples"),
        F.count_if(F.col("prop") & F.col("named")).alias("properties"),
        F.count_if("exact").alias("exact_matches"),
        F.count_if("close").alias("close_matches"),
    )
    # Rows of a subject: its longest label, at least one for a subject that only has a type.
    body = main_rows(quads).select(
        F.col("s").alias("subject"), F.col("p").alias("property"), F.col("o").alias("value")
    )
    counted = attach_property_labels(body, property_labels(quads)).groupBy("subject", "label").agg(
        F.count_if(F.col("property") != V.RDF_TYPE).alias("n")
    )
    per_row = counted.groupBy("subject").agg(F.greatest(F.max("n"), F.lit(1)).alias("rows"))
    subjects = per_row.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("subjects"))
    # Two one-row frames side by side.
    return figures.crossJoin(subjects).select(
        "triples", "subjects", "properties", "exact_matches", "close_matches"
    )


def property_catalog(quads: DataFrame) -> DataFrame:
    """``property, label, usage, has_match``, most used first."""
    usage = property_usage(quads)
    m = collect_matches(quads).select(F.col("iri").alias("property"), F.lit(True).alias("_m"))
    rows = property_labels(quads).join(usage, "label", "left").join(m, "property", "left")
    return rows.select(
        "property", "label", F.coalesce("usage", F.lit(0)).alias("usage"),
        F.coalesce("_m", F.lit(False)).alias("has_match"),
    ).orderBy(F.desc("usage"), "label", "property")


def property_mapping_table(quads: DataFrame) -> DataFrame:
    """``property, label, usage`` by label."""
    return property_catalog(quads).select("property", "label", "usage").orderBy("label", "property")


def group_by_subject_report(quads: DataFrame) -> DataFrame:
    """``subject, type, property, value`` lines: values labelled, properties by local name.

    The type is the local name of the smallest type, else ``Resource``. Lines, not lists: a
    subject of any size stays spread over rows.
    """
    types = quads.filter(F.col("p") == V.RDF_TYPE).groupBy("s").agg(F.min("o").alias("_type"))
    lines = quads.filter(F.col("p") != V.RDF_TYPE).select("s", "p", "o")
    labels = collect_labels(quads)
    joined = lines.join(types, "s", "left").join(labels, F.col("o") == F.col("iri"), "left")
    return joined.select(
        F.col("s").alias("subject"),
        F.coalesce(local_name(F.col("_type")), F.lit("Resource")).alias("type"),
        local_name(F.col("p")).alias("property"),
        F.coalesce("label", "o").alias("value"),
    )


def namespace_listing(quads: DataFrame, shown: int | None = None) -> DataFrame:
    """``ord, namespace, remaining``: all namespaces, or the first ``shown`` and how many more there are."""
    spaces = distinct_namespaces(quads)
    numbered = global_positions(spaces, ["namespace"], "ord")
    rows = numbered.select(F.col("ord").cast("int").alias("ord"), "namespace")
    if shown is None:
        return rows.withColumn("remaining", F.lit(0).cast("long"))
    total = numbered.agg(F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("ord") <= shown).crossJoin(F.broadcast(total)).select(
        "ord", "namespace", F.greatest(F.col("n") - shown, F.lit(0)).alias("remaining"),
    )


def metadata_report(quads: DataFrame) -> DataFrame:
    """``section, key, value`` rows: statistics, catalogue, publications, namespaces, properties."""
    stats = graph_statistics(quads)
    pairs = F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value"))
        for k, c in (("Total Triples", "triples"), ("Total Subjects", "subjects"),
                     ("Total Properties", "properties"))
    ])
    parts = [stats.select(F.lit("statistics").alias("section"), F.inline(pairs))]
    for name, suffix in (("dcat", V.DCAT_GRAPH_SUFFIX), ("publications", V.PUBLICATION_GRAPH_SUFFIX)):
        lines = group_by_subject_report(quads.filter(F.col("g").endswith(suffix)))
        parts.append(lines.select(
            F.lit(name).alias("section"),
            F.concat_ws(" | ", "subject", "type", "property").alias("key"), "value",
        ))
    spaces = namespace_listing(quads)
    parts.append(spaces.select(
        F.lit("namespaces").alias("section"), F.concat(F.lit("ns"), F.col("ord").cast("string")).alias("key"),
        F.col("namespace").alias("value"),
    ))
    props = property_catalog(quads)
    parts.append(props.select(
        F.lit("properties").alias("section"), F.col("property").alias("key"),
        F.concat_ws(" | ", "label", F.col("usage").cast("string")).alias("value"),
    ))
    return reduce(DataFrame.unionByName, parts)
