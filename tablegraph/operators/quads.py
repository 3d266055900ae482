"""Tables to quads: one exploded scan of the rows, lookups joined in, no row loops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegraph import vocab as V
from tablegraph.config import GraphSpec, Settings
from tablegraph.functions import text as T
from tablegraph.functions.values import (
    comparator_parts,
    guess_datatype,
    iso_datetime,
    literal_text,
)
from tablegraph.operators.templates import TemplatePlan, plan_template
from tablegraph.session import dealt
from tablegraph.sources.tables import validate_mapping

QUAD_COLUMNS = ["g", "s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang"]
FACTS_TYPE = "array<struct<" + ",".join(f"{c}:string" for c in QUAD_COLUMNS[1:]) + ">>"
QUAD_SCHEMA = ", ".join(f"{c} string" for c in QUAD_COLUMNS)


def fact(s: Column, p: str | Column, o: Column, kind: str = "lit", datatype: str | Column | None = None,
         s_kind: str = "iri", lang: str | None = None) -> Column:
    """One statement as a struct with the quad columns but the graph."""
    if kind == "lit" and datatype is None:
        datatype = V.RDF + "langString" if lang else V.XSD + "string"
    dt = datatype if isinstance(datatype, Column) else F.lit(datatype).cast("string")
    return F.struct(
        s.alias("s"),
        F.lit(s_kind).alias("s_kind"),
        (p if isinstance(p, Column) else F.lit(p)).alias("p"),
        o.cast("string").alias("o"),
        F.lit(kind).alias("o_kind"),
        dt.alias("o_datatype"),
        F.lit(lang).cast("string").alias("o_lang"),
    )


def explode_facts(df: DataFrame, graph: Column, facts: list[Column]) -> DataFrame:
    """Quads from per-row statements; a statement without subject or object is skipped."""
    rows = df.select(graph.alias("g"), F.inline(F.array(*facts)))
    rows = rows.filter(F.col("s").isNotNull() & F.col("o").isNotNull())
    return rows.select(*QUAD_COLUMNS)


def constant_quads(spark, graph: str, facts: list[tuple]) -> DataFrame:
    """Quads of a few fixed statements ``(s, p, o, kind, datatype)`` from driver settings."""
    rows = [(graph, s, "iri", p, o, kind, dt, None) for s, p, o, kind, dt in facts]
    return spark.createDataFrame(rows, QUAD_SCHEMA)


def distinct_quads(quads: DataFrame) -> DataFrame:
    """A graph is a set."""
    return quads.select(*QUAD_COLUMNS).distinct()


def union_graphs(*parts: DataFrame) -> DataFrame:
    return distinct_quads(reduce(DataFrame.unionByName, parts))


def graph_is_empty(quads: DataFrame, graph: str) -> bool:
    return quads.filter(F.col("g") == graph).isEmpty()


# --- lookups -----------------------------------------------------------------------------


def first_mapping_per_term(mapping: DataFrame, role: str) -> DataFrame:
    """``norm_term, iri`` of one role: the first row of each term, whatever its IRI is worth.

    "First" is the smallest ``row_id`` where the mapping has one, else the smallest IRI. The
    minimum folds on the map side, so a term repeated without end costs one row per task.
    """
    rows = validate_mapping(mapping)
    wanted = F.lower(T.py_strip(F.col("`RDF Role`"))) == role
    iri = T.strip_angle(T.safe_value(F.col("URI")))
    if "row_id" in rows.columns:
        first = F.min_by(iri, F.col("row_id"))
    else:
        first = F.min(iri)
    grouped = (
        rows.filter(wanted)
        .groupBy(F.lower(T.py_strip(F.col("Term"))).alias("norm_term"))
        .agg(first.alias("iri"))
    )
    return grouped.filter(T.is_absolute_iri(F.col("iri")))


def map_predicates(
    spark, columns: list[str], mapping: DataFrame, concepts: DataFrame | None, settings: Settings
) -> DataFrame:
    """``column, predicate`` for every column that gets one; at most one row per column.

    Concept of that exact name, else the mapped IRI, else an IRI made from the name.
    """
    names = spark.createDataFrame([(c,) for c in columns], "column string")
    out = names.withColumn("norm_term", F.lower(T.py_strip(F.col("column"))))
    # The column list is bounded by the table's width: broadcast it and read the big side once.
    wanted = F.broadcast(out.select("norm_term").distinct())
    mapped = first_mapping_per_term(mapping, "predicate").join(wanted, "norm_term", "left_semi")
    out = out.join(F.broadcast(mapped), "norm_term", "left")
    made = F.concat(
        F.lit(settings.namespace + "concepts/"),
        T.clean_for_iri(F.col("column"), settings.replacements),
    )
    if concepts is not None:
        exact = concepts.join(F.broadcast(names), concepts["term"] == names["column"], "left_semi")
        exact = exact.groupBy(F.col("term").alias("column")).agg(
            F.min("concept_iri").alias("concept_iri")
        )
        out = out.join(F.broadcast(exact), "column", "left")
        predicate = F.coalesce("concept_iri", "iri", made)
    else:
        predicate = F.coalesce(F.col("iri"), made)
    return out.select("column", predicate.alias("predicate")).filter("predicate is not null")


def map_objects(
    cells: DataFrame, mapping: DataFrame, concepts: DataFrame | None, settings: Settings
) -> DataFrame:
    """Cells ``node, row_key, predicate, column, value, use_concepts, as_iri`` with ``obj``.

    ``obj`` is a struct ``o, o_kind, o_datatype``: concept IRI, else mapped IRI, else comparator
    node, else typed literal. Both lookups have one row per key, so no cell is multiplied; small
    ones are broadcast by size, large ones shuffle on the value with skewed values split.
    """
    if concepts is not None:
        unique = concepts.groupBy(F.col("term").alias("_term")).agg(
            F.min("concept_iri").alias("_concept")
        )
        usable = F.col("use_concepts") & (F.col("value") == F.col("_term"))
        cells = cells.join(unique, usable, "left")
    else:
        cells = cells.withColumn("_concept", F.lit(None).cast("string"))
    mapped = first_mapping_per_term(mapping, "object").select(
        F.col("norm_term").alias("_norm"), F.col("iri").alias("_mapped")
    )
    cells = cells.join(mapped, F.lower("value") == F.col("_norm"), "left")

    value = F.col("value")
    direct = F.when(F.col("as_iri"), T.strip_angle(value)).otherwise(
        F.coalesce("_concept", "_mapped")
    )
    compared = comparator_parts(value, settings)
    node = F.concat(F.lit("_:b"), F.md5(F.concat_ws("|", "node", "predicate", "column", "value")))
    iso, datatype = F.col("_iso"), F.col("_datatype")

    def obj(o: Column, kind: str, dt: Column) -> Column:
        return F.struct(o.alias("o"), F.lit(kind).alias("o_kind"), dt.alias("o_datatype"))

    none = F.lit(None).cast("string")
    # Step by step, so that the costly tests are written once in the plan, not once per use.
    typed = cells.withColumn("direct", direct).withColumn("compared", compared)
    typed = typed.withColumn("_iso", iso_datetime(value, True))
    typed = typed.withColumn(
        "_datatype", guess_datatype(value, F.col("column"), settings, iso, True)
    )
    typed = typed.withColumn(
        "obj",
        F.when(F.col("as_iri") & ~T.is_iri_like(F.col("direct")), None)
        .when(F.col("direct").isNotNull(), obj(F.col("direct"), "iri", none))
        .when(F.col("compared").isNotNull(), obj(node, "bnode", none))
        .otherwise(obj(literal_text(value, datatype, iso, True), "lit", datatype)),
    )
    return typed.drop("_term", "_concept", "_norm", "_mapped", "direct", "_iso", "_datatype")


# --- rows to quads ------------------------------------------------------------------------


def _subject(spec: GraphSpec, settings: Settings) -> Column:
    if spec.subject_base and spec.subject_column:
        return T.subject_iri(
            F.col(f"`{spec.subject_column}`"), spec.subject_base, settings.replacements
        )
    base = T.dataset_namespace(spec.graph).rstrip("/") + "/subjects"
    return T.subject_iri(F.col(f"`{spec.id_column}`"), base, settings.replacements)


def _has_subject(spec: GraphSpec, settings: Settings) -> Column:
    shared = spec.subject_base and spec.subject_column
    column = spec.subject_column if shared else spec.id_column
    return T.cleans_to_text(F.col(f"`{column}`"), settings.replacements)


def _row_key(df: DataFrame, spec: GraphSpec) -> Column:
    """What tells rows apart for node names; fully equal rows describe the same nodes."""
    if spec.row_key:
        return F.col(f"`{spec.row_key}`").cast("string")
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in df.columns]
    return F.md5(F.concat_ws("\u0001", *parts))


def node_name(row_key: Column, part: str) -> Column:
    return F.concat(F.lit("_:b"), F.md5(F.concat_ws("|", row_key, F.lit(part))))


def rejected_rows(df: DataFrame, spec: GraphSpec, settings: Settings = Settings()) -> DataFrame:
    """``rows, rejected``: rows in all, and rows without a usable subject id."""
    gone = F.count_if(~_has_subject(spec, settings))
    return df.agg(F.count(F.lit(1)).alias("rows"), gone.alias("rejected"))


def rows_to_quads(
    df: DataFrame,
    mapping: DataFrame,
    spec: GraphSpec,
    settings: Settings = Settings(),
    concepts: DataFrame | None = None,
    dedupe: bool = True,
    declarations: bool = True,
) -> DataFrame:
    """The whole data graph of a table.

    Rows without a usable id are left out (see :func:`rejected_rows`). The row part explodes one
    array of statements per row, the cell part one array of cells; both read the table once.
    ``dedupe=False`` skips the final set semantics when ids are known to be unique.
    """
    spark = df.sparkSession
    ids = [spec.id_column] + ([spec.subject_column] if spec.subject_column else [])
    columns = [c for c in df.columns if c not in ids and c != spec.row_key]
    groups = {k: g for k, g in spec.groups.items() if g.connecting_predicate and g.columns}
    group_of = {c: k for k, g in groups.items() for c in g.columns}
    template = plan_template(spec, df.columns) if spec.active_template else None
    graph = F.lit(spec.graph)

    # The filter tests the raw id: a filter on the built IRI would be computed twice.
    # Dealt before the explosion: the statements of a task wait in its memory to be made distinct.
    base = dealt(df).filter(_has_subject(spec, settings)).select(
        _subject(spec, settings).alias("_s"),
        _row_key(df, spec).alias("_key"),
        *[T.safe_value(F.col(f"`{c}`")).alias(c) for c in df.columns],
    )

    s = F.col("_s")
    node_of = {k: node_name(F.col("_key"), "group|" + k) for k in groups}
    row_facts = []
    if spec.class_iri and not template:
        row_facts.append(fact(s, V.RDF_TYPE, F.lit(spec.class_iri), "iri"))
    for key, group in groups.items():
        row_facts.append(fact(s, group.connecting_predicate, node_of[key], "bnode"))
        if group.group_type:
            row_facts.append(
                fact(node_of[key], V.RDF_TYPE, F.lit(group.group_type), "iri", s_kind="bnode")
            )
    if template:
        row_facts += _template_row_facts(template, s)

    parts = []
    if row_facts:
        parts.append(explode_facts(base, graph, row_facts))
    predicates = map_predicates(spark, columns, mapping, concepts, settings)
    cells = _cells(base, columns, group_of, node_of, template)
    cells = cells.join(F.broadcast(predicates), "column", "left").withColumn(
        "predicate", F.coalesce("fixed", "predicate")
    ).filter("predicate is not null")
    parts.append(cell_quads(map_objects(cells, mapping, concepts, settings), graph, settings))
    if declarations:
        parts.append(_declarations(spark, spec, predicates, template, mapping))
    if declarations and spec.column_order:
        parts.append(column_order_quads(df, spec))
    quads = reduce(DataFrame.unionByName, parts)
    return distinct_quads(quads) if dedupe else quads


def _cells(base, columns, group_of, node_of, template: TemplatePlan | None) -> DataFrame:
    """Non-null cells with the node they describe; template cells carry their predicate."""

    def cell(node, kind, column, fixed, concepts, as_iri):
        return F.struct(
            node.alias("node"), F.lit(kind).alias("node_kind"), F.lit(column).alias("column"),
            F.col(f"`{column}`").alias("value"), F.lit(fixed).cast("string").alias("fixed"),
            F.lit(concepts).alias("use_concepts"), F.lit(as_iri).alias("as_iri"),
        )

    s = F.col("_s")
    items = []
    for c in columns:
        if c in group_of:
            items.append(cell(node_of[group_of[c]], "bnode", c, None, True, False))
        elif not template:
            items.append(cell(s, "iri", c, None, True, False))
    for part in template.cells if template else []:
        node = node_name(F.col("_key"), part.path) if part.path else s
        items.append(
            cell(node, "bnode" if part.path else "iri", part.column, part.predicate, False,
                 part.as_iri)
        )
    if not items:
        items = [F.struct(
            *[F.lit(None).cast(t).alias(n) for n, t in (
                ("node", "string"), ("node_kind", "string"), ("column", "string"),
                ("value", "string"), ("fixed", "string"), ("use_concepts", "boolean"),
                ("as_iri", "boolean"))]
        )]
    rows = base.select(F.inline(F.array(*items)))
    return rows.filter(F.col("value").isNotNull())


def cell_quads(cells: DataFrame, graph: Column, settings: Settings) -> DataFrame:
    """Statements of mapped cells; a comparator cell adds its node's three statements."""
    ex = settings.namespace
    o = F.col("obj.o")
    own = F.struct(
        F.col("node").alias("s"), F.col("node_kind").alias("s_kind"),
        F.col("predicate").alias("p"), o.alias("o"), F.col("obj.o_kind").alias("o_kind"),
        F.col("obj.o_datatype").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"),
    )
    is_node = F.col("obj.o_kind") == "bnode"
    node = F.when(is_node, o)
    extra = [
        fact(node, V.RDF_TYPE, F.lit(ex + "QuantitativeValue"), "iri", s_kind="bnode"),
        fact(node, ex + "comparator", F.col("compared.comparator"), s_kind="bnode"),
        fact(node, ex + "hasValue", F.col("compared.value"),
             datatype=F.col("compared.datatype"), s_kind="bnode"),
    ]
    # No filter on obj: it would be pushed below and repeat the whole typing expression.
    usable = F.col("obj.o_kind").isNotNull()
    facts = F.when(is_node, F.array(own, *extra)).when(usable, F.array(own))
    rows = cells.select(graph.alias("g"), F.inline(facts))
    return rows.select(*QUAD_COLUMNS)


def _template_row_facts(template: TemplatePlan, s: Column) -> list[Column]:
    def node(path: str) -> Column:
        return node_name(F.col("_key"), path) if path else s

    out = []
    for link in template.links:
        kind = "bnode" if link.path else "iri"
        if link.child:
            out.append(fact(node(link.path), link.predicate, node(link.child), "bnode", s_kind=kind))
        else:
            out.append(fact(node(link.path), link.predicate, F.lit(link.iri), "iri", s_kind=kind))
    return out


def _declarations(spark, spec, predicates, template, mapping) -> DataFrame:
    """Class and predicate declarations; a predicate shared by columns keeps one label."""
    labels = predicates.groupBy("predicate").agg(F.min(T.py_strip(F.col("column"))).alias("label"))
    if template:
        names = sorted({*template.predicates})
        own = spark.createDataFrame([(p,) for p in names], "predicate string")
        labels = labels.unionByName(template_labels(own, mapping)).groupBy("predicate").agg(
            F.min("label").alias("label")
        )
    quads = explode_facts(
        labels, F.lit(spec.graph),
        [fact(F.col("predicate"), V.RDF_TYPE, F.lit(V.RDF_PROPERTY), "iri"),
         fact(F.col("predicate"), V.RDFS_LABEL, F.col("label"))],
    )
    if spec.class_iri:
        one = spark.createDataFrame([(spec.class_iri,)], "iri string")
        quads = quads.unionByName(explode_facts(
            one, F.lit(spec.graph),
            [fact(F.col("iri"), V.RDF_TYPE, F.lit(V.RDFS + "Class"), "iri"),
             fact(F.col("iri"), V.RDFS_LABEL, T.iri_label(F.col("iri")))],
        ))
    return quads


def template_labels(predicates: DataFrame, mapping: DataFrame) -> DataFrame:
    """Label per template predicate: the term mapped to that IRI, else a name from the IRI."""
    rows = validate_mapping(mapping).filter(
        F.lower(T.py_strip(F.col("`RDF Role`"))) == "predicate"
    )
    rows = rows.join(F.broadcast(predicates), rows["URI"] == predicates["predicate"], "left_semi")
    terms = rows.groupBy(F.col("URI").alias("predicate")).agg(
        F.min(T.safe_value(F.col("Term"))).alias("term")
    )
    joined = predicates.join(F.broadcast(terms), "predicate", "left")
    return joined.select(
        "predicate", F.coalesce("term", T.iri_label(F.col("predicate"))).alias("label")
    )


def column_order_quads(df: DataFrame, spec: GraphSpec) -> DataFrame:
    """Dataset node with its columns, labels and 1-based positions."""
    from tablegraph.operators.reshape import column_positions

    ids = [c for c in (spec.id_column, spec.subject_column) if c]
    ns = T.dataset_namespace(spec.graph)
    rows = column_positions(df, ids)
    column = F.concat(F.lit(ns + "columns/"), T.clean_for_iri(F.col("column"), {}))
    dataset = F.lit(ns + "dataset")
    return explode_facts(rows, F.lit(spec.graph), [
        fact(dataset, V.RDF_TYPE, F.lit(ns + "Dataset"), "iri"),
        fact(column, V.RDF_TYPE, F.lit(ns + "Column"), "iri"),
        fact(column, V.RDFS_LABEL, F.col("column")),
        fact(column, V.SCHEMA + "position", F.col("position"), datatype=V.XSD + "integer"),
        fact(column, ns + "originalColumnName", F.col("column")),
        fact(dataset, ns + "hasColumn", column, "iri"),
    ]).distinct()
