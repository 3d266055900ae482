"""Graphs back to tables: labels, wide rows, links, statistics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegraph import vocab as V
from tablegraph.config import Settings
from tablegraph.functions import text as T
from tablegraph.operators import quads, skos, table_view
from tablegraph.plans.graph_queries import (
    _C,
    _CREATED,
    EX,
    GRAPH,
    SKOS_FACTS,
    duck_quads,
    q,
    term_mapping,
)
from tablegraph.plans.registry import query
from tablegraph.session import checkpoint

_SUBJECT = "'https://data.example.org/orders/subjects/' || o_custkey"
_TARGETS = {"O": EX + "concepts/open", "F": "http://ext.example.org/filled", "P": "part delivered"}


def order_quads(t):
    """Orders grouped under their customer: subjects with several values per property."""
    s = F.concat(F.lit("https://data.example.org/orders/subjects/"), F.col("o_custkey").cast("string"))
    state = F.lit(_TARGETS["P"])
    for key in "OF":
        state = F.when(F.col("o_orderstatus") == key, _TARGETS[key]).otherwise(state)
    body = quads.explode_facts(t.orders, F.lit(GRAPH), [
        quads.fact(s, V.RDF_TYPE, F.lit("http://voc.example.org/Buyer"), "iri"),
        quads.fact(s, EX + "priority", F.col("o_orderpriority")),
        quads.fact(s, EX + "state", state),
        quads.fact(s, EX + "day", F.date_format("o_orderdate", "yyyy-MM-dd")),
    ])
    head = quads.constant_quads(t.spark, GRAPH, [
        (EX + "priority", V.RDF_TYPE, V.RDF_PROPERTY, "iri", None),
        (EX + "priority", V.RDFS_LABEL, "Priority", "lit", V.XSD + "string"),
        (EX + "priority", V.EXACT_MATCH, "http://ext.example.org/priority", "iri", None),
        (EX + "state", V.RDF_TYPE, V.RDF_PROPERTY, "iri", None),
        (EX + "state", V.RDFS_LABEL, "a state", "lit", V.XSD + "string"),
        (EX + "state", V.PREF_LABEL, "State", "lit", V.XSD + "string"),
        (EX + "concepts/open", V.PREF_LABEL, "Open", "lit", V.XSD + "string"),
        (EX + "concepts/open", V.CLOSE_MATCH, "http://ext.example.org/open", "iri", None),
        ("http://ext.example.org/filled", V.RDFS_LABEL, 'Filled "up"', "lit", V.XSD + "string"),
    ])
    meta = quads.explode_facts(t.supplier, F.lit(EX + "graph/dcat-metadata"), [
        quads.fact(F.concat(F.lit("http://s/subjects/"), F.col("s_suppkey").cast("string")),
                   V.DCT + "title", F.col("s_name"))])
    # Read several times by each view, as a stored graph would be.
    return checkpoint(quads.union_graphs(body, head, meta))


_HEADS = [
    (EX + "priority", V.RDF_TYPE, V.RDF_PROPERTY, "iri"), (EX + "priority", V.RDFS_LABEL, "Priority", "lit"),
    (EX + "priority", V.EXACT_MATCH, "http://ext.example.org/priority", "iri"),
    (EX + "state", V.RDF_TYPE, V.RDF_PROPERTY, "iri"), (EX + "state", V.RDFS_LABEL, "a state", "lit"),
    (EX + "state", V.PREF_LABEL, "State", "lit"), (EX + "concepts/open", V.PREF_LABEL, "Open", "lit"),
    (EX + "concepts/open", V.CLOSE_MATCH, "http://ext.example.org/open", "iri"),
    ("http://ext.example.org/filled", V.RDFS_LABEL, 'Filled "up"', "lit"),
]
_STATE = (f"CASE o_orderstatus WHEN 'O' THEN '{_TARGETS['O']}' WHEN 'F' THEN '{_TARGETS['F']}' "
          f"ELSE '{_TARGETS['P']}' END")
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
# Distinct values per subject and label.
_VALUES = f"""vals AS (SELECT DISTINCT {_SUBJECT} AS subject, 'Priority' AS label, o_orderpriority AS value FROM orders
 UNION SELECT {_SUBJECT}, 'State', {_STATE} FROM orders
 UNION SELECT {_SUBJECT}, '{EX}day', {_DAY} FROM orders),
nums AS (SELECT *, row_number() OVER (PARTITION BY subject, label ORDER BY value) AS pos FROM vals),
sizes AS (SELECT subject, label, count(*) AS n FROM vals GROUP BY ALL),
tall AS (SELECT subject, max(n) AS n FROM sizes GROUP BY subject),
grid AS (SELECT subject, CAST(unnest(generate_series(1, n)) AS BIGINT) AS pos FROM tall)"""
_WIDE = " ".join(
    f"JOIN nums v{i} ON v{i}.subject = grid.subject AND v{i}.label = '{label}' AND v{i}.pos = least(grid.pos, "
    f"(SELECT n FROM sizes s WHERE s.subject = grid.subject AND s.label = '{label}'))"
    for i, label in enumerate(["Priority", "State", EX + "day"]))
_LABELS = ["Priority", "State", EX + "day"]


@query(f"""WITH {_VALUES} SELECT grid.subject, grid.pos, v0.value AS "Priority", v1.value AS "State",
 v2.value AS "{EX}day" FROM grid {_WIDE}""")
def quads_to_table(t):
    return table_view.quads_to_table(order_quads(t))


@query(f"WITH {_VALUES} SELECT subject, label, CAST(pos AS BIGINT) AS pos, value FROM nums")
def values_per_property(t):
    return table_view.values_per_property(order_quads(t))


def _linked(v: str, kind: str) -> str:
    if kind == "markdown":
        return (f"CASE {v} WHEN '{_TARGETS['O']}' THEN 'Open' WHEN '{_TARGETS['F']}' THEN "
                f"'[Filled \"up\"]({_TARGETS['F']})' ELSE {v} END")
    return (f"CASE {v} WHEN '{_TARGETS['O']}' THEN '=HYPERLINK(\"http://ext.example.org/open\", \"Open\")' "
            f"WHEN '{_TARGETS['F']}' THEN '=HYPERLINK(\"{_TARGETS['F']}\", \"Filled \"\"up\"\"\")' ELSE {v} END")


@query(f"""WITH {_VALUES} SELECT grid.subject, grid.pos, v0.value AS "Priority", {_linked('v1.value', 'link')} AS "State",
 v2.value AS "{EX}day" FROM grid {_WIDE}""")
def link_table(t):
    return table_view.link_table(order_quads(t), _LABELS)


@query(f"""WITH {_VALUES} SELECT '[' || split_part(grid.subject, '/subjects/', 2) || '](' || grid.subject || ')' AS "Subject",
 grid.pos, v0.value AS "Priority", {_linked('v1.value', 'markdown')} AS "State", v2.value AS "{EX}day" FROM grid {_WIDE}""")
def preview_table(t):
    return table_view.preview_table(order_quads(t), _LABELS)


@query(f"WITH {_VALUES} SELECT label, CAST(sum(tall.n) AS BIGINT) AS usage FROM sizes JOIN tall USING (subject) GROUP BY label")
def property_usage(t):
    return table_view.property_usage(order_quads(t))


_ALL = f"""{_VALUES}, counts AS (SELECT (SELECT count(*) FROM vals) + (SELECT count(DISTINCT subject) FROM vals)
  + {len(_HEADS)} + (SELECT count(*) FROM supplier) AS triples)"""


@query(f"""WITH {_ALL} SELECT CAST(triples AS BIGINT) AS triples, CAST((SELECT sum(n) FROM tall) AS BIGINT) AS subjects,
 2::BIGINT AS properties, 1::BIGINT AS exact_matches, 1::BIGINT AS close_matches FROM counts""")
def graph_statistics(t):
    return table_view.graph_statistics(order_quads(t))


_CATALOG = f"""WITH {_VALUES}, usage AS (SELECT label, CAST(sum(tall.n) AS BIGINT) AS usage FROM sizes JOIN tall USING (subject) GROUP BY label)
SELECT CASE label WHEN 'Priority' THEN '{EX}priority' ELSE '{EX}state' END AS property, label, usage{{}}
FROM usage WHERE label IN ('Priority', 'State')"""


@query(_CATALOG.format(", label = 'Priority' AS has_match"))
def property_catalog(t):
    return table_view.property_catalog(order_quads(t))


@query(_CATALOG.format(""))
def property_mapping_table(t):
    return table_view.property_mapping_table(order_quads(t))


@query(f"""WITH {_VALUES} SELECT DISTINCT label, CASE label WHEN 'Priority' THEN '{EX}priority' ELSE '{EX}state' END AS property,
 label = 'Priority' AS linked, CASE label WHEN 'Priority' THEN '=HYPERLINK("http://ext.example.org/priority", "Priority")'
 ELSE 'State' END AS header FROM vals WHERE label IN ('Priority', 'State')""")
def link_headers(t):
    return table_view.link_headers(order_quads(t))


@query(f"SELECT DISTINCT {_SUBJECT} AS subject FROM orders")
def main_subjects(t):
    return table_view.main_subjects(order_quads(t))


@query("SELECT DISTINCT c_name AS iri, c_mktsegment AS label FROM customer WHERE c_nationkey > 9 UNION ALL "
       "SELECT DISTINCT c_name, lower(c_mktsegment) FROM customer WHERE c_nationkey <= 9")
def collect_labels(t):
    s = F.col("c_name")
    pref = F.when(F.col("c_nationkey") > 9, F.col("c_mktsegment"))
    q_ = quads.explode_facts(t.customer, F.lit("g"), [
        quads.fact(s, V.PREF_LABEL, pref), quads.fact(s, V.RDFS_LABEL, F.lower("c_mktsegment"))])
    return table_view.collect_labels(q_)


_VOCAB = duck_quads(q("g"), SKOS_FACTS)


@query(f"""SELECT {_C} AS iri, CASE WHEN c_mktsegment = 'BUILDING' THEN 'http://ext/' || c_custkey END AS exact,
 CASE WHEN c_mktsegment = 'MACHINERY' THEN 'http://ext/' || c_custkey END AS close FROM customer
 WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def collect_matches(t):
    return table_view.collect_matches(skos.skos_quads(term_mapping(t), GRAPH, _CREATED))


@query(f"""WITH v AS ({_VOCAB}), ty AS (SELECT s, min(o) AS ty FROM v WHERE p = '{V.RDF_TYPE}' GROUP BY s),
lab AS (SELECT s, coalesce(min(o) FILTER (p = '{V.PREF_LABEL}'), min(o) FILTER (p = '{V.RDFS_LABEL}')) AS label FROM v
  WHERE p IN ('{V.PREF_LABEL}', '{V.RDFS_LABEL}') GROUP BY s)
SELECT v.s AS subject, regexp_extract(ty, '[#/]([^#/]*)$', 1) AS type, regexp_extract(v.p, '[#/]([^#/]*)$', 1) AS property,
 coalesce(label, v.o) AS value FROM v LEFT JOIN ty USING (s) LEFT JOIN lab ON lab.s = v.o WHERE p <> '{V.RDF_TYPE}'""")
def group_by_subject_report(t):
    return table_view.group_by_subject_report(skos.skos_quads(term_mapping(t), GRAPH, _CREATED))


_SPACES = [EX, "http://ext.example.org/", "https://data.example.org/orders/subjects/", "http://s/subjects/",
           "http://voc.example.org/", V.RDF, V.RDFS, V.SKOS, V.DCT, EX + "concepts/"]


@query(f"""WITH {_ALL},
usage AS (SELECT label, CAST(sum(tall.n) AS BIGINT) AS usage FROM sizes JOIN tall USING (subject) GROUP BY label),
spaces AS (SELECT namespace, row_number() OVER (ORDER BY namespace) AS i FROM (VALUES {', '.join(f"('{s}')" for s in _SPACES)}) AS n(namespace))
SELECT 'statistics' AS section, 'Total Triples' AS key, CAST(triples AS VARCHAR) AS value FROM counts
UNION ALL SELECT 'statistics', 'Total Subjects', CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) FROM tall
UNION ALL SELECT 'statistics', 'Total Properties', '2'
UNION ALL SELECT 'dcat', 'http://s/subjects/' || s_suppkey || ' | Resource | title', s_name FROM supplier
UNION ALL SELECT 'namespaces', 'ns' || i, namespace FROM spaces
UNION ALL SELECT 'properties', CASE label WHEN 'Priority' THEN '{EX}priority' ELSE '{EX}state' END, label || ' | ' || usage
 FROM usage WHERE label IN ('Priority', 'State')""")
def metadata_report(t):
    return table_view.metadata_report(order_quads(t))


@query("""
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]+') AND length(url) <= 255 AND title <> ''
  THEN '=HYPERLINK("' || replace(url, '"', '""') || '", "' || replace(title, '"', '""') || '")' ELSE title END AS cell
FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
""")
def hyperlink_cells(t):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return t.pages.select("page_id", T.hyperlink_cell(F.col("url"), title).alias("cell"))


@query(f"""WITH m AS (SELECT {_C} AS iri, c_custkey, c_mktsegment FROM customer)
SELECT c_custkey, iri AS value, 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS markdown,
 CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '=HYPERLINK("http://ext/' || c_custkey || '", "Customer#'
 ELSE '=HYPERLINK("' || iri || '", "Customer#' END || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '")' AS hyperlink
FROM m UNION ALL SELECT c_custkey, c_name, c_name, c_name FROM customer""")
def linked_values(t):
    concept = skos.concept_iri(F.col("c_name"), Settings())
    values = t.customer.select("c_custkey", F.explode(F.array(concept, F.col("c_name"))).alias("value"))
    return table_view.linked_values(skos.skos_quads(term_mapping(t), GRAPH, _CREATED), values)
