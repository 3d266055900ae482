"""Graphs built from the given tables: rows, groups, templates, vocabulary, metadata, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegraph import vocab as V
from tablegraph.config import Group, GraphSpec, Settings
from tablegraph.operators import prefixes, publish, quads, skos
from tablegraph.plans.registry import query
from tablegraph.session import checkpoint
from tablegraph.sinks import text as out
from tablegraph.sources import nquads

EX = Settings().namespace
GRAPH = "https://data.example.org/graph/customers"
NS = "https://data.example.org/customers/"
MAP = "Term string, URI string, `RDF Role` string"


def duck_fact(s, p, o, kind="lit", dt=None, s_kind="iri", lang=None) -> str:
    """SELECT list of one statement for the SQL side."""
    if kind == "lit" and dt is None:
        dt = f"'{V.RDF}langString'" if lang else f"'{V.XSD}string'"
    return (f"{s} AS s, '{s_kind}' AS s_kind, {p} AS p, {o} AS o, '{kind}' AS o_kind, "
            f"{dt or 'NULL'} AS o_datatype, {repr(lang) if lang else 'NULL'} AS o_lang")


def duck_quads(graph: str, facts: list[tuple[str, str]]) -> str:
    """UNION of ``(select list, from clause)`` facts in one graph; null objects left out."""
    parts = " UNION ALL ".join(f"SELECT {body} FROM {source}" for body, source in facts)
    return f"SELECT DISTINCT {graph} AS g, * FROM ({parts}) WHERE o IS NOT NULL AND s IS NOT NULL"


def q(text: str) -> str:
    return f"'{text}'"


def customer_mapping(t):
    """Mapping of the customer table: segments to concepts, one predicate."""
    seg = F.col("c_mktsegment")
    iri = F.concat(F.lit("<http://voc.example.org/"), F.lower(seg), F.lit(">"))
    objects = t.customer.select(
        F.lower(seg).alias("Term"),
        F.when(seg == "HOUSEHOLD", "No Match").otherwise(iri).alias("URI"),
        F.lit("object").alias("RDF Role")).distinct()
    heads = t.spark.createDataFrame(
        [("c_acctbal", "http://voc.example.org/balance", "predicate"),
         ("c_name", "no iri", "predicate")], MAP)
    return objects.unionByName(heads)


CUSTOMER_SPEC = GraphSpec(GRAPH, "c_custkey", class_iri="http://voc.example.org/Customer")


def customer_rows(t):
    limit = F.concat(F.lit("<= "), F.col("c_nationkey").cast("string"))
    return t.customer.withColumn("limit", limit)


def customer_quads(t):
    return quads.rows_to_quads(customer_rows(t), customer_mapping(t), CUSTOMER_SPEC)


_S = f"'{NS}subjects/' || c_custkey"
_LIMIT = f"'{EX}concepts/limit'"
_NODE = f"'_:b' || md5({_S} || '|' || {_LIMIT} || '|limit|<= ' || c_nationkey)"
_INT, _DEC = f"'{V.XSD}integer'", f"'{V.XSD}decimal'"
_SEG = "CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'http://voc.example.org/' || lower(c_mktsegment) END"
_CLS = "'http://voc.example.org/Customer'"
_HEADS = [("c_name", f"{EX}concepts/c_name"), ("c_nationkey", f"{EX}concepts/c_nationkey"),
          ("c_acctbal", "http://voc.example.org/balance"),
          ("c_mktsegment", f"{EX}concepts/c_mktsegment"), ("limit", f"{EX}concepts/limit")]
CUSTOMER_FACTS = [
    (duck_fact(_S, q(V.RDF_TYPE), _CLS, "iri"), "customer"),
    (duck_fact(_S, q(f"{EX}concepts/c_name"), "c_name"), "customer"),
    (duck_fact(_S, q(f"{EX}concepts/c_nationkey"), "CAST(c_nationkey AS VARCHAR)", dt=_INT), "customer"),
    (duck_fact(_S, q("http://voc.example.org/balance"), "CAST(c_acctbal AS VARCHAR)", dt=_DEC), "customer"),
    (duck_fact(_S, q(f"{EX}concepts/c_mktsegment"), _SEG, "iri"), "customer"),
    (duck_fact(_S, q(f"{EX}concepts/c_mktsegment"),
               "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_mktsegment END"), "customer"),
    (duck_fact(_S, _LIMIT, _NODE, "bnode"), "customer"),
    (duck_fact(_NODE, q(V.RDF_TYPE), q(EX + "QuantitativeValue"), "iri", s_kind="bnode"), "customer"),
    (duck_fact(_NODE, q(EX + "comparator"), "'<='", s_kind="bnode"), "customer"),
    (duck_fact(_NODE, q(EX + "hasValue"), "CAST(c_nationkey AS VARCHAR)", dt=_INT, s_kind="bnode"), "customer"),
    (duck_fact(_CLS, q(V.RDF_TYPE), q(V.RDFS + "Class"), "iri"), "(SELECT 1)"),
    (duck_fact(_CLS, q(V.RDFS_LABEL), "'Customer'"), "(SELECT 1)"),
    *[(duck_fact(q(p), q(V.RDF_TYPE), q(V.RDF_PROPERTY), "iri"), "(SELECT 1)") for _, p in _HEADS],
    *[(duck_fact(q(p), q(V.RDFS_LABEL), q(c)), "(SELECT 1)") for c, p in _HEADS],
]
CUSTOMER_SQL = duck_quads(q(GRAPH), CUSTOMER_FACTS)


@query(CUSTOMER_SQL)
def rows_to_quads(t):
    return customer_quads(t)


@query(CUSTOMER_SQL)
def nquads_round_trip(t):
    back = nquads.parse_lines(out.nquad_lines(customer_quads(t)))
    return back.filter("_corrupt IS NULL").drop("_corrupt")


_TERM_S = "CASE s_kind WHEN 'bnode' THEN s ELSE '<' || s || '>' END"
_TERM_O = f"""CASE WHEN o_kind = 'bnode' THEN o WHEN o_kind = 'iri' THEN '<' || o || '>'
  WHEN o_datatype = '{V.XSD}string' THEN '"' || o || '"' ELSE '"' || o || '"^^<' || o_datatype || '>' END"""


@query(f"""WITH quads AS ({CUSTOMER_SQL})
SELECT {_TERM_S} || ' <' || p || '> ' || {_TERM_O} || ' <' || g || '> .' AS value FROM quads""")
def nquad_lines(t):
    return out.nquad_lines(customer_quads(t))


@query(f"""WITH quads AS ({CUSTOMER_SQL}), x AS (SELECT g, {_TERM_S} AS s, '<' || p || '>' AS p, {_TERM_O} AS o FROM quads)
SELECT '<' || g || '> {{' || chr(10) || '  ' || s || ' ' || string_agg(p || ' ' || o, ' ;' || chr(10) || '    ' ORDER BY p, o)
  || ' .' || chr(10) || '}}' AS value FROM x GROUP BY g, s""")
def trig_blocks(t):
    return out.trig_blocks(checkpoint(customer_quads(t))).select("value")


@query(f"""WITH quads AS ({CUSTOMER_SQL}), x AS (SELECT {_TERM_S} AS s, '<' || p || '>' AS p, {_TERM_O} AS o FROM quads)
SELECT s || ' ' || string_agg(p || ' ' || o, ' ;' || chr(10) || '    ' ORDER BY p, o) || ' .' AS value
FROM x GROUP BY s""")
def turtle_blocks(t):
    return out.turtle_blocks(checkpoint(customer_quads(t)), GRAPH).select("value")


_VALUE_JSON = f"""CASE WHEN o_kind <> 'lit' THEN '{{"@id":"' || o || '"}}'
  WHEN o_datatype = '{V.XSD}string' THEN '{{"@value":"' || o || '"}}'
  ELSE '{{"@value":"' || o || '","@type":"' || o_datatype || '"}}' END"""


@query(f"""WITH quads AS ({CUSTOMER_SQL}), x AS (SELECT g, s,
  CASE WHEN p = '{V.RDF_TYPE}' THEN '@type' ELSE p END AS k,
  CASE WHEN p = '{V.RDF_TYPE}' THEN '"' || o || '"' ELSE {_VALUE_JSON} END AS v FROM quads),
m AS (SELECT g, s, '"' || k || '":[' || string_agg(v, ',' ORDER BY v) || ']' AS m FROM x GROUP BY g, s, k)
SELECT '{{"@id":"' || g || '","@graph":[{{"@id":"' || s || '",' || string_agg(m, ',' ORDER BY m) || '}}]}}' AS value
FROM m GROUP BY g, s""")
def jsonld_lines(t):
    return out.jsonld_lines(checkpoint(customer_quads(t)))


@query(f"""WITH quads AS ({CUSTOMER_SQL}), sp AS (
  SELECT unnest([CASE WHEN s_kind = 'iri' THEN s END, p, CASE WHEN o_kind = 'iri' THEN o END]) AS i FROM quads)
SELECT DISTINCT CASE WHEN contains(i, '#') THEN regexp_extract(i, '^(.*#)', 1)
  ELSE regexp_extract(i, '^(.*/)[^/]+$', 1) END AS namespace FROM sp WHERE i IS NOT NULL
  AND (contains(i, '#') OR regexp_matches(i, '/[^/]+$'))""")
def distinct_namespaces(t):
    return prefixes.distinct_namespaces(customer_quads(t))


# --- groups, templates ---------------------------------------------------------------------

SUPPLIERS = "https://data.example.org/graph/suppliers"
_SN = "'https://shared.example.org/supplier/' || replace(s_name, '#', '_')"
_GN = "'_:b' || md5(s_suppkey || '|group|account')"


def supplier_spec():
    groups = {"account": Group(["s_acctbal", "s_nationkey"], "http://voc.example.org/hasAccount",
                               "http://voc.example.org/Account")}
    return GraphSpec(SUPPLIERS, "s_suppkey", subject_base="https://shared.example.org/supplier/",
                     subject_column="s_name", groups=groups, row_key="row")


@query(duck_quads(q(SUPPLIERS), [
    (duck_fact(_SN, q("http://voc.example.org/hasAccount"), _GN, "bnode"), "supplier"),
    (duck_fact(_GN, q(V.RDF_TYPE), q("http://voc.example.org/Account"), "iri", s_kind="bnode"), "supplier"),
    (duck_fact(_GN, q(EX + "concepts/s_acctbal"), "CAST(s_acctbal AS VARCHAR)", dt=_DEC, s_kind="bnode"), "supplier"),
    (duck_fact(_GN, q(EX + "concepts/s_nationkey"), "CAST(s_nationkey AS VARCHAR)", dt=_INT, s_kind="bnode"), "supplier"),
    *[(duck_fact(q(EX + f"concepts/{c}"), q(V.RDF_TYPE), q(V.RDF_PROPERTY), "iri"), "(SELECT 1)")
      for c in ("s_acctbal", "s_nationkey")],
    *[(duck_fact(q(EX + f"concepts/{c}"), q(V.RDFS_LABEL), q(c)), "(SELECT 1)")
      for c in ("s_acctbal", "s_nationkey")],
]))
def group_nodes(t):
    df = t.supplier.withColumn("row", F.col("s_suppkey"))
    return quads.rows_to_quads(df, t.spark.createDataFrame([], MAP), supplier_spec())


PARTS = "https://data.example.org/graph/parts"
_P = "http://p.example.org/"
_TEMPLATES = [
    {"template_name": "observation", "rdf_type": _P + "Observation", "properties": [
        {"predicate": _P + "observed", "map_type": "Fixed URI", "value": _P + "price"},
        {"predicate": _P + "feature", "map_type": "Column Value (URI)", "value": "iri"},
        {"predicate": _P + "result", "map_type": "Nested Template", "value": "result"}]},
    {"template_name": "result", "rdf_type": _P + "Result", "properties": [
        {"predicate": _P + "number", "map_type": "Column Value (Literal)", "value": "p_retailprice"},
        {"predicate": _P + "unit", "map_type": "Fixed URI", "value": _P + "PPB"}]}]
_PS = "'https://data.example.org/parts/subjects/' || p_partkey"
_PN = "'_:b' || md5(p_partkey || '|/observation.2')"
_PROPS = ["observed", "feature", "result", "number", "unit"]
_COLS = ["p_retailprice", "iri"]


@query(duck_quads(q(PARTS), [
    (duck_fact(_PS, q(V.RDF_TYPE), q(_P + "Observation"), "iri"), "part"),
    (duck_fact(_PS, q(_P + "observed"), q(_P + "price"), "iri"), "part"),
    (duck_fact(_PS, q(_P + "feature"), "'http://f/' || p_partkey", "iri"), "part"),
    (duck_fact(_PS, q(_P + "result"), _PN, "bnode"), "part"),
    (duck_fact(_PN, q(V.RDF_TYPE), q(_P + "Result"), "iri", s_kind="bnode"), "part"),
    (duck_fact(_PN, q(_P + "number"), "CAST(p_retailprice AS VARCHAR)", dt=_DEC, s_kind="bnode"), "part"),
    (duck_fact(_PN, q(_P + "unit"), q(_P + "PPB"), "iri", s_kind="bnode"), "part"),
    *[(duck_fact(q(_P + x), q(V.RDF_TYPE), q(V.RDF_PROPERTY), "iri"), "(SELECT 1)") for x in _PROPS],
    *[(duck_fact(q(_P + x), q(V.RDFS_LABEL), q("the unit" if x == "unit" else x)), "(SELECT 1)") for x in _PROPS],
    *[(duck_fact(q(EX + "concepts/" + x), q(V.RDF_TYPE), q(V.RDF_PROPERTY), "iri"), "(SELECT 1)") for x in _COLS],
    *[(duck_fact(q(EX + "concepts/" + x), q(V.RDFS_LABEL), q(x)), "(SELECT 1)") for x in _COLS],
]))
def template_quads(t):
    key = F.col("p_partkey").cast("string")
    df = t.part.select("p_partkey", key.alias("row"), "p_retailprice",
                       F.concat(F.lit("<http://f/"), key, F.lit(">")).alias("iri"))
    mapping = t.spark.createDataFrame([("the unit", _P + "unit", "predicate")], MAP)
    spec = GraphSpec(PARTS, "p_partkey", templates=_TEMPLATES, active_template="observation",
                     row_key="row")
    return quads.rows_to_quads(df, mapping, spec)


@query("""
SELECT count(*) AS rows, count_if(o_orderstatus = 'P') AS rejected FROM orders
""")
def rejected_rows(t):
    odd = F.when(F.col("o_orderstatus") == "P", F.lit(" !? ")).otherwise(F.col("o_orderkey").cast("string"))
    return quads.rejected_rows(t.orders.withColumn("id", odd), GraphSpec(GRAPH, "id"))


# --- vocabulary ----------------------------------------------------------------------------


def term_mapping(t):
    """Reconciled mapping with customer names as terms."""
    key = F.col("c_custkey").cast("string")
    seg = F.col("c_mktsegment")
    match = F.when(seg == "BUILDING", "skos:exactMatch").when(seg == "MACHINERY", "SKOS:closeMatch")
    return t.customer.select(
        F.concat(F.lit(" "), "c_name").alias("Term"),
        F.concat(F.lit("<http://ext/"), key, F.lit(">")).alias("URI"),
        F.lit("object").alias("RDF Role"),
        match.when(seg == "FURNITURE", "skos:broadMatch").otherwise("").alias("Match Type"),
        F.lower("c_name").alias("Provider Term"), seg.alias("Provider Description"),
        F.when(F.col("c_nationkey") > 12, F.concat(F.lit("label "), key)).alias("label"),
        F.lit("OLS").alias("source"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("https://ui/"), key)).alias("ui_link"))


_C = f"'{EX}concepts/' || replace(c_name, '#', '_')"
_CREATED = "2024-01-01T00:00:00"
_MATCHED = "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'http://ext/' || c_custkey END"
SKOS_FACTS = [
    (duck_fact(q(EX + "concept-scheme"), q(V.RDF_TYPE), q(V.SKOS + "ConceptScheme"), "iri"), "(SELECT 1)"),
    (duck_fact(q(EX + "concept-scheme"), q(V.RDFS_LABEL), "'Concept Scheme from Mapping Table'"), "(SELECT 1)"),
    (duck_fact(_C, q(V.RDF_TYPE), q(V.SKOS + "Concept"), "iri"), "customer"),
    (duck_fact(_C, q(V.SKOS + "inScheme"), q(EX + "concept-scheme"), "iri"), "customer"),
    (duck_fact(_C, q(V.PREF_LABEL), "c_name"), "customer"),
    (duck_fact(_C, q(V.DCT + "created"), q(_CREATED), dt=f"'{V.XSD}dateTime'"), "customer"),
    (duck_fact(_C, q(V.VOID + "inDataset"), q(GRAPH), "iri"), "customer"),
    (duck_fact(_C, q(V.ALT_LABEL), "lower(c_name)"), "customer"),
    (duck_fact(_C, q(V.SKOS + "definition"),
               "CASE WHEN c_nationkey > 12 THEN 'label ' || c_custkey ELSE c_mktsegment END"), "customer"),
    (duck_fact(_C, q(V.DCT + "source"), "'OLS'"), "customer"),
    (duck_fact(_C, q(V.RDFS_SEE_ALSO), "CASE WHEN c_acctbal > 0 THEN 'https://ui/' || c_custkey END", "iri"), "customer"),
    (duck_fact(_C, q(V.RDFS_SEE_ALSO), _MATCHED, "iri"), "customer"),
    (duck_fact(_C, q(V.EXACT_MATCH), "CASE WHEN c_mktsegment = 'BUILDING' THEN 'http://ext/' || c_custkey END", "iri"), "customer"),
    (duck_fact(_C, q(V.CLOSE_MATCH), "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'http://ext/' || c_custkey END", "iri"), "customer"),
]


@query(duck_quads(q(Settings().terms_graph), SKOS_FACTS))
def skos_quads(t):
    return skos.skos_quads(term_mapping(t), GRAPH, _CREATED)


@query(f"SELECT DISTINCT c_name AS term, {_C} AS concept_iri FROM customer")
def term_lookup(t):
    return skos.term_lookup(term_mapping(t))


@query(f"""WITH d AS ({CUSTOMER_SQL}), v AS ({duck_quads(q(Settings().terms_graph), SKOS_FACTS)})
SELECT g, count(*) AS quads FROM (SELECT * FROM d UNION SELECT * FROM v) GROUP BY g""")
def union_graphs(t):
    merged = quads.union_graphs(customer_quads(t), skos.skos_quads(term_mapping(t), GRAPH, _CREATED),
                                customer_quads(t))
    return merged.groupBy("g").agg(F.count(F.lit(1)).alias("quads"))


# --- prefixes ------------------------------------------------------------------------------

_HOSTS = """cat AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/)', 1) AS namespace FROM pages
 UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[a-z]+/)', 1) FROM pages WHERE contains(url, 'https'))"""


def page_catalogue(t):
    """Namespaces that occur in the page addresses, one prefix each: host and language level."""
    host = F.regexp_extract("url", r"^(https?://[^/]+/)", 1)
    level = F.regexp_extract("url", r"^(https?://[^/]+/[a-z]+/)", 1)
    spaces = t.pages.select(host.alias("namespace")).unionByName(
        t.pages.filter(F.col("url").contains("https")).select(level.alias("namespace"))).distinct()
    prefix = F.concat(F.lit("p"), F.substring(F.md5("namespace"), 1, 12))
    return spaces.select("namespace", prefix.alias("prefix"), F.lit(0).cast("long").alias("ord"))


def _page_iris(t):
    return t.pages.select(F.col("url").alias("iri")).distinct()


_LONGEST = f"""{_HOSTS}, hit AS (SELECT DISTINCT url AS iri, arg_max(namespace, length(namespace)) AS namespace
 FROM pages JOIN cat ON starts_with(url, namespace) GROUP BY url)"""


@query(f"WITH {_LONGEST} SELECT iri, namespace FROM hit")
def longest_namespace(t):
    return prefixes.longest_namespace(_page_iris(t), page_catalogue(t))


# Longest common prefix of the smallest and largest IRI of a group.
_LCP = """(SELECT coalesce(max(i), 0) FROM generate_series(1, least(length(lo), length(hi))) AS g(i)
  WHERE substr(lo, 1, i) = substr(hi, 1, i))"""
_BOUND = f"""{_LONGEST}, ends AS (SELECT namespace, min(iri) AS lo, max(iri) AS hi FROM hit GROUP BY namespace),
base AS (SELECT namespace, lo, hi, substr(lo, 1, CAST({_LCP} AS INTEGER)) AS b FROM ends),
bound AS (SELECT namespace, CASE WHEN lo <> hi AND length(b) > length(namespace)
  THEN regexp_extract(b, '^(.*[/#])', 1) ELSE namespace END AS bound FROM base)"""


@query(f"WITH {_BOUND} SELECT namespace, bound FROM bound")
def common_namespace(t):
    return prefixes.common_namespace(prefixes.longest_namespace(_page_iris(t), page_catalogue(t)))


@query(f"WITH {_BOUND} SELECT 'p' || substr(md5(namespace), 1, 12) AS prefix, bound AS namespace FROM bound")
def used_prefixes(t):
    return prefixes.used_prefixes(_page_iris(t), page_catalogue(t))


_CHOICES = ["en", "fr", "de", "e", "example"]


@query(f"""WITH spaces AS (SELECT url AS iri, regexp_extract(url, '^(https?://[^/]+/)', 1) AS namespace FROM pages),
opts AS (SELECT DISTINCT namespace, prefix, ord FROM spaces,
  (VALUES {', '.join(f"('{p}', {i})" for i, p in enumerate(_CHOICES))}) AS v(prefix, ord)),
scored AS (SELECT o.namespace, o.prefix, o.ord,
  (SELECT count(DISTINCT s.iri) FROM spaces s WHERE s.namespace = o.namespace
    AND starts_with(lower(substr(s.iri, length(o.namespace) + 1)), o.prefix)) AS score FROM opts o),
best AS (SELECT *, max(score) OVER (PARTITION BY namespace) AS top FROM scored),
kept AS (SELECT * FROM best WHERE CASE WHEN top > 0 THEN score > 0
  ELSE contains(regexp_extract(namespace, '//([^/]+)', 1), prefix) END),
placed AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY score DESC, length(prefix) DESC, ord) AS i FROM kept)
SELECT namespace, prefix FROM placed WHERE i = 1""")
def prefix_choice(t):
    host = F.regexp_extract("iri", r"^(https?://[^/]+/)", 1)
    groups = _page_iris(t).withColumn("namespace", host)
    options = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(i).cast("long").alias("ord"))
                        for i, p in enumerate(_CHOICES)])
    catalogue = groups.select("namespace").distinct().select("namespace", F.inline(options))
    return prefixes.prefix_choice(groups, catalogue)


@query("""SELECT DISTINCT 'http://ext/' || c_custkey AS iri FROM customer
UNION SELECT url FROM pages UNION SELECT 'http://cfg.example.org/x'""")
def used_iris(t):
    data = t.pages.select(F.concat(F.lit("<"), "url", F.lit("> and more")).alias("note"), "page_id")
    return prefixes.used_iris(term_mapping(t), data, ["http://cfg.example.org/x"])


# --- catalogue and publications ------------------------------------------------------------

_NG = "'https://data.example.org/graph/n' || n_nationkey || '/'"


def _nation_quads(t):
    g = F.concat(F.lit("https://data.example.org/graph/n"), F.col("c_nationkey").cast("string"), F.lit("/"))
    s = F.concat(F.lit("http://c/"), F.col("c_custkey").cast("string"))
    return quads.explode_facts(t.customer, g, [
        quads.fact(s, V.RDFS_LABEL, F.col("c_name")),
        quads.fact(s, V.SKOS + "note", F.col("c_mktsegment"), lang="en")])


_BYTES = f"""sizes AS (SELECT c_nationkey, sum(
  octet_length(encode('<http://c/' || c_custkey || '> <{V.RDFS_LABEL}> "' || c_name || '" <https://data.example.org/graph/n' || c_nationkey || '/> .')) + 1
  + octet_length(encode('<http://c/' || c_custkey || '> <{V.SKOS}note> "' || c_mktsegment || '"@en <https://data.example.org/graph/n' || c_nationkey || '/> .')) + 1
 ) AS bytes FROM customer GROUP BY c_nationkey)"""


@query(f"WITH {_BYTES} SELECT 'https://data.example.org/graph/n' || c_nationkey || '/' AS g, CAST(bytes AS BIGINT) AS bytes FROM sizes")
def graph_byte_size(t):
    return publish.graph_byte_size(_nation_quads(t))


_D, _DI = f"{_NG} || 'dataset/main'", f"{_NG} || 'distribution/main'"
_CAT, _ORG = q(EX + "catalog"), "'http://org/' || n_regionkey"
_MAIL = f"'_:b' || md5({_NG} || '|mail' || n_nationkey || '@example.org')"
_DATE = f"'{V.XSD}date'"
_LIC = "'http://creativecommons.org/publicdomain/zero/1.0/'"
_FROM = "nation JOIN sizes ON c_nationkey = n_nationkey"
_DCAT_SQL = duck_quads(q(EX + "graph/dcat-metadata"), [
    (duck_fact(s, q(p), o, **kw), _FROM) for s, p, o, kw in [
        (_CAT, V.RDF_TYPE, q(V.DCAT + "Catalog"), {"kind": "iri"}),
        (_CAT, V.DCT + "title", "'Data Catalog'", {"lang": "en"}),
        (_CAT, V.DCT + "publisher", _ORG, {"kind": "iri"}),
        (_CAT, V.DCAT + "dataset", _D, {"kind": "iri"}),
        (_CAT, V.DCT + "description", "'This catalog describes the published datasets.'", {"lang": "en"}),
        (_CAT, V.DCT + "issued", "'2024-01-01'", {"dt": _DATE}),
        (_ORG, V.RDF_TYPE, q(V.FOAF + "Organization"), {"kind": "iri"}),
        (_ORG, V.FOAF + "name", "'Org ' || n_regionkey", {}),
        (_D, V.RDF_TYPE, q(V.DCAT + "Dataset"), {"kind": "iri"}),
        (_D, V.DCT + "title", "n_name", {"lang": "en"}),
        (_D, V.DCT + "description", "'about ' || n_name", {"lang": "en"}),
        (_D, V.DCT + "publisher", _ORG, {"kind": "iri"}),
        (_D, V.DCT + "issued", "'2024-01-01'", {"dt": _DATE}),
        (_D, V.DCT + "modified", "'2024-01-01'", {"dt": _DATE}),
        (_D, V.DCT + "license", _LIC, {"kind": "iri"}),
        (_D, V.DCAT + "distribution", _DI, {"kind": "iri"}),
        (_D, V.DCT + "identifier", "CASE WHEN n_nationkey > 9 THEN 'id ' || n_nationkey END", {}),
        (_D, V.DCT + "accessRights", "'http://publications.europa.eu/resource/authority/access-right/PUBLIC'", {"kind": "iri"}),
        (_D, V.DCAT + "contactPoint", _MAIL, {"kind": "bnode"}),
        (_MAIL, V.RDF_TYPE, q(V.VCARD + "Individual"), {"kind": "iri", "s_kind": "bnode"}),
        (_MAIL, V.VCARD + "hasEmail", "'mail' || n_nationkey || '@example.org'", {"s_kind": "bnode"}),
        (_DI, V.RDF_TYPE, q(V.DCAT + "Distribution"), {"kind": "iri"}),
        (_DI, V.DCAT + "accessURL", _NG, {"kind": "iri"}),
        (_DI, V.DCT + "title", "'Distribution of ' || n_name || ' in nquads format'", {"lang": "en"}),
        (_DI, V.DCT + "license", _LIC, {"kind": "iri"}),
        (_DI, V.DCAT + "mediaType", "'http://www.iana.org/assignments/media-types/application/n-quads'", {"kind": "iri"}),
        (_DI, V.DCAT + "byteSize", "CAST(CAST(bytes AS BIGINT) AS VARCHAR)", {"dt": _DEC}),
        (_D, V.DCAT + "keyword", "'region ' || n_regionkey", {"lang": "en"}),
        (_D, V.DCAT + "keyword", "n_name", {"lang": "en"}),
        (_D, V.DCT + "creator", "'Author, ' || n_name", {}),
        (_D, V.DCAT + "theme", q(publish.THEMES["ENER – Energy"]), {"kind": "iri"}),
    ]])


@query(f"WITH {_BYTES} {_DCAT_SQL}")
def dcat_quads(t):
    key = F.col("n_nationkey").cast("string")
    region = F.col("n_regionkey").cast("string")
    sets = t.nation.select(
        F.concat(F.lit("https://data.example.org/graph/n"), key, F.lit("/")).alias("graph"),
        F.col("n_name").alias("title"), F.concat(F.lit("about "), "n_name").alias("description"),
        F.array(F.concat(F.lit("region "), region), F.col("n_name")).alias("keywords"),
        F.when(F.col("n_nationkey") > 9, F.concat(F.lit("id "), key)).otherwise("").alias("identifier"),
        F.array(F.concat(F.lit("Author, "), "n_name")).alias("creator"),
        F.lit("PUBLIC").alias("access_rights"),
        F.concat(F.lit("mail"), key, F.lit("@example.org")).alias("contact_point"),
        F.concat(F.lit("Org "), region).alias("publisher_name"),
        F.concat(F.lit("http://org/"), region).alias("publisher_uri"),
        F.array(F.lit("ENER – Energy"), F.lit("unknown")).alias("themes"),
        F.lit("CC0 1.0").alias("license"))
    return publish.dcat_quads(sets, _nation_quads(t), "2024-01-01")


def document_works(t):
    """Documents packed as publication metadata bodies."""
    key = F.col("doc_id").cast("string")
    cross = F.to_json(F.struct(
        F.concat(F.lit("10.5555/"), key).alias("DOI"),
        F.array(F.concat(F.lit("Document "), key)).alias("title"), F.col("text").alias("abstract"),
        F.array(F.struct(F.col("lang").alias("given"), F.col("source").alias("family"))).alias("author"),
        F.col("source").alias("container-title"),
        F.struct(F.array(F.array(F.lit(2020), F.lit(5))).alias("date-parts")).alias("published-online"),
        F.concat(F.lit("1-"), F.col("n_chars").cast("string")).alias("page"),
        F.lit("article").alias("type"),
        F.array(F.struct(F.col("lang").alias("name"))).alias("funder"),
        F.array(F.struct(F.concat(F.lit("10.5555/"), (F.col("doc_id") + 1).cast("string")).alias("DOI"),
                         F.lit("1999").alias("year"))).alias("reference")))
    labelled = t.spread("documents").join(t.labels, "doc_id", "left")
    index = F.to_json(F.struct(
        F.col("quality").alias("cited_by_count"),
        F.array(F.struct(F.col("lang").alias("display_name"), F.col("toxic").alias("level"))).alias("concepts")))
    return labelled.select(F.concat(F.lit("10.5555/"), key).alias("doi"), cross.alias("crossref"),
                           index.alias("openalex"))


def _h(kind, letter, text):
    return f"'https://semopenalex.org/{kind}/{letter}' || upper(md5({text}))"


_W = _h("work", "W", "'10.5555/' || doc_id")
_AU = "lang || ' ' || source"
_A, _AS = _h("author", "A", _AU), _h("authorship", "AS", f"{_W} || {_AU}")
_SO, _LO = _h("source", "S", "source"), _h("location", "L", f"{_W} || source")
_OA, _FU = _h("openaccess", "OA", _W), _h("funder", "F", "lang")
_RE, _CO = _h("work", "W", "'10.5555/' || (doc_id + 1)"), _h("concept", "C", "lang")
_BOOL = f"'{V.XSD}boolean'"
_PUBLICATION = duck_quads(q(EX + "graph/publication-reference"), [
    (duck_fact(s, q(p), o, **kw), "docs") for s, p, o, kw in [
        (_W, V.RDF_TYPE, q(V.SOA + "Work"), {"kind": "iri"}),
        (_W, V.DCT + "title", "'Document ' || doc_id", {"lang": "en"}),
        (_W, V.DCT + "abstract", "text", {"lang": "en"}),
        (_W, V.PRISM + "doi", "'https://doi.org/10.5555/' || doc_id", {"kind": "iri"}),
        (_W, V.PRISM + "publicationDate", "'2020-05-01'", {"dt": _DATE}),
        (_W, V.FABIO + "hasPublicationYear", "'2020'", {"dt": _INT}),
        (_W, V.PRISM + "startingPage", "'1'", {}),
        (_W, V.PRISM + "endingPage", "CAST(n_chars AS VARCHAR)", {}),
        (_W, V.SOA + "crossrefType", "'article'", {}), (_W, V.SOA + "workType", "'article'", {}),
        (_W, V.SOA + "isParatext", "'false'", {"dt": _BOOL}),
        (_W, V.SOA + "isRetracted", "'false'", {"dt": _BOOL}),
        (_W, V.DCT + "created", "'2024-01-01'", {"dt": _DATE}),
        (_W, V.DCT + "modified", "'2024-01-01'", {"dt": _DATE}),
        (_W, V.SOA + "citedByCount", "CAST(coalesce(quality, 0) AS VARCHAR)", {"dt": _INT}),
        (_A, V.RDF_TYPE, q(V.SOA + "Author"), {"kind": "iri"}), (_A, V.FOAF + "name", _AU, {}),
        (_AS, V.RDF_TYPE, q(V.SOA + "Authorship"), {"kind": "iri"}),
        (_AS, V.SOA + "hasAuthor", _A, {"kind": "iri"}),
        (_AS, V.SOA + "position", "'1'", {"dt": _INT}),
        (_AS, V.SOA + "isCorresponding", "'true'", {"dt": _BOOL}),
        (_W, V.SOA + "hasAuthorship", _AS, {"kind": "iri"}), (_W, V.DCT + "creator", _A, {"kind": "iri"}),
        (_SO, V.RDF_TYPE, q(V.SOA + "Source"), {"kind": "iri"}), (_SO, V.FOAF + "name", "source", {}),
        (_SO, V.SOA + "sourceType", "'journal'", {}),
        (_LO, V.RDF_TYPE, q(V.SOA + "Location"), {"kind": "iri"}),
        (_LO, V.SOA + "hasSource", _SO, {"kind": "iri"}),
        (_W, V.SOA + "hasPrimaryLocation", _LO, {"kind": "iri"}),
        (_W, V.SOA + "hasLocation", _LO, {"kind": "iri"}),
        (_OA, V.RDF_TYPE, q(V.SOA + "OpenAccess"), {"kind": "iri"}),
        (_OA, V.SOA + "isOa", "'false'", {"dt": _BOOL}), (_OA, V.SOA + "oaStatus", "'closed'", {}),
        (_W, V.SOA + "hasOpenAccess", _OA, {"kind": "iri"}),
        (_FU, V.RDF_TYPE, q(V.SOA + "Funder"), {"kind": "iri"}), (_FU, V.FOAF + "name", "lang", {}),
        (_W, V.SOA + "hasFunder", _FU, {"kind": "iri"}),
        (_W, V.CITO + "cites", _RE, {"kind": "iri"}), (_RE, V.RDF_TYPE, q(V.SOA + "Work"), {"kind": "iri"}),
        (_RE, V.PRISM + "doi", "'10.5555/' || (doc_id + 1)", {}),
        (_RE, V.DCT + "identifier", "'https://doi.org/10.5555%2F' || (doc_id + 1)", {"kind": "iri"}),
        (_RE, V.DCT + "date", "'1999'", {}),
        (_CO, V.RDF_TYPE, q(V.SOA + "Concept"), {"kind": "iri"}), (_CO, V.PREF_LABEL, "lang", {}),
        (_CO, V.SOA + "level", "CAST(toxic AS VARCHAR)", {"dt": _INT}),
        (_W, V.SOA + "hasConcept", _CO, {"kind": "iri"}),
    ]])


@query(f"WITH docs AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) {_PUBLICATION}")
def publication_quads(t):
    return publish.publication_quads(publish.parse_works(document_works(t)), "2024-01-01")


@query(f"""SELECT 'https://data.example.org/graph/docs' AS s, min({_W}) AS o FROM documents""")
def link_dataset_to_publication(t):
    works = publish.publication_quads(publish.parse_works(document_works(t)), "2024-01-01")
    return publish.link_dataset_to_publication("https://data.example.org/graph/docs", works).select("s", "o")


_MW = _h("work", "W", "'Order ' || o_orderkey")
_MA = "'Ann ' || o_orderpriority"


@query(f"""WITH m AS (SELECT *, {_MW} AS w FROM orders WHERE o_orderstatus <> 'P')
SELECT w AS s, '{V.DCT}title' AS p, 'Order ' || o_orderkey AS o FROM m
UNION ALL SELECT w, '{V.PRISM}publicationDate', strftime(o_orderdate, '%Y') || '-01-01' FROM m
UNION ALL SELECT w, '{V.SOA}hasVolume', CAST(o_custkey AS VARCHAR) FROM m
UNION ALL SELECT w, '{V.DCT}creator', {_h('author', 'A', _MA)} FROM m
UNION ALL SELECT w, '{V.DCT}creator', {_h('author', 'A', "'Bo B. Lee'")} FROM m""")
def manual_works(t):
    year = F.year("o_orderdate")
    authors = F.concat("o_orderpriority", F.lit(", Ann; Bo B. Lee"))
    rows = t.orders.select(
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        authors.alias("authors"), F.when(F.col("o_orderstatus") != "P", "J").otherwise("").alias("journal"),
        year.alias("year"), F.col("o_custkey").cast("string").alias("volume"), F.lit("").alias("pages"),
        F.lit("").alias("doi"))
    out_ = publish.publication_quads(publish.manual_works(rows), "2024-01-01", parts="core")
    wanted = [V.DCT + "title", V.PRISM + "publicationDate", V.SOA + "hasVolume", V.DCT + "creator"]
    return out_.filter(F.col("p").isin(wanted)).select("s", "p", "o")
