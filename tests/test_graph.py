"""Tables to quads, vocabulary, catalogue and publication graphs, and back to tables."""

import json

import pytest
from pyspark.sql import functions as F

from tablegraph import vocab as V
from tablegraph.config import Group, GraphSpec, Settings
from tablegraph.functions import text as T
from tablegraph.operators import prefixes, publish, quads, skos, table_view
from tablegraph.sinks import text as out
from tablegraph.sources import nquads
from tests.test_terms import rows

G = "https://data.org/graph/dagta"
NS = "https://data.org/dagta/"
EX = "https://example.org/"
MAP = "Term string, URI string, `RDF Role` string"


def mapping(spark, data=()):
    return spark.createDataFrame(list(data), MAP)


def spo(df):
    return {(r.s, r.p, r.o) for r in df.collect()}


def test_plain_rows(spark):
    df = spark.createDataFrame(
        [("1", "red", "<=5", "ja", "http://z"), ("2", " RED ", "2,5", None, ""),
         ("!!", "x", "1", "x", "x"), (None, "x", "1", "x", "x")],
        "id string, colour string, size string, ok string, `Ort` string")
    m = mapping(spark, [("Red", "<http://x/red>", "object"), ("red", "http://later", "object"),
                        ("size", "http://x/size", " Predicate "), ("ok", "no iri", "predicate")])
    m = m.withColumn("row_id", F.monotonically_increasing_id())
    spec = GraphSpec(G, "id", class_iri="http://x/Thing", column_order=True)
    q = quads.rows_to_quads(df, m, spec)
    got = spo(q)
    s1, s2 = NS + "subjects/1", NS + "subjects/2"
    bnode = [r.o for r in q.filter("o_kind = 'bnode'").collect()][0]
    data = {t for t in got if t[0] in (s1, s2, bnode)}
    assert data == {
        (s1, V.RDF_TYPE, "http://x/Thing"), (s2, V.RDF_TYPE, "http://x/Thing"),
        (s1, EX + "concepts/colour", "http://x/red"), (s2, EX + "concepts/colour", "http://x/red"),
        (s1, "http://x/size", bnode), (s2, "http://x/size", "2.5"),
        (s1, EX + "concepts/ok", "true"), (s1, EX + "concepts/Ort", "http://z"),
        (bnode, V.RDF_TYPE, EX + "QuantitativeValue"), (bnode, EX + "comparator", "<="),
        (bnode, EX + "hasValue", "5")}
    assert ("http://x/Thing", V.RDFS_LABEL, "Thing") in got
    assert ("http://x/size", V.RDFS_LABEL, "size") in got
    assert (NS + "columns/size", V.SCHEMA + "position", "2") in got
    assert rows(quads.rejected_rows(df, spec)) == [(4, 2)]
    kinds = {(r.o, r.o_datatype) for r in q.filter(F.col("s") == s2).collect()}
    assert ("2.5", V.XSD + "decimal") in kinds
    concepts = spark.createDataFrame(
        [("red", EX + "concepts/red"), ("size", EX + "concepts/size")],
        "term string, concept_iri string")
    got = spo(quads.rows_to_quads(df, m, spec, concepts=concepts))
    assert (s1, EX + "concepts/colour", EX + "concepts/red") in got
    assert (s2, EX + "concepts/colour", "http://x/red") in got
    assert (s2, EX + "concepts/size", "2.5") in got
    shared = GraphSpec(G, "id", subject_base="https://b/", subject_column="colour")
    assert {s for s, _, _ in spo(quads.rows_to_quads(df, m, shared)) if s.startswith("https://b")} == {
        "https://b/red", "https://b/RED", "https://b/x"}
    assert not quads.graph_is_empty(q, G) and quads.graph_is_empty(q, "http://none")


def test_groups(spark):
    df = spark.createDataFrame([("1", "a", "b", "c"), ("1", "a", "z", None)],
                               "id string, x string, y string, z string")
    spec = GraphSpec(G, "id", groups={
        "g1": Group(["x", "y"], "http://p/has", "http://t/G"), "bad": Group([], "http://p")})
    q = quads.rows_to_quads(df, mapping(spark), spec)
    links = q.filter("p = 'http://p/has'").collect()
    assert len({r.o for r in links}) == 2  # same subject, two rows, two nodes
    node = links[0].o
    assert {r.p for r in q.filter(F.col("s") == node).collect()} == {
        V.RDF_TYPE, EX + "concepts/x", EX + "concepts/y"}
    assert rows(q.filter("p = 'https://example.org/concepts/z'"), "s") == [(NS + "subjects/1",)]


TEMPLATES = [
    {"template_name": "obs", "rdf_type": "http://www.w3.org/ns/sosa/Observation", "properties": [
        {"predicate": "http://p/observedProperty", "map_type": "Fixed URI", "value": "http://v/DON"},
        {"predicate": "http://p/feature", "map_type": "Column Value (URI)", "value": "sample"},
        {"predicate": "http://p/hasResult", "map_type": "Nested Template", "value": "res"},
        {"predicate": "http://p/none", "map_type": "Nested Template", "value": "missing"}]},
    {"template_name": "res", "rdf_type": "http://v/Concentration", "properties": [
        {"predicate": "http://p/numericValue", "map_type": "Column Value (Literal)", "value": "level"},
        {"predicate": "http://p/unit", "map_type": "Fixed URI", "value": "http://v/PPB"}]}]


def test_templates(spark):
    df = spark.createDataFrame([("1", "http://s/1", "2,5"), ("2", "http://s/2", "7")],
                               "id string, sample string, level string")
    spec = GraphSpec(G, "id", templates=TEMPLATES, active_template="obs", class_iri="http://c")
    q = quads.rows_to_quads(df, mapping(spark, [("my unit", "http://p/unit", "predicate")]), spec)
    s = NS + "subjects/1"
    node = q.filter((F.col("s") == s) & (F.col("o_kind") == "bnode")).first().o
    assert {t for t in spo(q) if t[0] in (s, node)} == {
        (s, V.RDF_TYPE, TEMPLATES[0]["rdf_type"]), (s, "http://p/observedProperty", "http://v/DON"),
        (s, "http://p/feature", "http://s/1"), (s, "http://p/hasResult", node),
        (node, V.RDF_TYPE, "http://v/Concentration"), (node, "http://p/numericValue", "2.5"),
        (node, "http://p/unit", "http://v/PPB")}
    labels = {(r.s, r.o) for r in q.filter(F.col("p") == V.RDFS_LABEL).collect()}
    assert {("http://p/unit", "my unit"), ("http://p/none", "none")} <= labels
    loop = [{"template_name": "a", "properties": [
        {"predicate": "http://p", "map_type": "Nested Template", "value": "a"}]}]
    with pytest.raises(ValueError):
        quads.rows_to_quads(df, mapping(spark), GraphSpec(G, "id", templates=loop, active_template="a"))


def test_skos(spark):
    m = spark.createDataFrame(
        [("Größe", "http://x/size", "predicate", "skos:exactMatch", "size", "d", "lab", "OLS", "http://u"),
         ("!!", "http://y", "object", "skos:broadMatch", None, "desc", None, None, "bad"),
         (" ", "http://z", "object", "", None, None, None, None, None)],
        MAP + ", `Match Type` string, `Provider Term` string, `Provider Description` string, "
        "label string, source string, ui_link string")
    q = skos.skos_quads(m, G, "2024-01-01T00:00:00")
    c = EX + "concepts/Groesse"
    assert {(p, o) for s, p, o in spo(q) if s == c} == {
        (V.RDF_TYPE, V.SKOS + "Concept"), (V.SKOS + "inScheme", EX + "concept-scheme"),
        (V.PREF_LABEL, "Größe"), (V.DCT + "created", "2024-01-01T00:00:00"),
        (V.VOID + "inDataset", G), (V.ALT_LABEL, "size"), (V.SKOS + "definition", "lab"),
        (V.DCT + "source", "OLS"), (V.RDFS_SEE_ALSO, "http://u"),
        (V.RDFS_SEE_ALSO, "http://x/size"), (V.EXACT_MATCH, "http://x/size")}
    other = [s for s, p, o in spo(q) if p == V.PREF_LABEL and o == "!!"][0]
    assert other.startswith(EX + "concepts/concept_")
    assert (other, V.RDFS_SEE_ALSO, "http://y") in spo(q)
    assert rows(skos.term_lookup(m), "term") == [("!!",), ("Größe",)]


def round_trip_input(spark):
    df = spark.createDataFrame(
        [(f"r{i}", f"name {i}", str(i), None if i % 3 else "x") for i in range(9)],
        "id string, Name string, Number string, Rare string")
    return df, quads.rows_to_quads(df, mapping(spark), GraphSpec(G, "id"))


def test_round_trip(spark):
    df, q = round_trip_input(spark)
    table = table_view.quads_to_table(q)
    assert table.columns == ["subject", "pos", "Name", "Number", "Rare"]
    assert rows(table, "Name", "Number", "Rare") == rows(df, "Name", "Number", "Rare")
    pivoted = table_view.pivot_subjects(
        table_view.subject_values(q), ["Name", "Number", "Rare"])
    assert rows(pivoted, "Name") == rows(df, "Name")


def test_text_round_trip(spark):
    _, q = round_trip_input(spark)
    odd = spark.createDataFrame(
        [("http://g", "_:b1", "bnode", "http://p", 'a "q" \\ \n\té\U0001F600', "lit", V.XSD + "string", None),
         (None, "http://s", "iri", "http://p", "", "lit", V.RDF + "langString", "en"),
         (None, "http://s", "iri", "http://p", "_:x", "bnode", None, None)], quads.QUAD_SCHEMA)
    all_quads = q.unionByName(odd)
    back = nquads.parse_lines(out.nquad_lines(all_quads))
    assert back.filter("_corrupt is not null").count() == 0
    key = lambda r: tuple(str(x) for x in r)
    cols = quads.QUAD_COLUMNS
    assert sorted(map(key, back.select(cols).collect())) == sorted(map(key, all_quads.select(cols).collect()))
    lines = spark.createDataFrame(
        [("<http://s> <http://p> \"\\u00e9\\U0001F600\"@EN .",), ("# note",), ("",), ("junk",)],
        "value string")
    got = nquads.parse_lines(lines).collect()
    assert [(r.o, r.o_lang, r._corrupt) for r in got] == [("é\U0001F600", "en", None), (None, None, "junk")]
    trig = {r.s: r.value for r in out.trig_blocks(odd.unionByName(odd)).collect()}
    assert trig["_:b1"].startswith("<http://g> {\n  _:b1 <http://p>")
    assert trig["<http://s>"] == '<http://s> <http://p> ""@en ;\n    <http://p> _:x .'
    hot = spark.range(500).select(
        F.lit("g").alias("g"), F.lit("s").alias("s"), F.lit("iri").alias("s_kind"), F.lit("p").alias("p"),
        F.col("id").cast("string").alias("o"), F.lit("lit").alias("o_kind"),
        F.lit(V.XSD + "string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    blocks = out.trig_blocks(hot, block=50).collect()
    assert len(blocks) >= 10 and sum(b.value.count("<p>") for b in blocks) == 500
    turtle = out.turtle_blocks(all_quads, G).collect()
    assert all("{" not in b.value for b in turtle) and len(turtle) > 9
    nodes = [json.loads(r.value) for r in out.jsonld_lines(odd).collect()]
    graph = [n for n in nodes if "@graph" in n][0]
    assert graph["@graph"][0]["http://p"][0]["@value"].startswith('a "q"')
    typed = [json.loads(r.value) for r in out.jsonld_lines(q).collect()]
    assert any(n["@graph"][0].get("@type") == [V.RDF_PROPERTY] for n in typed)


def test_statistics_and_links(spark):
    P = EX + "concepts/name"
    data = [(G, NS + "subjects/1", P, "v1", "lit"), (G, NS + "subjects/1", P, "v2", "lit"),
            (G, NS + "subjects/1", EX + "q", EX + "concepts/red", "iri"),
            (G, NS + "subjects/2", P, "http://m/1", "iri"),
            (G, NS + "subjects/2", V.RDF_TYPE, "http://c", "iri"),
            (G, P, V.RDF_TYPE, V.RDF_PROPERTY, "iri"), (G, P, V.RDFS_LABEL, "name", "lit"),
            (G, P, V.EXACT_MATCH, "http://ext/p", "iri"),
            ("voc", EX + "concepts/red", V.PREF_LABEL, "Red", "lit"),
            ("voc", EX + "concepts/red", V.RDFS_LABEL, "A red", "lit"),
            ("voc", EX + "concepts/red", V.CLOSE_MATCH, "http://ext/red", "iri"),
            ("voc", "http://m/1", V.PREF_LABEL, 'M "1"', "lit"),
            (EX[:-1] + V.DCAT_GRAPH_SUFFIX, "http://d/subjects/9", V.DCT + "title", "T", "lit")]
    q = spark.createDataFrame([(g, s, "iri", p, o, k, None, None) for g, s, p, o, k in data],
                              quads.QUAD_SCHEMA)
    assert rows(table_view.collect_labels(q)) == [
        ("http://m/1", 'M "1"'), (P, "name"), (EX + "concepts/red", "Red")] 
    assert rows(table_view.main_subjects(q)) == [(NS + "subjects/1",), (NS + "subjects/2",)]
    assert rows(table_view.property_usage(q)) == [(EX + "q", 2), ("name", 3)]
    assert rows(table_view.graph_statistics(q)) == [(13, 3, 1, 1, 1)]
    assert rows(table_view.property_catalog(q)) == [(P, "name", 3, True)]
    assert rows(table_view.property_mapping_table(q)) == [(P, "name", 3)]
    links = table_view.link_table(q)
    assert rows(links.filter("subject like '%2'"), "name") == [('=HYPERLINK("http://m/1", "M ""1""")',)]
    red = [r[0] for r in links.filter("subject like '%1'").select(f"`{EX}q`").collect()]
    assert red == ['=HYPERLINK("http://ext/red", "Red")'] * 2
    preview = table_view.preview_table(q)
    assert preview.columns[0] == "Subject"
    assert rows(preview, "name")[0] == ('[M "1"](http://m/1)',)
    heads = {r.label: (r.linked, r.header) for r in table_view.link_headers(q).collect()}
    assert heads == {"name": (True, '=HYPERLINK("http://ext/p", "name")')}
    report = rows(table_view.metadata_report(q))
    assert ("statistics", "Total Triples", "13") in report
    assert ("dcat", "http://d/subjects/9 | Resource | title", "T") in report
    assert rows(table_view.namespace_listing(q, 2))[0][0] == 1
    plain = q.filter("g = 'voc'")
    assert table_view.main_subjects(plain).count() == 2


def test_report_lists_all_namespaces(spark):
    spaces = [f"http://n{i:03d}.example.org/" for i in range(60)]
    q = spark.createDataFrame([(G, s + "a", "iri", s + "p", "v", "lit", None, None) for s in spaces],
                              quads.QUAD_SCHEMA)
    report = table_view.metadata_report(q).where("section = 'namespaces'").collect()
    assert sorted((r.key, r.value) for r in report) == sorted((f"ns{i + 1}", s) for i, s in enumerate(spaces))
    first = table_view.namespace_listing(q, 20).collect()
    assert sorted(map(tuple, first)) == [(i + 1, s, 40) for i, s in enumerate(spaces[:20])]


def test_prefixes(spark):
    cat = spark.createDataFrame(
        [("http://x.org/obo/", "obo", 1), ("http://x.org/obo/", "go", 2),
         ("http://x.org/", "xorg", 3), ("http://q/", "aa", 4), ("http://q/", "bb", 5)],
        "namespace string, prefix string, ord long")
    iris = spark.createDataFrame(
        [(i,) for i in ["http://x.org/obo/GO_1", "http://x.org/obo/GO_2", "http://x.org/a",
                        "http://q/zz", "http://other/1"]], "iri string")
    longest = dict(rows(prefixes.longest_namespace(iris, cat)))
    assert longest["http://x.org/obo/GO_1"] == "http://x.org/obo/" and len(longest) == 4
    bound = dict(rows(prefixes.used_prefixes(iris, cat), "prefix", "namespace"))
    assert bound == {"go": "http://x.org/obo/", "xorg": "http://x.org/"}
    common = spark.createDataFrame(
        [("http://x.org/", "http://x.org/v/1/a"), ("http://x.org/", "http://x.org/v/1/b")],
        "namespace string, iri string")
    assert rows(prefixes.common_namespace(common)) == [("http://x.org/", "http://x.org/v/1/")]
    merged = prefixes.merge_prefixes([
        spark.createDataFrame([("a", "1")], "prefix string, namespace string"),
        spark.createDataFrame([("a", "2"), ("b", "3")], "prefix string, namespace string")])
    assert rows(merged) == [("a", "1"), ("b", "3")]
    df = spark.createDataFrame([("see https://a.b/c and", "x")], "t string, u string")
    m = mapping(spark, [("t", "<http://m/x>", "object"), ("u", "none", "object")])
    assert rows(prefixes.used_iris(m, df, ["http://cfg/1"])) == [
        ("http://cfg/1",), ("http://m/x",), ("https://a.b/c",)]


WORK = {
    "DOI": "10.1/a", "title": ["Title"], "author": [
        {"given": "Ann", "family": "Lee", "ORCID": "https://orcid.org/0-1",
         "affiliation": [{"name": "Inst"}]}, {"name": "Group"}, {}],
    "container-title": "Journal", "ISSN": ["1-2", "3"], "publisher": "Pub", "URL": "http://u",
    "published-online": {"date-parts": [[2020, 5]]}, "volume": "1", "issue": "2", "page": "3-9",
    "type": "article", "license": [{"URL": "x"}], "funder": [{"name": "Fund", "DOI": "10.f"}, {}],
    "reference": [{"DOI": "10.2/b c", "article-title": "Ref", "year": "1999"}, {"key": "x"}]}
INDEX = {"cited_by_count": 4, "abstract_inverted_index": {"b": [1], "a": [0, 2]},
         "concepts": [{"display_name": "C", "level": 1, "score": 0.5}]}


def test_publications(spark):
    bodies = spark.createDataFrame(
        [("10.1/a", json.dumps(WORK), json.dumps(INDEX)), ("10.1/bad", "not json", None)],
        "doi string, crossref string, openalex string")
    q = publish.publication_quads(publish.parse_works(bodies), "2024-01-01")
    got = spo(q)
    w = "https://semopenalex.org/work/W" + __import__("hashlib").md5(b"10.1/a").hexdigest().upper()
    own = {(p, o) for s, p, o in got if s == w}
    for p, o in [(V.DCT + "title", "Title"), (V.DCT + "abstract", "a b a"),
                 (V.PRISM + "publicationDate", "2020-05-01"), (V.FABIO + "hasPublicationYear", "2020"),
                 (V.PRISM + "endingPage", "9"), (V.SOA + "citedByCount", "4"),
                 (V.PRISM + "doi", "https://doi.org/10.1/a")]:
        assert (p, o) in own
    assert len([1 for p, o in own if p == V.DCT + "creator"]) == 3
    assert {o for s, p, o in got if p == V.FOAF + "name"} == {
        "Ann Lee", "Group", "Author3", "Inst", "Journal", "Fund"}
    assert {o for s, p, o in got if p == V.SOA + "oaStatus"} == {"hybrid"}
    assert {o for s, p, o in got if p == V.PRISM + "issn"} == {"1-2"}
    assert {o for s, p, o in got if p == V.DCT + "identifier"} == {"https://doi.org/10.2%2Fb%20c"}
    assert len({o for s, p, o in got if p == V.CITO + "cites"}) == 1
    manual = spark.createDataFrame(
        [("T", "Lee, Ann; Bo Oz", "J", 2021, "", "1-2", ""), ("", "x", "J", 1, "", "", "")],
        "title string, authors string, journal string, year int, volume string, pages string, doi string")
    q = publish.publication_quads(publish.manual_works(manual), "2024-01-01", parts="core")
    got = spo(q)
    assert {o for s, p, o in got if p == V.PRISM + "publicationDate"} == {"2021-01-01"}
    assert {o for s, p, o in got if p == V.FOAF + "name"} == {"Ann Lee", "Bo Oz", "J"}
    link = publish.link_dataset_to_publication(G + "dataset/main", q)
    assert link.first().o.startswith("https://semopenalex.org/")


def test_catalogue(spark):
    _, q = round_trip_input(spark)
    meta = spark.createDataFrame(
        [(G, "T", "D", ["k1", "k2"], "", ["Lee, Ann"], "PUBLIC", "a@b.c", "Org", "http://org",
          ["ENER – Energy", "nonsense"], "CC0 1.0")],
        "graph string, title string, description string, keywords array<string>, identifier string, "
        "creator array<string>, access_rights string, contact_point string, publisher_name string, "
        "publisher_uri string, themes array<string>, license string")
    got = spo(publish.dcat_quads(meta, q, "2024-01-01"))
    d = G + "dataset/main"
    size = sum(len(r.value.encode()) + 1 for r in out.nquad_lines(q).collect())
    assert (G + "distribution/main", V.DCAT + "byteSize", str(size)) in got
    assert {o for s, p, o in got if p == V.DCAT + "theme"} == {publish.THEMES["ENER – Energy"]}
    assert {o for s, p, o in got if p == V.DCAT + "keyword"} == {"k1", "k2"}
    assert (d, V.DCT + "license", "http://creativecommons.org/publicdomain/zero/1.0/") in got
    assert {o for s, p, o in got if p == V.VCARD + "hasEmail"} == {"a@b.c"}
    assert not [1 for s, p, o in got if p == V.DCT + "identifier"]
    both = quads.union_graphs(q, q)
    assert both.count() == q.count()


def test_graph_names(spark):
    df = spark.createDataFrame([("my data.csv",)], "f string")
    a = df.select(T.hashed_graph_iri(F.col("f"), "2024-01-01-00-00-00", "http://x/")).first()[0]
    want = __import__("hashlib").md5(b"mydatacsv-2024-01-01-00-00-00").hexdigest()
    assert a == f"http://x/graph/da{want}ta"
    assert Settings().namespace == EX
