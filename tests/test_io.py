"""Files in and out, whole jobs, streams."""

import os

import pytest
from tablegraph.config import GraphSpec, Settings
from tablegraph.operators import quads, table_view
from tablegraph.plans import graph_to_table, reconcile, table_to_graph
from tablegraph.sinks import text as out
from tablegraph.sources import nquads, prefixes, tables, vocabulary
from tablegraph.streaming import streams
from tests.test_graph import G, MAP, NS
from tests.test_terms import rows


def put(folder, name, text, encoding="utf-8"):
    path = os.path.join(str(folder), name)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return path


def test_read_table(spark, tmp_path):
    path = put(tmp_path, "a.csv", "﻿Id; Name;Name;\n1; x ;NA;-\n2;y, z;;q\n")
    assert tables.infer_delimiter(spark, path) == ";"
    df = tables.read_table(spark, path)
    assert df.columns[:3] == ["Id", "Name", "Name_1"] and df.columns[3] == "Unnamed_Col_3"
    got = df.collect()
    assert got[0][1].strip() == "x" and got[0][2] is None and got[0][3] is None
    assert got[1][1] == "y, z" and got[1][3] == "q"
    late = put(tmp_path, "b.csv", "title\nsource\na,b\n1,\"x,y\"\n2,nan\n")
    df = tables.read_table(spark, late, start_row=3, sep=",")
    assert df.columns == ["a", "b"]
    assert rows(df.fillna("")) == [("1", "x,y"), ("2", "")]
    for text, want in [("a|b\n1|2\n", "|"), ("a\tb\n", "\t"), ("plain\n", ","), ("", ",")]:
        assert tables.infer_delimiter(spark, put(tmp_path, "d.csv", text)) == want
    assert tables.pick_separator(spark, put(tmp_path, "e.csv", "a|b\n")) == "|"
    assert tables.detect_encoding(spark, path) == "utf-8"
    latin = put(tmp_path, "f.csv", "größe,b\n1,2\n", "latin-1")
    assert tables.detect_encoding(spark, latin) == "iso-8859-1"
    assert tables.read_table(spark, latin, encoding="iso-8859-1").columns == ["größe", "b"]


def test_columns_and_mapping(spark):
    names = tables.sanitize_names([None, "a\nb", " ", "x", "x", "x"])
    assert names == ["Unnamed_Col_0", "a_b", "Empty_Col_Name_2", "x", "x_1", "x_2"]
    df = spark.createDataFrame([(bytearray("é".encode()), 1), (bytearray(b"\xe9"), 2)], "b binary, n int")
    assert rows(tables.normalize_mixed(df)) == [("é", "1"), ("é", "2")]
    m = spark.createDataFrame([("t", "u", "object")], "` Term` string, `Mapped ID` string, `RDF Role` string")
    assert tables.validate_mapping(m).columns[:3] == ["Term", "URI", "RDF Role"]
    with pytest.raises(ValueError):
        tables.validate_mapping(m.drop("RDF Role"))
    with pytest.raises(ValueError):
        tables.validate_matching(m)


def test_fingerprint_prefixes_vocabulary(spark, tmp_path):
    path = put(tmp_path, "p.txt", "@prefix a: <http://a/> .\nPREFIX b: <http://a/>\n@PREFIX a: <http://a/>\njunk\n")
    cat = prefixes.read_prefixes(spark, path)
    assert rows(cat, "namespace", "prefix") == [("http://a/", "a"), ("http://a/", "b")]
    assert prefixes.read_prefixes(spark, str(tmp_path / "none.txt")).count() == 0
    more = prefixes.merge_prefix_overrides(cat, {"http://a/": ["a"], "http://s/": ["s", "t"]})
    assert rows(more, "prefix") == [("a",), ("b",), ("s",), ("t",)]
    import hashlib

    got = tables.file_fingerprint(spark, path).first()
    assert got.sha256 == hashlib.sha256(open(path, "rb").read()).hexdigest()
    voc = put(tmp_path, "voc.csv", "Identifier,Title,Synonyms\nu1,Red,scarlet;crimson\nu2,,x\n")
    assert rows(vocabulary.read_vocabulary_table(spark, voc)) == [("u1", "Red", "", ["scarlet", "crimson"])]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", "2"), ("2", "b", None)], "id string, x string, y string")
    q = quads.rows_to_quads(df, spark.createDataFrame([], MAP), GraphSpec(G, "id"))
    path = str(tmp_path / "graph")
    out.write_lines(out.nquad_lines(q), path)
    back = graph_to_table.load_quads(spark, path)
    assert rows(back.fillna("")) == rows(q.fillna(""))
    graph_to_table.export_table(back, str(tmp_path / "export"))
    table = tables.read_table(spark, str(tmp_path / "export" / "table"), sep=",")
    assert rows(table.fillna(""), "x", "y") == [("a", "2"), ("b", "")]
    stored = str(tmp_path / "quads")
    graph_to_table.write_quads_table(q, stored)
    assert spark.read.parquet(stored).filter("g_role = 'data'").count() == q.count()
    heads = spark.createDataFrame([("ex", "http://e/")], "prefix string, namespace string")
    blocks = out.with_prefix_header(heads, out.trig_blocks(q))
    assert "@prefix ex: <http://e/> ." in [r.value for r in blocks.collect()]


def test_whole_job(spark):
    df = spark.createDataFrame([("1", "red", "2,5"), ("2", "blue", "see https://voc.org/x")],
                               "id string, Colour string, Note string")
    vocab = spark.createDataFrame([("https://voc.org/red", "Red", "a colour"), ("https://voc.org/b", "green", "")],
                                  "uri string, label string, description string")
    table = spark.createDataFrame(
        [(0, "Colour", "", "predicate", ""), (1, "red", "", "object", ""), (2, "blue", "", "object", "")],
        "term_id int, Term string, URI string, `RDF Role` string, `Match Type` string")
    mapping = reconcile.reconcile(table, {"voc": vocab})
    got = {r.Term: (r.URI, r["Match Type"]) for r in mapping.collect()}
    assert got == {"Colour": ("No Match", ""), "red": ("https://voc.org/red", "skos:exactMatch"),
                   "blue": ("No Match", "")}
    spec = GraphSpec(G, "id", class_iri="https://voc.org/Row")
    meta = spark.createDataFrame(
        [(G, "T", "D", [], "", [], "PUBLIC", "mailto:a@b", "Org", "http://org", [], "CC0 1.0")],
        "graph string, title string, description string, keywords array<string>, identifier string, "
        "creator array<string>, access_rights string, contact_point string, publisher_name string, "
        "publisher_uri string, themes array<string>, license string")
    graphs = table_to_graph.build_graphs(df, mapping, spec, "2024-01-01T00:00:00", dataset=meta)
    table = table_view.quads_to_table(graphs.all())
    assert rows(table, "Colour", "Note") == [
        ("https://example.org/concepts/blue", "see https://voc.org/x"),
        ("https://example.org/concepts/red", "2.5")]
    linked = table_view.link_table(graphs.all())
    assert ('=HYPERLINK("https://voc.org/red", "red")',) in rows(linked, "Colour")
    cat = spark.createDataFrame([("https://voc.org/", "voc", 0)], "namespace string, prefix string, ord long")
    bound = dict(rows(table_to_graph.prefix_bindings(df, mapping, cat, Settings(), spec)))
    assert bound["voc"] == "https://voc.org/" and bound["dataset"] == NS and "skos" in bound


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    data = spark.createDataFrame([("1", "red"), ("2", "<=5")], "id string, c string")
    data.write.parquet(src)
    mapping = spark.createDataFrame([("red", "http://v/red", "object")], MAP)
    spec = GraphSpec(G, "id", class_iri="http://v/Row")
    stream = spark.readStream.schema(data.schema).parquet(src)
    q = streams.stream_quads(stream, mapping, spec)
    run = streams.write_quad_stream(q, str(tmp_path / "out"), str(tmp_path / "ck"))
    run.awaitTermination(120)
    got = nquads.read_nquads(spark, str(tmp_path / "out")).drop("_corrupt")
    static = streams.declarations(data, mapping, spec)
    whole = quads.rows_to_quads(data, mapping, spec)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, quads.union_graphs(got, static).collect())) == sorted(map(key, whole.collect()))

    bodies = spark.createDataFrame([(1, "t", "P", '{"search":[{"id":"Q1","label":"a"}]}')],
                                   "term_id int, term string, provider string, body string")
    bodies.write.parquet(str(tmp_path / "bodies"))
    stream = spark.readStream.schema(bodies.schema).parquet(str(tmp_path / "bodies"))
    linked = streams.stream_links(streams.stream_suggestions(stream, "entity_search"), "uri", "label")
    run = linked.writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert rows(spark.table("hits"), "cell") == [('=HYPERLINK("http://www.wikidata.org/entity/Q1", "a")',)]


def test_spread_only_adds_tasks(spark):
    from tablegraph.session import spread

    small = spark.range(10, numPartitions=1)
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(100, numPartitions=20)
    assert spread(wide) is wide


def test_long_and_odd_literals(spark):
    from tablegraph.sources.nquads import parse_lines

    texts = ["x" * 200_000, '\\"' * 50_000 + "\\n", "a\x1fb\x1f", "\\\\" * 30_000]
    lines = [(f'<http://a/s{i}> <http://a/p> "{t}"@en <http://a/g> .',) for i, t in enumerate(texts)]
    got = {r.s: r for r in parse_lines(spark.createDataFrame(lines, "value string")).collect()}
    want = ["x" * 200_000, '"' * 50_000 + "\n", "a\x1fb\x1f", "\\" * 30_000]
    assert [got[f"http://a/s{i}"].o for i in range(4)] == want
    assert all(r._corrupt is None and r.o_lang == "en" for r in got.values())


def test_read_tables_with_a_late_header(spark, tmp_path):
    """Titles of every file go, however many files there are."""
    for name in "ab":
        put(tmp_path, f"{name}.csv", f"title {name}\nid,v\n1,x{name}\n\n2,\"y, {name}\"\n")
    df = tables.read_table(spark, str(tmp_path), start_row=2, sep=",")
    assert df.columns == ["id", "v"]
    assert rows(df) == [("1", "xa"), ("1", "xb"), ("2", "y, a"), ("2", "y, b")]


def test_quoted_line_breaks_across_splits(spark, tmp_path):
    """Against Python's reader, with splits of a few bytes, so that records and quotes cross them."""
    import csv
    import io
    import random

    rng = random.Random(8)
    pieces = ["a", "5\" pipe", "two\nlines", "say \"\"no\"\"".replace('""', '"'), "x,y", "\n\n", "", "end\"", "é" * 9]
    table = [[str(i), rng.choice(pieces), rng.choice(pieces) + "."] for i in range(300)]
    out = io.StringIO()
    for i, row in enumerate(table):
        # Some quotes stand inside a field that is not quoted; there they are text.
        fields = [f if i % 3 and not set(f) & set(',\n') and not f.startswith('"') else '"' + f.replace('"', '""') + '"'
                  for f in row]
        out.write(",".join(fields) + "\n")
    path = put(tmp_path, "t.csv", "some title, \"of a table\nid,p,q\n" + out.getvalue())
    want = sorted(tuple(r) for r in list(csv.reader(io.StringIO(out.getvalue()))))
    assert want == sorted(map(tuple, table))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("37", "1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = tables.read_table(spark, path, start_row=2, sep=",")
            assert got.columns == ["id", "p", "q"]
            found = sorted(tuple(x or "" for x in r) for r in got.collect())
            assert [r[0] for r in found] == [r[0] for r in want]
            assert found == want, size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    first = put(tmp_path, "u.csv", "a,b\n1,\"x\ny\"\n2,z\n")
    assert rows(tables.read_table(spark, first, sep=",")) == [("1", "x\ny"), ("2", "z")]
