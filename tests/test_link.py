"""Vocabulary search, ranking, resolving, response bodies, patterns."""

import json

import pytest
from pyspark.sql import functions as F

from tablegraph import vocab as V
from tablegraph.operators import link, patterns, rank, resolve, responses
from tablegraph.operators.quads import QUAD_SCHEMA
from tablegraph.sources import vocabulary
from tests.test_terms import rows


def quad(s, p, o, lang=None, kind="lit"):
    return ("g", s, "iri", p, o, kind, None, lang)


@pytest.fixture(scope="module")
def vocab(spark):
    data = [
        quad("u1", V.RDFS_LABEL, "rot", "de"), quad("u1", V.PREF_LABEL, "red bolt", "en"),
        quad("u1", V.ALT_LABEL, "scarlet bolt"), quad("u1", V.RDFS_COMMENT, "a bolt", "en"),
        quad("u1", V.SKOS + "scopeNote", "note", "en"),
        quad("u2", V.RDFS_LABEL, "blue nut"), quad("u3", V.SKOS + "note", "no label"),
        quad("u1", V.RDF_TYPE, V.SKOS + "Concept", kind="iri"),
        quad("u2", V.RDF_TYPE, V.QUDT + "Unit", kind="iri"),
        quad("u2", V.RDFS_LABEL, "Blue Nut", "en"),
    ]
    return spark.createDataFrame(data, QUAD_SCHEMA).cache()


def test_entities_and_search(spark, vocab):
    entities = link.extract_entities(vocab)
    assert rows(entities) == [("u1", "red bolt", "a bolt"), ("u2", "Blue Nut", "")]
    names = link.entity_synonyms(vocab)
    terms = spark.createDataFrame(
        [(1, "Scarlet bolts"), (2, "blue nut"), (3, "xy"), (4, " "), (5, "BLUE  nut")],
        "term_id int, term string")
    long = link.search_vocabulary(terms, entities, 1, names)
    got = {r.term_id: (r.uri, r.score) for r in long.collect()}
    assert got[1] == ("u1", pytest.approx(1 - 1 / 13, abs=1e-6))
    assert got[2] == ("u2", 1.0) and got[5] == ("u2", 1.0)
    assert got[3] == ("u1", 0.0)  # no token hit: compared with all entities, as the inventory asks
    assert 4 not in got
    in_row = entities.join(
        names.groupBy("uri").agg(F.collect_list("name").alias("synonyms")), "uri", "left")
    assert rows(link.search_vocabulary(terms, in_row, 2)) == rows(
        link.search_vocabulary(terms, entities, 2, names))
    a = long.filter("term_id = 1")
    b = a.withColumn("score", F.lit(0.99)).withColumn("uri", F.lit("other"))
    assert rows(link.merge_resources_topk([a, b], 1), "uri", "rank") == [("other", 1)]


def test_vocabulary_table(spark):
    df = spark.createDataFrame(
        [(" A ", "x;y", "d"), ("", "z", "d"), ("B", None, None)],
        "Name string, Aliases string, Notes string")
    got = vocabulary.vocabulary_entities(df, "voc.csv", ["Name"])
    assert rows(got) == [("urn:local:voc.csv#1", "A", "d", ["x", "y"]),
                         ("urn:local:voc.csv#2", "B", "", [])]
    with pytest.raises(ValueError):
        vocabulary.vocabulary_entities(df.select("Notes"), "x")


def suggestions(spark, data):
    return spark.createDataFrame(
        data, "term_id int, term string, provider string, rank int, uri string, label string, "
        "description string, score double, source_provider string, ontology string")


def test_ranking_and_prefill(spark):
    s = suggestions(spark, [
        (1, "bolt", "A", 0, "u1", "bolts", "d", None, "SRC", None),
        (1, "bolt", "B", 0, "u2", "bolt", "", 0.5, None, "ONT"),
        (1, "bolt", "B", 1, "u3", "nut", None, 0.9, "", None),
        (1, "bolt", "B", 2, None, "nut", None, 9.9, "", None),
        (2, "zzz", "A", 0, "u4", "abc", None, None, None, None)])
    api = rank.rank_suggestions(s, 2, "api", ["A", "B"]).orderBy("term_id", "place")
    assert [(r.term_id, r.uri) for r in api.collect()] == [(1, "u3"), (1, "u2"), (2, "u4")]
    lev = rank.rank_suggestions(s, 1, "levenshtein")
    assert rows(lev, "term_id", "uri") == [(1, "u2"), (2, "u4")]
    mapping = spark.createDataFrame(
        [(i, t, u, "object", m, "", "", "", "") for i, t, u, m in [
            (1, "bolt", "", ""), (2, "zzz", "No Match", ""), (3, "k", "http://k", ""),
            (4, " ", "", "")]],
        "term_id int, Term string, URI string, `RDF Role` string, `Match Type` string, "
        "`Source Provider` string, `Confirmed Display String` string, `Provider Term` string, "
        "`Provider Description` string")
    out = {r.term_id: r for r in rank.prefill_best(mapping, s, 0.7, skos=True).collect()}
    assert (out[1].URI, out[1]["Source Provider"], out[1]["Match Type"]) == (
        "u2", "ONT", "skos:exactMatch")
    assert out[1]["Confirmed Display String"] == "bolt [Lev: 1.00] <u2>"
    assert (out[2].URI, out[2]["Confirmed Display String"]) == ("No Match", "--- No Match ---")
    assert (out[3].URI, out[3]["Match Type"]) == ("http://k", "skos:exactMatch")
    assert out[4].URI == ""
    assert rows(rank.with_suggestions(mapping, s, "B"), "term_id") == [(1,)]
    assert rows(rank.provider_hit_counts(s)) == [("A", 2), ("B", 1)]
    kept = rank.filter_ontologies(
        s.withColumn("provider", F.lit("SemLookP")), {"SemLookP": ["ont"], "Other": ["x"]})
    assert rows(kept, "uri") == [("u2",)]
    text = s.limit(1).select(rank.suggestion_text(None).alias("t")).first().t
    assert text == "bolts [SRC] (d) <u1>"
    assert [r.uri for r in rank.rank_by_similarity(rank.drop_malformed(s)).collect()] == [
        "u2", "u1", "u3", "u4"]


def test_resolve(spark):
    iris = spark.createDataFrame(
        [(0, "http://a"), (1, "bad"), (2, "https://www.wikidata.org/wiki/Q1"), (3, "http://b"),
         (4, "http://a")], "row_id int, iri string")
    lookups = spark.createDataFrame(
        [("ols", "http://a", "late", "X", "l1"), ("portal", "http://a", "early", "Y", "l2"),
         ("portal", "http://b", "no link", "Y", "")],
        "service string, iri string, label string, acronym string, ui_link string")
    out = resolve.resolve_cascade(iris, lookups, ["portal", "ols"])
    got = {r.row_id: (r.label, r.source, r.message) for r in out.collect()}
    assert got == {
        0: ("early", "PORTAL", None), 4: ("early", "PORTAL", None),
        1: (None, "Error", "Invalid IRI provided."),
        2: ("Wikidata Entity", "WIKIDATA", None), 3: (None, "None", "IRI not found in any source.")}
    again = resolve.resolve_cascade(iris, lookups, ["portal", "ols"], ignore=["Portal"])
    assert rows(again.filter("row_id = 0"), "label") == [("late",)]
    ordered = resolve.restore_input_order(iris, out.filter("row_id != 3"))
    assert [r.source for r in ordered.collect()] == ["PORTAL", "Error", "WIKIDATA", "Error", "PORTAL"]
    mapping = spark.createDataFrame(
        [("t1", "http://a", "old"), ("t2", "http://z", "keep")],
        "Term string, URI string, label string")
    got = {r.Term: (r.label, r.source) for r in resolve.enrich_mapping(mapping, out).collect()}
    assert got == {"t1": ("early", "PORTAL"), "t2": ("keep", "")}


def bodies(spark, provider, body):
    return spark.createDataFrame(
        [(1, "t", provider, json.dumps(body) if not isinstance(body, str) else body)],
        "term_id int, term string, provider string, body string")


def picked(df):
    return [tuple(r) for r in df.orderBy("rank").select(
        "uri", "label", "description", "source_provider").collect()]


def test_responses(spark):
    portal = {"collection": [
        {"@id": "u1", "prefLabel": "L1", "definition": [" d1 ", "d2"],
         "links": {"ontology": "https://data.x.org/ontologies/GO"}},
        {"@id": "u2", "definition": "plain"}, {"prefLabel": "no id"}]}
    assert picked(responses.portal_suggestions(bodies(spark, "P", portal))) == [
        ("u1", "L1", "d1", "GO"), ("u2", "N/A", "plain", "Unknown")]
    ols = {"response": {"docs": [
        {"iri": "u1", "label": "L", "description": ["d"], "ontology_prefix": "GO"},
        {"iri": "u2", "label": "M", "ontology_name": "chebi"}]}}
    assert picked(responses.ols_suggestions(bodies(spark, "O", ols))) == [
        ("u1", "L", "d", "GO"), ("u2", "M", "", "Unknown")]
    assert picked(responses.named_ols_suggestions(bodies(spark, "S", ols)))[1][3] == "chebi"
    search = {"search": [{"id": "Q1", "label": "a"}, {"id": "Q2", "concepturi": "c", "description": "d"}]}
    assert picked(responses.entity_search_suggestions(bodies(spark, "W", search))) == [
        ("http://www.wikidata.org/entity/Q1", "a", "", "Wikidata"), ("c", "N/A", "d", "Wikidata")]
    places = {"geonames": [
        {"geonameId": 5, "toponymName": "Berlin", "fcodeName": "city", "countryName": "DE"},
        {"geonameId": 6}, {"name": "x"}]}
    assert picked(responses.place_suggestions(bodies(spark, "G", places))) == [
        ("http://sws.geonames.org/5/", "Berlin", "city, DE", "GeoNames")]
    bad = {"status": {"message": "m", "value": 1}, "geonames": places["geonames"]}
    assert picked(responses.place_suggestions(bodies(spark, "G", bad))) == []
    summary = {"result": {"uids": ["1", "2"], "1": {"scientificname": "E. coli", "rank": "species"}}}
    base = "https://www.ncbi.nlm.nih.gov/"
    assert picked(responses.summary_suggestions(bodies(spark, "taxonomy", summary))) == [
        (base + "Taxonomy/Browser/wwwtax.cgi?id=1", "E. coli", "species", "NCBI taxonomy")]
    paper = {"result": {"uids": ["7"], "7": {"title": "T", "authors": [{"name": "A B"}], "pubdate": "2020"}}}
    assert picked(responses.summary_suggestions(bodies(spark, "pubmed", paper))) == [
        ("https://pubmed.ncbi.nlm.nih.gov/7/", "T", "A B (2020)", "NCBI pubmed")]
    project = {"result": {"uids": ["7"], "7": {"project_acc": "PRJ", "project_title": "pt"}}}
    assert picked(responses.summary_suggestions(bodies(spark, "bioproject", project))) == [
        (base + "bioproject/PRJ", "pt", "", "NCBI bioproject")]
    sparql = {"results": {"bindings": [
        {"uri": {"value": "u"}, "label": {"value": "l"}, "note": {"value": "n"}},
        {"uri": {"value": "u"}}]}}
    assert picked(responses.binding_suggestions(
        bodies(spark, "Q", sparql), descriptions=("description", "note"), source="QUDT")) == [
        ("u", "l", "n", "QUDT")]
    assert picked(responses.portal_suggestions(bodies(spark, "P", "not json"))) == []
    looked = spark.createDataFrame(
        [("bioportal", "u1", json.dumps(portal)), ("ols", "u2", json.dumps(ols)),
         ("ontobee", "http://x/obo/GO_1", '{"boolean": true}'), ("ontobee", "u", '{"boolean": false}')],
        "service string, iri string, body string")
    out = responses.iri_lookups(looked, {s: "https://l/{acronym}" for s in ("bioportal", "ols", "ontobee")})
    assert rows(out, "service", "label", "acronym", "ui_link") == sorted([
        ("bioportal", "L1", "GO", "https://l/GO"), ("ols", "M", "CHEBI", "https://l/CHEBI"),
        ("ontobee", None, "GO", "https://l/GO")], key=lambda x: x[0])
    lists = spark.createDataFrame(
        [('[{"acronym":"go"},{"acronym":null}]',),
         ('{"_embedded":{"ontologies":[{"ontologyId":" chebi "}]}}',)], "body string")
    assert rows(responses.ontology_list(lists)) == [("CHEBI",), ("GO",)]


def test_patterns(spark, vocab):
    terms = spark.createDataFrame([("BOLT",), ("nut",)], "term string")
    got = patterns.label_contains(terms, vocab)
    assert rows(got, "term", "uri", "label", "description") == [
        ("BOLT", "u1", "red bolt", "a bolt"), ("nut", "u2", "Blue Nut", None),
        ("nut", "u2", "blue nut", None)]
    got = patterns.typed_label_contains(terms, vocab)
    assert rows(got, "term", "uri", "label") == [("nut", "u2", "Blue Nut")]
    odd = spark.createDataFrame([("b.lt$",), ("zzz",), ("e",), ("",), ("d b",)], "term string")
    labels = vocab.select(F.col("o").alias("label")).distinct()
    got = {(r.term, r.label) for r in patterns.contains_join(odd, labels, "label").collect()}
    texts = [r.label for r in labels.collect()]
    assert got == {(t, x) for t in ("zzz", "e", "d b") for x in texts if t in x.lower()}
    got = patterns.pattern_join(odd.filter("term like '%$'"), labels, "label")
    assert {r.label for r in got.collect()} == {"red bolt", "scarlet bolt", "a bolt"}
    got = patterns.concept_search(terms, vocab)
    assert rows(got, "term", "uri", "label", "description") == [("BOLT", "u1", "red bolt", "note")]


PATTERNS = ["ab+c", "colou?r", "^red .*bolt$", "a|b", "(ab|cd)ef", "x(y(z))w", "[abc]d", "\\d+ mm", "a{2}b", "ab{0,1}c",
            "\\.csv", "ab*?cd", "(?i)zz", "\\bkelvin\\b", "a.c", "s+k", "\\Qa.b\\E", "ab\\x41cd", "q++r", "\\pLab", "(a)b\\1",
            "plain", "k$", "[^a]ski", "i+n"]


def test_required_runs(spark):
    got = spark.createDataFrame([(p,) for p in PATTERNS], "p string").select(
        "p", patterns.required_run(F.col("p")).alias("run")).collect()
    want = {"ab+c": "ab", "colou?r": "colo", "^red .*bolt$": "bolt", "a|b": None, "(ab|cd)ef": "ef", "x(y(z))w": "w",
            "[abc]d": "d", "\\d+ mm": " mm", "a{2}b": "b", "ab{0,1}c": "a", "\\.csv": "csv", "ab*?cd": "cd",
            "(?i)zz": None, "\\bkelvin\\b": "kelvin", "\\Qa.b\\E": None, "ab\\x41cd": "ab", "q++r": "q", "\\pLab": "ab",
            "(a)b\\1": None, "k$": "k"}
    assert {r.p: r.run for r in got if r.p in want} == want


def test_pattern_join_equals_testing_all(spark):
    """Letters whose case folds oddly, empty and null labels, and patterns without any plain character."""
    texts = ["abbc", "Color", "colour red", "red x bolt", "abef", "xyzw", "AD", "12 mm", "aab", "ac", "x.csv", "abcd",
             "zz", "a Kelvin b", "Kelvin", "ſſk", "SSK", "a.b", "abAcd", "qqr", "éab", "aba", "PLAIN", "skı",
             "bSKİ", "ın", "", None, "k"]
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "uri int, name string")
    terms = spark.createDataFrame([(p,) for p in PATTERNS], "term string")
    got = patterns.pattern_join(terms, labels, "name")
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    special = [p for p in PATTERNS if p != "plain"]
    want = set()
    for p in special:
        hit = labels.where(F.rlike("name", F.lit("(?iu)" + p))).collect()
        want |= {(p, r.uri) for r in hit}
    want |= {("plain", 22)}
    rows_got = [(r.term, r.uri) for r in got.collect()]
    assert set(rows_got) == want and len(rows_got) == len(want)
