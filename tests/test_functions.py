"""Scalar functions against the worked edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tablegraph import vocab as V
from tablegraph.functions import similarity as S
from tablegraph.functions import text as T
from tablegraph.functions import values as X


def apply(spark, values, fn, schema="v string"):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    cols = [F.col(c) for c in df.columns[1:]]
    return [r.out for r in df.select("i", fn(*cols).alias("out")).orderBy("i").collect()]


def test_numeric_like(spark):
    yes = ["1,234.56", "1.234,56", "1,5", "1e5", "1_000", "nan", "inf", " -3.5 ", "+1.", ".5"]
    no = ["1d", "", "abc", "1__0", "1.2.3", ".", "e5", None, "_1"]
    assert apply(spark, yes, X.is_numeric_like) == [True] * len(yes)
    assert apply(spark, no, X.is_numeric_like) == [False] * len(no)


def test_date_like(spark):
    yes = ["1998-10-03", "1998-10-03 10:11:12", "3 October 1998", "October 3, 1998", "10/3/1998"]
    no = ["1.2.3", "48.1", "P001", "AB-12", "2020", "Version 2023", "2023-02-30", "may", None]
    assert apply(spark, yes, X.is_date_like) == [True] * len(yes)
    assert apply(spark, no, X.is_date_like) == [False] * len(no)
    assert apply(spark, yes + ["Sat Oct 3 1998"], X.is_date_like_free) == [True] * (len(yes) + 1)
    assert apply(spark, ["1.2.3", "P001", "hello world"], X.is_date_like_free) == [False] * 3


def test_iso_datetime_agrees_with_free_parser(spark):
    values = [
        "1998-10-03", "1998/1/3", "1998-10-03T01:02:03.5", "03.10.1998", "13.10.1998",
        "1998-10-03 01:02:03+02:00", "1998-10-03T01:02:03Z", "3 Oct 1998", "Oct 3, 1998",
        "1998-10-03 01:02", "1998-10-03 01:02:03.120000",
    ]
    assert apply(spark, values, X.iso_datetime) == apply(spark, values, X.iso_datetime_free)


def test_clean_for_iri(spark):
    got = apply(spark, ["Größe (mm)", "___", "a--b", " x ", "", None], T.clean_for_iri)
    assert got == ["Groesse_mm", None, "a--b", "x", None, None]


def test_guess_datatype(spark):
    values = [
        ("ja", "c"), ("2020.0", "Jahr"), ("2020", "c"), ("-3,5", "c"), ("1998-10-03", "c"),
        ("x", "c"), ("2020", "Year"), ("", "c"),
    ]
    got = apply(spark, values, X.guess_datatype, "v string, n string")
    want = "boolean gYear integer decimal dateTime string gYear string".split()
    assert got == [V.XSD + w for w in want]
    texts = apply(
        spark, values, lambda v, n: X.literal_text(v, X.guess_datatype(v, n)), "v string, n string"
    )
    assert texts == ["true", "2020", "2020", "-3.5", "1998-10-03T00:00:00", "x", "2020", ""]


def test_comparator(spark):
    got = apply(spark, ["<=5", "> 2,5", "=5", "5<"], X.comparator_parts)
    assert [(r.comparator, r.value, r.datatype) if r else None for r in got] == [
        ("<=", "5", V.XSD + "integer"), (">", "2.5", V.XSD + "decimal"), None, None,
    ]


def test_iri_label(spark):
    values = ["http://a/b#c", "http://a/b/c/", "http://a", "foo", "http://a/b?x=1", "http://a/"]
    assert apply(spark, values, T.iri_label) == ["c", "c", "a", "foo", "b", "a"]


def test_iri_parts(spark):
    values = ["http://a/b#c", "http://a/b", "http://a/b/", "x"]
    assert apply(spark, values, T.local_name) == ["c", "b", "", "x"]
    assert apply(spark, values, T.namespace_of) == ["http://a/b#", "http://a/", None, None]
    assert apply(spark, ["<<x>", " <a> ", "b"], T.strip_angle) == ["x", "a", "b"]
    assert apply(spark, ["http://a", "a:b", "", None, "?q"], T.is_absolute_iri) == [
        True, False, False, False, False]
    assert apply(spark, ["http://a", "a", "", None, "?q"], T.is_iri_like) == [
        True, True, False, False, False]
    links = ["http://a/b", "ftp://a", "http://a b", "http://" + "a" * 300, "http://", None]
    assert apply(spark, links, T.is_linkable_iri) == [True] + [False] * 5
    got = apply(spark, ['see http://a.b/c, <https://x/y> "http://q"z'], T.extract_iris)
    assert got == [["http://a.b/c,", "https://x/y", "http://q"]]
    assert T.dataset_namespace("https://h.org/graph/da1ta") == "https://h.org/da1ta/"
    assert T.dataset_namespace("https://h.org") == "https://h.org/default/"


def brute_lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_similarities(spark):
    rng = random.Random(5)
    pairs = [("kitten", "sitting"), ("", ""), ("abc", "xyz"), ("Ä", "a"), ("abc", "")]
    for _ in range(60):
        pairs.append(tuple("".join(rng.choices("abcÄ ", k=rng.randint(0, 9))) for _ in "ab"))
    got = apply(spark, pairs, S.lev_score, "a string, b string")
    for (a, b), score in zip(pairs, got):
        longest = max(len(a), len(b))
        want = 1.0 if not longest else 1 - brute_lev(a.lower(), b.lower()) / longest
        assert score == pytest.approx(want)
    got = apply(spark, pairs, S.indel_ratio, "a string, b string")
    for (a, b), score in zip(pairs, got):
        total = len(a) + len(b)
        want = 1.0 if not total else 2 * brute_lcs(a.lower(), b.lower()) / total
        assert score == pytest.approx(want)
    assert apply(spark, [("a", None)], S.lev_score, "a string, b string") == [0.0]
    sims = apply(
        spark, [("A  b", "a b"), ("", "a"), ("abc", "abd")], S.lev_sim, "a string, b string"
    )
    assert sims == [1.0, 0.0, pytest.approx(2 / 3)]
    jac = apply(spark, [("red bolt", "Red nut"), ("a", "b")], S.token_jaccard, "a string, b string")
    assert jac == [pytest.approx(1 / 3), 0.0]


def test_cosine_and_hybrid(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "u array<float>, v array<float>"
    )
    got = [r[0] for r in df.select(S.cosine(F.col("u"), F.col("v"))).collect()]
    assert got == [pytest.approx(1 / math.sqrt(2)), 0.0]
    row = spark.range(1).select(
        S.hybrid_score(F.lit(1.0), F.lit(0.5), F.lit(0.2)).alias("a"),
        S.hybrid_score(F.lit(None).cast("double"), F.lit(0.5), F.lit(0.2)).alias("b"),
    ).first()
    assert row.a == pytest.approx(0.66) and row.b == pytest.approx(0.2)


def test_names_and_ids(spark):
    names = apply(spark, ["Smith, John; Doe, Alice", "Ann B. Lee", "Plato"], T.person_names)
    assert [[(n.given, n.family) for n in row] for row in names] == [
        [("John", "Smith"), ("Alice", "Doe")], [("Ann B.", "Lee")], [("", "Plato")]]
    assert apply(spark, ["a"], lambda c: T.entity_id(c, "W", 10)) == ["W0CC175B9C0"]
    assert apply(spark, ["a|b; c ,, d"], T.split_synonyms) == [["a", "b", "c", "d"]]
    assert apply(spark, ["MyColName_2 HTTPServer x"], T.column_words) == [
        ["my", "col", "name", "http", "server"]]
    link = apply(spark, ["http://x/obo/GO_1"], lambda c: T.ui_link(
        F.lit("https://u/{acronym}?i={encoded_iri}"), T.obo_acronym(c), c))
    assert link == ["https://u/GO?i=http%3A%2F%2Fx%2Fobo%2FGO_1"]
    assert apply(spark, [("gene", "5"), ("zzz", "5"), ("gene", "")], T.repository_iri,
                 "d string, x string") == [
        "https://www.ncbi.nlm.nih.gov/gene/5", "https://www.ncbi.nlm.nih.gov/zzz/5", None]
    assert apply(spark, ['["a","b"]', "a", '"a"'], T.first_or_scalar) == ["a", "a", "a"]
    assert apply(spark, ["https://orcid.org/0-1"], T.orcid_id) == ["0-1"]
    assert apply(spark, ["10-20", "7"], T.page_range) == [("10", "20"), ("7", None)]
    assert apply(spark, ["10.1/a b"], lambda c: T.doi_iri(c, True)) == [
        "https://doi.org/10.1%2Fa%20b"]
    assert apply(spark, [("http://a", 'x "y"'), ("zz", "l")], T.hyperlink_cell,
                 "u string, l string") == ['=HYPERLINK("http://a", "x ""y""")', "l"]
    assert apply(spark, ["data.csv", "x/dir.a"], lambda c: T.stable_graph_iri(
        c, "https://h/asset/dataset"))[0].startswith("https://h/asset/dataset/da")
    assert apply(spark, ["Big Red bolt"], T.tokenize) == [["big", "red", "bolt"]]
