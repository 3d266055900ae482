"""Reshaping, profiling, matching tables, near-duplicates."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tablegraph.operators import positions, profile, reshape, similar, terms
from tablegraph.plans.term_queries import literals_by_type
from tests.test_functions import brute_lcs


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_split_column(spark):
    df = spark.createDataFrame(
        [("P001", "Berlin, Germany", "10"), ("P002", "Vienna , Austria,x", "15"), ("P3", "", None)],
        "id string, Location string, Value string",
    )
    out = reshape.split_column(df, "Location", ",", ["City", "Country"], keep_original=False)
    assert out.columns == ["id", "Value", "City", "Country"]
    assert [tuple(r) for r in out.collect()] == [
        ("P001", "10", "Berlin", "Germany"), ("P002", "15", "Vienna", "Austria,x"),
        ("P3", None, None, None)]
    for bad in [("nope", ["a"]), ("Location", []), ("Location", ["id"])]:
        with pytest.raises(ValueError):
            reshape.split_column(df, bad[0], ",", bad[1])
    names = reshape.suggest_split_names(df, "Location", ",")
    assert rows(names) == [(1, "Location_1"), (2, "Location_2"), (3, "Location_3")]


def test_expand_codes(spark):
    df = spark.createDataFrame(
        [("S101", "CIP, NAL, TET"), ("S102", "tet"), ("S103", "sensitive"), ("S104", "GEN, ERY"),
         ("S105", None)], "id string, p string")
    codes = ["CIP", "NAL", "TET", "GEN", "ERY"]
    out = reshape.expand_codes(df, "p", ",", codes, "Resistant_", "True", "False")
    want = {"S101": [1, 1, 1, 0, 0], "S102": [0, 0, 1, 0, 0], "S103": [0] * 5,
            "S104": [0, 0, 0, 1, 1], "S105": [0] * 5}
    for r in out.collect():
        assert [r["Resistant_" + c] for c in codes] == [bool(x) for x in want[r.id]]
    code = reshape.expand_codes(df, "p", ",", ["CIP"], "x ", "$CODE$", None, keep_original=False)
    assert {r.id: r.x_CIP for r in code.collect()}["S101"] == "CIP"
    assert {r.id: r.x_CIP for r in code.collect()}["S102"] is None
    with pytest.raises(ValueError):
        reshape.expand_codes(df, "p", ",", ["a b", "a_b"])
    assert [r.code for r in reshape.detect_codes(df, "p", ",").collect()] == [
        "CIP", "ERY", "GEN", "NAL", "TET", "sensitive", "tet"]
    assert rows(reshape.codes_in_use(df, "p", ",", ["CIP", "none"])) == [("CIP",)]


def test_positions_split_hot_groups(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}", i) for i in range(3000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, v int").repartition(7)
    got = positions.group_positions(df, ["k"], ["v"], hot_rows=50).collect()
    assert sorted(got) == sorted(positions.group_positions(df, ["k"], ["v"]).collect())
    want = {}
    for k in {k for k, _ in data}:
        for i, v in enumerate(sorted(v for kk, v in data if kk == k), 1):
            want[(k, v)] = i
    assert {(r.k, r.v): r.pos for r in got} == want
    number = positions.global_positions(df, ["v"]).collect()
    assert all(r.pos == r.v + 1 for r in number)


def test_generate_ids(spark):
    df = spark.createDataFrame([(f"n{i:03d}", "x") for i in range(120)], "name string, id string")
    out = reshape.generate_ids(df.repartition(5), ["name"], "id", "id_")
    assert out.columns == ["name", "id", "id_1"]
    assert rows(out, "name", "id_1")[0] == ("n000", "id_001")
    assert rows(out, "name", "id_1")[-1] == ("n119", "id_120")
    zero = reshape.generate_ids(df, ["name"], prefix="row_", start=0)
    assert rows(zero, "_generated_id_")[0] == ("row_000",)


def test_expand_multi_values(spark):
    values = [("x", "a", v) for v in "123"] + [("x", "b", "p"), ("x", "b", "q"), ("x", "z", "k"),
                                              ("y", "a", "9")]
    df = spark.createDataFrame(values, "subject string, label string, value string")
    wide = reshape.expand_multi_values(reshape.value_positions(df), ["a", "b", "z"])
    assert rows(wide, "subject", "a", "b", "z")[:3] == [
        ("x", "1", "p", "k"), ("x", "2", "q", "k"), ("x", "3", "q", "k")]
    assert wide.count() == 4


def test_profile(spark):
    df = spark.createDataFrame(
        [("1", "x", "2020-01-02", None, "true"), ("2,5", "3", "1999-12-31", "", "false")],
        "num string, mix string, day string, none string, flag string")
    assert rows(profile.numeric_columns(df)) == [("num",)]
    assert rows(profile.date_columns(df)) == [("day",)]
    assert profile.id_columns(spark.createDataFrame([(1, 2, 3)], "row_id int, Width int, n int")) == [
        "row_id", "Width"]
    assert [r.term for r in profile.header_terms(spark, ["a", "12", "1998-10-03"]).collect()] == ["a"]
    assert profile.skip_transformed(["a", "a_1", "b", "c"], {"a": ["a_1"]}, ["b"], True, True) == [
        "a_1", "c"]
    assert profile.omit_columns(df, ["num"]) == ["mix", "day", "none", "flag"]
    names = ["sample_type", "sample_size", "SampleDate", "x_1", "x_2", "xy_a", "xy_b"]
    groups = profile.suggest_column_groups(
        spark.createDataFrame([(n,) for n in names], "column string"))
    got = {}
    for r in groups.collect():
        got.setdefault(r.group_key, []).append(r.column)
    assert {k: sorted(v) for k, v in got.items()} == {
        "word_sample": ["SampleDate", "sample_size", "sample_type"],
        "word_xy": ["xy_a", "xy_b"]}


def test_matching_table(spark):
    df = spark.createDataFrame(
        [("red", "1", "Kind"), ("blue ", "2", "true"), ("red", "x", "1998-10-03")],
        "kind string, n string, `2020` string")
    table = terms.sort_matching_table(terms.matching_table(df))
    got = [(r["Term"], r["Source Column"], r["RDF Role"]) for r in table.collect()]
    assert got == [("kind", "kind", "predicate"), ("n", "n", "predicate"),
                   ("blue", "kind", "object"), ("red", "kind", "object"), ("x", "n", "object")]


def brute_pairs(words, t):
    out = {}
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            la, lb = a.lower(), b.lower()
            ratio = 2 * brute_lcs(la, lb) / (len(la) + len(lb)) if la + lb else 1.0
            if ratio >= t:
                out[(a, b)] = ratio
    return out


def greedy(words, pairs):
    free, groups = set(words), {}
    for i, a in enumerate(words):
        if a not in free:
            continue
        free.discard(a)
        members = [b for b in words[i + 1:] if b in free and (a, b) in pairs]
        free -= set(members)
        if members:
            groups[a] = sorted([a, *members])
    return groups


@pytest.mark.parametrize("t", [0.85, 0.6, 0.95])
def test_similar_pairs_and_groups_equal_brute_force(spark, t):
    rng = random.Random(int(t * 100))
    base = ["".join(rng.choices("abcde ", k=rng.randint(1, 24))) for _ in range(40)]
    words = set(base)
    while len(words) < 190:
        w = list(rng.choice(base))
        for _ in range(rng.randint(1, 3)):
            i = rng.randint(0, len(w))
            rng.choice([lambda: w.insert(i, rng.choice("abcde")),
                        lambda: w and w.pop(min(i, len(w) - 1))])()
        word = "".join(w)
        words.add(word.upper() if rng.random() < 0.1 else word)
    words |= {f"Item#{i:06d}" for i in range(30)} | {"aaaaaaaaaaaaaaaaab", "aaaaaaaaaaaaaaaabb"}
    words = sorted(w for w in words if w)
    df = spark.createDataFrame([(w,) for w in words], "term string")
    pairs = similar.similar_pairs(df, t)
    got = {(r.a, r.b): r.ratio for r in pairs.collect()}
    want = brute_pairs(words, t)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    found = {}
    for r in similar.consolidate_groups(pairs).collect():
        found.setdefault(r.leader, []).append(r.member)
    assert {k: sorted(v) for k, v in found.items()} == greedy(words, want)


def test_long_near_equal_texts(spark):
    """Every pair of 1,000 texts of 240 characters that differ in two places, exact ratios."""
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefghij klmnop", k=240))
    spots = [(i, j) for i in range(0, 240, 3) for j in range(i + 1, 240, 7)]
    texts = []
    for i, j in rng.sample(spots, 1000):
        texts.append(base[:i] + "X" + base[i + 1:j] + "Y" + base[j + 1:])
    df = spark.createDataFrame([(w,) for w in texts], "term string")
    start = time.perf_counter()
    found = similar.similar_pairs(df).toPandas()
    assert time.perf_counter() - start < 60
    assert len(found) == 1000 * 999 // 2 == len(found.drop_duplicates(["a", "b"]))
    for a, b, ratio in found.sample(40, random_state=1).itertuples(index=False):
        assert abs(ratio - 2 * brute_lcs(a.lower(), b.lower()) / 480) < 1e-12


@pytest.mark.parametrize("t", [0.7, 0.9, 0.99, 1.0])
def test_similar_pairs_of_mixed_lengths(spark, t):
    rng = random.Random(int(t * 1000))
    words = {"", "é", "É", "x", "ab", "aB"}
    for size in (3, 9, 17, 33, 64, 130):
        base = "".join(rng.choices("abcdefg ", k=size))
        words.add(base)
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(1, max(1, size // 6))):
                at = rng.randrange(len(w))
                w[at:at + rng.randint(0, 1)] = rng.choices("abcdefg", k=rng.randint(0, 2))
            words.add("".join(w))
    rows_in = [(w,) for w in sorted(words)] + [(None,), ("ab",)]
    pairs = similar.similar_pairs(spark.createDataFrame(rows_in, "term string"), t)
    got = {(r.a, r.b): r.ratio for r in pairs.collect()}
    want = brute_pairs(sorted(words - {""}), t)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_groups_of_a_chain(spark):
    names = [f"n{i:03d}" for i in range(201)]
    pairs = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
    want = [(names[i], names[j]) for i in range(0, 200, 2) for j in (i, i + 1)]
    assert sorted(rows(similar.consolidate_groups(pairs))) == want
    none = spark.createDataFrame([], "a string, b string")
    assert rows(similar.consolidate_groups(none)) == []


def test_a_leader_whose_terms_another_leads_first(spark):
    edges = [("b", "c"), ("c", "d"), ("a", "b"), ("d", "z"), ("e", "z")]
    pairs = spark.createDataFrame(edges, "a string, b string")
    assert sorted(rows(similar.consolidate_groups(pairs))) == [
        ("a", "a"), ("a", "b"), ("c", "c"), ("c", "d"), ("e", "e"), ("e", "z")]


def test_greedy_order_matters(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert rows(similar.consolidate_groups(pairs)) == [("a", "a"), ("a", "b")]


def test_apply_consolidation(spark):
    table = spark.createDataFrame(
        [("kind", "kind", "predicate"), ("a", "k", "object"), ("b", "k", "object"),
         ("c", "k", "object"), ("d", "k", "object")],
        "Term string, `Source Column` string, `RDF Role` string")
    groups = spark.createDataFrame(
        [("a", "a"), ("a", "b"), ("c", "c"), ("c", "d")], "leader string, member string")
    choices = spark.createDataFrame([("c", None)], "leader string, choice string")
    out = terms.apply_consolidation(table, groups, choices)
    assert [r[0] for r in sorted(out.collect())] == ["a", "c", "d", "kind"]


def test_decisions_and_missing_terms(spark):
    names = ("term_id int, Term string, URI string, `RDF Role` string, `Match Type` string, "
             "`Source Provider` string, `Confirmed Display String` string, "
             "`Provider Term` string, `Provider Description` string")
    mapping = spark.createDataFrame(
        [(i, f"t{i}", "", "object", "", "", "", "", "") for i in range(3)], names)
    decisions = spark.createDataFrame(
        [(0, "http://x", "P", "disp", "lab", "desc", None),
         (1, "No Match", None, None, None, None, None)],
        "term_id int, uri string, source string, display string, label string, "
        "description string, match_type string")
    out = {r.term_id: r for r in terms.apply_decisions(mapping, decisions).collect()}
    assert (out[0].URI, out[0]["Match Type"], out[0]["Provider Term"]) == (
        "http://x", "skos:exactMatch", "lab")
    assert (out[1].URI, out[1]["Confirmed Display String"], out[1]["Match Type"]) == (
        "No Match", "--- No Match ---", "")
    assert out[2].URI == ""
    done = terms.apply_decisions(mapping, decisions)
    assert rows(terms.unreconciled(done), "term_id") == [(1,), (2,)]
    assert {r.URI for r in terms.download_table(done).collect()} == {"http://x", ""}
    more = spark.createDataFrame([("t0",), ("new",)], "Term string")
    full = terms.complete_missing_terms(mapping, more)
    assert full.columns[:6] == ["Term", "URI", "RDF Role", "Match Type", "Source Provider",
                                "Confirmed Display String"]
    assert rows(full.filter("URI = 'No Match'"), "Term") == [("new",)]
    assert rows(terms.page(mapping, ["term_id"], 9, 2), "term_id") == [(2,)]
    processed = spark.createDataFrame([(0, "P")], "term_id int, provider string")
    assert rows(terms.pending_terms(mapping, processed, "P", 1), "term_id") == [(1,)]


def test_literals_are_told_once_per_value(spark, capsys):
    rows = [("a", "7"), ("a", " 7"), ("a", "2,5"), ("b", "ja"), ("b", "1998-10-03"), ("year", "1998.0"), ("b", "")]
    cells = spark.createDataFrame(rows * 50, "column string, value string")
    out = literals_by_type(cells)
    got = {(r.column, r.datatype.split("#")[1]): (r.cells, r.lowest, r.highest) for r in out.collect()}
    assert got == {
        ("a", "integer"): (100, "7", "7"), ("a", "decimal"): (50, "2.5", "2.5"), ("b", "boolean"): (50, "true", "true"),
        ("b", "dateTime"): (50, "1998-10-03T00:00:00", "1998-10-03T00:00:00"), ("b", "string"): (50, "", ""),
        ("year", "gYear"): (50, "1998", "1998"),
    }
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out  # from the result down to the table
    assert plan.rindex("keys=[column") > max(plan.rindex("RLIKE"), plan.rindex("datatype"))
