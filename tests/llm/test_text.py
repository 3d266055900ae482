"""Operators on texts against brute-force versions, on edge cases and empty tables."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablegraph.llm import jaccard, phrases, quality, suffixes
from tablegraph.llm.words import ODD, mixed, windows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def listed(rows):
    return [(r[0], WORD.findall(r[1] or ""), r[1]) for r in rows]


def removed(rows, size):
    """Words that repeat a window of a smaller id, as a mask for each (id, text)."""
    first = {}
    for i, w, _ in listed(rows):
        if i is not None:
            for j in range(len(w) - size + 1):
                g = tuple(w[j : j + size])
                first[g] = min(i, first.get(g, i))
    out = {}
    for i, w, t in listed(rows):
        gone = [False] * len(w)
        for j in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[j : j + size])] < i:
                gone[j : j + size] = [True] * size
        out[i, t] = gone
    return out


def test_phrases_equal_brute_force(docs, rows):
    want = removed(rows, 13)
    got = phrases.drop_repeated(docs).collect()
    assert len(got) == len(rows)
    left = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got)
    assert left == Counter(
        (i, len(w), sum(want[i, t]), " ".join(x for x, g in zip(w, want[i, t]) if not g))
        for i, w, t in listed(rows))
    assert got[0].key == "x" and got[0].rest == "x"


def test_passages_are_repeats_and_all_planted_ones_go(docs, rows):
    want = removed(rows, 50)
    got = suffixes.drop_passages(docs).collect()
    assert len(got) == len(rows)
    whole = Counter((i, t) for i, _, t in listed(rows))
    spans = {}
    for r in got:
        for i, t in whole:
            if i == r.doc_id and len(WORD.findall(t or "")) == r.n_words:
                spans.setdefault((i, t), r)
    for (i, t), r in spans.items():
        gone = [any(s.start <= k < s.end for s in r.removed) for k in range(r.n_words)]
        assert sum(gone) == r.n_removed
        assert gone == want[i, t]
        if not r.n_removed:
            assert r.text == t
    assert {r.doc_id for r in got if r.n_removed} == {i for (i, t), g in want.items() if any(g)}


def test_passages_that_share_too_little_with_the_first(spark):
    """Later documents share 50 words with each other and 26 to 49 with the first."""
    rng = random.Random(9)

    def fill(n):
        return [f"u{rng.randrange(10**9)}" for _ in range(n)]

    base, rows = fill(120), []
    for i in range(60):
        a = rng.randrange(0, 90)
        part = base[a : a + rng.randrange(20, 100)]
        rows.append((i, " ".join(fill(rng.randrange(0, 40)) + part + fill(rng.randrange(0, 40)))))
    rows += [(100, rows[5][1]), (101, rows[7][1] + " " + " ".join(base[10:70]))]
    want = removed(rows, 50)
    got = suffixes.drop_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    masks = {r.doc_id: [any(s.start <= k < s.end for s in r.removed) for k in range(r.n_words)] for r in got}
    assert masks == {i: want[i, t] for i, t in rows}


def test_classes_equal_brute_force(docs, rows):
    sets = []
    for i, _, t in listed(rows):
        w = WORD.findall((t or "").translate(LOWER))
        n = min(5, len(w)) or 1
        sets.append((i, t, {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()))
    parent = {i: i for i, _, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, _, x in sets:
        for b, _, y in sets:
            if None not in (a, b) and a < b and x and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    want = {(i, len(s), root(i) if i is not None else None) for i, _, s in sets}
    assert {tuple(r) for r in jaccard.classes(docs).collect()} == want


def test_counts_and_base_rules(spark, docs, rows):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, None, 0), (2, 0, None), (None, 1, 1), (99, 1, 0)],
        "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, w, t in listed(rows):
        seen = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        twice = {k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t or ""),
             len(lines) - len(set(lines)), len(twice), failed, not failed] += 1
    assert Counter((r.doc_id, *[r[c] for c in quality.COUNTS], r.base_failed, r.kept) for r in got) == want


def test_cutoffs_keep_their_promise(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(4000)]
    bad = [(9000 + i, " ".join(["#$%&"] * 30 + [f"v{i}x{j}" for j in range(40)]), "en") for i in range(50)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(
        [(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.judged(docs, labels).collect()}
    assert all(got[i] for i, _, _ in good)
    assert not any(got[i] for i, _, _ in bad)
    few = labels.where("doc_id < 100 or doc_id >= 9000")
    assert all(r.kept for r in quality.judged(docs, few).collect())  # too few labels: base rules only


def test_cutoffs_of_languages_with_few_labels(spark):
    """From 228 good documents on junk goes, and the good ones that all ratios turn away stay few."""
    plain = {"de": 228, "fr": 227, "es": 400}
    rows = [(k * 10000 + i, " ".join(f"w{i}x{j}" for j in range(60)), lang, 1)
            for k, (lang, n) in enumerate(plain.items()) for i in range(n)]
    for k, lang in enumerate(plain):
        rows += [(k * 10000 + 9000 + i, " ".join(["#$%&"] * 30 + [f"v{i}x{j}" for j in range(40)]), lang, 0)
                 for i in range(20)]
    # Good documents in Spanish with words of more than 12 letters: no cutoff of the length holds.
    rows += [(28000 + i, " ".join(f"longlonglongword{i}x{j}" for j in range(60)), "es", 1) for i in range(40)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    gone = Counter()
    got = {r.doc_id: r.kept for r in quality.judged(docs, labels).collect()}
    for i, _, lang, good in rows:
        gone[lang, good] += not got[i]
    assert gone == {("de", 0): 20, ("de", 1): 0, ("fr", 0): 0, ("fr", 1): 0, ("es", 0): 20, ("es", 1): 0}


@pytest.mark.parametrize("k, n, rate", [(0, 500, 0.01), (2, 800, 0.005), (40, 20000, 0.005), (7, 7, 0.5)])
def test_binomial_tail(spark, k, n, rate):
    from math import comb

    from pyspark.sql import functions as F

    want = sum(comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))
    got = spark.range(1).select(quality.at_most(F.lit(k).cast("long"), F.lit(n).cast("long"), rate)).first()[0]
    assert got == (pytest.approx(want, rel=1e-8) if k < n * rate else 1.0)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert phrases.drop_repeated(empty).count() == 0
    assert suffixes.drop_passages(empty).count() == 0
    assert jaccard.classes(empty).count() == 0
    assert quality.judged(empty, labels).count() == 0


def test_contexts_and_common_words_without_a_call_per_place():
    rng = random.Random(9)
    kinds = ["a", "bé", "字字", "\x00", "'S", "c\x85"]
    texts = [" \t".join(rng.choices(kinds, k=rng.randrange(70))) + "\n " * (i % 3) for i in range(60)]
    w = words(pa.array([None, *texts, ""]))
    flat, least = w.flat.to_pylist(), 50
    at = np.arange(0, len(flat), 7)
    near, shown = suffixes.contexts(w, at, least), []
    for p in at:
        a, b = max(w.offsets[w.texts[p]], p - suffixes.SPAN + 1), min(w.offsets[w.texts[p] + 1], p + least)
        shown += [" ".join(flat[a:p]).encode(), " ".join(flat[p:b]).encode()]
    assert near == shown and suffixes.contexts(w, at[:0], least) == []
    assert suffixes.spread(suffixes.squeeze(near)) == near
    of = np.array([rng.randrange(len(at)) for _ in at])
    left, right = suffixes.extended(w, at, near, of, least)

    def alike(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    for i, o in enumerate(of):
        back, ahead = ([x.decode().split(" ") if x else [] for x in near[2 * k : 2 * k + 2]] for k in (i, o))
        assert left[i] == alike(back[0][::-1], ahead[0][::-1]) and right[i] == alike(back[1], ahead[1])


def test_window_hashes_and_cut_text_equal_the_plain_forms():
    rng, most = random.Random(3), 2**64
    hashes = np.array([rng.randrange(most) for _ in range(90)], np.uint64)
    for size in (1, 2, 3, 5, 8, 13, 26, 50, 89, 90, 91):
        n = max(0, 90 - size + 1)
        sums = [sum(int(hashes[i + j]) * int(ODD) ** (size - 1 - j) for j in range(size)) for i in range(n)]
        assert (windows(hashes, size) == mixed(np.array([(x + size) % most for x in sums], np.uint64))).all()
    for text in ("", " \t ", "a", " é  b\n\x0b字 d \x85 e\r\n", "x  y"):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        for gone in itertools.product([False, True], repeat=n):
            marks, out, at = np.array(gone, bool), "", 0
            for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
                if gone[i]:
                    out, at = out + (text[at : m.start()] if i == 0 or not gone[i - 1] else ""), m.end()
            assert suffixes.cut_text(text, marks) == re.sub(r"[\x20\x09-\x0D]+\Z", "", out + text[at:])
