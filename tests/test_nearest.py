"""Entities for terms that share no token with any, against comparing all pairs."""

import random

from tablegraph.operators import link


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def brute(terms, entities, limit):
    out = set()
    for term in terms:
        scored = []
        for uri, label, synonyms in entities:
            sims = [1 - distance(term, n) / max(len(term), len(n)) if n else 0.0 for n in (label, *synonyms)]
            raw = min(1.0, max(sims) + 0.08) if label and term in label else max(sims)
            scored.append((-round(raw, 9), uri))
        out |= {(term, i + 1, uri, round(-raw, 6)) for i, (raw, uri) in enumerate(sorted(scored)[:limit])}
    return out


def test_search_without_shared_tokens(spark):
    rng = random.Random(4)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    entities = [(f"u{i:03d}", word("abcd", rng.randrange(1, 14)), [word("abce", rng.randrange(1, 9))]) for i in range(150)]
    entities += [("u900", "xyz xabdy", []), ("u901", "same", ["same"]), ("u902", "same", []), ("u903", "", [])]
    # No token of three letters in common with any name; near, far, contained, and like nothing at all.
    terms = [word("abcd", rng.randrange(5, 14)) + "e" for _ in range(25)] + ["abd", "sam", "qqqq", "0", "zz zz", "é"]
    rows = spark.createDataFrame([(u, n, "", s) for u, n, s in entities], "uri string, label string, "
                                 "description string, synonyms array<string>")
    asked = spark.createDataFrame([(t, t) for t in terms], "term_id string, term string")
    known = {t for _, n, s in entities for x in (n, *s) for t in x.split() if len(t) > 2}
    terms = [t for t in terms if not set(t.split()) & known]
    asked = asked.where(asked.term.isin(terms))
    for limit in (1, 6, 400):
        got = link.search_vocabulary(asked, rows, limit)
        assert {(r.term, r.rank, r.uri, r.score) for r in got.collect()} == brute(terms, entities, limit)
    long = spark.createDataFrame([(u, x) for u, _, s in entities for x in s], "uri string, name string")
    got = link.search_vocabulary(asked, rows.drop("synonyms"), 6, long)
    assert {(r.term, r.rank, r.uri, r.score) for r in got.collect()} == brute(terms, entities, 6)
    nothing = link.search_vocabulary(asked, rows.limit(0), 5)
    assert nothing.count() == 0
