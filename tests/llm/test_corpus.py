"""Source audit, personal data and phrases against brute force, on edge cases."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry_points
from tablegraph.llm import collocations, divergence, pii
from tests.conftest import SF_SMALL

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- op11 --------------------------------------------------------------------------------------------------


def audit(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(ASCII_LOWER)))
            for text, lang, source in rows]
    groups = sorted({(lang, source) for lang, source, _ in docs})
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in sorted({g[0] for g in groups}):
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = [s for x, s in groups if x == lang]

        def shares(count):
            base = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // base for t in kept}

        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(whole[t] - own[s][t], t.encode(), t) for t in kept
                    if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, part, x[2], -x[0], i + 1) for i, x in enumerate(sorted(found)[:limit])]
    return sorted(out)


def test_audit_equals_brute_force(docs, rows):
    given_rows = [(r[1], r[2], r[3]) for r in rows]
    for least, top in ((1, 50), (3, 5), (10**6, 50)):
        got = divergence.audited(docs, least=least, top=top)
        assert sorted(map(tuple, got.collect())) == audit(given_rows, least, top)


def test_audit_of_many_sources(spark, monkeypatch):
    """More sources than a tile holds, several blocks, and a text that all sources have."""
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "BLOCK_BITS", 4)
    monkeypatch.setattr(divergence, "SOURCES_PER_ROW", 2)
    made = [(f"common words {' '.join(f't{chr(97 + (i * k) % 23)}' for k in range(9))}", "en", f"s{i % 8}")
            for i in range(40)] + [("the same text", "en", f"s{i}") for i in range(8)] * 3
    got = divergence.audited(spark.createDataFrame(made, "text string, lang string, source string"), least=2)
    assert sorted(map(tuple, got.collect())) == audit(made, 2, 50)


def test_audit_of_nothing(empty):
    assert divergence.audited(empty).count() == 0


# --- op12 --------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def checksum(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_rules(text):
    spans = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in ADDRESS.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == 3 or checksum(digits)):
                spans.append((m.start(), kind, m.end()))
    return sorted(spans)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.@a+- ()é", max_size=60))
def test_rules_equal_plain_patterns(text):
    assert pii.rule_spans(text) == plain_rules(text)


def test_rules_on_examples():
    text = "a@b.co.x+y@z.w 1.2.3.4.5.6.7.8, 4539-1488-0343-6467, +1 (243) 555-5526, 999.1.1.1, 4539148803436468"
    assert pii.rule_spans(text) == plain_rules(text)
    assert [k for _, k, _ in pii.rule_spans(text)] == [0, 0, 1, 1, 2, 3]
    assert pii.rule_spans("9" * 5000 + ".1.1.1") == []


def field(spark, docs=None):
    rows = pii.written_rows()
    table = pii.labelled(spark, docs) if docs is not None else spark.createDataFrame(rows, "text string, spans string")
    return pii.trained(table)


def test_field_learns_its_lines(spark):
    own = field(spark)
    rows = pii.written_rows()
    got = own.spans(pa.array([t for t, _ in rows], pa.large_string()))
    right = sum(pii.written_spans(got.get(i, [])) == s for i, (_, s) in enumerate(rows))
    assert right >= 0.9 * len(rows)
    unseen = pa.array(["fax (0512) 555-0187 or so", "the cat sat on 3 mats in 1999", None, ""], pa.large_string())
    got = own.spans(unseen.fill_null(""))
    assert list(got) == [0] and got[0][0][1] == 3


def test_decoding_is_the_best_path(spark):
    """Against all labellings of short lines."""
    from itertools import product

    import numpy as np

    own = field(spark)
    for text in ("call 555-0134", "visa 4539.1488.0343.6467 at", "a at b"):
        lines, state = own.decoded(pa.array([text], pa.large_string()))
        scores = lines.scores(own.weights)

        def value(path):
            if not pii.FIRST[path[0]] or not all(pii.ALLOWED[a, b] for a, b in zip(path, path[1:], strict=False)):
                return -np.inf
            return scores[range(len(path)), path].sum() + sum(own.moves[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(product(range(pii.STATES), repeat=len(scores)), key=value)
        assert np.isclose(value(tuple(state)), value(best), rtol=1e-5)


def test_found_on_edge_cases(spark, docs, empty):
    own = field(spark, docs)
    got = pii.found(docs, own)
    assert got.count() == docs.count()
    assert set(got.columns) == {*docs.columns} - {"text"} | {"n_email", "n_ip", "n_card", "n_phone", "rule_spans", "spans"}
    assert pii.found(empty, field(spark, empty)).count() == 0


def test_personal_data_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = entry_points.queries()["op12_personal_data"](spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_rules(texts[r.doc_id])
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(want) <= set(pii.read_spans(r.spans))


# --- op13 --------------------------------------------------------------------------------------------------


def phrases(rows, least, share, top):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(ws)
            for n in range(1, 5):
                counts[lang].update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in candidates.items():
            for i, j in combinations(range(len(p) + 1), 2):
                inner = p[i:j]
                if 2 <= len(inner) < len(p) and 100 * a >= share * f[inner]:
                    gone.add(inner)
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], sizes[lang], -x[0])
                for i, x in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_phrases_equal_brute_force(spark, docs, rows):
    given_rows = [(r[1], r[2]) for r in rows] + [
        ("de en de en de en de en. de en", "de"), ("x\x00y ab\u0085c x\x00y ab\u0085c", "a\nb")] * 4
    table = spark.createDataFrame(
        [(i, t, lang) for i, (t, lang) in enumerate(given_rows)], "doc_id long, text string, lang string")
    for least, share, top in ((2, 80, 2000), (4, 50, 30)):
        got = collocations.mined(table, least=least, share=share, top=top)
        assert sorted(map(tuple, got.collect())) == phrases(given_rows, least, share, top)
    assert collocations.mined(docs, least=3).count() > 0


def test_phrases_of_nothing(empty):
    assert collocations.mined(empty).count() == 0


def test_automaton():
    import numpy as np

    paths = np.array([[0, 1, -1], [0, 1, 2], [0, 3, 2], [1, 1, 2]])
    a = collocations.Automaton.built(["\nen", "\nde", "b", "c"], paths, np.array([5, 7, 7, 1]))
    b = collocations.Automaton.unpacked(*a.packed())
    got = [(tuple(r), w) for ps, ws in b.unfolded() for r, w in zip(ps.tolist(), ws.tolist(), strict=True)]
    assert sorted(got) == [((0, 1), 5), ((0, 1, 2), 7), ((0, 3, 2), 7), ((1, 1, 2), 1)]
    other = collocations.Automaton.built(["\nen", "b", "x"], np.array([[0, 1, -1], [0, 2, -1]]), np.array([1, 1]))
    assert collocations.Automaton.built(
        ["\nen", "x", "b"], np.array([[0, 2, -1]]), np.array([9])).composed(other) == [9, 0]
