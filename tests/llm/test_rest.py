"""Tokens, chat, media, mixing, addresses and languages: round trips, brute force, edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from tablegraph.llm import bpe, chat, language, media, mixing, urls
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_tokens_equal_the_library(docs, rows, empty):
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], r[1], tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    got = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert Counter((r.doc_id, r.text, tuple(r.ids), r.decoded) for r in got.collect()) == want
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0


def test_scan_and_heap_merge_alike():
    own, library, rng = bpe.Codec(PATH), Tokenizer.from_file(PATH), random.Random(3)
    for n in (1, 2, 63, 64, 65, 500, 5000):
        word = "".join(rng.choice("abcdefgehinthr") for _ in range(n))
        parts = [*word[:-1], word[-1] + "</w>"]
        scanned = bpe.merge_short([own.vocab[p] for p in parts], own.merges, own.ranks, own.size)
        assert bpe.merge_long(parts, own.rank) == [own.tokens[i] for i in scanned]
        assert own.encode(word) == library.encode(word, add_special_tokens=False).ids


def test_every_code_point():
    """Alone, inside a word, beside a digit and in both cases, below and beyond the Latin letters."""
    own, library = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50):
        text = " ".join(f"{c} a{c}b 1{c}" for c in points[k : k + 50])
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(ord(points[k]))


def test_tokens_query(spark):
    """The digests of the query against the library."""
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in entry_points.queries()["op1_bpe"](spark, SF_SMALL).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        stored = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(stored).hexdigest())
        back = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_chat_windows_round_trip(spark):
    rng = random.Random(2)
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "\\", "\\<|", "<\\|end|>", "", None]
    rows = []
    for conv in (1, 2, 3, None):
        for turn in range(1200 if conv == 1 else 7):
            role = "system" if turn == 0 and conv != 2 else ("user", "assistant")[turn % 2]
            text = nasty[turn % 7] if turn % 3 else " ".join("w" * rng.randrange(1, 40) for _ in range(rng.randrange(200)))
            rows.append((conv, turn, role, text))
    rows += [(3, None, None, "early"), (3, 4, "user", "same"), (3, 4, "user", "same"), (2, 3, "assistant", "x " * 3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(turns).withColumn("turns", chat.parsed(F.col("text"))).withColumn(
        "said", F.transform("loss", lambda s: chat.unescaped(F.substring("text", s["start"] + 1, s["length"]))))
    got = defaultdict(list)
    for r in sorted(made.collect(), key=lambda r: (r.block, r.window)):
        new = r.turns[r.repeated:]
        assert [t.text for t in new if t.role == "assistant"] == list(r.said)
        body = re.sub(r"<\|turn\|>|<\|text\|>|<\|end\|>", "", r.text)
        assert not re.search(r"<\||</?s>|\[/?INST\]", body)
        if r.conv_id in (1, None):
            assert "system" in {t.role for t in r.turns}
        cost = sum(len((t.text or "").split()) + chat.OVERHEAD for t in new)
        assert cost <= 512 or len(new) == 1
        got[r.conv_id] += [(t.role, t.text) for t in new]
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert got == want
    assert chat.windows(turns.limit(0)).count() == 0


def test_media_round_trip(docs, rows, empty):
    got = media.fingerprinted(media.stored(docs)).collect()
    assert Counter((r.doc_id, bytes(r.payload)) for r in got) == Counter((r[0], media.payload(r[1])) for r in rows)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text].add((bytes(r.media), tuple(r.times), tuple(r.codes)))
        assert list(r.times) == sorted(r.times)
    assert all(len(x) == 1 for x in by_text.values())
    assert media.fingerprinted(media.stored(empty)).count() == 0


def test_fingerprint_finds_its_tones():
    import numpy as np

    t = np.arange(8192)
    tone = (128 + 60 * np.sin(2 * np.pi * 20 * t / media.FRAME)).astype(np.uint8).tobytes()
    times, codes = media.pairs(tone)
    assert len(times) and {c >> 12 for c in codes.tolist()} == {20}
    assert media.from_wav(media.to_wav(tone)) == tone


def test_mix(spark, docs, rows, empty):
    rng = random.Random(1)
    many = [(100 + i, " ".join("w" for _ in range(rng.randrange(1, 200))), f"s{i % 7}") for i in range(700)]
    many += [(900 + i, "w " * 50, "s0") for i in range(900)] + [(2000, "a b", None), (2000, "a b", None), (2001, None, "s1")]
    table = spark.createDataFrame(many, "doc_id long, text string, source string")
    got = mixing.mixed(table).collect()
    assert len(got) == len(many)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 3 * r.size
        assert r.taken == r.size * len(r.shards)
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    left, free = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(free)}
    want = {}
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]]:
        want |= {s: 3 * size[s] for s in over}
        left -= sum(want[s] for s in over)
        free = [s for s in free if s not in over]
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s])
    shards = Counter(x for r in got for x in r.shards)
    assert set(shards) == set(range(16)) and max(shards.values()) - min(shards.values()) <= 16
    again = {(r.doc_id, r.text, tuple(r.shards)) for r in mixing.mixed(table.repartition(5)).collect()}
    assert again == {(r.doc_id, r.text, tuple(r.shards)) for r in got}
    assert mixing.mixed(docs).count() == len(rows)
    assert mixing.mixed(empty).count() == 0


def test_quotas_are_exact(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), ("c", 1), (None, 400)], "source string, quota long")
    leaves = mixing.split_quotas(quotas, 3).collect()
    by_source, by_node = Counter(), Counter()
    for r in leaves:
        assert r.quota >= 0
        by_source[r.source] += r.quota
        by_node[r.node] += r.quota
    assert by_source == {"a": 1000, "b": 37, "c": 1, None: 400}
    assert max(by_node.values()) - min(by_node.values()) <= 3


def test_written_leaves_hold_their_quotas(spark, monkeypatch):
    rng, split, quotas = random.Random(8), mixing.split_quotas, []
    given = [(i if i % 9 else None, f"u{i} " + " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(60))),
              ("a", "b", "é", None)[i % 4]) for i in range(600)]
    table = spark.createDataFrame(given, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "BLOCKS", 1 << 30)  # a block for each document: draws are rows

    def kept(*given):
        quotas.append(split(*given))
        return quotas[-1]

    monkeypatch.setattr(mixing, "split_quotas", kept)
    mix = mixing.mixed(table)
    out = mixing.written(mix)
    places = out.withColumn("part", F.spark_partition_id()).collect()
    want = {(r.node, r.source): r.quota for r in quotas[0].collect() if r.quota}
    assert Counter((r.shard, r.source) for r in places) == want
    # The pipeline's stage writes these rows in this order.
    stage = corpus_pipeline.mix_sources(spark, table, "")
    assert stage.columns == table.columns
    shown = [(r.part, r.doc_id, r.text, r.source) for r in places]
    assert [tuple(r) for r in stage.select(F.spark_partition_id(), *stage.columns).collect()] == shown
    for a, b in zip(places, places[1:]):
        assert a.part != b.part or a.shard <= b.shard


def test_urls(spark):
    given = ["http://A.Example.com/x/?b=2&a=1&utm_src=q#f", "https://www.a.example.com:443/x?a=1&b=2", None, "",
             "no scheme", "http://x.org", "http://x.org/a", "http://example.org/es/1", "http://notexample.org/es/1",
             "http://q.com/fr/de/", "http://z.net/ok", "http://z.net/ok/", "http://Z.net/other", "://", "http://"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(given + given[:2])],
                                  "page_id long, url string, host string, key string")
    listed = spark.createDataFrame([("http://a.example.com/x?a=1&b=2",), ("http://m.z.net/ok",), (None,)], "url string")
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block")]
    got = {r.page_id: r for r in urls.judged(pages, listed, rules).collect()}
    assert [got[k].verdict for k in range(17)] == [
        "block", "block", "allow", "allow", "allow", "allow", "allow", "block", "allow", "allow", "block", "block",
        "allow", "allow", "allow", "block", "block"]
    assert [got[k].rule for k in (5, 6, 7, 8)] == [None, "org/", "example.org/es/", "org/"]
    assert (got[0].host, got[0].path) == ("a.example.com", "/x/") and (got[2].host, got[2].path) == ("", "")
    assert urls.judged(pages.limit(0), listed, rules).count() == 0
    assert urls.judged(pages, listed.limit(0), rules).where("verdict = 'block'").count() == 1


def test_bloom_filter_has_no_false_negative(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = urls.bloom_blocks(keys, 256)
    met = keys.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(256))).join(blocks, "block")
    for j, b in enumerate(urls.bits(F.col("key"))):
        met = met.where(F.col(f"w{j}").bitwiseAND(b) != 0)
    assert met.count() == 3000


def test_languages_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    rows = docs.where(held).select("doc_id", "text", F.lit(None).cast("string").alias("declared"),
                                   F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), "lang")
    truth = dict(docs.select("doc_id", "lang").collect())
    got = language.identified(rows, docs.where(~held)).collect()
    assert sum(r.lang == truth[r.doc_id] for r in got) >= 0.97 * len(got)


def test_evidence_decides_where_text_is_silent(spark):
    known = spark.createDataFrame(
        [("the quick brown house " * 20, "en"), ("der schnelle braune fuchs " * 20, "de"), (None, "fr"), ("x", None)],
        "text string, lang string")
    rows = [(i, "der schnelle fuchs", "de", "com/", "h.de") for i in range(40)]
    rows += [(100 + i, "the quick house", "en", "com/", "h.en") for i in range(40)]
    rows += [(200, None, "de", "com/", "h.de"), (201, "", None, "com/", "h.en"), (202, None, None, None, None)]
    table = spark.createDataFrame(rows, "row long, text string, declared string, suffix string, host string")
    got = {r.row: r.lang for r in language.identified(table, known).collect()}
    assert got[0] == "de" and got[100] == "en" and got[200] == "de" and got[201] == "en" and len(got) == 83
    assert language.identified(table.limit(0), known).count() == 0


def test_windows_do_not_depend_on_turn_numbers(spark):
    """Dense, sparse, null and equal numbers of the same turns give the same windows."""
    turns = [(i, "user" if i % 2 else "assistant", f"{i:04d} " + "w " * 99) for i in range(600)]
    rows = [(c, n(i), role, text) for c, n in enumerate((
        lambda i: i, lambda i: 256 * i, lambda i: None, lambda i: 7)) for i, role, text in (
        turns if c < 2 else [(i, "user", text) for i, _, text in turns])]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = defaultdict(list)
    for r in sorted(made.collect(), key=lambda r: (r.block, r.window)):
        got[r.conv_id].append((r.block, r.window, r.text, r.loss, r.repeated))
    assert got[0] == got[1] and got[2] == got[3]
    # Every window but the first repeats a turn: 104 tokens of the 128 that history may hold.
    assert [w[4] for w in got[0]] == [0] + [1] * (len(got[0]) - 1)
    # One conversation without numbers: every turn has its own place.
    many = made.sparkSession.range(50_000).selectExpr(
        "0 as conv_id", "cast(null as long) as turn", "cast(id as string) as text")
    places = chat.split_positions(many, ["conv_id"], ["turn", "text"], "p")
    assert places.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first() == (50_000, 1, 50_000)
