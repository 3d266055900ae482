"""Substring dedup by repeated-phrase automata: confirm recurring phrases, compile them, stream texts.

A phrase is a run of ``size`` consecutive words. Every phrase that also starts in a document with a
smaller id is removed; phrases are judged on the input.

1. Content-selected anchors (minimisers of short word grams) are counted over all documents; a phrase
   recurs only if its anchor does.
2. Phrases under recurring anchors are confirmed: buckets send one entry per distinct phrase, shards
   answer with the smallest id and the number of documents that hold it.
3. The document with the smallest id sends the text of its confirmed phrases to a shard of the phrase
   dictionary, and every other document sends its stretches that may hold them. A phrase of very many
   documents is dealt over as many shards as its documents need.
4. Each shard compiles its phrases into one Aho-Corasick automaton over word sequences and streams the
   stretches through it. What it finds, compared word by word, is what goes.

Whole-text copies of an earlier document need no search: all their words go if they hold a phrase.
Null texts have no words; rows with a null id neither lose words nor take any from others; rows of one
id take nothing from each other. Equal rows get equal results. Columns of any name pass through.
"""

from __future__ import annotations

import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegraph.llm import exchange as ex
from tablegraph.llm.frame import (
    BUCKETS_PER_PARTITION, SIDE, SPANS, bucketed, copies, copy_side, unpacked,
    width, with_rest,
)
from tablegraph.llm.words import (
    Words, column, covered, inside, minimisers, runs, windows, words,
)

GRAM = 5
# Documents of one phrase that one shard streams.
DOCS_PER_SHARD = 1000
CONFIRMED = 9
NO_ID = np.iinfo(np.int64).min


def ids_of(docs: pa.Table) -> np.ndarray:
    return pc.fill_null(column(docs, "id"), int(NO_ID)).to_numpy()


def left_out(docs: pa.Table, side: pa.Table) -> np.ndarray:
    """Copies and rows without an id take no part in the search."""
    skipped = ex.copy_keys(side)
    copied = np.isin(column(docs, "key").to_numpy(), np.fromiter(skipped, np.int64, len(skipped)))
    return copied | column(docs, "id").is_null().to_numpy(zero_copy_only=False)


def anchors(w: Words, out: np.ndarray, size: int):
    """Mask of the phrases that take part, the anchor of each, and the distinct anchors."""
    fits = inside(w, size)
    fits &= ~out[w.texts[: len(fits)]]
    place = minimisers(windows(w.hashes, GRAM), size - GRAM + 1)[: len(fits)]
    return fits, place, np.unique(place[fits])


def recurring(docs: pa.Table, side: pa.Table, size: int):
    """Words, phrases under recurring anchors (starts), and their hashes."""
    w = words(column(docs, "text"))
    fits, place, at = anchors(w, left_out(docs, side), size)
    grams = windows(w.hashes, GRAM)
    held = np.zeros(len(grams) + 1, np.uint32)
    held[at] = ex.totals(grams[at], w.texts[at], side)
    starts = np.flatnonzero(fits & (held[place] >= 2))
    return w, starts, windows(w.hashes, size)[starts]


def two(a: bytes, b: bytes) -> bytes:
    return struct.pack("<I", len(a)) + a + b


def apart(data: bytes) -> tuple[bytes, bytes]:
    n = struct.unpack_from("<I", data)[0]
    return data[4 : 4 + n], data[4 + n :]


def confirmed(frame: DataFrame, side: DataFrame, size: int) -> DataFrame:
    """Side rows that tell each bucket the first holder and the holders of its phrases."""
    shards = width(frame.sparkSession)

    def ask(docs: pa.Table, extra: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            w, starts, found = recurring(docs, extra, size)
            order, first_at, _, counts = ex.grouped(found, w.texts[starts])
            if len(order):
                least = np.minimum.reduceat(ids_of(docs)[w.texts[starts]][order], first_at)
                keys, bucket = found[order][first_at], docs["bucket"][0].as_py()
                for shard, a, b in ex.pieces(keys, 64, shards):
                    told = two(ex.pack(least[a:b]), ex.pack(counts[a:b].astype(np.uint32)))
                    rows.append((shard, bucket, ex.pack_sorted(keys[a:b]), told))
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                        names=["shard", "bucket", "keys", "counts"])

    def answer(asked: pa.Table) -> pa.Table:
        keys = [ex.unpack_sorted(x) for x in column(asked, "keys").to_pylist()]
        told = [apart(x) for x in column(asked, "counts").to_pylist()]
        ids = np.concatenate([ex.unpack(x, np.int64) for x, _ in told])
        held = np.concatenate([ex.unpack(x, np.uint32) for _, x in told])
        _, entry = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(entry, held).astype(np.uint32)[entry]
        least = np.full(entry.max() + 1 if len(entry) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, entry, ids)
        least = np.where(total >= 2, least[entry], 0)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        packed = [two(ex.pack(a), ex.pack(b))
                  for a, b in zip(np.split(least, ends), np.split(total, ends), strict=True)]
        n = asked.num_rows
        return pa.table({
            "bucket": column(asked, "bucket"), "kind": pa.array([CONFIRMED] * n, pa.int32()),
            "shard": column(asked, "shard"), "id": pa.nulls(n, pa.int64()),
            "payload": pa.array(packed, pa.binary()),
        })

    asked = frame.groupBy("bucket").cogroup(side.groupBy("bucket")).applyInArrow(ask, ex.ASK)
    return side.unionByName(asked.groupBy("shard").applyInArrow(answer, SIDE))


def stretches(frame: DataFrame, side: DataFrame, size: int) -> DataFrame:
    """Texts of confirmed phrases (``key`` null) and the stretches that may hold them, by shard."""
    shards = width(frame.sparkSession) * BUCKETS_PER_PARTITION

    def send(docs: pa.Table, extra: pa.Table) -> pa.Table:
        out = {"holder": [], "salt": [], "bucket": [], "key": [], "id": [], "start": [], "text": []}

        def row(*values):
            for name, v in zip(out, values, strict=True):
                out[name].append(v)

        if docs.num_rows:
            w, starts, found = recurring(docs, extra, size)
            order, _, entry, _ = ex.grouped(found, w.texts[starts])
            told = [r for r in extra.select(["kind", "shard", "payload"]).to_pylist()
                    if r["kind"] == CONFIRMED]
            told = [apart(r["payload"]) for r in sorted(told, key=lambda r: r["shard"])]
            if told:
                least, total = np.zeros(len(found), np.int64), np.zeros(len(found), np.uint32)
                least[order] = np.concatenate([ex.unpack(x, np.int64) for x, _ in told])[entry]
                total[order] = np.concatenate([ex.unpack(x, np.uint32) for _, x in told])[entry]
                ids, of = ids_of(docs), w.texts[starts]
                salts = total // DOCS_PER_SHARD + 1
                again = (total >= 2) & (ids[of] > least)
                source = (total >= 2) & (ids[of] == least)
                keys, bucket = column(docs, "key").to_numpy(), docs["bucket"][0].as_py()
                # A stretch ends where the phrases do, or where their holder or spread changes.
                if len(starts):
                    cut = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(of) != 0)
                                          | (np.diff(least) != 0) | (np.diff(salts) != 0)
                                          | (again[1:] != again[:-1]) | (source[1:] != source[:-1])])
                    begin = np.flatnonzero(cut)
                    for a, b in zip(begin, [*begin[1:], len(starts)], strict=True):
                        if not (again[a] or source[a]):
                            continue
                        t, n = int(of[a]), int(salts[a])
                        text = w.between(int(starts[a]), int(starts[b - 1]) + size)
                        if again[a]:
                            row(int(least[a]), int(keys[t]) % n, bucket, int(keys[t]), int(ids[t]),
                                int(starts[a] - w.offsets[t]), text)
                        else:
                            for salt in range(n):
                                row(int(least[a]), salt, bucket, None, int(ids[t]), 0, text)
        return pa.table(out, schema=schema)

    schema = pa.schema([("holder", pa.int64()), ("salt", pa.int64()), ("bucket", pa.int32()),
                        ("key", pa.int64()), ("id", pa.int64()), ("start", pa.int64()),
                        ("text", pa.string())])
    sent = frame.groupBy("bucket").cogroup(side.groupBy("bucket")).applyInArrow(
        send, "holder long, salt long, bucket int, key long, id long, start long, text string"
    )
    shard = F.pmod(F.xxhash64("holder", "salt"), F.lit(shards)).cast("int")
    return sent.select(shard.alias("shard"), "bucket", "key", "id", "start", "text")


def located(sent: DataFrame, size: int) -> DataFrame:
    """Side rows with the spans of each document that the automata of the shards found."""

    def stream(rows: pa.Table) -> pa.Table:
        known: dict[str, int] = {}
        phrases = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        rows = rows.to_pylist()
        for r in rows:
            if r["key"] is None:
                ids = tuple(known.setdefault(x, len(known) + 1) for x in r["text"].split(" "))
                for i in range(len(ids) - size + 1):
                    phrases.add_word(ids[i : i + size], r["id"])
        out = {"bucket": [], "kind": [], "shard": [], "id": [], "payload": []}
        if len(phrases):
            phrases.make_automaton()
            for r in rows:
                if r["key"] is None:
                    continue
                ids = tuple(known.get(x, 0) for x in r["text"].split(" "))
                hit = np.zeros(len(ids), bool)
                for end, holder in phrases.iter(ids):
                    if holder < r["id"]:
                        hit[end - size + 1 : end + 1] = True
                spans = np.concatenate(runs(hit)) + r["start"]
                for name, v in zip(out, (r["bucket"], SPANS, 0, r["key"],
                                         spans.astype("<i8").tobytes()), strict=True):
                    out[name].append(v)
        return pa.table(out, schema=pa.schema([
            ("bucket", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()), ("id", pa.int64()),
            ("payload", pa.binary())]))

    return sent.groupBy("shard").applyInArrow(stream, SIDE)


def removed_spans(side: pa.Table) -> dict[int, list[np.ndarray]]:
    """Starts and ends, by words, of each document key's spans."""
    found: dict[int, list[np.ndarray]] = {}
    some = side.filter(pc.equal(side["kind"], SPANS))
    for key, data in zip(column(some, "id").to_pylist(), column(some, "payload").to_pylist(),
                         strict=True):
        found.setdefault(key, []).append(np.frombuffer(data, "<i8").reshape(2, -1))
    return found


def without_spans(frame: DataFrame, side: DataFrame, size: int) -> DataFrame:
    """``id, n_words, n_removed, text`` (kept words, one space between) and ``rest``."""
    rest = "rest" in frame.columns

    def cut(docs: pa.Table, extra: pa.Table) -> pa.Table:
        n = docs.num_rows
        w = words(column(docs, "text")) if n else words(pa.array([], pa.string()))
        lengths = np.diff(w.offsets)
        gone = np.zeros(len(w.flat), bool)
        skipped, spans = ex.copy_keys(extra), removed_spans(extra)
        for t, key in enumerate(column(docs, "key").to_pylist() if n else []):
            a, b = w.offsets[t], w.offsets[t + 1]
            if key in skipped:
                gone[a:b] = b - a >= size
            elif key in spans:
                starts, ends = np.concatenate(spans[key], axis=1)
                gone[a:b] = covered(b - a, starts, ends)
        kept = np.concatenate([[0], np.cumsum(~gone)])[w.offsets]
        lists = pa.LargeListArray.from_arrays(
            pa.array(kept, pa.int64()), w.flat.filter(pa.array(~gone)).cast(pa.large_string()))
        text = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
        columns = [docs["id"], pa.array(lengths, pa.int64()),
                   pa.array(lengths - np.diff(kept), pa.int64()), text]
        names = ["id", "n_words", "n_removed", "text"]
        if rest:
            columns, names = [*columns, docs["rest"]], [*names, "rest"]
        return pa.table(columns, names=names)

    schema = with_rest("id long, n_words long, n_removed long, text string", frame)
    return frame.groupBy("bucket").cogroup(side.groupBy("bucket")).applyInArrow(cut, schema)


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  size: int = 13) -> DataFrame:
    """The documents with the words of repeated phrases removed, and ``n_words``, ``n_removed``."""
    frame = bucketed(docs, id_col, text_col)
    plain = copy_side(copies(frame))

    def tokens(table: pa.Table, skipped: set[int]):
        w = words(column(table, "text"))
        out = np.isin(column(table, "key").to_numpy(), np.fromiter(skipped, np.int64, len(skipped)))
        out |= column(table, "id").is_null().to_numpy(zero_copy_only=False)
        at = anchors(w, out, size)[2]
        return windows(w.hashes, GRAM)[at], w.texts[at]

    told = ex.token_counts(frame, plain, tokens)
    told = confirmed(frame, told, size)
    spans = located(stretches(frame, told, size), size)
    left = without_spans(frame, spans.unionByName(plain), size)
    return unpacked(left, docs.columns, id_col, text_col, ["n_words", "n_removed"])
