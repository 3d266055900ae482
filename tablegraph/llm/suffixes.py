"""Suffix-array dedup over sparse suffixes: sort, compare neighbours, extend left and right.

Suffixes are kept only at minimiser positions: of any ``least`` equal words, the first ``SPAN`` word
grams hold one position that the words alone select, and at least ``reach = least - SPAN + 1`` words
follow it. Suffixes whose next ``reach`` words occur in one document only are dropped by exact counts.
The others are sorted by their words; neighbours with ``reach`` words in common form a run, and the
run's first suffix (smallest id, then place) is the one that stays. Every other member is extended
against it, word by word to the left and right; where the equal stretch has ``least`` words or more,
the member's document loses it.

Buckets send one suffix per run (their own first), so a passage of very many documents is one row for
each bucket, and the answer goes back to the bucket, where the other members are extended.

A member can share too little with the run's first suffix and enough with a later one. An exact check
settles that: of each stretch of ``least`` words that holds a shared suffix, buckets send the hash and
their smallest id, shards answer the smallest of all, and every stretch of an earlier document goes. So
a word goes just if a window of ``least`` words around it is also in a document of smaller id.
These hashes decide: what the extension finds lies in such stretches, and whole copies aside it adds no word.

A whole-text copy of an earlier document with at least ``least`` words loses them all. Repeats inside
one document stay. Null texts have no words; rows with a null id neither lose nor take words. Equal
rows get equal results. Text around what goes is left as it was. Columns of any name pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from tablegraph.llm import exchange as ex
from tablegraph.llm.frame import (
    BLANKS, SIDE, bucketed, copies, copy_side, unpacked, width, with_rest,
)
from tablegraph.llm.phrases import ids_of, left_out
from tablegraph.llm.words import (
    Words, column, covered, inside, minimisers, runs, split, windows, words,
)

GRAM = 8
SPAN = 25
FIRSTS = 8
# Suffixes whose words are compared at once.
ROWS = 10_000
# 1 for the bytes between words.
BLANK = np.zeros(256, np.int8)
BLANK[list(BLANKS.encode())] = 1

ASK = ("shard int, bucket int, keys binary, ids binary, places binary, several binary, texts binary, "
       "stretches binary, owners binary")


def suffixes(w: Words, out: np.ndarray, least: int):
    """Places of the sparse suffixes and a hash of the next ``reach`` words of each."""
    reach = least - SPAN + 1
    fits = inside(w, GRAM + SPAN - 1)
    fits &= ~out[w.texts[: len(fits)]]
    chosen = np.zeros(len(w.flat), bool)
    chosen[minimisers(windows(w.hashes, GRAM), SPAN)[: len(fits)][fits]] = True
    at = np.flatnonzero(chosen)
    whole = inside(w, reach)
    at = at[at < len(whole)]
    at = at[whole[at]]
    return at, windows(w.hashes, reach)[at]


def shared(docs: pa.Table, side: pa.Table, least: int):
    """Words, the suffixes that another document has too, by their hash, id and place."""
    w = words(column(docs, "text"))
    at, hashes = suffixes(w, left_out(docs, side), least)
    held = ex.totals(hashes, w.texts[at], side) >= 2
    at, hashes = at[held], hashes[held]
    order = np.lexsort((at, ids_of(docs)[w.texts[at]], hashes))
    return w, at[order], hashes[order]


def contexts(w: Words, at: np.ndarray, least: int) -> list[bytes]:
    """Of each place, up to ``SPAN - 1`` words before it and ``least`` words from it, in its text."""
    if not len(at):
        return []
    text, begin = w.joined()
    a = np.maximum(w.offsets[w.texts[at]], at - SPAN + 1)
    b = np.minimum(w.offsets[w.texts[at] + 1], at + least)
    edges = zip(begin[a].tolist(), begin[at].tolist(), begin[b].tolist(), strict=True)
    return [bytes(x) for i, j, k in edges for x in (text[i : max(i, j - 1)], text[j : k - 1])]


def stretches(w: Words, at: np.ndarray, least: int):
    """Starts of the stretches of ``least`` words that hold one of the places, and their hashes."""
    near = covered(len(w.flat), np.maximum(at - (SPAN - 1), 0), at + 1)
    fits = inside(w, least)
    starts = np.flatnonzero(near[: len(fits)] & fits)
    return starts, windows(w.hashes, least)[starts]


def fresh(values: np.ndarray) -> np.ndarray:
    """Mask of the values that differ from the one before."""
    mask = np.ones(len(values), bool)
    mask[1:] = values[1:] != values[:-1]
    return mask


def squeeze(texts: list[bytes]) -> bytes:
    return b"" if not texts else zstandard.ZstdCompressor(level=3).compress(b"\n".join(texts))


def spread(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n") if data else []


def first_suffixes(frame: DataFrame, side: DataFrame, least: int) -> DataFrame:
    """Side rows that tell each bucket the first suffix of each of its runs and the extension."""
    shards = width(frame.sparkSession)
    reach = least - SPAN + 1

    def ask(docs: pa.Table, extra: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            w, at, hashes = shared(docs, extra, least)
            begin = np.flatnonzero(fresh(hashes))
            many = np.diff(np.concatenate([begin, [len(at)]])) > 1
            own, keys = at[begin], hashes[begin]
            ids = ids_of(docs)[w.texts[own]]
            places = own - w.offsets[w.texts[own]]
            near = contexts(w, own, least)
            starts, found = stretches(w, at, least)
            owners = ids_of(docs)[w.texts[starts]]
            order = np.lexsort((owners, found))
            order = order[fresh(found[order])]
            found, owners = found[order], owners[order]
            bucket = docs["bucket"][0].as_py()
            mine = {shard: (a, b) for shard, a, b in ex.pieces(keys, 64, shards)}
            theirs = {shard: (a, b) for shard, a, b in ex.pieces(found, 64, shards)}
            for shard in sorted(mine.keys() | theirs.keys()):
                a, b = mine.get(shard, (0, 0))
                c, d = theirs.get(shard, (0, 0))
                rows.append((shard, bucket, ex.pack_sorted(keys[a:b]), ex.pack(ids[a:b]),
                             ex.pack(places[a:b]), ex.pack(many[a:b]), squeeze(near[2 * a : 2 * b]),
                             ex.pack_sorted(found[c:d]), ex.pack(owners[c:d])))
        names = ["shard", "bucket", "keys", "ids", "places", "several", "texts", "stretches", "owners"]
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                        names=names)

    def answer(asked: pa.Table) -> pa.Table:
        read = {k: column(asked, k).to_pylist() for k in ("ids", "places", "several", "texts")}
        ids = np.concatenate([ex.unpack(x, np.int64) for x in read["ids"]])
        places = np.concatenate([ex.unpack(x, np.int64) for x in read["places"]])
        several = np.concatenate([ex.unpack(x, np.bool_) for x in read["several"]])
        texts = [x for part in read["texts"] for x in spread(part)]
        left, right = texts[::2], texts[1::2]
        n = len(ids)
        offsets, numbers = numbered(texts)
        before = leading(numbers, offsets[:-1][::2], offsets[1:][::2], SPAN - 1, backwards=True)
        after = leading(numbers, offsets[:-1][1::2], offsets[1:][1::2], least)
        # The sparse suffix array of the shard: by words, then by id and place.
        order = np.lexsort((places, ids, *after.T[::-1]))
        alike = np.zeros(n, bool)
        alike[1:] = common(after[order][1:], after[order][:-1]) >= reach
        run = np.cumsum(~alike) - 1
        by = np.lexsort((places[order], ids[order], run))  # the first of each run
        head = order[by[fresh(run[by])]]
        first = np.empty(n, np.int64)
        first[order] = head[run]
        back = common(before, before[first])
        ahead = common(after, after[first])
        ends = np.cumsum([len(ex.unpack(x, np.bool_)) for x in read["several"]])
        starts = np.concatenate([[0], ends[:-1]])
        owners = smallest(
            [ex.unpack_sorted(x) for x in column(asked, "stretches").to_pylist()],
            [ex.unpack(x, np.int64) for x in column(asked, "owners").to_pylist()])
        packed = []
        for a, b, owner in zip(starts, ends, owners, strict=True):
            told = [x for i in range(a, b) if several[i] for x in (left[first[i]], right[first[i]])]
            packed.append(pack_parts(
                ex.pack(ids[first[a:b]]), ex.pack(back[a:b].astype(np.uint16)),
                ex.pack(ahead[a:b].astype(np.uint16)), squeeze(told), ex.pack(owner)))
        return pa.table({
            "bucket": column(asked, "bucket"),
            "kind": pa.array([FIRSTS] * len(packed), pa.int32()),
            "shard": column(asked, "shard"), "id": pa.nulls(len(packed), pa.int64()),
            "payload": pa.array(packed, pa.binary()),
        })

    asked = frame.groupBy("bucket").cogroup(side.groupBy("bucket")).applyInArrow(ask, ASK)
    return side.unionByName(asked.groupBy("shard").applyInArrow(answer, SIDE))


def smallest(keys: list[np.ndarray], ids: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of keys, the smallest id that any list has for each of them."""
    every, owner = np.concatenate(keys), np.concatenate(ids)
    order = np.lexsort((owner, every))
    new = fresh(every[order])
    out = np.empty(len(every), np.int64)
    out[order] = owner[order[new]][np.cumsum(new) - 1]
    return np.split(out, np.cumsum([len(k) for k in keys])[:-1])


def pack_parts(*parts: bytes) -> bytes:
    sizes = np.array([len(p) for p in parts], "<u4").tobytes()
    return sizes + b"".join(parts)


def unpack_parts(data: bytes, n: int) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(data[: 4 * n], "<u4")) + 4 * n
    return [data[a:b] for a, b in zip([4 * n, *ends[:-1]], ends, strict=True)]


def numbered(texts: list[bytes], known: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts' words, and the words as numbers from 1: among the ``known`` ones, 0 for any other."""
    offsets, flat = split(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    codes = flat.dictionary_encode().indices if known is None else pc.fill_null(pc.index_in(flat, value_set=known), -1)
    return offsets, codes.to_numpy(zero_copy_only=False) + 1


def leading(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, backwards: bool = False) -> np.ndarray:
    """The first ``size`` words of each stretch, or the last from its end on; zeros behind them."""
    out, place = np.zeros((len(starts), size), np.int32), np.arange(size)
    for i in range(0, len(starts), ROWS):
        a, b = starts[i : i + ROWS, None], ends[i : i + ROWS, None]
        held = place < b - a
        at = b - 1 - place if backwards else a + place
        out[i : i + ROWS][held] = numbers[at[held]]
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that two rows have in common from the start."""
    return np.cumprod((a == b) & (a > 0), axis=1, dtype=np.int16).sum(axis=1, dtype=np.int64)


def extended(w: Words, at: np.ndarray, texts: list[bytes], of: np.ndarray, least: int):
    """Words that each place has in common with the told text ``of`` it, to the left and right."""
    offsets, told = numbered(texts, w.known)
    own, left, right = w.codes + 1, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for i in range(0, len(at), ROWS):
        p, pair = at[i : i + ROWS], 2 * of[i : i + ROWS]
        t = w.texts[p]
        left[i : i + ROWS] = common(leading(own, w.offsets[t], p, SPAN - 1, backwards=True),
                                    leading(told, offsets[pair], offsets[pair + 1], SPAN - 1, backwards=True))
        right[i : i + ROWS] = common(leading(own, p, w.offsets[t + 1], least),
                                     leading(told, offsets[pair + 1], offsets[pair + 2], least))
    return left, right


def spans_of(docs: pa.Table, side: pa.Table, least: int) -> tuple[Words, np.ndarray]:
    """Words of the bucket and the mask of those that go."""
    w, at, hashes = shared(docs, side, least)
    gone_from, gone_to = [], []
    told = [r for r in side.select(["kind", "shard", "payload"]).to_pylist() if r["kind"] == FIRSTS]
    told = [unpack_parts(r["payload"], 5) for r in sorted(told, key=lambda r: r["shard"])]
    if told:
        firsts = np.concatenate([ex.unpack(x[0], np.int64) for x in told])
        back = np.concatenate([ex.unpack(x[1], np.uint16) for x in told]).astype(np.int64)
        ahead = np.concatenate([ex.unpack(x[2], np.uint16) for x in told]).astype(np.int64)
        ids, first = ids_of(docs)[w.texts[at]], fresh(hashes)
        run = np.cumsum(first) - 1
        many = np.bincount(run, minlength=len(firsts)) > 1
        goes = (ids[first] > firsts) & (back + ahead >= least)
        gone_from.append(at[first][goes] - back[goes])
        gone_to.append(at[first][goes] + ahead[goes])
        later = np.flatnonzero(~first & (ids > firsts[run]))
        left, right = extended(
            w, at[later], [y for x in told for y in spread(x[3])], np.cumsum(many)[run[later]] - 1, least)
        goes = left + right >= least
        gone_from.append(at[later][goes] - left[goes])
        gone_to.append(at[later][goes] + right[goes])
        starts, found = stretches(w, at, least)
        owner = np.concatenate([ex.unpack(x[4], np.int64) for x in told])
        earlier = owner[np.unique(found, return_inverse=True)[1]] < ids_of(docs)[w.texts[starts]]
        gone_from.append(starts[earlier])
        gone_to.append(starts[earlier] + least)
    none = np.zeros(0, np.int64)
    gone = covered(len(w.flat), np.concatenate([none, *gone_from]), np.concatenate([none, *gone_to]))
    skipped = ex.copy_keys(side)
    for t, key in enumerate(column(docs, "key").to_pylist()):
        if key in skipped and w.offsets[t + 1] - w.offsets[t] >= least:
            gone[w.offsets[t] : w.offsets[t + 1]] = True
    return w, gone


def cut_text(text: str, gone: np.ndarray) -> str:
    """The text without the marked words; the rest keeps its white space."""
    data = text.encode()
    edge = np.flatnonzero(np.diff(BLANK[np.frombuffer(data, np.uint8)], prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in zip(*runs(gone), strict=True):
        out.append(data[at : starts[a]])
        at = ends[b - 1]
    out.append(data[at:])
    return b"".join(out).rstrip(BLANKS.encode()).decode()


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  least: int = 50) -> DataFrame:
    """The documents without repeated passages, and ``n_words``, ``n_removed``, ``removed``.

    ``removed`` lists the spans that went, as word positions [start, end) of the given text.
    """
    frame = bucketed(docs, id_col, text_col)
    plain = copy_side(copies(frame))
    rest = "rest" in frame.columns

    def tokens(table: pa.Table, skipped: set[int]):
        w = words(column(table, "text"))
        out = np.isin(column(table, "key").to_numpy(), np.fromiter(skipped, np.int64, len(skipped)))
        out |= column(table, "id").is_null().to_numpy(zero_copy_only=False)
        at, hashes = suffixes(w, out, least)
        return hashes, w.texts[at]

    def cut(table: pa.Table, extra: pa.Table) -> pa.Table:
        n = table.num_rows
        removed, counts, texts, spans = [], [], [], []
        if n:
            w, gone = spans_of(table, extra, least)
            texts = column(table, "text").to_pylist()
            for t in range(n):
                own = gone[w.offsets[t] : w.offsets[t + 1]]
                counts.append(len(own))
                removed.append(int(own.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)}
                              for a, b in zip(edge[::2], edge[1::2], strict=True)])
                if removed[-1]:
                    texts[t] = cut_text(texts[t], own)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [table["id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                   pa.array(texts, pa.string()), pa.array(spans, span)]
        names = ["id", "n_words", "n_removed", "text", "removed"]
        if rest:
            columns, names = [*columns, table["rest"]], [*names, "rest"]
        return pa.table(columns, names=names)

    told = first_suffixes(frame, ex.token_counts(frame, plain, tokens), least)
    schema = with_rest("id long, n_words long, n_removed long, text string, "
                       "removed array<struct<start: long, end: long>>", frame)
    left = frame.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(cut, schema)
    return unpacked(left, docs.columns, id_col, text_col, ["n_words", "n_removed", "removed"])
