"""Words of many texts as flat arrays, window hashes and minimisers; runs inside Python tasks."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
HALF = np.uint64(32)


class Words(NamedTuple):
    """Word i of text t is ``flat[offsets[t] + i]``; ``hashes`` has a 64-bit hash for each word."""

    offsets: np.ndarray
    flat: pa.Array
    hashes: np.ndarray
    texts: np.ndarray  # the text of each word
    codes: np.ndarray  # the place of each word among the distinct ones
    known: pa.Array  # the distinct words

    def of(self, t: int) -> list[str]:
        return self.flat.slice(self.offsets[t], self.offsets[t + 1] - self.offsets[t]).to_pylist()

    def between(self, start: int, end: int) -> str:
        return " ".join(self.flat.slice(start, end - start).to_pylist())

    def joined(self) -> tuple[memoryview, np.ndarray]:
        """All words as UTF-8 with a blank between, and where each begins: words a to b end before ``begin[b] - 1``."""
        ended = pc.binary_join_element_wise(self.flat, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        return memoryview(ended.buffers()[2]), np.frombuffer(ended.buffers()[1], np.int64)[ended.offset :]


def column(table: pa.Table, name: str) -> pa.Array:
    """One column in one piece."""
    got = table[name]
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def split(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Offsets and words: maximal runs without space, tab, line feed, VT, FF, CR; null has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    starts = lists.offsets.to_numpy()
    return before[starts - starts[0]] if len(starts) else np.zeros(1, np.int64), flat.filter(full)


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words with their hashes: each distinct word of the batch is hashed once."""
    offsets, flat = split(texts, lower)
    coded = flat.dictionary_encode()
    distinct = np.fromiter(
        map(xxhash.xxh3_64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary)
    )
    codes = coded.indices.to_numpy()
    hashes = distinct[codes] if len(flat) else np.zeros(0, np.uint64)
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return Words(offsets, flat, hashes, texts, codes, coded.dictionary)


def cut(texts: pa.Array, kinds: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words by a table of UTF-8 bytes: the text of each, the piece that it lies in, the words.

    ``kinds`` says of each byte value whether it is part of a word (0), ends it (1), or ends a piece
    of text too (2); ``letters`` is what the byte is written as. Null texts have no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    kind = kinds[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = edges[:-1][edges[:-1] < len(data)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    kept = letters[data[inside]]
    goes_on = np.append(inside[1:] & ~begins[1:], False) if len(data) else inside
    lengths = np.flatnonzero(inside & ~goes_on) - starts + 1
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
    of = np.searchsorted(edges, starts, side="right") - 1
    return of, np.searchsorted(np.flatnonzero(kind == 2), starts) + of, flat


def byte_tables(gaps, ends=()) -> tuple[np.ndarray, np.ndarray]:
    """Tables for :func:`cut`, with A to Z in lower case."""
    kinds, letters = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    kinds[list(gaps)] = 1
    kinds[list(ends)] = 2
    letters[0x41:0x5B] += 32
    return kinds, letters


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> HALF)
    x = x * MIX
    return x ^ (x >> HALF)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive words of the stream, by its start.

    The sum of the words' hashes times falling powers of ``ODD``; runs are doubled, or grow by one word.
    """
    n = max(0, len(hashes) - size + 1)
    if not n:
        return np.zeros(0, np.uint64)
    out, run, power = hashes, 1, int(ODD)
    for bit in f"{size:b}"[1:]:
        out = out[:-run] * np.uint64(power) + out[run:]
        run, power = 2 * run, power * power % 2**64
        if bit == "1":
            out = out[:-1] * ODD + hashes[run:]
            run, power = run + 1, power * int(ODD) % 2**64
    return mixed(out + np.uint64(size))


def inside(w: Words, size: int) -> np.ndarray:
    """Starts whose window of ``size`` words stays in one text, as a mask over the stream."""
    n = max(0, len(w.texts) - size + 1)
    return w.texts[:n] == w.texts[size - 1 : size - 1 + n]


def minimisers(grams: np.ndarray, span: int) -> np.ndarray:
    """For each start, the place of the smallest of the next ``span`` grams, leftmost on ties.

    The choice depends on the words alone, so equal windows choose equal places. Minima of runs
    that double in length need about log2(span) passes.
    """
    n = max(0, len(grams) - span + 1)
    best, place, run = grams, np.arange(len(grams)), 1
    while run < span:
        step = min(run, span - run)
        left, right = best[: len(best) - step], best[step:]
        smaller = right < left
        best = np.where(smaller, right, left)
        place = np.where(smaller, place[step:], place[: len(place) - step])
        run += step
    return place[:n]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the stretches where the mask holds."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the places inside any of the spans."""
    depth = np.zeros(length + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0
