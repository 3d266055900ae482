"""Exact counts of hashed tokens over all documents, exchanged as packed arrays.

Each bucket of documents sends every shard its sorted distinct tokens, a few bytes each; a shard adds
up all buckets' counts and answers every bucket in the order in which it asked. A token that fills a
third of the corpus is one entry per bucket, so no shard holds more than its share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegraph.llm.frame import COPY, REPLY, width
from tablegraph.llm.words import column

ASK = "shard int, bucket int, keys binary, counts binary"


def pack(values: np.ndarray) -> bytes:
    """A numeric array, byte planes apart, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values by their differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def key_bits(shards: int) -> int:
    """Bits of a token that are counted: some 11 more than would number all tokens.

    A shard is meant to get about 2**22 tokens, so the width of the shuffle tells how many there are.
    Two tokens that share the bits are counted together: callers use counts to find candidates and to
    order them, never as the last word.
    """
    return min(62, 33 + max(1, shards - 1).bit_length())


def shard_of(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Shards are ranges of the key, so shard by shard is sorted order."""
    top = keys >> np.uint64(bits - 32)
    return ((top * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def grouped(tokens: np.ndarray, docs: np.ndarray):
    """Order of the tokens, starts of equal ones in it, the entry of each, documents of each.

    ``docs`` ascends along the stream, so equal tokens of a document are neighbours in the order.
    """
    order = np.argsort(tokens, kind="stable")
    t, d = tokens[order], docs[order]
    if not len(t):
        empty = np.zeros(0, np.int64)
        return order, empty, empty, empty
    new = np.concatenate([[True], t[1:] != t[:-1]])
    fresh = new | np.concatenate([[True], d[1:] != d[:-1]])
    starts = np.flatnonzero(new)
    return order, starts, np.cumsum(new) - 1, np.add.reduceat(fresh.astype(np.int64), starts)


def pieces(keys: np.ndarray, bits: int, shards: int):
    """(shard, start, end) of the sorted keys."""
    if not len(keys):
        return
    of = shard_of(keys, bits, shards)
    edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    for a, b in zip(edges, [*edges[1:], len(of)], strict=True):
        yield int(of[a]), int(a), int(b)


def copy_keys(side: pa.Table) -> set[int]:
    return set(column(side.filter(pc.equal(side["kind"], COPY)), "id").to_pylist())


def replies(side: pa.Table) -> list[bytes]:
    """The answers to this bucket, in the order in which it asked."""
    rows = [r for r in side.select(["kind", "shard", "payload"]).to_pylist() if r["kind"] == REPLY]
    return [r["payload"] for r in sorted(rows, key=lambda r: r["shard"])]


def token_counts(frame: DataFrame, side: DataFrame, tokens) -> DataFrame:
    """Side rows that tell each bucket in how many documents each of its distinct tokens occurs.

    ``tokens(docs, skipped keys)`` gives the tokens of a bucket's documents and the document of
    each, ascending. The same call on the same bucket, through :func:`totals`, reads the answer.
    """
    shards = width(frame.sparkSession)
    bits = key_bits(shards)

    def ask(docs: pa.Table, extra: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            found, of = tokens(docs, copy_keys(extra))
            keys = found >> np.uint64(64 - bits)
            order, starts, _, counts = grouped(keys, of)
            distinct = keys[order][starts]
            bucket = docs["bucket"][0].as_py()
            for shard, a, b in pieces(distinct, bits, shards):
                rows.append((shard, bucket, pack_sorted(distinct[a:b]),
                             pack(counts[a:b].astype(np.uint32))))
        names = ["shard", "bucket", "keys", "counts"]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names
        )

    def answer(asked: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in column(asked, "keys").to_pylist()]
        counts = [unpack(x, np.uint32) for x in column(asked, "counts").to_pylist()]
        _, entry = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(entry, np.concatenate(counts)).astype(np.uint32)[entry]
        ends = np.cumsum([len(k) for k in keys])
        packed = [pack(x) for x in np.split(total, ends[:-1])]
        n = asked.num_rows
        return pa.table({
            "bucket": column(asked, "bucket"), "kind": pa.array([REPLY] * n, pa.int32()),
            "shard": column(asked, "shard"), "id": pa.nulls(n, pa.int64()),
            "payload": pa.array([bytes([bits]) + x for x in packed], pa.binary()),
        })

    asked = frame.groupBy("bucket").cogroup(side.groupBy("bucket")).applyInArrow(ask, ASK)
    told = asked.groupBy("shard").applyInArrow(
        answer, "bucket int, kind int, shard int, id long, payload binary"
    )
    return told.unionByName(side)


def totals(found: np.ndarray, of: np.ndarray, side: pa.Table) -> np.ndarray:
    """Documents of the whole corpus that hold each of the bucket's tokens, token by token."""
    told = replies(side)
    keys = found >> np.uint64(64 - told[0][0]) if told else found
    order, starts, entry, _ = grouped(keys, of)
    got = [unpack(x[1:], np.uint32) for x in told]
    counts = np.concatenate(got) if got else np.zeros(0, np.uint32)
    if len(counts) != len(starts):
        raise ValueError("the answers don't fit the tokens asked about")
    out = np.zeros(len(found), np.uint32)
    out[order] = counts[entry]
    return out
