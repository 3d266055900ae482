"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds its distinct word shingles. Exact document counts of all shingles
(:mod:`exchange`) give one global order, rarest first. Two sets with Jaccard similarity >= t share a
shingle among the first ``n - ceil(t n) + 1`` of both, so only those prefixes are joined, and of
these only shingles that a second document has. Pairs pass the length, positional and suffix
filters, then each is verified once on the whole sets.

Links decide classes, so copies and near copies need not meet in all pairs: whole-text copies are one
node; a first pass verifies every node against one leader of its lists; then all pairs that the lists
still allow between *different* classes are verified. A group of n near copies costs about n checks,
and no link between different classes is lost.

Nulls and texts without words have an empty set and link with nothing; a row with a null id is its
own class with a null id. Rows that are equal share a class. Columns of any name pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegraph.llm.exchange import copy_keys, token_counts, totals
from tablegraph.llm.frame import bucketed, copies, copy_side
from tablegraph.llm.graph import components
from tablegraph.llm.words import column, inside, windows, words
from tablegraph.session import checkpoint

# Pivots that cut the order of hashes into equal parts for the suffix filter.
PARTS = 16


def shingles(docs: pa.Table, size: int):
    """Distinct shingles of the bucket's documents with the document of each, by document."""
    w = words(column(docs, "text"), lower=True)
    whole = windows(w.hashes, size)
    fits = inside(w, size)
    found, of = whole[fits], w.texts[: len(fits)][fits]
    lengths = np.diff(w.offsets)
    for k in range(1, size):  # fewer words: the whole sequence is the one shingle
        texts = np.flatnonzero(lengths == k)
        if len(texts):
            found = np.concatenate([found, windows(w.hashes, k)[w.offsets[texts]]])
            of = np.concatenate([of, texts])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    if len(found):
        new = np.concatenate([[True], (found[1:] != found[:-1]) | (of[1:] != of[:-1])])
        found, of = found[new], of[new]
    return found, of


def spoken_for(docs: pa.Table, skipped: set[int]) -> np.ndarray:
    """Mask of the copies among the bucket's documents."""
    return np.isin(column(docs, "key").to_numpy(), np.fromiter(skipped, np.int64, len(skipped)))


def shingle_sets(frame: DataFrame, side: DataFrame, size: int, percent: int) -> DataFrame:
    """``key, id, n`` of every document; ``tokens`` in global order, ``prefix`` places, ``parts``.

    ``shared`` counts the shingles that other documents have; places count from the first of them.
    ``centre`` is the mean log2 of the documents that hold a shingle: an original has more in common
    with its near copies than they with each other. The last three are null unless a shingle of the prefix occurs in another document, and for
    copies: their first copy speaks for them.
    """

    def tokens(docs: pa.Table, skipped: set[int]):
        found, of = shingles(docs, size)
        keep = ~spoken_for(docs, skipped)[of]
        return found[keep], of[keep]

    def sets(docs: pa.Table, extra: pa.Table) -> pa.Table:
        n = docs.num_rows
        if not n:
            return schema.empty_table()
        found, of = shingles(docs, size)
        sizes = np.bincount(of, minlength=n)
        keep = ~spoken_for(docs, copy_keys(extra))[of]
        found, of = found[keep], of[keep]
        held = totals(found, of, extra)
        order = np.lexsort((found, held, of))
        found, of, held = found[order], of[order], held[order]
        counts = np.bincount(of, minlength=n)
        starts = np.concatenate([[0], np.cumsum(counts)])
        prefix = counts - -(-percent * counts // 100) + 1
        place = np.arange(len(of)) - starts[of]
        asks = (place < prefix[of]) & (held >= 2)
        part = (found >> np.uint64(60)).astype(np.int64)
        spread = np.bincount(of * PARTS + part, minlength=n * PARTS).reshape(n, PARTS)
        # Shingles that no other document has come first; they can't be shared.
        shared = np.bincount(of, held >= 2, minlength=n).astype(np.int64)
        centre = np.bincount(of, np.log2(np.maximum(held, 1)), minlength=n) / np.maximum(counts, 1)
        own, places, parts = [None] * n, [None] * n, [None] * n
        for t in np.unique(of[asks]):
            a, b = starts[t], starts[t + 1]
            own[t] = found[a:b].view(np.int64)
            places[t] = np.flatnonzero(asks[a:b]).astype(np.int32) - np.int32(counts[t] - shared[t])
            parts[t] = spread[t].astype(np.int32)
        return pa.table(
            [column(docs, "key"), column(docs, "id"), pa.array(sizes, pa.int64()),
             pa.array(shared, pa.int64()), pa.array(centre, pa.float64()), pa.array(own, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())),
             pa.array(parts, pa.list_(pa.int32()))], schema=schema,
        )

    schema = pa.schema([
        ("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()),
        ("centre", pa.float64()), ("tokens", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int32())),
        ("parts", pa.list_(pa.int32())),
    ])
    told = token_counts(frame, side, tokens)
    return frame.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(
        sets, "key long, id long, n long, shared long, centre double, "
        "tokens array<long>, prefix array<int>, parts array<int>"
    )


def may_link(x: str, y: str, percent: int):
    """Length and positional filters on two rows of one list, ````n, shared, at`` with prefixes``.

    A linked pair has |A n B| >= t (|A| + |B|) / (1 + t), and is found at its first common shingle:
    before it nothing is shared, so the smaller tail bounds the overlap. Tails count the shingles that
    other documents have; the others only add to the sizes.
    """
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    most = F.least(
        F.col(f"{x}shared") - F.col(f"{x}at"), F.col(f"{y}shared") - F.col(f"{y}at")
    )
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (
        (100 + percent) * most >= percent * (nx + ny)
    )


def by_leader(percent: int):
    """Filter on two nodes whose overlaps with one leader are known.

    What they share is in the leader, at most the smaller overlap, or outside, at most the smaller
    rest. A near copy that failed against its original rarely reaches another near copy of it.
    """
    outside = [F.greatest(F.lit(0), F.col(f"{s}shared") - F.col(f"{s}in")) for s in "xy"]
    most = F.least("xin", "yin") + F.least(*outside)
    return (F.col("xlead") != F.col("ylead")) | (
        (100 + percent) * most >= percent * (F.col("xn") + F.col("yn"))
    )


def overlaps(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``a, b, both, linked`` of the pairs that pass the suffix filter, on whole sets, once each.

    Suffix filter: the hashes of both sets between fixed pivots; no part shares more than its smaller.
    """
    cut = nodes.select("key", "parts")
    likely = pairs.join(cut.select(F.col("key").alias("a"), F.col("parts").alias("pa")), "a").join(
        cut.select(F.col("key").alias("b"), F.col("parts").alias("pb")), "b"
    )

    def total(parts):
        return F.aggregate(parts, F.lit(0), lambda s, x: s + x)

    common = total(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)))
    likely = likely.where(
        (100 + percent) * common >= percent * (total(F.col("pa")) + total(F.col("pb")))
    ).select("a", "b")
    sets = nodes.select("key", "tokens")
    whole = likely.join(
        sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb")), "b"
    ).join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    either = F.size("ta") + F.size("tb") - shared
    return whole.select(
        "a", "b", shared.alias("both"), (100 * shared >= percent * either).alias("linked")
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            size: int = 5, percent: int = 75) -> DataFrame:
    """``id, n_shingles, component_id`` for each document: the smallest id its links reach."""
    frame = bucketed(docs, id_col, text_col)
    found = copies(frame)
    sets = checkpoint(shingle_sets(frame, copy_side(found), size, percent))
    # Rows of one id with different texts are different sets: until the end, a key is a node's name.
    nodes = sets.where("tokens is not null and id is not null").dropDuplicates(["key"])
    # The more central, the smaller; the key's bits make it one node's own.
    nodes = nodes.withColumn("rank", F.shiftleft(
        F.greatest(F.lit(0), 0xFFFF - F.floor(F.col("centre") * 1024)).cast("long"), 47
    ).bitwiseOR(F.col("key").bitwiseAND((1 << 47) - 1)))

    def lists(of: DataFrame, *columns: str) -> DataFrame:
        """A row for each node and each shingle of its prefix that others have."""
        ask = F.explode(F.transform("prefix", lambda p: F.struct(
            F.get("tokens", (p + F.col("n") - F.col("shared")).cast("int")).alias("token"),
            p.cast("long").alias("at"))))
        return of.select("key", "n", "shared", *columns, ask.alias("ask")).select(
            "key", "n", "shared", *columns, "ask.token", "ask.at"
        )

    # First pass: each node against the most central leader that any of its lists names.
    rows = lists(nodes, "rank")
    leaders = rows.groupBy("token").agg(
        *[F.min_by(c, "rank").alias(f"x{c}") for c in ("key", "n", "shared", "at")],
        F.min("rank").alias("xrank"), F.max("rank").alias("last"),
    ).where("xrank < last").drop("last")
    first = checkpoint(
        rows.join(leaders, "token").where("xrank < rank")
        .where(may_link("x", "", percent))
        .groupBy(F.col("key").alias("a")).agg(F.min_by("xkey", "xrank").alias("b"))
    )
    met = checkpoint(overlaps(first, nodes, percent))
    links = met.where("linked").select("a", "b")
    comp = components(links).select(F.col("id").alias("key"), F.col("component").alias("c"))
    # Second pass: whatever the lists allow between classes that are still apart.
    led = met.select(F.col("a").alias("key"), F.col("b").alias("lead"), F.col("both").alias("in"))
    marked = lists(
        nodes.join(comp, "key", "left").join(led, "key", "left").withColumns({
            "c": F.coalesce("c", "key"), "lead": F.coalesce("lead", "key"),
            "in": F.coalesce("in", "n").cast("long")}),
        "c", "lead", "in",
    )
    open_ = marked.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    open_ = open_.where("c0 < c1").select("token")
    apart = checkpoint(marked.join(open_, "token"))
    largest = apart.groupBy("token", "c").agg(F.count(F.lit(1)).alias("rows")).groupBy("token").agg(
        F.max_by("c", "rows").alias("main")
    )
    apart = apart.join(largest, "token")
    names = ("c", "key", "n", "shared", "at", "lead", "in")
    few = apart.where("c <> main").select(
        "token", *[F.col(c).alias(f"x{c}") for c in names])
    every = apart.select(
        "token", "main", *[F.col(c).alias(f"y{c}") for c in names])
    more = (
        few.join(every, "token").where("xc <> yc and (yc = main or xkey < ykey)")
        .where(may_link("x", "y", percent)).where(by_leader(percent))
        .select(F.least("xkey", "ykey").alias("a"), F.greatest("xkey", "ykey").alias("b")).distinct()
    )
    links = links.unionByName(
        overlaps(checkpoint(more), nodes, percent).where("linked").select("a", "b"))
    # From keys to documents: links by id, so that rows of one id are one node, and copies.
    ids = nodes.select("key", "id")
    told = links.join(ids.select(F.col("key").alias("a"), F.col("id").alias("ia")), "a").join(
        ids.select(F.col("key").alias("b"), F.col("id").alias("ib")), "b"
    ).select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    sizes = sets.select("key", "id", "n").dropDuplicates(["key", "id"])
    copied = found.select("key", "id", "first").distinct().join(
        sizes.where("n > 0").select("key"), "key"
    ).select(F.col("first").alias("a"), F.col("id").alias("b"))
    comp = components(checkpoint(told.unionByName(copied)))
    return sizes.join(comp, "id", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
