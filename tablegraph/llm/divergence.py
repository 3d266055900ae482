"""How the sources of a language differ in the terms they use.

Identical texts of a language are collapsed first: rows are counted by language, digest and source
with map-side combine, one copy of each text stays, and it is tokenized once for all sources that have
it (once for each ``SOURCES_PER_ROW`` of them). Its terms then add to document frequencies and counts
with the number of its copies as weight. A language keeps the terms in at least ``least`` documents.

Shares are whole numbers: ``p = 1 + floor(10**9 * (count + 5) / (N + 5 * V))`` for a group of a language
and source, or a whole language, with ``N`` occurrences of the ``V`` kept terms. Two groups differ by the
sum of ``abs(p - q)`` over all kept terms. That sum is evaluated from the counts above zero only: where a
group lacks a term it has the same share ``z`` for all of them, so every pair starts from
``V * abs(z - z')`` and is corrected by the terms that either has. The corrections are added up block by
block of terms and tile by tile of sources, so no task holds more than a block of counts and a tile of sums.
Languages with more than ``TILE`` sources have several tiles. All pairs of sources of a language are
the answer, so the result grows with the square of their number.

Null texts, languages and sources are ''. Empty texts have no terms, but their group exists. Repeated
rows count as often as they occur. Equal values are ranked by the bytes of the item. Only the columns named
are read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegraph.llm import words
from tablegraph.llm.frame import quoted, tuned
from tablegraph.session import checkpoint

SOURCES_PER_ROW = 64
TILE = 512
# Counts above zero in a block, and rows of counts that a task adds up before it passes them on.
BLOCK_BITS = 14
HELD = 500_000

TABLES = words.byte_tables([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
COUNTED = "lang string, source string, term string, df long, n long"


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``lang, text, spread``: each text of a language once, with its rows by source."""
    keyed = docs.select("lang", "source", F.unhex(F.sha2("text", 256)).alias("digest"))
    by_source = keyed.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", "digest").orderBy("source")) - 1
    spread = by_source.withColumn("slice", F.floor(place / SOURCES_PER_ROW)).groupBy(
        "lang", "digest", "slice").agg(F.collect_list(F.struct("source", "n")).alias("spread"))
    texts = docs.select("lang", F.unhex(F.sha2("text", 256)).alias("digest"), "text").groupBy(
        "lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(spread, ["lang", "digest"]).select("lang", "text", "spread")


def summed(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate(
        [("df", "sum"), ("n", "sum")])
    return whole.rename_columns({"df_sum": "df", "n_sum": "n"}).select(["lang", "source", "term", "df", "n"])


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys and the starts of equal ones in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else order


def counted(batch: pa.RecordBatch):
    """Tables of weighted document frequencies and counts of a batch of distinct texts."""
    langs = batch.column(0).cast(pa.large_string()).dictionary_encode()
    spread = batch.column(2)
    per_text = np.diff(spread.offsets.to_numpy())
    entries = spread.flatten()
    weight = entries.field("n").to_numpy()
    sources = entries.field("source").cast(pa.large_string()).dictionary_encode()
    lang_of = np.repeat(langs.indices.to_numpy(), per_text).astype(np.int64)
    group = lang_of * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
    first = np.cumsum(per_text) - per_text
    of, _, flat = words.cut(batch.column(1), *TABLES)
    coded = flat.dictionary_encode()
    size = max(1, len(coded.dictionary))
    keys, times = np.unique(of * size + coded.indices.to_numpy(), return_counts=True)
    text, term = np.divmod(keys, size)
    # Texts with many sources in pieces of bounded size.
    costs = np.cumsum(per_text[text])
    edges = np.searchsorted(costs, np.arange(HELD, (costs[-1] if len(costs) else 0) + HELD, HELD))
    for a, b in zip([0, *edges[:-1]], edges, strict=True):
        if a == b:
            continue
        t, many = text[a:b], per_text[text[a:b]]
        at = np.repeat(np.arange(a, b), many)
        entry = np.repeat(first[t] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        key = group[entry] * size + term[at]
        order, starts = runs_of(key)
        g, term_of = np.divmod(key[order[starts]], size)
        lang, source = np.divmod(g, max(1, len(sources.dictionary)))
        df = np.add.reduceat(weight[entry][order], starts)
        n = np.add.reduceat((weight[entry] * times[at])[order], starts)
        yield pa.table({
            "lang": langs.dictionary.take(pa.array(lang)), "source": sources.dictionary.take(pa.array(source)),
            "term": coded.dictionary.take(pa.array(term_of)), "df": pa.array(df), "n": pa.array(n)})


def term_counts(texts: DataFrame) -> DataFrame:
    """``lang, source, term, df, n`` over all documents, from distinct texts, dealt by language and term.

    A term has at most as many rows in the shuffle as tasks times sources.
    """

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in counted(batch):
                held.append(part)
                size += part.num_rows
                if size >= HELD:
                    held = [summed(held)]
                    size = held[0].num_rows
                    if 2 * size >= HELD:
                        yield from sent(held[0])
                        held, size = [], 0
        if held:
            yield from sent(summed(held))

    def sent(table):
        for name in ("lang", "source", "term"):
            i = table.schema.get_field_index(name)
            table = table.set_column(i, name, table.column(name).cast(pa.string()))
        return table.to_batches(max_chunksize=10_000)

    # Tasks have added up already; one shuffle by term serves the sums by source and by language.
    dealt = texts.mapInArrow(run, COUNTED).repartition("lang", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10**9 * (count + 5) / (total + 5 * terms))``, exact; 0 without kept terms."""
    wide = "decimal(20,0)"
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast(wide)
    base = F.nullif((total + 5 * terms).cast(wide), F.lit(0).cast(wide))
    return F.coalesce(1 + F.call_function("div", top, base), F.lit(0)).cast("long")


def audited(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
            least: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group of a language and source.

    ``part`` is ``pair`` (the distance to each other source of the language) or ``term`` (the ``top`` terms
    that the group uses more than the language does).
    """
    tuned(docs.sparkSession)
    blank = F.lit("")
    given = docs.select(
        F.coalesce(quoted(lang_col), blank).alias("lang"), F.coalesce(quoted(source_col), blank).alias("source"),
        F.coalesce(quoted(text_col), blank).alias("text"))
    whole = Window.partitionBy("lang", "term")
    kept = checkpoint(term_counts(distinct_texts(given)).select(
        "lang", "source", "term", "n", F.sum("df").over(whole).alias("df"),
        F.sum("n").over(whole).alias("total")).where(F.col("df") >= least).drop("df"))
    langs = kept.select("lang", "term", "total").distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"), F.count(F.lit(1)).alias("filled"))
    zero = F.lit(0).cast("long")
    groups = given.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(
        langs, "lang", "left").na.fill(0, ["source_n", "filled", "v", "lang_n"])
    groups = checkpoint(groups.select(
        "*", share(zero, F.col("source_n"), F.col("v")).alias("z"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")))
    entries = kept.join(
        groups.select("lang", "source", "source_n", "v", "lang_n", "place"), ["lang", "source"]
    ).withColumn("p", share(F.col("n"), F.col("source_n"), F.col("v")))
    over = entries.select(
        "lang", "source", F.col("term").alias("item"),
        (F.col("p") - share(F.col("total"), F.col("lang_n"), F.col("v"))).alias("value")).where("value > 0")
    best = ranked(over, "term").where(F.col("rank") <= top)
    return ranked(pair_distances(entries, groups), "pair").unionByName(best)


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value",
                       F.row_number().over(order).alias("rank"))


def pair_distances(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of sources of a language."""
    shape = groups.groupBy("lang").agg(
        F.floor(F.max("place") / TILE).cast("int").alias("last_tile"),
        F.shiftright(F.sum("filled"), BLOCK_BITS).cast("int").alias("last_block"))

    def tiled(rows: DataFrame, blocks: Column) -> DataFrame:
        """Rows once for each pair of tiles that theirs is part of, and each of the blocks."""
        tile = F.floor(F.col("place") / TILE).cast("int")
        spread = rows.join(shape, "lang").select(
            "*", F.explode(F.sequence(F.lit(0), F.col("last_tile"))).alias("other"))
        return spread.select(
            "lang", F.least(tile, "other").alias("i"), F.greatest(tile, "other").alias("j"),
            F.explode(blocks).alias("block"),
            *[F.col(c).alias(c) for c in rows.columns[1:]])  # aliases: both sides stem from the same table

    last = F.col("last_block")
    own = F.array(F.pmod(F.xxhash64("term"), last + 1).cast("int"))
    left = tiled(entries.select("lang", "place", "term", "p"), own)
    right = tiled(groups.select("lang", "place", "z"), F.sequence(F.lit(0), last))
    keys = ["lang", "i", "j", "block"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        corrections, "lang string, a int, b int, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = groups.select("lang", "place", "source", "z", "v")
    one = name.select("lang", F.col("place").alias("a"), F.col("source").alias("x"), F.col("z").alias("zx"), "v")
    two = name.select("lang", F.col("place").alias("b"), F.col("source").alias("y"), F.col("z").alias("zy"))
    named = sums.join(one, ["lang", "a"]).join(two, ["lang", "b"]).select(
        "lang", "x", "y", (F.col("value") + F.col("v") * F.abs(F.col("zx") - F.col("zy"))).alias("value"))
    sides = F.array(*[F.struct(F.col(s).alias("source"), F.col(t).alias("item")) for s, t in ("xy", "yx")])
    return named.select("lang", F.inline(sides), "value")


def corrections(key, entries: pa.Table, sources: pa.Table) -> pa.Table:
    """What a block of terms adds to ``V * abs(z - z')`` for each pair of sources of a pair of tiles.

    A sum over a block stays below 2**53, so adding up in double precision is exact.
    """
    lang, i, j, _ = (k.as_py() for k in key)
    order = np.argsort(sources["place"].to_numpy())
    place, z = sources["place"].to_numpy()[order], sources["z"].to_numpy()[order]
    cols = np.flatnonzero(place // TILE == j)
    of = np.searchsorted(place, entries["place"].to_numpy())
    p = entries["p"].to_numpy()
    term = words.column(entries, "term").dictionary_encode()
    code = term.indices.to_numpy() if len(of) else np.zeros(0, np.int64)
    by = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[by], np.arange(len(place) + 1))
    in_cols = (place[of] // TILE == j) if len(of) else np.zeros(0, bool)
    b_of, b_p, b_code = of[in_cols], p[in_cols], code[in_cols]
    per_b = np.bincount(b_of, minlength=len(place))
    shares = np.full(len(term.dictionary) if len(of) else 0, -1, np.int64)
    out = []
    for a in np.flatnonzero(place // TILE == i):
        mine = by[edges[a] : edges[a + 1]]
        gap = np.abs(z - z[a])
        shares[code[mine]] = p[mine]
        met = shares[b_code]
        w = np.abs(b_p - z[a])
        both = met >= 0
        x, y, zb = met[both], b_p[both], z[b_of[both]]
        w[both] = np.abs(x - y) - np.abs(x - zb) + np.abs(z[a] - zb)
        shares[code[mine]] = -1
        total = np.bincount(b_of, w, minlength=len(place)).astype(np.int64) - per_b * gap
        # The terms of a against the share that b has for a term it lacks, by prefix sums.
        own = np.sort(p[mine])
        sums = np.concatenate([[0], np.cumsum(own)])
        below = np.searchsorted(own, z, side="right")
        total += 2 * (z * below - sums[below]) + sums[-1] - z * len(own) - len(own) * gap
        to = cols[cols > a] if i == j else cols
        out.append((np.full(len(to), place[a]), place[to], total[to]))
    a, b, value = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
    return pa.table({
        "lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a.astype(np.int32)),
        "b": pa.array(b.astype(np.int32)), "value": pa.array(value.astype(np.int64))})
