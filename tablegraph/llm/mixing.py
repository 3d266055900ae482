"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources, in code point order with null last, weigh 1, 2, 3, repeating. Targets share all words by
weight; none exceeds ``limit`` times its source, the excess goes to the others by weight until none
does. A source is cut into hashed blocks of documents. It gives whole passes of all its blocks and,
for the remainder, some more: every so many blocks in order of size, then single blocks exchanged so
that the words come nearest the target.

The draws (block, pass) are the mix. A tree splits them among output shards: at each node every
source's quota for the left half is drawn in turn from the hypergeometric distribution of what is
left, so the quotas of a level are exact and jointly multivariate-hypergeometric. At the leaves each
source's draws, permuted by hash, are dealt out in disjoint runs of the leaf quotas, and a shard's rows
are shuffled locally by hash. All randomness is hashing, so reruns agree.

A block holds 1/4096 of its source, so a source with a third of all rows is spread over thousands of
keys, and tables of blocks have at most 4096 rows for each source. Null texts have no words and are
carried with their block. Null ids and repeated rows are rows like others. Columns of any name pass
through; an added column replaces one of its name.
"""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegraph.llm.frame import BLANKS, GAP, let, quoted, tuned
from tablegraph.session import checkpoint

BLOCKS = 4096
LEVELS = 4  # 16 output shards
EXCHANGES = 4


def word_count(text: Column) -> Column:
    """Words of a text: gaps cut it, and blanks at its ends make none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


def targets(sizes: DataFrame, limit: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row for each source.

    Water-filling: sources in order of limit / weight are at their limit while the level that the
    remaining words and weights give lies above it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    cap = F.col("source_size") * limit
    by_cap = Window.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everyone)
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("w").over(after)
    levelled = weighed.withColumns({"cap": cap, "level": level})
    # The first source below its limit fixes the level of all after it.
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("cap") / F.col("w")))
    levelled = levelled.withColumn("from", free.over(everyone)).withColumn(
        "at", F.max(F.when(F.col("cap") / F.col("w") == F.col("from"), F.col("level"))).over(everyone))
    return levelled.select(
        "source", "source_size",
        F.when(F.col("cap") / F.col("w") < F.col("from"), F.col("cap"))
        .otherwise(F.least(F.coalesce(F.col("at") * F.col("w"), "cap"), "cap")).alias("target"),
    )


def seed(*parts) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def uniform(hashed: Column) -> Column:
    """A hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / float(1 << 53)


def chosen_blocks(blocks: DataFrame) -> DataFrame:
    """``passes`` of each block, so that each source's words come near its target.

    ``blocks`` has ``source, block, words, source_size, target``; at most 4096 rows for a source.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.least(ratio, F.lit(3.0))
    by_size = Window.partitionBy("source").orderBy(
        F.col("words").desc(), seed("order", "source", "block"), "block")
    n = F.row_number().over(by_size).cast("double")
    part = F.col("ratio") - F.col("whole")
    got = blocks.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio").cast("double"))
    got = got.withColumn(
        "extra", (F.floor(part * n + 0.5) - F.floor(part * (n - 1) + 0.5)).cast("int")
    ).withColumn("free", part > 0)
    source = Window.partitionBy("source").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    for step in range(EXCHANGES):
        # The block whose turning in or out leaves the smallest distance to the target, if smaller.
        gap = F.col("target") - F.sum((F.col("whole") + F.col("extra")) * F.col("words")).over(source)
        got = got.withColumn("gap", gap)
        turned = F.when(F.col("free"), F.abs(
            F.col("gap") - F.when(F.col("extra") == 1, -F.col("words")).otherwise(F.col("words"))))
        got = got.withColumn("turned", turned)
        pick = F.min(F.when(F.col("turned") < F.abs("gap"), F.struct("turned", "block"))).over(source)
        got = got.withColumn("pick", pick)
        got = got.withColumn("extra", F.when(
            F.coalesce(F.col("pick.block") == F.col("block"), F.lit(False)), 1 - F.col("extra")
        ).otherwise(F.col("extra")))
    return got.select("source", "block", (F.col("whole") + F.col("extra")).cast("int").alias("passes"))


def log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 9, brought back by the recurrence."""

    def series(x: Column) -> Column:
        t = x + 9.0
        product = x + 1.0
        for i in range(2, 9):
            product = product * (x + float(i))
        return (t - 0.5) * F.log(t) - t + 0.5 * log(2 * pi) + 1 / (12 * t) - 1 / (
            360 * t * t * t) - F.log(product)

    return let(x, series)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """A draw by inversion from the mode outward: of ``drawn`` from ``total``, how many are ``good``.

    The walk is as wide as 20 standard deviations; what is left of ``u`` after it, if anything, stays
    at the mode. The result always lies in the support.
    """
    given = F.struct(
        total.cast("double").alias("n"), good.cast("double").alias("k"),
        drawn.cast("double").alias("d"), u.alias("u"))

    def bounded(g):
        return F.struct(
            *[g[c].alias(c) for c in "nkdu"],
            F.greatest(F.lit(0.0), g["d"] + g["k"] - g["n"]).alias("low"),
            F.least(g["d"], g["k"]).alias("high"))

    def centred(g):
        mode = F.greatest(g["low"], F.least(g["high"], F.floor(
            (g["d"] + 1) * (g["k"] + 1) / (g["n"] + 2)).cast("double")))
        return F.struct(*[g[c].alias(c) for c in ("n", "k", "d", "u", "low", "high")], mode.alias("m"))

    def choose(a, b):
        return log_factorial(a) - log_factorial(b) - log_factorial(a - b)

    def walk(g):
        n, k, d, u, mode = (g[c] for c in ("n", "k", "d", "u", "m"))
        at_mode = F.exp(choose(k, mode) + choose(n - k, d - mode) - choose(n, d))
        wide = F.ceil(20 * F.sqrt(d * k / F.greatest(n, F.lit(1.0))) + 20).cast("int")

        def step(s, _):
            # One place up and one down; the first place where the running sum passes u is the draw.
            up = F.when(s["x"] < g["high"], s["up"] * (k - s["x"]) * (d - s["x"])
                        / ((s["x"] + 1) * (n - k - d + s["x"] + 1))).otherwise(0.0)
            down = F.when(s["y"] > g["low"], s["down"] * s["y"] * (n - k - d + s["y"])
                          / ((k - s["y"] + 1) * (d - s["y"] + 1))).otherwise(0.0)
            return let(F.struct(up.alias("up"), down.alias("down")), lambda t: F.struct(
                t["up"].alias("up"), t["down"].alias("down"), (s["x"] + 1).alias("x"),
                (s["y"] - 1).alias("y"), (s["sum"] + t["up"] + t["down"]).alias("sum"),
                F.when(s["found"].isNotNull(), s["found"])
                .when((u < s["sum"] + t["up"]) & (t["up"] > 0), s["x"] + 1)
                .when((u < s["sum"] + t["up"] + t["down"]) & (t["down"] > 0), s["y"] - 1)
                .alias("found")))

        start = let(at_mode, lambda p: F.struct(
            p.alias("up"), p.alias("down"), mode.alias("x"), mode.alias("y"), p.alias("sum"),
            F.when(u < p, mode).alias("found")))
        walked = F.aggregate(F.sequence(F.lit(1), wide), start, step, lambda s: s["found"])
        return F.coalesce(walked, mode).cast("long")

    return let(let(let(given, bounded), centred), walk)


def split_quotas(quotas: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``node, source, quota`` of the 2 ** levels leaves from ``source, quota`` of the root.

    A level's rows are one for each node and source. Within a node, sources are drawn in turn: of the
    draws still to be split (window sums), each source's share of the left half.
    """
    level = quotas.select(F.lit(0).alias("node"), "source", "quota")
    for depth in range(levels):
        node = Window.partitionBy("node")
        ordered = node.orderBy(F.col("source").asc_nulls_last())
        rest = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        # The left half's draws are split evenly over the remaining total at each turn: the share that
        # earlier sources took is a sum over them, so turns are folded in one array for each node.
        folded = level.withColumn("rest", F.sum("quota").over(rest)).groupBy("node").agg(
            F.sort_array(F.collect_list(F.struct(
                F.col("source").isNull().alias("last"), "source", "quota", "rest"))).alias("rows"),
            F.floor(F.sum("quota") / 2).alias("half"),
        )

        def turn(state, row):
            left = hypergeometric(
                row["rest"], row["quota"], state["left"],
                uniform(seed("tree", state["seed"], F.coalesce(row["source"], F.lit("\\0null")))))
            return F.struct(
                (state["left"] - left).alias("left"), state["seed"].alias("seed"),
                F.concat(state["got"], F.array(F.struct(
                    row["source"].alias("source"), left.alias("left"),
                    (row["quota"] - left).alias("right")))).alias("got"))

        empty = F.array().cast("array<struct<source:string,left:bigint,right:bigint>>")
        first = F.struct(
            F.col("half").cast("long").alias("left"),
            (F.col("node") + F.lit(depth * 1_000_003)).cast("long").alias("seed"), empty.alias("got"))
        split = folded.select("node", F.explode(
            F.aggregate("rows", first, turn, lambda s: s["got"])).alias("s"))
        level = split.select(
            F.explode(F.array(
                F.struct((F.col("node") * 2).alias("node"), F.col("s.source").alias("source"),
                         F.col("s.left").alias("quota")),
                F.struct((F.col("node") * 2 + 1).alias("node"), F.col("s.source").alias("source"),
                         F.col("s.right").alias("quota")))).alias("r")
        ).select("r.*")
    return level


def mixed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
          source_col: str = "source", levels: int = LEVELS, carry: list[str] | None = None) -> DataFrame:
    """The documents with ``size, source_size, target, taken`` and ``shards``, one for each pass.

    ``carry`` names the columns to pass through; all by default.
    """
    tuned(docs.sparkSession)
    added = ["size", "source_size", "target", "taken", "shards"]
    kept = [c for c in carry or docs.columns if c not in added]
    rows = docs.select(
        F.struct(*[quoted(c).alias(c) for c in kept]).alias("row"),
        quoted(source_col).cast("string").alias("source"),
        word_count(quoted(text_col)).alias("size"),
        F.pmod(F.xxhash64(quoted(id_col), quoted(text_col)), F.lit(BLOCKS)).cast("int").alias("block"),
    )
    blocks = checkpoint(rows.groupBy("source", "block").agg(F.sum("size").alias("words")))
    sizes = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    aims = checkpoint(targets(sizes))
    passes = chosen_blocks(
        blocks.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    passes = checkpoint(passes)
    leaves = split_quotas(
        passes.groupBy("source").agg(F.sum("passes").cast("long").alias("quota")), levels)
    # Each source's draws in hashed order meet its leaves' runs: disjoint, and as many as the quotas.
    draws = passes.where("passes > 0").select(
        "source", "block", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass"))
    turn = Window.partitionBy("source").orderBy(
        seed("draw", "source", "block", "pass"), "block", "pass")
    draws = draws.withColumn("place", F.row_number().over(turn).cast("long"))
    run = Window.partitionBy("source").orderBy("node")
    runs = leaves.withColumn("to", F.sum("quota").over(run)).select(
        F.col("source").alias("s"), "node", (F.col("to") - F.col("quota")).alias("from"), "to")
    runs = runs.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("to", "node"))).alias("runs"))
    dealt = draws.join(runs, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "block",
        F.get(F.filter("runs", lambda r: r["to"] >= F.col("place")), F.lit(0))["node"].alias("shard"))
    shards = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    told = aims.withColumnRenamed("source", "s")
    shares = blocks.select("source", "block").join(
        shards.select(F.col("source").alias("s1"), F.col("block").alias("b1"), "shards"),
        F.col("source").eqNullSafe(F.col("s1")) & (F.col("block") == F.col("b1")), "left",
    ).join(told, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target",
        F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    return rows.join(
        shares, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    ).select(
        *[F.col("row").getField(c).alias(c) for c in kept], "size", "source_size", "target",
        (F.col("size") * F.size("shards")).alias("taken"), "shards")


def written(mix: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: a row for each draw, by shard and shuffled inside it.

    The hash has the text too, where the mix carries it, so that rows without an id are spread as well.
    """
    rows = mix.select("*", F.posexplode("shards").alias("pass", "shard")).drop("shards")
    named = [quoted(c) for c in (id_col, text_col) if c in mix.columns]
    return rows.withColumn("_turn", seed("shuffle", F.xxhash64(*named), "pass")) \
        .repartition("shard", F.pmod("_turn", F.lit(64))) \
        .sortWithinPartitions("shard", "_turn").drop("_turn")
