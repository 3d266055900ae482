"""The best entities of a term among all of them, without comparing all pairs.

Two texts with an edit similarity of ``s`` share at least ``s`` times the longer one's letters, a letter
with its running number counting as one (``a1`` is the first a). So each text needs to be met only under
its rarest letters: the first ``length - ceil(s * length) + 1`` in one order for all. The search goes from
a high similarity to lower ones; a term whose k-th best score can't be passed by anything below the step is
done, and only the open ones go on. The last step meets every entity that shares a letter at all, and what
has none is added by address. Nothing is capped, so the result is that of comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegraph.functions.similarity import CONTAINS_BONUS
from tablegraph.session import checkpoint, dealt, parallel_tasks

# Names that one task takes: it groups the pairs that they make with all open texts.
NAMES_PER_TASK = 10_000

# Similarities of the steps in hundredths; the last is any at all.
STEPS = (75, 55, 40, 25, 0)


def numbered_letters(text: Column) -> Column:
    """Letters with their running number, as ``a1, b1, a2``."""
    ordered = F.array_sort(F.split(text, ""))
    return F.transform(ordered, lambda c, i: F.concat(
        c, (i - F.array_position(ordered, c) + 2).cast("string")))


def by_rarity(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """``text, size, letters``: numbered letters, those of the fewest names first."""
    letters = texts.select("text", F.explode(numbered_letters(F.col("text"))).alias("letter"))
    placed = letters.join(counts, "letter", "left").groupBy("text").agg(F.array_sort(F.collect_list(
        F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "letter"))).alias("placed"))
    return placed.select(
        "text", F.length("text").alias("size"), F.transform("placed", lambda p: p["letter"]).alias("letters"))


def met(asked: DataFrame, known: DataFrame, step: int) -> DataFrame:
    """``text, name, sim`` of the pairs that reach the step, each once."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        need = F.greatest(F.lit(1), F.floor((step * F.col("size") + 99) / 100))
        first = F.slice("letters", F.lit(1), (F.col("size") - need + 1).cast("int"))
        cut = rows.select(F.col("text").alias(name), F.col("size").alias(f"{name}_size"), first.alias(f"{name}_first"))
        return cut.withColumn("letter", F.explode(f"{name}_first"))

    longer, shorter = F.greatest("x_size", "y_size"), F.least("x_size", "y_size")
    # A pair that shares several letters counts under the first, in the order that both lists have.
    once = F.get(F.array_intersect("x_first", "y_first"), F.lit(0)) == F.col("letter")
    pairs = side(asked, "x").join(side(known, "y"), "letter").where((100 * shorter >= step * longer) & once)
    steps_apart = F.levenshtein("x", "y")
    close = pairs.select("x", "y", longer.alias("longer"), steps_apart.alias("apart")).where(
        (F.col("apart") < F.col("longer"))
        & (100 * (F.col("longer") - F.col("apart")) >= step * F.col("longer")))
    return close.select(
        F.col("x").alias("text"), F.col("y").alias("name"),
        (F.lit(1.0) - F.col("apart") / F.col("longer")).alias("sim"))


def nearest_entities(texts: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """``text, uri, raw``: the best ``limit`` entities of each text, all entities taken into account.

    ``names`` has ``uri, name, label`` with normalised texts, a row for each name. ``raw`` is the best
    similarity over an entity's names, plus the bonus where its label contains the text; equal scores are
    in order of ``uri``. Blank names are like nothing.
    """
    limit = max(limit, 1)
    names = checkpoint(names.select("uri", "name", "label").distinct())
    names = dealt(names, NAMES_PER_TASK)
    known = names.where("name <> ''").select(F.col("name").alias("text")).distinct()
    counts = known.select(F.explode(numbered_letters(F.col("text"))).alias("letter")).groupBy("letter").agg(
        F.count(F.lit(1)).alias("n"))
    known = checkpoint(by_rarity(known, counts))
    still_open = checkpoint(by_rarity(texts.select("text").where("text <> ''").distinct(), counts))
    # At most ``limit`` addresses: what a text without any similar entity gets.
    first = sorted(r.uri for r in names.select("uri").distinct().orderBy("uri").limit(limit).collect())
    order = Window.partitionBy("text").orderBy(F.desc("raw"), "uri")
    done = []
    for step in STEPS:
        # Each pair meets all entities of its name, and the results wait in memory to be grouped.
        pairs = met(still_open, known, step).repartition(parallel_tasks(names), "text", "name")
        found = pairs.join(names, "name").groupBy("text", "uri", "label").agg(
            F.max("sim").alias("sim"))
        contains = (F.col("label") != "") & F.col("label").contains(F.col("text"))
        found = found.select("text", "uri", F.when(
            contains, F.least(F.lit(1.0), F.col("sim") + CONTAINS_BONUS)).otherwise(F.col("sim")).alias("raw"))
        if step == 0:
            rest = still_open.select("text", F.explode(F.array(
                *[F.lit(u) for u in first]).cast("array<string>")).alias("uri"), F.lit(0.0).alias("raw"))
            found = found.unionByName(rest).groupBy("text", "uri").agg(F.max("raw").alias("raw"))
        best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
        if step == 0:
            done.append(best.drop("place"))
            break
        best = checkpoint(best)
        # Whatever this step has not met scores less than the step and the bonus.
        full = best.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("least")).where(
            (F.col("n") >= limit) & (F.col("least") >= step / 100 + CONTAINS_BONUS)).select("text")
        done.append(best.join(full, "text", "left_semi").drop("place"))
        still_open = checkpoint(still_open.join(full, "text", "left_anti"))
        if still_open.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
