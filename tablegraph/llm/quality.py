"""Quality rules with risk-controlled cutoffs.

Base rules (too few words, too many repeated word triples) hold for every text. Beyond them, four
ratios (symbols, repeated lines, repeated triples, word length) have fixed grids of cutoffs. For each
stratum (language) the labelled good documents that pass the base rules are a holdout: cutoffs may be
used if the exact binomial test rejects, at the corrected level, that they turn away more than the
allowed rate of good documents. Cutoffs are tested from lax to strict until one fails (fixed sequence).

The size of the holdout alone chooses between two ways, so either keeps its level. Where it is large
enough for a test of each ratio by itself (1,196 good documents at the default risk and delta), every
ratio has its own sequence at its share of rate and level. Below that all ratios move together, in turn
by one step, along one sequence of joint rules, and the rate that all of them turn away is tested at the
whole risk (from 228 good documents). The level is divided by the number of strata (Bonferroni), so all
chosen cutoffs hold together with probability ``1 - delta``. With fewer labels than that even no good
document turned away proves nothing, and a stratum keeps the base rules only.

Everything is DataFrame expressions: a text's counts are one expression over its words, holdouts are
one grouped aggregate, and the table of cutoffs (strata times ratios, a fixed number) is broadcast.

Null and empty texts have no words and fail the base rules. A document with several labels is good if
all say so; labels of unknown documents and null labels count for nothing. Repeated rows get equal
results. Other columns pass through; an added column replaces one of its name.
"""

from __future__ import annotations

from functools import reduce
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegraph.llm.frame import BLANKS, GAP, let, quoted, stored, tuned
from tablegraph.session import checkpoint

LANGUAGES = ("de", "en", "es", "fr")
SYMBOLS = "#*$%&|<>"
# Ratio names and their cutoffs from lax to strict.
GRIDS = {
    "symbols": (0.3, 0.2, 0.15, 0.1, 0.05, 0.02, 0.01),
    "lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35),
    "triples": (0.48, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "length": (12.0, 11.0, 10.0, 9.0, 8.0, 7.5, 7.0),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(ws: Column) -> Column:
    """Words inside three-word windows that occur twice or more, from the word list.

    Window hashes are compared first; only a text with an equal pair sorts them by hash and place.
    """
    places = F.sequence(F.lit(0), F.size(ws) - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

    def marked(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def twice(s: Column) -> Column:
            found = F.filter(s, lambda x, i: (
                F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            ))
            return let(
                F.sort_array(F.transform(found, lambda x: x["p"])),
                lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3))),
                    F.lit(0), lambda s, x: s + x),
            )

        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, twice)).otherwise(F.lit(0))

    return F.when(F.size(ws) >= 4, let(hashes, marked)).otherwise(F.lit(0))


def counts(text: Column) -> Column:
    """The counts of a text as one struct."""
    whole = F.coalesce(text, F.lit(""))
    ws = F.filter(F.split(whole, GAP), lambda w: w != "")
    lines = F.filter(
        F.split(whole, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return let(
        F.struct(
            ws.alias("ws"), lines.alias("lines"),
            F.length(F.translate(whole, BLANKS, "")).alias("chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).alias("symbols"),
        ),
        lambda t: F.struct(
            F.size(t["ws"]).cast("long").alias("n_words"),
            t["chars"].cast("long").alias("word_chars"),
            t["symbols"].cast("long").alias("n_symbols"),
            (F.size(t["lines"]) - F.size(F.array_distinct(t["lines"]))).cast("long").alias("n_dup_lines"),
            repeated_words(t["ws"]).cast("long").alias("n_repeat_words"),
            F.size(t["lines"]).cast("long").alias("n_lines"),
        ),
    )


def ratio(name: str, c: str = "_counts") -> Column:
    """A ratio from the counts; null where it has no base."""
    parts = {
        "symbols": ("n_symbols", "word_chars"), "lines": ("n_dup_lines", "n_lines"),
        "triples": ("n_repeat_words", "n_words"), "length": ("word_chars", "n_words"),
    }[name]
    top, base = (F.col(f"{c}.{p}") for p in parts)
    return F.when(base > 0, top / base)


def base_failed(c: str = "_counts") -> Column:
    n = F.col(f"{c}.n_words")
    return (n < 50) | (100 * F.col(f"{c}.n_repeat_words") > 50 * n)


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*LANGUAGES), lang).otherwise(F.lit("other"))


def log_gamma(x: Column) -> Column:
    """ln gamma(x), x >= 1: Stirling's series at x + 8, brought back by the recurrence."""
    t = x + 8.0
    product = x
    for i in range(1, 8):
        product = product * (x + float(i))
    series = 1 / (12 * t) - 1 / (360 * t * t * t) + 1 / (1260 * t * t * t * t * t)
    return (t - 0.5) * F.log(t) - t + 0.5 * log(2 * pi) + series - F.log(product)


def at_most(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of a binomial(n, rate); 1 at or above the mean, where no test could reject.

    Below the mean terms fall as k does, so the sum starts at k; 40 standard deviations further
    down nothing is left in double precision.
    """
    x, m = k.cast("double"), n.cast("double")
    last = (
        log_gamma(m + 1) - log_gamma(x + 1) - log_gamma(m - x + 1)
        + x * log(rate) + (m - x) * log(1 - rate)
    )
    odds = (1 - rate) / rate
    depth = F.least(k, F.ceil(40 * F.sqrt(m * rate)) + 40).cast("int")
    tail = F.aggregate(
        F.sequence(F.lit(0), depth),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, j: F.struct(
            (s["term"] * (x - j) / (m - x + j + 1) * odds).alias("term"),
            (s["sum"] + s["term"]).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    return F.when(x < m * rate, F.exp(last) * tail).otherwise(F.lit(1.0))


def cutoffs(found: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """One row of cutoffs (null: none) for each stratum, from ``id, stratum, _counts`` and labels.

    ``risk`` is the rate of good documents that all ratios together may turn away in a stratum.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    held = found.where(~base_failed()).join(good.select(F.col("doc_id").alias("id")), "id")
    steps = joint_steps()
    tests = [
        F.array(*[F.count_if(ratio(name) > cut) for cut in grid]).alias(f"n_{name}")
        for name, grid in GRIDS.items()
    ]
    together = F.array(*[F.count_if(beyond(step)) for step in steps]).alias("n_joint")
    held = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *tests, together)
    level = delta / (len(LANGUAGES) + 1)
    own_risk, own_level = risk / len(GRIDS), level / len(GRIDS)
    # Whether a ratio that turns no good document away could pass by itself.
    alone = at_most(F.lit(0), F.col("n"), own_risk) <= own_level
    passed = held.select(
        "stratum", alone.alias("alone"), passes("n_joint", risk, level),
        *[passes(f"n_{name}", own_risk, own_level) for name in GRIDS])
    return passed.select("stratum", *[
        F.when(F.col("alone"), strictest(f"n_{name}", grid))
        .otherwise(strictest("n_joint", [step.get(name) for step in steps])).alias(f"cut_{name}")
        for name, grid in GRIDS.items()
    ])


def passes(counts: str, risk: float, level: float) -> Column:
    """How many tests pass, from lax to strict, before the first that fails, from their counts."""
    failed = F.transform(counts, lambda k: at_most(k, F.col("n"), risk) > level)
    first = F.array_position(failed, True)
    return F.when(first > 0, first - 1).otherwise(F.size(failed)).cast("int").alias(counts)


def strictest(passed: str, values) -> Column:
    """The value of the last test that passes; null if there is none."""
    return F.get(F.array(*[F.lit(v).cast("double") for v in values]), F.col(passed) - 1)


def joint_steps() -> list[dict[str, float]]:
    """Cutoffs of all ratios from lax to strict: each step moves one ratio, in turn, to its next."""
    steps, at = [], {}
    for i in range(max(map(len, GRIDS.values()))):
        for name, grid in GRIDS.items():
            if i < len(grid):
                at = at | {name: grid[i]}
                steps.append(at)
    return steps


def beyond(step: dict[str, float]) -> Column:
    """Whether any ratio lies beyond its cutoff."""
    return reduce(Column.__or__, [F.coalesce(ratio(n) > cut, F.lit(False)) for n, cut in step.items()])


def judged(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
           lang_col: str = "lang", risk: float = 0.02, delta: float = 0.05,
           with_text: bool = True) -> DataFrame:
    """The documents with their counts, ``base_failed`` and ``kept``.

    The counts are made once: they are checkpointed, or with the text written beside it as Parquet, of
    which the cutoffs read the counts only. No text is shuffled.
    """
    tuned(docs.sparkSession)
    dropped = [*COUNTS, "base_failed", "kept", *([] if with_text else [text_col])]
    kept = [c for c in docs.columns if c not in dropped]
    counted = docs.select(
        F.struct(*[quoted(c).alias(c) for c in kept]).alias("_row"),
        quoted(id_col).alias("_id"), stratum(quoted(lang_col)).alias("_stratum"),
        counts(quoted(text_col)).alias("_counts"),
    )
    counted = stored(counted) if with_text else checkpoint(counted)
    found = counted.select(F.col("_id").alias("id"), F.col("_stratum").alias("stratum"), "_counts")
    return verdicts(counted, checkpoint(cutoffs(found, labels, risk, delta)), kept)


def verdicts(counted: DataFrame, limits: DataFrame, kept: list[str]) -> DataFrame:
    """Counts and verdicts by the cutoffs of each row's stratum."""
    limits = limits.withColumnRenamed("stratum", "_stratum")
    bad = F.lit(False)
    for name in GRIDS:
        bad = bad | F.coalesce(ratio(name) > F.col(f"cut_{name}"), F.lit(False))
    # At most one row for each language of the list and one for the rest.
    return counted.join(F.broadcast(limits), "_stratum", "left").select(
        *[F.col("_row").getField(c).alias(c) for c in kept], *[F.col(f"_counts.{c}").alias(c) for c in COUNTS],
        base_failed().alias("base_failed"), (~base_failed() & ~bad).alias("kept"),
    )
