"""Near-duplicate terms: an exact similarity join and greedy grouping."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegraph.functions.similarity import lcs_length
from tablegraph.session import checkpoint, parallel_tasks, shared_folder

# Slack against float rounding in length bounds; only ever admits more candidates.
_EPS = 1e-9

# Edit budgets up to this are tested natively before the exact ratio; no result depends on it.
NATIVE_BUDGET = 12


def _common_needed(la: Column, lb: Column, t: float) -> Column:
    """Smallest common-subsequence length that reaches ratio ``t``."""
    return F.ceil(F.lit(t) * (la + lb) / 2 - _EPS).cast("int")


def _near(la: Column, lb: Column, t: float) -> Column:
    """Whether a similar pair of these lengths loses at most one character on each side."""
    needed = _common_needed(la, lb, t)
    return (la - needed <= 1) & (lb - needed <= 1)


def _edits(n: Column, t: float) -> Column:
    """Most characters a text of length ``n`` and a similar longer one lose together."""
    return F.floor(F.lit(2 * (1 - t) / t) * n + _EPS).cast("int")


def _longest(n: Column, t: float) -> Column:
    return F.floor(n * (2 - t) / t + _EPS).cast("int")


def _band(n: Column, bits: int) -> Column:
    """First length of the band of ``n``: its leading ``bits + 1`` binary digits, then zeros."""
    low = F.greatest(F.length(F.bin(n)) - 1 - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", n, low), low)


def _banded(texts: DataFrame, lengths: Column, t: float, bits: int) -> DataFrame:
    """Rows for each length band of ``lengths``, with its segment ``size`` and position ``width``."""
    rows = texts.withColumn(
        "band", F.explode(F.array_distinct(F.transform(lengths, lambda m: _band(m, bits))))
    )
    step = F.call_function(
        "shiftleft", F.lit(1), F.greatest(F.length(F.bin("band")) - 1 - bits, F.lit(0))
    )
    last = F.col("band") + step - 1
    # A segment size holds for every length of the band: one segment more than edits.
    sizes = F.transform(
        F.sequence(F.col("band"), last),
        lambda m: F.floor(m / (_edits(m, t) + 1)).cast("int"),
    )
    return rows.withColumn("width", _edits(last, t) + 1).withColumn(
        "size", F.greatest(F.array_min(sizes), F.lit(1))
    )


def _segment_pairs(texts: DataFrame, t: float) -> DataFrame:
    """Candidate ids ``x, y`` (x not longer) of the similar pairs that are not near; no text in it.

    The shorter text is cut into segments of one size per length band, at least one more than
    the pair can have edits. An edit breaks at most one segment (single characters break by a
    loss only), so enough of them stand unchanged in the longer text, shifted by no more than
    the characters lost before. The longer text offers all its substrings of that size; hashes
    of band, stretch of positions and substring meet. A clash of hashes only adds candidates.
    """
    n = F.col("n")
    bits = min(10, max(0, math.ceil(-math.log2(min(1.0, 2 * (1 - t) / t + _EPS)))))
    shortest = F.greatest(F.ceil(F.lit(t / (2 - t)) * n - _EPS).cast("int"), F.lit(1))
    longer = F.filter(F.sequence(n, _longest(n, t)), lambda m: ~_near(n, m, t))
    shorter = F.filter(F.sequence(shortest, n), lambda m: ~_near(m, n, t))

    def key(at: Column) -> Column:
        return F.xxhash64("band", at, F.substr("text", F.col("place") + 1, F.col("size")))

    own = _banded(texts.filter(F.size(longer) > 0), F.array(n), t, bits)
    starts = F.sequence(F.lit(0), n - F.col("size"), F.col("size"))
    own = own.withColumn("place", F.explode(F.filter(starts, lambda p: p + F.col("size") <= n)))
    reach = F.col("width") - 1
    first = F.floor(F.greatest(F.col("place") - reach, F.lit(0)) / F.col("width")).cast("int")
    last = F.floor((F.col("place") + reach) / F.col("width")).cast("int")
    own = own.withColumn("at", F.explode(F.sequence(first, last)))
    x = own.select(key(F.col("at")).alias("key"), "id", "n", "size", "place")

    offered = _banded(texts.filter(F.size(shorter) > 0), shorter, t, bits)
    offered = offered.filter(n >= F.col("size")).withColumn(
        "place", F.explode(F.sequence(F.lit(0), n - F.col("size")))
    )
    at = F.floor(F.col("place") / F.col("width")).cast("int")
    y = offered.select(key(at).alias("key"), "id", "n", "place")

    # Few bytes, many meetings: a width given explicitly is not merged for small data.
    wide = parallel_tasks(texts)
    x, y = x.repartition(wide, "key").alias("x"), y.repartition(wide, "key").alias("y")
    la, lb = F.col("x.n"), F.col("y.n")
    needed = _common_needed(la, lb, t)
    shift = F.col("y.place") - F.col("x.place")
    met = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & ((la < lb) | ((la == lb) & (F.col("x.id") < F.col("y.id"))))
        & (lb <= _longest(la, t))
        & ~_near(la, lb, t)
        & (shift >= needed - la)
        & (shift <= lb - needed),
    )
    whole = F.when(F.col("size") == 1, needed).otherwise(
        F.floor(la / F.col("size")).cast("int") - (la + lb - 2 * needed)
    )
    counted = met.groupBy(F.col("x.id").alias("x"), F.col("y.id").alias("y")).agg(
        F.count(F.lit(1)).alias("met"), F.max(whole).alias("whole")
    )
    return counted.filter(F.col("met") >= F.col("whole")).select("x", "y")


def _near_pairs(texts: DataFrame, t: float) -> DataFrame:
    """Candidate ids ``x, y`` of the near pairs: they share the text less one character at most.

    Only texts short enough for ``t`` have near partners; the others make no variants.
    """
    n = F.col("n")
    cuts = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.xxhash64(F.concat(F.substring("text", F.lit(1), i - 1), F.substr("text", i + 1)))
            .alias("variant"),
            (n - 1).alias("left"),
        ),
    )
    uncut = F.array(F.struct(F.xxhash64("text").alias("variant"), n.alias("left")))
    some = texts.filter(_near(n, n, t) | _near(n, n + 1, t) | _near(n - 1, n, t))
    cut = some.select("id", "n", F.inline(F.array_distinct(F.concat(uncut, cuts))))
    x, y = cut.alias("x"), cut.alias("y")
    la, lb = F.col("x.n"), F.col("y.n")
    return (
        x.join(
            y,
            (F.col("x.variant") == F.col("y.variant"))
            & (F.col("x.left") == F.col("y.left"))
            & (F.col("x.id") < F.col("y.id"))
            & _near(la, lb, t)
            & (F.col("x.left") >= _common_needed(la, lb, t)),
        )
        .select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))
        .distinct()
    )


def similar_pairs(terms: DataFrame, t: float = 0.85) -> DataFrame:
    """``a, b, ratio`` for all distinct terms a < b whose indel ratio is at least ``t``. Exact.

    Three cases cover every pair, none of them compares all terms or all of a block blindly:

    * equal after lower-casing: ratio 1, joined on the lower-cased text;
    * so close that each side may lose at most one character: joined on hashes of the text with
      one character removed;
    * the rest: joined on hashed segments (see :func:`_segment_pairs`).

    The joins carry hashes and lengths only; candidates fetch their texts once, and the native
    edit distance lets the exact ratio see the survivors only. Keys shared by very many terms
    are split by adaptive skew joins. Null terms are left out, the empty one is similar to none.
    """
    if not 0 < t <= 1:
        raise ValueError("threshold must be in (0, 1]")
    # Few bytes but much work per text: a fixed width keeps all cores busy.
    named = terms.select("term").filter(F.col("term").isNotNull())
    named = named.withColumn("text", F.lower("term")).repartition(parallel_tasks(terms), "text")
    named = checkpoint(named.distinct().withColumn("id", F.xxhash64("text")))
    texts = named.filter(F.col("text") != "").select("id", "text").distinct()
    texts = texts.withColumn("n", F.length("text"))

    # Different texts of one hash meet nowhere else.
    twins = texts.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    found = _near_pairs(texts, t).unionByName(_segment_pairs(texts, t))
    found = found.unionByName(twins.select(F.col("id").alias("x"), F.col("id").alias("y")))

    left = named.select(F.col("id").alias("x"), F.col("term").alias("ta"), F.col("text").alias("a"))
    right = named.select(F.col("id").alias("y"), F.col("term").alias("tb"), F.col("text").alias("b"))
    total = F.length("a") + F.length("b")
    budget = (total - 2 * F.ceil(F.lit(t) * total / 2 - _EPS)).cast("int")
    both = found.join(left, "x").join(right, "y").repartition(parallel_tasks(terms))
    both = both.filter((F.col("x") != F.col("y")) | (F.col("a") < F.col("b")))
    # The native distance costs its budget for every character, the exact ratio a word step.
    cheap = F.call_function("levenshtein", "a", "b", budget) >= 0
    both = both.filter((budget > NATIVE_BUDGET) | cheap)
    ratio = F.lit(2.0) * lcs_length(F.col("a"), F.col("b")) / total
    different = both.select("ta", "tb", ratio.alias("ratio")).filter(F.col("ratio") >= t)

    equal = left.join(
        right.filter(F.col("b") != ""), (F.col("a") == F.col("b")) & (F.col("ta") < F.col("tb"))
    )
    pairs = different.unionByName(equal.select("ta", "tb", F.lit(1.0).alias("ratio")))
    return pairs.select(
        F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"), "ratio"
    )


def consolidate_groups(pairs: DataFrame) -> DataFrame:
    """Greedy groups ``leader, member`` (leader included) from similar ``a < b`` pairs.

    Terms are taken in sorted order; a free term leads and takes all later free terms similar
    to it. The result equals the sequential loop's, found in parallel rounds: a term without an
    open earlier neighbour leads, its open neighbours follow somebody and so never lead. All
    edges of terms so decided leave, so a round costs what is still open; it decides at least
    the smallest open term. At last each follower takes its smallest neighbour that leads.

    Open edges are written to two folders in turn below ``spark.checkpoint.dir``: each round
    reads one and replaces the other, so only the last two rounds are stored.
    """
    spark = pairs.sparkSession
    folder = f"{shared_folder(spark)}/groups-{uuid.uuid4().hex}"
    pairs.select("a", "b").distinct().write.parquet(f"{folder}/edges")
    edges = spark.read.parquet(f"{folder}/edges")
    still_open, turn = edges, 0
    followers = f"{folder}/followers"
    # An empty start, so that the folder can be read whatever follows.
    edges.select("b").limit(0).write.parquet(f"{followers}/round=0")
    while not still_open.isEmpty():
        led = still_open.select(F.col("b").alias("a")).distinct()
        leading = still_open.select("a").distinct().join(led, "a", "left_anti")
        turn += 1
        following = still_open.join(leading, "a").select("b").distinct()
        following.write.parquet(f"{followers}/round={turn}")
        following = spark.read.parquet(f"{followers}/round={turn}")
        # Rows of a leader end in a follower, so dropping both ends of followers drops them too.
        rest = still_open.join(following, "b", "left_anti").join(
            following.select(F.col("b").alias("a")), "a", "left_anti"
        )
        rest.select("a", "b").write.mode("overwrite").parquet(f"{folder}/open-{turn % 2}")
        still_open = spark.read.parquet(f"{folder}/open-{turn % 2}")
    never = spark.read.schema("b string").option("recursiveFileLookup", True).parquet(followers)
    leading = edges.join(never.select(F.col("b").alias("a")), "a", "left_anti")
    led = leading.groupBy("b").agg(F.min("a").alias("leader"))
    members = F.array(F.col("b"), F.col("leader"))
    return led.select("leader", F.explode(members).alias("member")).distinct()
