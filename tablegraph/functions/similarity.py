"""String and vector similarities as Column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablegraph.functions.text import norm, tokenize

# Weights of the hybrid score and the bonus for a contained query.
WEIGHT_TEXT = 0.5
WEIGHT_LABEL = 0.2
WEIGHT_EDIT = 0.3
CONTAINS_BONUS = 0.08


def lev_score(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, lower-cased; two empty texts 1.0, null 0.0."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    score = F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(x, y) / F.nullif(longest, F.lit(0))
    )
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(score)


def normed_sim(x: Column, y: Column) -> Column:
    """1 - edit distance / longer length of two normalised texts; blank gives 0.0."""
    longest = F.greatest(F.length(x), F.length(y))
    blank = x.isNull() | y.isNull() | (x == "") | (y == "")
    return F.when(blank, F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(x, y) / F.nullif(longest, F.lit(0))
    )


def lev_sim(a: Column, b: Column) -> Column:
    """As ``lev_score`` on normalised text, but blank gives 0.0."""
    return normed_sim(norm(a), norm(b))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = tokenize(a), tokenize(b)
    both = F.size(F.array_intersect(x, y))
    either = F.size(F.array_union(x, y))
    empty = (F.size(x) == 0) | (F.size(y) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(both / F.nullif(either, F.lit(0)))


def contains_boost(score: Column, query: Column, label: Column) -> Column:
    q, n = norm(query), norm(label)
    hit = (q != "") & (n != "") & n.contains(q)
    return F.when(hit, F.least(F.lit(1.0), score + CONTAINS_BONUS)).otherwise(score)


def lcs_length(a: Column, b: Column) -> Column:
    """Arrow-batched longest common subsequence length; call it on filtered pairs only.

    Everything the workers need is local to this function, so executors do not have to have
    this package installed.
    """

    def one(left: str, right: str) -> int:
        """One machine word row per character of the right text."""
        places: dict[str, int] = {}
        for i, ch in enumerate(left):
            places[ch] = places.get(ch, 0) | (1 << i)
        full = (1 << len(left)) - 1
        row = full
        for ch in right:
            hit = row & places.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(left) - row.bit_count()

    def measure(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(left, right)], dtype="int32")

    # Marked so that a filter on the result is not pushed below and evaluated a second time.
    return F.pandas_udf(measure, "int").asNondeterministic()(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / total length on lower-cased text; two empty texts 1.0."""
    x, y = F.lower(a), F.lower(b)
    total = F.length(x) + F.length(y)
    return F.when(total == 0, F.lit(1.0)).otherwise(
        F.lit(2.0) * lcs_length(x, y) / F.nullif(total, F.lit(0))
    )


def _dot(u: Column, v: Column) -> Column:
    products = F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(u: Column, v: Column) -> Column:
    """Cosine of two vectors; null when either is missing, 0.0 for a zero vector."""
    length = F.sqrt(_dot(u, u)) * F.sqrt(_dot(v, v))
    return F.when(u.isNull() | v.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(F.try_divide(_dot(u, v), length), F.lit(0.0))
    )


def hybrid_score(text_cosine: Column, label_cosine: Column, edit: Column) -> Column:
    """Weighted mix; the edit score alone when vectors are missing."""
    mixed = WEIGHT_TEXT * text_cosine + WEIGHT_LABEL * label_cosine + WEIGHT_EDIT * edit
    return F.coalesce(mixed, edit)
