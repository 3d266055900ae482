"""Column splitting, code expansion, unpivot, generated ids, multi-value rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegraph.functions.text import SPACE, py_strip, zero_padded_id
from tablegraph.operators.positions import global_positions, group_positions


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _split_pattern(delimiter: str) -> str:
    return f"{SPACE}*" + r"\Q" + delimiter.replace(r"\E", r"\E\\E\Q") + r"\E" + f"{SPACE}*"


def split_column(
    df: DataFrame, column: str, delimiter: str, names: list[str], keep_original: bool = True
) -> DataFrame:
    """Parts of a column as new columns; surplus parts stay in the last, blanks are null."""
    if column not in df.columns:
        raise ValueError(f"column '{column}' not found")
    if not names:
        raise ValueError("no new column names given")
    taken = [n for n in names if n in df.columns]
    if taken:
        raise ValueError(f"column name(s) already in use: {', '.join(taken)}")
    parts = F.split(_col(column).cast("string"), _split_pattern(delimiter), len(names))
    new = [F.nullif(py_strip(F.get(parts, F.lit(i))), F.lit("")).alias(n)
           for i, n in enumerate(names)]
    old = [_col(c) for c in df.columns if keep_original or c != column]
    return df.select(*old, *new)


def suggest_split_names(df: DataFrame, column: str, delimiter: str) -> DataFrame:
    """``position, name``: as many numbered names as the longest split has parts."""
    parts = F.size(F.split(_col(column).cast("string"), r"\Q" + delimiter + r"\E"))
    longest = df.agg(F.max(parts).alias("n"))
    return longest.select(
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("position")
    ).select("position", F.concat(F.lit(column + "_"), F.col("position").cast("string")).alias("name"))


def code_column_names(codes: list[str], prefix: str, existing: list[str]) -> dict[str, str]:
    """Sanitised column name per code; an empty or clashing name is an error."""
    out: dict[str, str] = {}
    for code in codes:
        name = re.sub(r"[^\w-]", "_", f"{prefix}{code.strip()}").strip("_")
        name = re.sub(r"_+", "_", name)
        if not name:
            raise ValueError(f"no valid column name for code '{code}' with prefix '{prefix}'")
        if name in existing or name in out.values():
            raise ValueError(f"column name '{name}' of code '{code}' is already in use")
        out[code] = name
    return out


def expand_codes(
    df: DataFrame,
    column: str,
    delimiter: str,
    codes: list[str],
    prefix: str = "",
    true_value: str | None = "True",
    false_value: str | None = None,
    keep_original: bool = True,
) -> DataFrame:
    """One indicator column per code, matched without case among the parts of a cell.

    ``$CODE$`` as true value puts the code itself; True/False gives boolean columns.
    """
    if column not in df.columns:
        raise ValueError(f"column '{column}' not found")
    if not codes:
        raise ValueError("no codes given")
    names = code_column_names(codes, prefix, df.columns)
    parts = F.transform(
        F.split(_col(column).cast("string"), _split_pattern(delimiter)),
        lambda p: F.lower(py_strip(p)),
    )
    boolean = str(true_value).lower() == "true" and str(false_value).lower() == "false"
    kept = [_col(c) for c in df.columns if keep_original or c != column]
    new = []
    for code, name in names.items():
        present = F.coalesce(F.array_contains(parts, code.strip().lower()), F.lit(False))
        if boolean:
            new.append(present.alias(name))
            continue
        yes = code if true_value == "$CODE$" else true_value
        no = None if false_value == "$CODE$" else false_value
        new.append(F.when(present, F.lit(yes)).otherwise(F.lit(no).cast("string")).alias(name))
    return df.select(*kept, *new)


def detect_codes(df: DataFrame, column: str, delimiter: str) -> DataFrame:
    """Distinct trimmed parts of a column over all its values, sorted."""
    parts = df.select(_col(column).cast("string").alias("v")).distinct()
    split = F.transform(F.split("v", _split_pattern(delimiter)), py_strip)
    parts = parts.select(F.explode(split).alias("code"))
    return parts.filter(F.col("code") != "").distinct().orderBy("code")


def codes_in_use(df: DataFrame, column: str, delimiter: str, codes: list[str]) -> DataFrame:
    """Configured codes that occur in the column; all detected codes when none are configured."""
    found = detect_codes(df, column, delimiter)
    return found.filter(F.col("code").isin(codes)) if codes else found


def unpivot_rows(df: DataFrame, ids: list[str], columns: list[str] | None = None) -> DataFrame:
    """One ``(ids, column, value)`` row per non-null cell, values as text."""
    columns = [c for c in df.columns if c not in ids] if columns is None else columns
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), _col(c).cast("string").alias("value"))
          for c in columns]
    )
    rows = df.select(*[_col(i) for i in ids], F.inline(cells))
    return rows.filter(F.col("value").isNotNull())


def generate_ids(
    df: DataFrame,
    order_by: list[str],
    name: str = "_generated_id_",
    prefix: str = "id_",
    start: int = 1,
) -> DataFrame:
    """Dense zero-padded ids in ``order_by`` order; a taken column name gets a number suffix."""
    target, n = name, 0
    while target in df.columns:
        n += 1
        target = f"{name}_{n}"
    rows = global_positions(df, order_by, "_number")
    # The row count is the highest number: one row, joined back to pad all ids alike.
    total = rows.agg(F.max("_number").alias("_total"))
    number = F.col("_number") - 1 + start
    joined = rows.crossJoin(F.broadcast(total))
    return joined.select(
        *[_col(c) for c in df.columns],
        zero_padded_id(prefix, number, F.col("_total")).alias(target),
    )


def column_positions(df: DataFrame, id_columns: list[str]) -> DataFrame:
    """``column, position``: data columns in table order, ids excluded."""
    names = [c for c in df.columns if c not in id_columns]
    return df.sparkSession.createDataFrame(
        [(c, i) for i, c in enumerate(names, 1)], "column string, position int"
    )


def value_positions(df: DataFrame) -> DataFrame:
    """``(subject, label, value)`` rows numbered inside each (subject, label), sorted by value."""
    return group_positions(df, ["subject", "label"], ["value"], "pos")


def expand_multi_values(values: DataFrame, labels: list[str]) -> DataFrame:
    """Wide rows ``subject, pos, <labels>`` from numbered ``(subject, label, value, pos)`` rows.

    A subject gives as many rows as its longest label has values; values are paired by
    position and a shorter label repeats its last value. No value list is ever built: the
    wide rows come from one pivot by (subject, pos), the repeats from one by subject.
    """
    wide = (
        values.groupBy("subject", "pos")
        .pivot("label", labels)
        .agg(F.first("value", ignorenulls=True))
    )
    last = (
        values.groupBy("subject").pivot("label", labels).agg(F.max_by("value", "pos"))
    )
    last = last.toDF("_subject", *[f"_last_{i}" for i in range(len(labels))])
    joined = wide.join(last, F.col("subject") == F.col("_subject"), "left")
    return joined.select(
        "subject",
        "pos",
        *[F.coalesce(_col(c), F.col(f"_last_{i}")).alias(c) for i, c in enumerate(labels)],
    )
