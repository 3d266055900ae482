"""Row numbers that survive hot keys: no group and no table ever passes through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegraph.session import checkpoint


# A group up to this many rows is numbered inside one task; a larger one is split over many.
HOT_ROWS = 1_000_000


def group_positions(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    name: str = "pos",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """1-based position of each row inside its key group, in ``order_by`` order.

    The largest group is measured first (partial counts, one number to the driver). While it
    fits one task, a window over the keys numbers the rows with a single shuffle; beyond
    ``hot_rows`` the same result comes from :func:`split_positions`.
    """
    if keys:
        sizes = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= hot_rows:
            order = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(
                *[F.col(f"`{c}`") for c in order_by]
            )
            return df.withColumn(name, F.row_number().over(order).cast("long"))
    return split_positions(df, keys, order_by, name)


def split_positions(
    df: DataFrame, keys: list[str], order_by: list[str], name: str = "pos"
) -> DataFrame:
    """:func:`group_positions` for groups of any size.

    Rows are range partitioned by key *and* order, so a group that holds a third of all rows
    is spread over many tasks. Each partition numbers its own run of a group; the runs are then
    shifted by the rows of the same group in earlier partitions. The partitioned rows are
    checkpointed once, which pins the partition boundaries if an executor is lost.

    With an empty ``keys`` the whole table is one group. Rows that tie on ``order_by`` are
    equal up to their order, so callers pass columns that make rows distinct.
    """
    names = df.columns
    ordered = df.repartitionByRange(*[F.col(f"`{c}`") for c in [*keys, *order_by]])
    ordered = ordered.sortWithinPartitions(*[F.col(f"`{c}`") for c in [*keys, *order_by]])
    marked = checkpoint(
        ordered.withColumn("_part", F.spark_partition_id()).withColumn(
            "_line", F.monotonically_increasing_id()
        )
    )
    # One row per (partition, group): its first line and its length. Sorted partitions make a
    # group's lines consecutive, so line - first + 1 is the position inside the run.
    runs = marked.groupBy("_part", *keys).agg(
        F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # Without keys this window sees one row per partition; with keys at most that per group.
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    renamed = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    runs = runs.select(F.col("_part").alias("_p"), *renamed, "_first", "_before")
    on = [F.col("_part") == F.col("_p")]
    on += [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    place = F.col("_line") - F.col("_first") + F.col("_before") + 1
    return marked.join(runs, on).select(*[F.col(f"`{c}`") for c in names], place.alias(name))


def global_positions(df: DataFrame, order_by: list[str], name: str = "pos") -> DataFrame:
    """Dense 1-based row numbers over the whole table, without a single-task window."""
    return split_positions(df, [], order_by, name)
