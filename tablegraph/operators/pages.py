"""Pages of a large table in key order, each read from the range partitions that hold it.

The table is range partitioned by the order and all other columns, sorted, and written once as Parquet with a
folder for each range. The sizes of the ranges, one number each, are the directory: it says which ranges
a page lies in and at which lines, so a page deep inside the table reads one or two folders and passes
neither offset nor limit through the driver.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StructType, VariantType

from tablegraph.session import shared_folder

RANGE, LINE = "_page_range", "_page_line"


class Pages:
    """A table laid out by range; build it once and ask for any page."""

    def __init__(self, df: DataFrame, order_by: list[str], ranges: int | None = None):
        """``ranges`` fixes their number; without it small ones are joined."""
        spark = df.sparkSession
        # Rows that tie on the order are told apart by all columns that can be ordered.
        ties = [f.name for f in df.schema.fields if f.name not in order_by
                and not isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))]
        self.order = [F.col(f"`{c}`") for c in [*order_by, *ties]]
        self.empty = df.limit(0)
        self.columns = [F.col(f"`{c}`") for c in df.columns]
        path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
        by = self.order if ranges is None else [ranges, *self.order]
        ranged = df.repartitionByRange(*by).sortWithinPartitions(*self.order)
        # The lower bits of the id count the rows of a task.
        laid = ranged.withColumn(RANGE, F.spark_partition_id()).withColumn(
            LINE, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        laid.write.partitionBy(RANGE).parquet(path)
        shape = StructType([f for f in laid.schema.fields if f.name != RANGE]).add(RANGE, IntegerType())
        self.table = spark.read.schema(shape).parquet(path)
        counts = self.table.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
        self.sizes = sorted((r[RANGE], r.n) for r in counts.collect())  # a row for each range
        self.total = sum(n for _, n in self.sizes)

    def places(self, offset: int, size: int) -> list[tuple[int, int, int]]:
        """``range, first line, last line`` of the rows from ``offset`` on."""
        found, before = [], 0
        for name, n in self.sizes:
            a, b = max(offset - before, 0), min(offset + size - before, n)
            if a < b:
                found.append((name, a, b - 1))
            before += n
        return found

    def page(self, number: int, size: int) -> DataFrame:
        """One page; a page beyond the last shows the last, below one the first."""
        if size <= 0:
            return self.empty
        number = min(max(number, 1), max(1, -(-self.total // size)))
        places = self.places((number - 1) * size, size)
        if not places:
            return self.empty
        held = [(F.col(RANGE) == r) & F.col(LINE).between(a, b) for r, a, b in places]
        return self.table.where(reduce(Column.__or__, held)).orderBy(*self.order).select(*self.columns)
