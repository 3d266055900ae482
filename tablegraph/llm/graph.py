"""Connected classes of a link table by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegraph.session import checkpoint


def _roots(pointers: DataFrame) -> DataFrame:
    """Follow ``a -> p`` (p <= a) until every row points at a root; path lengths halve each round."""
    while True:
        up = pointers.select(F.col("a").alias("p"), F.col("p").alias("q")).where("p <> q")
        if up.isEmpty():
            return pointers
        jumped = checkpoint(
            pointers.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"), "q")
        )
        pointers = jumped.select("a", "p")
        if jumped.where("q is not null").isEmpty():
            return pointers


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id of the links ``a, b``: the smallest id it can reach.

    Each round points every node at its smallest neighbour (a map-side combined minimum, so a node
    with a third of all links is fine), follows the pointers to their roots and keeps only the links
    between different roots. A round at least halves what is left.
    """
    found = None
    edges = links.where("a <> b").select("a", "b").distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("p"))
        pointers = _roots(checkpoint(least.select("a", F.least("a", "p").alias("p"))))
        if found is None:
            found = pointers.select(F.col("a").alias("id"), F.col("p").alias("component"))
        else:
            found = checkpoint(
                found.join(pointers.withColumnRenamed("a", "component"), "component", "left")
                .select("id", F.coalesce("p", "component").alias("component"))
            )
        to = pointers.select(F.col("a").alias("a"), F.col("p").alias("ra"))
        edges = checkpoint(
            edges.join(to, "a").join(to.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
            .where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        if edges.isEmpty():
            return found
