"""Which prefixes a graph needs: namespaces matched, prefixes chosen, common bases bound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegraph.functions.text import extract_iris, is_absolute_iri, strip_angle
from tablegraph.operators.reshape import unpivot_rows
from tablegraph.session import checkpoint


def mapping_iris(mapping: DataFrame, column: str = "URI") -> DataFrame:
    iri = strip_angle(F.col(f"`{column}`"))
    return mapping.select(iri.alias("iri")).filter(is_absolute_iri(F.col("iri"))).distinct()


def data_iris(df: DataFrame) -> DataFrame:
    """Distinct absolute web IRIs inside any cell."""
    cells = unpivot_rows(df, []).filter(F.col("value").contains("http"))
    found = cells.select(F.explode(extract_iris(F.col("value"))).alias("iri"))
    return found.select(strip_angle(F.col("iri")).alias("iri")).filter(
        is_absolute_iri(F.col("iri"))
    ).distinct()


def used_iris(mapping: DataFrame, df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Distinct IRIs of the mapping, the data and the settings."""
    out = mapping_iris(mapping).unionByName(data_iris(df))
    if extra:
        rows = df.sparkSession.createDataFrame([(e,) for e in extra], "iri string")
        out = out.unionByName(rows.filter(is_absolute_iri(F.col("iri"))))
    return out.distinct()


def matching_namespaces(iris: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``iri, namespace`` for every catalogue namespace that starts the IRI.

    The catalogue's few distinct lengths cut each IRI into that many prefixes, so the match is
    an equality join and not a comparison of all IRIs with all namespaces.
    """
    spaces = catalogue.select("namespace").distinct()
    # One row: the sorted set of lengths, at most one entry per possible length.
    lengths = spaces.agg(
        F.array_sort(F.collect_set(F.length("namespace"))).alias("lengths")
    )
    cut = iris.crossJoin(F.broadcast(lengths)).select("iri", F.explode("lengths").alias("n"))
    cut = cut.filter(F.length("iri") >= F.col("n")).select(
        "iri", F.substring(F.col("iri"), F.lit(1), F.col("n")).alias("namespace")
    )
    return cut.join(spaces, "namespace").select("iri", "namespace")


def longest_namespace(iris: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``iri, namespace``: the longest catalogue namespace of each IRI."""
    hits = matching_namespaces(iris, catalogue)
    return hits.groupBy("iri").agg(F.max_by("namespace", F.length("namespace")).alias("namespace"))


def prefix_choice(groups: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``namespace, prefix`` for namespaces with IRIs assigned; none where nothing fits.

    The only prefix; else the one most local ids start with (ties: the longer); else the longest
    that occurs in the host.
    """
    spaces = groups.select("namespace").distinct()
    options = catalogue.join(spaces, "namespace", "left_semi")
    sizes = options.groupBy("namespace").agg(F.count(F.lit(1)).alias("choices"))
    local = groups.select(
        "namespace", F.lower(F.substr("iri", F.length("namespace") + 1)).alias("local")
    )
    # Local ids are cut to each prefix's length, then joined on equality.
    joined = local.join(options, "namespace").filter(
        F.col("local").startswith(F.lower("prefix"))
    )
    scores = joined.groupBy("namespace", "prefix").agg(F.count(F.lit(1)).alias("score"))
    host = F.lower(F.regexp_extract("namespace", r"https?://([^/]+)", 1))
    rated = (
        options.join(sizes, "namespace").join(scores, ["namespace", "prefix"], "left")
        .withColumn("score", F.coalesce("score", F.lit(0)))
        .withColumn("in_host", (host != "") & host.contains(F.lower("prefix")))
        .withColumn("scored", F.max("score").over(Window.partitionBy("namespace")) > 0)
        .filter(
            (F.col("choices") == 1)
            | F.when(F.col("scored"), F.col("score") > 0).otherwise(F.col("in_host"))
        )
    )
    best = F.max_by("prefix", F.struct("score", F.length("prefix"), -F.col("ord")))
    return rated.groupBy("namespace").agg(best.alias("prefix"))


def _common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two texts; of a group's min and max it is the group's."""
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))),
        F.lit(0),
        lambda n, i: F.when(
            (n == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i
        ).otherwise(n),
    )
    return F.substring(a, F.lit(1), same)


def common_namespace(groups: DataFrame) -> DataFrame:
    """``namespace, bound``: the common base of a group's IRIs, cut after its last ``/`` or ``#``.

    One IRI, or a base that says no more than the namespace, binds the namespace itself.
    """
    ends = groups.groupBy("namespace").agg(
        F.min("iri").alias("lo"), F.max("iri").alias("hi")
    )
    base = _common_prefix(F.col("lo"), F.col("hi"))
    cut = F.regexp_extract(base, r"^(.*[/#])", 1)
    longer = (
        (F.col("lo") != F.col("hi"))
        & (F.length(base) > F.length("namespace"))
        & (F.length(cut) >= F.length("namespace"))
    )
    return ends.select("namespace", F.when(longer, cut).otherwise(F.col("namespace")).alias("bound"))


def used_prefixes(iris: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``prefix, namespace`` bindings for the IRIs; a prefix is bound once, longest first.

    IRIs of a namespace without a fitting prefix fall to the next shorter namespace, which may
    change that one's choice; the assignment repeats until nothing falls any more. Each round
    rules out at least one namespace of the catalogue.
    """
    hits = checkpoint(matching_namespaces(iris.select("iri").distinct(), catalogue))
    while True:
        best = hits.groupBy("iri").agg(
            F.max_by("namespace", F.length("namespace")).alias("namespace")
        )
        chosen = prefix_choice(best, catalogue)
        failed = best.select("namespace").distinct().join(chosen, "namespace", "left_anti")
        if failed.isEmpty():
            break
        hits = checkpoint(hits.join(failed, "namespace", "left_anti"))
    bound = chosen.join(common_namespace(best), "namespace")
    order = F.struct(F.length("namespace"), F.col("namespace"))
    return bound.groupBy("prefix").agg(F.max_by("bound", order).alias("namespace"))


def merge_prefixes(parts: list[DataFrame]) -> DataFrame:
    """Bindings of several graphs; the earlier graph's binding of a prefix wins."""
    tagged = [p.select("prefix", "namespace", F.lit(i).alias("_i")) for i, p in enumerate(parts)]
    merged = reduce(DataFrame.unionByName, tagged)
    return merged.groupBy("prefix").agg(
        F.min_by("namespace", F.struct("_i", "namespace")).alias("namespace")
    )


def distinct_namespaces(quads: DataFrame) -> DataFrame:
    """Distinct namespaces of all IRIs in subject, predicate and object position."""
    from tablegraph.functions.text import namespace_of

    nodes = F.array(
        F.when(F.col("s_kind") == "iri", F.col("s")), F.col("p"),
        F.when(F.col("o_kind") == "iri", F.col("o")),
    )
    spaces = F.array_distinct(F.transform(nodes, namespace_of))
    out = quads.select(F.explode(spaces).alias("namespace"))
    return out.filter(F.col("namespace").isNotNull()).distinct()
