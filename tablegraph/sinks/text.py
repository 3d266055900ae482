"""Graph text out: N-Quads, TriG, Turtle and JSON-LD lines, plus CSV tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegraph.vocab import RDF, RDF_TYPE, XSD

# Statements per text block; a subject with more of them is written as several blocks.
BLOCK = 1000


def escape(c: Column) -> Column:
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
                     ("\x1f", "\\u001F")):
        c = F.replace(c, F.lit(raw), F.lit(out))
    return c


def _node(value: Column, kind: Column) -> Column:
    return F.when(kind == "bnode", value).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def _object(datatype: Column, lang: Column) -> Column:
    quoted = F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'))
    plain = datatype.isNull() | datatype.isin(XSD + "string", RDF + "langString")
    literal = (
        F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang))
        .when(plain, quoted)
        .otherwise(F.concat(quoted, F.lit("^^<"), datatype, F.lit(">")))
    )
    return F.when(F.col("o_kind") == "lit", literal).otherwise(
        _node(F.col("o"), F.col("o_kind"))
    )


def _subject() -> Column:
    return _node(F.col("s"), F.col("s_kind"))


def _predicate() -> Column:
    return F.concat(F.lit("<"), "p", F.lit(">"))


def quad_text() -> Column:
    """The line of one quad, from its columns."""
    graph = F.when(F.col("g").isNotNull(), F.concat(F.lit("<"), "g", F.lit(">")))
    value = _object(F.col("o_datatype"), F.col("o_lang"))
    return F.concat_ws(" ", _subject(), _predicate(), value, graph, F.lit("."))


def nquad_lines(quads: DataFrame) -> DataFrame:
    """One ``value`` line per quad."""
    return quads.select(quad_text().alias("value"))


def _terms(quads: DataFrame) -> DataFrame:
    """Quads with their nodes in text form."""
    return quads.select(
        "g",
        _subject().alias("s"),
        _predicate().alias("p"),
        _object(F.col("o_datatype"), F.col("o_lang")).alias("o"),
    )


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows with a block number per (graph, subject), so no block grows without bound.

    Subjects are counted first (partial sums, one row per subject out of the shuffle); only a
    subject above ``block`` statements is spread over several blocks by a hash of the statement.
    """
    sizes = rows.groupBy("g", "s").agg(F.count(F.lit(1)).alias("_n"))
    big = sizes.filter(F.col("_n") > block).select(
        F.col("g").alias("_g"), F.col("s").alias("_s"), F.ceil(F.col("_n") / block).alias("_k")
    )
    joined = rows.join(big, F.col("g").eqNullSafe(F.col("_g")) & (F.col("s") == F.col("_s")), "left")
    number = F.when(F.col("_k").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64("p", "o"), F.col("_k"))
    )
    return joined.withColumn("block", number.cast("long")).drop("_g", "_s", "_k")


def trig_blocks(quads: DataFrame, block: int = BLOCK) -> DataFrame:
    """``g, s, block, value``: one text block per graph and subject, valid TriG each."""
    rows = _blocks(_terms(quads).distinct(), block)
    body = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("p", "o"))),
            lambda x: F.concat(x["p"], F.lit(" "), x["o"]),
        ),
        " ;\n    ",
    )
    grouped = rows.groupBy("g", "s", "block").agg(body.alias("body"))
    subject = F.concat("s", F.lit(" "), "body", F.lit(" ."))
    text = F.when(F.col("g").isNull(), subject).otherwise(
        F.concat(F.lit("<"), "g", F.lit("> {\n  "), subject, F.lit("\n}"))
    )
    return grouped.select("g", "s", "block", text.alias("value"))


def turtle_blocks(quads: DataFrame, graph: str, block: int = BLOCK) -> DataFrame:
    """As :func:`trig_blocks` for the triples of one graph, without the graph wrapper."""
    only = quads.filter(F.col("g") == graph).withColumn("g", F.lit(None).cast("string"))
    return trig_blocks(only, block)


def jsonld_lines(quads: DataFrame, block: int = BLOCK) -> DataFrame:
    """``value``: one JSON-LD node object per subject (expanded form) and line.

    Values are grouped per predicate first, then per subject; a subject above ``block``
    statements gives several node objects with the same ``@id``, which JSON-LD merges.
    """
    typed = ~F.col("o_datatype").isin(XSD + "string", RDF + "langString")
    value = F.struct(
        F.when(F.col("o_kind") != "lit", F.col("o")).alias("@id"),
        F.when(F.col("o_kind") == "lit", F.col("o")).alias("@value"),
        F.when(typed & F.col("o_lang").isNull(), F.col("o_datatype")).alias("@type"),
        F.col("o_lang").alias("@language"),
    )
    rows = quads.distinct().select("g", "s", "p", "o", F.to_json(value).alias("json"))
    rows = _blocks(rows, block)
    # rdf:type is written as @type with bare IRIs.
    is_type = F.col("p") == RDF_TYPE
    key = F.when(is_type, F.lit("@type")).otherwise(F.col("p"))
    item = F.when(is_type, F.to_json(F.array("o"))).otherwise(F.col("json"))
    item = F.when(is_type, F.regexp_replace(item, r"^\[|\]$", "")).otherwise(item)
    per_key = (
        rows.groupBy("g", "s", "block", key.alias("key"))
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .withColumn(
            "member",
            F.concat(
                F.regexp_replace(F.to_json(F.array("key")), r"^\[|\]$", ""),
                F.lit(":["),
                F.array_join("items", ","),
                F.lit("]"),
            ),
        )
    )
    nodes = per_key.groupBy("g", "s", "block").agg(
        F.array_join(F.sort_array(F.collect_list("member")), ",").alias("members")
    )

    def quoted(c: str) -> Column:
        return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")

    node = F.concat(F.lit('{"@id":'), quoted("s"), F.lit(","), "members", F.lit("}"))
    text = F.when(F.col("g").isNull(), node).otherwise(
        F.concat(F.lit('{"@id":'), quoted("g"), F.lit(',"@graph":['), node, F.lit("]}"))
    )
    return nodes.select(text.alias("value"))


def prefix_header(bindings: DataFrame) -> DataFrame:
    """``@prefix p: <ns> .`` lines, ``value``, from a small ``prefix, namespace`` frame."""
    return bindings.select(
        F.format_string("@prefix %s: <%s> .", "prefix", "namespace").alias("value")
    )


def with_prefix_header(bindings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Header lines in front of the blocks, in the first partition of the written text."""
    return prefix_header(bindings).coalesce(1).union(blocks.select("value"))


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.select("value").write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
