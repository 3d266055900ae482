"""Chat formatting in budgeted windows of whole turns.

Turns carry a cost in tokens (words of the text and ``OVERHEAD`` for the template). Prefix sums over a
conversation's turns choose the windows: the turns that lie within one stretch of ``budget`` tokens
are a window's new turns, and a turn that crosses a stretch's edge is a window of its own. A window
repeats the conversation's system turn and the last turns before it that cost ``history`` tokens at
most; repeated turns are context only, so each assistant text is a loss target exactly once.

Template: ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts get a backslash
after their first character, backslashes are doubled; removing one backslash before each character
after it gives the text back.

A conversation is cut into blocks of ``BLOCK`` turns by their running place, found by a range partitioning
of conversation and turn, so turn numbers may be sparse, null or equal without any effect. Only the token
sums of its blocks meet in one place, and a block's array of turns is bounded, so a conversation with a
third of all turns is spread like any other. A block always holds more tokens than the history, which
therefore ends in the block before at the latest. DataFrame expressions only.

Null texts and roles count as empty. Null conversation ids form one conversation, null turns come
first; turns of equal number come in order of role and text, repeated rows stay. Only the columns
named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegraph.llm.frame import BLANKS, GAP, let, quoted, tuned
from tablegraph.operators.positions import split_positions

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
OVERHEAD = 4
BLOCK = 256


def escaped(text: Column) -> Column:
    """No control string is left: ``<|``, ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` are cut."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"(<(?=\||/?s>)|\[(?=/?INST\]))", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def cost(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return (F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, GAP))) + OVERHEAD).cast(
        "long")


def written_turn(t: Column) -> Column:
    return F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT), escaped(t["text"]), F.lit(END))


def windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text", budget: int = 512,
            history: int = 128) -> DataFrame:
    """One row for each window: ``conv_id, block, window, text, loss, repeated``.

    ``loss`` lists the spans of ``text`` (start and length in characters) that are targets, and
    ``repeated`` counts the turns at the start that are context from earlier. Windows are in order of
    block and window.
    """
    tuned(turns.sparkSession)
    said = F.coalesce(quoted(text_col), F.lit(""))
    given = turns.select(
        quoted(conv_col).alias("conv_id"), quoted(turn_col).cast("long").alias("turn"),
        F.coalesce(quoted(role_col), F.lit("")).alias("role"), said.alias("text"), cost(said).alias("cost"))
    given = split_positions(given, ["conv_id"], ["turn", "role", "text"], "place").select(
        "conv_id", F.floor((F.col("place") - 1) / BLOCK).alias("block"),
        F.struct("place", "turn", "role", "text", "cost").alias("t"))
    blocks = given.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list("t")).alias("turns"), F.sum("t.cost").alias("tokens"),
    ).withColumn("turns", _with_prefix_sums(F.col("turns")))
    # Narrow rows, one for each block: what came before, the system turn, the last turns of the block.
    tail = F.filter("turns", lambda t: t["to"] > F.col("tokens") - history)
    edges = blocks.select(
        "conv_id", "block", "tokens", tail.alias("tail"),
        F.get(F.filter("turns", lambda t: t["role"] == "system"), F.lit(0)).alias("system"),
    )
    order = Window.partitionBy("conv_id").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"),
        F.coalesce(F.lag("tail").over(order), F.array().cast(blocks.schema["turns"].dataType)).alias("tail"),
        F.lag("tokens").over(order).alias("last"),
        F.first("system", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(
            "system"),
    )
    whole = blocks.join(edges, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    # Earlier turns get places below zero, so one filter finds a window's history on either side.
    shifted = F.transform("tail", lambda t: t.withField("from", t["from"] - F.col("last")).withField(
        "to", t["to"] - F.col("last")))
    whole = whole.withColumn("earlier", shifted).withColumn(
        "marked", F.transform("turns", lambda t: t.withField("window", _window(t, budget))))
    keys = F.array_distinct(F.transform("marked", lambda t: t["window"]))
    opened = whole.select(
        "conv_id", "block", "system", "earlier", "marked", F.posexplode(keys).alias("window", "key"))
    fresh = opened.withColumn(
        "fresh", F.filter("marked", lambda t: t["window"] == F.col("key")))
    first = F.get("fresh", F.lit(0))["from"]
    context = F.concat(
        F.filter("earlier", lambda t: t["from"] >= F.col("first") - history),
        F.transform(
            F.filter("marked", lambda t: (t["to"] <= F.col("first")) & (t["from"] >= F.col("first") - history)),
            lambda t: t.dropFields("window")),
    )
    fresh = fresh.withColumn("first", first).withColumn("context", context)
    # The system turn leads, unless it is among the turns that follow anyway.
    same = lambda t: t["place"] == F.col("system.place")
    lead = F.when(
        F.col("system").isNotNull() & ~F.exists("context", same) & ~F.exists("fresh", same),
        F.array(written_turn(F.col("system"))),
    ).otherwise(F.array().cast("array<string>"))
    fresh = fresh.withColumn("parts", F.concat(
        lead, F.transform("context", written_turn))).withColumn(
        "own", F.transform("fresh", lambda t: F.struct(
            written_turn(t).alias("text"),
            (F.length(F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT)))).alias("skip"),
            F.length(escaped(t["text"])).alias("n"), (t["role"] == "assistant").alias("target"))))
    return fresh.select(
        "conv_id", "block", "window",
        F.concat(F.array_join("parts", ""), F.array_join(F.transform("own", lambda t: t["text"]), "")).alias(
            "text"),
        _loss(F.length(F.array_join("parts", "")), F.col("own")).alias("loss"),
        F.size("parts").alias("repeated"),
    )


def _with_prefix_sums(turns: Column) -> Column:
    """Each turn with the tokens before and through it, in one pass over the block."""
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<place:bigint,turn:bigint,role:string,text:string,from:bigint,to:bigint>>").alias("got"))

    def step(s, t):
        return F.struct(
            (s["at"] + t["cost"]).alias("at"),
            F.concat(s["got"], F.array(F.struct(
                t["place"].alias("place"), t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"),
                s["at"].alias("from"), (s["at"] + t["cost"]).alias("to")))).alias("got"))

    return F.aggregate(turns, start, step, lambda s: s["got"])


def _window(t: Column, budget: int) -> Column:
    """The stretch that a turn lies in, doubled, or the odd number of the edge that it crosses."""
    a = F.floor((t["from"] + F.col("start")) / budget)
    b = F.floor((t["to"] + F.col("start") - 1) / budget)
    return F.when(a == b, 2 * a).otherwise(2 * a + 1)


def _loss(start: Column, own: Column) -> Column:
    """Spans of the targets' texts, by running lengths."""
    first = F.struct(
        start.alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("got"))

    def step(s, t):
        span = F.array(F.struct((s["at"] + t["skip"]).alias("start"), t["n"].alias("length")))
        return F.struct(
            (s["at"] + F.length(t["text"])).alias("at"),
            F.when(t["target"], F.concat(s["got"], span)).otherwise(s["got"]).alias("got"))

    return F.aggregate(own, first, step, lambda s: s["got"])


def parsed(text: Column) -> Column:
    """The turns of a window's text: role and text, unescaped."""
    pieces = F.filter(F.split(text, r"<\|turn\|>"), lambda x: x != "")

    def turn(piece: Column) -> Column:
        return let(F.split(piece, r"<\|text\|>|<\|end\|>"), lambda x: F.struct(
            unescaped(F.get(x, F.lit(0))).alias("role"), unescaped(F.get(x, F.lit(1))).alias("text")))

    return F.transform(pieces, turn)


def targets(text: Column, loss: Column) -> Column:
    """All text under the loss mask, in order."""
    return F.array_join(F.transform(
        loss, lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"]))), "")
