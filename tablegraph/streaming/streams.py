"""The row-wise operators on streams: stateless, append mode, no watermark needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablegraph.config import GraphSpec, Settings
from tablegraph.functions.text import hyperlink_cell
from tablegraph.operators import quads, responses
from tablegraph.sinks.text import nquad_lines

RESPONSE_SHAPES = {
    "portal": responses.portal_suggestions,
    "ols": responses.ols_suggestions,
    "named_ols": responses.named_ols_suggestions,
    "entity_search": responses.entity_search_suggestions,
    "places": responses.place_suggestions,
    "summary": responses.summary_suggestions,
    "bindings": responses.binding_suggestions,
}


def stream_quads(
    rows: DataFrame,
    mapping: DataFrame,
    spec: GraphSpec,
    settings: Settings = Settings(),
    concepts: DataFrame | None = None,
) -> DataFrame:
    """Quads of streamed rows; the mapping is a static side of stream-static joins.

    Set semantics would need state for every quad ever seen, so repeated rows repeat their
    quads; readers apply :func:`tablegraph.operators.quads.distinct_quads`. Class and predicate
    declarations do not depend on rows and come from :func:`declarations`.
    """
    return quads.rows_to_quads(
        rows, mapping, spec, settings, concepts, dedupe=False, declarations=False
    )


def declarations(
    rows: DataFrame,
    mapping: DataFrame,
    spec: GraphSpec,
    settings: Settings = Settings(),
    concepts: DataFrame | None = None,
) -> DataFrame:
    """The static part of a streamed graph, written once."""
    empty = rows.sparkSession.createDataFrame([], rows.schema)
    return quads.rows_to_quads(empty, mapping, spec, settings, concepts)


def stream_suggestions(bodies: DataFrame, shape: str) -> DataFrame:
    """Suggestions from a stream of saved response bodies of one shape."""
    return RESPONSE_SHAPES[shape](bodies)


def stream_links(rows: DataFrame, iri: str, label: str) -> DataFrame:
    return rows.withColumn("cell", hyperlink_cell(F.col(iri), F.col(label)))


def write_quad_stream(quads_stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append N-Quads lines; the file sink commits each batch exactly once."""
    lines = nquad_lines(quads_stream)
    return (
        lines.writeStream.format("text").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
