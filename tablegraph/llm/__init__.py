"""Operators of a training-data pipeline: text quality, duplicates, mixing, tokens, chat, media, pages.

Each module holds one operator with its general interface; ``queries`` applies every operator to its
whole table and ``load_queries`` hands those queries and their SQL to the entry module. Nothing
outside this folder (and ``corpus_pipeline.py``) imports it.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the Python workers by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load_queries():
    """The ``opN_`` queries and ``pipeline`` by name, and the SQL of those that SQL can express."""
    from tablegraph.llm import queries

    return dict(queries.QUERIES), dict(queries.SQL)
