"""Whole jobs and the registered queries."""

from __future__ import annotations


def load_queries():
    """The query functions and their SQL, by name."""
    from importlib import import_module

    from tablegraph.plans import registry

    for module in ("term_queries", "link_queries", "graph_queries", "view_queries"):
        import_module(f"tablegraph.plans.{module}")
    return registry.QUERIES, registry.SQL
