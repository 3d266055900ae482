"""Schema templates: resolved on the driver to a flat list of statements per row."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from tablegraph.config import GraphSpec

log = logging.getLogger(__name__)

# How a template property gets its object.
LITERAL, IRI, FIXED, NESTED = (
    "Column Value (Literal)", "Column Value (URI)", "Fixed URI", "Nested Template",
)


@dataclass(frozen=True)
class Link:
    """A statement that needs no cell: a fixed IRI or a nested node (``child`` path)."""

    path: str
    predicate: str
    iri: str | None = None
    child: str | None = None


@dataclass(frozen=True)
class Cell:
    """A statement whose object is a cell of the row."""

    path: str
    predicate: str
    column: str
    as_iri: bool


@dataclass
class TemplatePlan:
    links: list[Link] = field(default_factory=list)
    cells: list[Cell] = field(default_factory=list)
    predicates: list[str] = field(default_factory=list)


def _usable(iri: str | None) -> bool:
    """Any text with a scheme, a path or a colon."""
    return bool(iri) and (":" in iri or not iri.startswith(("?", "#")))


def plan_template(spec: GraphSpec, columns: list[str]) -> TemplatePlan | None:
    """Flatten the active template; None when there is no template of that name.

    Nodes are named by their path, so a template used twice under one row gives two nodes. An
    unknown template, column or map type and an unusable IRI are skipped with a warning; a
    template that contains itself is an error.
    """
    by_name = {}
    for t in spec.templates:
        if t.get("template_name") in by_name:
            raise ValueError(f"template name '{t['template_name']}' is used twice")
        by_name[t.get("template_name")] = t
    if spec.active_template not in by_name:
        log.warning("template '%s' not found", spec.active_template)
        return None
    plan = TemplatePlan()
    _expand(spec.active_template, "", (), by_name, columns, plan)
    return plan


def _expand(name, path, above, by_name, columns, plan) -> None:
    from tablegraph.vocab import RDF_TYPE

    if name in above:
        raise ValueError(f"template '{name}' contains itself")
    template = by_name[name]
    if _usable(template.get("rdf_type")):
        plan.links.append(Link(path, RDF_TYPE, iri=template["rdf_type"]))
    for i, prop in enumerate(template.get("properties", [])):
        predicate, kind, value = (prop.get(k) for k in ("predicate", "map_type", "value"))
        if not _usable(predicate):
            log.warning("template '%s': predicate '%s' skipped", name, predicate)
            continue
        plan.predicates.append(predicate)
        if kind in (LITERAL, IRI) and value in columns:
            plan.cells.append(Cell(path, predicate, value, kind == IRI))
        elif kind == FIXED and _usable(value):
            plan.links.append(Link(path, predicate, iri=value))
        elif kind == NESTED and value in by_name:
            child = f"{path}/{name}.{i}"
            plan.links.append(Link(path, predicate, child=child))
            _expand(value, child, (*above, name), by_name, columns, plan)
        else:
            log.warning("template '%s': %s '%s' for %s skipped", name, kind, value, predicate)
