"""The terms of which programs consist."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from hornfels.types import ANY, Typed


@dataclass(frozen=True)
class Var:
    """A variable of a rule; typed ones bind values of their type only."""

    name: str
    type: str = ANY


LAYOUTS = ("set", "cached", "bistore", "hexastore")
"""Storages of a relation (see :mod:`hornfels.sources.layout`)."""


@dataclass(frozen=True)
class Declaration:
    name: str
    columns: dict[str, str]
    derived: bool
    storage: str = "set"

    def __hash__(self):
        return hash(self.name)


Bindings = list[tuple[str, Any]]
"""Pairs of a column and a variable or a literal."""


@dataclass
class Atom:
    relation: str
    bindings: Bindings
    cid: Any = None


@dataclass
class Negation:
    relation: str
    bindings: Bindings


@dataclass
class Condition:
    variables: list[Var]
    test: Callable


@dataclass
class Aggregation:
    target: Var
    relation: str
    bindings: Bindings
    function: Any
    """An :class:`hornfels.functions.aggregates.Bound`."""


@dataclass
class Rule:
    head: str
    columns: Bindings
    atoms: list[Atom] = field(default_factory=list)
    conditions: list[Condition] = field(default_factory=list)
    negations: list[Negation] = field(default_factory=list)
    aggregations: list[Aggregation] = field(default_factory=list)

    def relations(self) -> list[tuple[str, bool]]:
        """Relations of the body, and whether each is used positively."""
        return [(a.relation, True) for a in self.atoms] + [(t.relation, False) for t in (*self.negations, *self.aggregations)]


@dataclass
class Fact:
    head: str
    values: dict[str, Typed]
