"""Building programs.

    p = Program()
    p.input("edge", {"from": "s32", "to": "s32"})
    p.output("path", {"from": "s32", "to": "s32"})
    p.rule("path", ["s32", "s32"], lambda h, b, x, y: (h.bind({"from": x, "to": y}), b.search("edge", {"from": x, "to": y})))
    p.rule("path", ["s32"] * 3, lambda h, b, x, y, z: (
        h.bind({"from": x, "to": z}), b.search("edge", {"from": x, "to": y}), b.search("path", {"from": y, "to": z})))

Columns are bound by mappings or lists of pairs.  A rule can also be given as plain data (:meth:`Program.rule_from`).
Every program has the inputs ``evac`` (entity, attribute, value of any type) and ``links`` (from, to: content ids).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from hornfels import errors as E
from hornfels.plans.stratify import Stratum, is_monotone, stratify
from hornfels.plans.terms import LAYOUTS, Aggregation, Atom, Bindings, Condition, Declaration, Fact, Negation, Rule, Var
from hornfels.plans.validate import check_fact, check_rule
from hornfels.types import ANY, check_name


def _pairs(columns: Mapping[str, Any] | list | tuple | None) -> Bindings:
    return list((columns or {}).items()) if isinstance(columns, Mapping) or not columns else [tuple(c) for c in columns]


class Head:
    """Columns of a rule's head."""

    def __init__(self):
        self.columns: Bindings = []

    def bind(self, columns=None, **more) -> Head:
        self.columns += _pairs(columns) + list(more.items())
        return self

    def set(self, column: str, value: Any) -> Head:
        self.columns.append((column, value))
        return self


class Body:
    """Terms of a rule's body; their order does not matter, but for aggregations among themselves."""

    def __init__(self):
        self.atoms: list[Atom] = []
        self.conditions: list[Condition] = []
        self.negations: list[Negation] = []
        self.aggregations: list[Aggregation] = []

    def search(self, relation: str, columns=None, **more) -> Body:
        """Rows of the relation, joined on shared variables."""
        self.atoms.append(Atom(relation, _pairs(columns) + list(more.items())))
        return self

    def search_cid(self, relation: str, cid: Any, columns=None, **more) -> Body:
        """Rows of an input by their content id, a variable of type cid or bytes."""
        self.atoms.append(Atom(relation, _pairs(columns) + list(more.items()), cid))
        return self

    def except_(self, relation: str, columns=None, **more) -> Body:
        """No row of the relation matches."""
        self.negations.append(Negation(relation, _pairs(columns) + list(more.items())))
        return self

    def when(self, variables: list[Var] | tuple[Var, ...] | Var, test: Callable) -> Body:
        """``test`` gets the variables' columns and gives a boolean column."""
        self.conditions.append(Condition([variables] if isinstance(variables, Var) else list(variables), test))
        return self

    predicate = when

    def group_by(self, target: Var, relation: str, columns, aggregate) -> Body:
        """``target`` is the aggregate over the rows of the relation that agree on literals and bound variables."""
        self.aggregations.append(Aggregation(target, relation, _pairs(columns), aggregate() if callable(aggregate) else aggregate))
        return self


class Program:
    def __init__(self, preamble: bool = True, facts: str = "set", links: str = "set"):
        """preamble: declare the inputs of facts and links, in the storages given."""
        self.declarations: dict[str, Declaration] = {}
        self.rules: list[Rule] = []
        self.facts: list[Fact] = []
        if preamble:
            self.input("evac", {"entity": ANY, "attribute": ANY, "value": ANY}, storage=facts)
            self.input("links", {"from": "cid", "to": "cid"}, storage=links)

    def _declare(self, name: str, columns, derived: bool, storage: str) -> Program:
        if name in self.declarations:
            raise E.ConflictingRelationDeclaration(name)
        if storage not in LAYOUTS:
            raise ValueError(f"unknown storage {storage!r}")
        own: dict[str, str] = {}
        for column, kind in _pairs(columns):
            if column in own:
                raise E.DuplicateDeclarationCol(name, column)
            own[column] = check_name(kind)
        self.declarations[name] = Declaration(name, own, derived, storage)
        return self

    def input(self, name: str, columns=None, storage: str = "set") -> Program:
        """Declare an input.  ``storage``: one of ``LAYOUTS`` (see :mod:`hornfels.sources.layout`)."""
        return self._declare(name, columns, False, storage)

    def output(self, name: str, columns=None, storage: str = "set") -> Program:
        """Declare a derived relation."""
        return self._declare(name, columns, True, storage)

    def fact(self, name: str, columns=None, **more) -> Program:
        self.facts.append(check_fact(self.declarations, name, _pairs(columns) + list(more.items())))
        return self

    def rule(self, name: str, types: list[str] | tuple[str, ...], build: Callable) -> Program:
        """``build(h, b, *variables)`` gets one variable for each type."""
        head, body = Head(), Body()
        build(head, body, *[Var(f"x{k}", t) for k, t in enumerate(types)])
        return self._add(Rule(name, head.columns, body.atoms, body.conditions, body.negations, body.aggregations))

    def rule_from(self, name: str, head: Mapping[str, Any], body: list[Mapping[str, Any]]) -> Program:
        """A rule as data: terms are ``{"op": "search" | "except" | "group_by" | "when", "rel", "where", "cid", ...}``."""
        b = Body()
        for term in body:
            match term["op"]:
                case "search":
                    b.atoms.append(Atom(term["rel"], _pairs(term.get("where")), term.get("cid")))
                case "except":
                    b.except_(term["rel"], term.get("where"))
                case "group_by":
                    b.group_by(term["target"], term["rel"], term.get("where"), term["agg"])
                case "when":
                    b.when(term["vars"], term["test"])
                case other:
                    raise ValueError(f"unknown term {other!r}")
        return self._add(Rule(name, _pairs(head), b.atoms, b.conditions, b.negations, b.aggregations))

    def _add(self, rule: Rule) -> Program:
        self.rules.append(check_rule(self.declarations, rule))
        return self

    def strata(self) -> list[Stratum]:
        return stratify([d.name for d in self.declarations.values() if d.derived], self.rules, self.facts)

    def is_monotone(self) -> bool:
        return is_monotone(self.rules)


def build(define: Callable[[Program], Any]) -> Program:
    """A program from a function that declares it; it is checked for strata as well."""
    p = Program()
    define(p)
    p.strata()
    return p
