"""Programs that must not build, and the error that each gives."""

import pytest

from hornfels import errors as E
from hornfels.functions.aggregates import count, min_, sum_
from hornfels.plans.builder import Program, build
from hornfels.plans.terms import Var
from hornfels.types import Typed


def program():
    return Program().input("in", {"a": "s32", "b": "string"}).output("p", {"x": "s32"}).output("q", {"x": "s32"}).output("any_p", {"x": "any"})


def raises(error, args, define):
    with pytest.raises(error) as caught:
        define(program())
    assert caught.value.args[: len(args)] == args


@pytest.mark.parametrize(
    ("error", "args", "define"),
    [
        (E.ConflictingRelationDeclaration, ("p",), lambda p: p.output("p", {"x": "s32"})),
        (E.ConflictingRelationDeclaration, ("in",), lambda p: p.input("in", {})),
        (E.DuplicateDeclarationCol, ("r", "x"), lambda p: p.output("r", [("x", "s32"), ("x", "s32")])),
        (E.UnrecognizedRelation, ("none",), lambda p: p.fact("none", {})),
        (E.UnrecognizedRelation, ("none",), lambda p: p.rule("none", [], lambda h, b: None)),
        (E.UnrecognizedRelation, ("none",), lambda p: p.rule("p", ["s32"], lambda h, b, x: b.search("none", {"x": x}))),
        (E.UnrecognizedRelation, ("none",), lambda p: p.rule("p", ["s32"], lambda h, b, x: b.except_("none", {}))),
        (E.UnrecognizedRelation, ("none",), lambda p: p.rule("p", ["s32"], lambda h, b, x: b.group_by(x, "none", {}, count))),
        (E.UnrecognizedColumnBinding, ("p", "y"), lambda p: p.fact("p", {"y": 1})),
        (E.UnrecognizedColumnBinding, ("in", "y"), lambda p: p.rule("p", ["s32"], lambda h, b, x: b.search("in", {"y": x}))),
        (E.UnrecognizedColumnBinding, ("in", "y"), lambda p: p.rule("p", ["s32"], lambda h, b, x: b.search("in", {"a": x}).except_("in", {"y": x}))),
        (E.UnrecognizedColumnBinding, ("in", "y"), lambda p: p.rule("p", ["s32", "s32"], lambda h, b, x, y: b.group_by(x, "in", {"y": y}, sum_(y)))),
        (E.UnrecognizedColumnBinding, ("p", "y"), lambda p: p.rule("p", ["s32"], lambda h, b, x: (h.bind({"y": x}), b.search("in", {"a": x})))),
        (E.ConflictingColumnBinding, ("p", "x"), lambda p: p.fact("p", [("x", 1), ("x", 2)])),
        (E.ConflictingColumnBinding, ("in", "a"), lambda p: p.rule("p", ["s32"], lambda h, b, x: b.search("in", [("a", x), ("a", 1)]))),
        (E.ConflictingColumnBinding, ("in", "a"), lambda p: p.rule("p", ["s32"], lambda h, b, x: b.search("in", {"a": x}).except_("in", [("a", x), ("a", x)]))),
        (E.ConflictingColumnBinding, ("p", "x"), lambda p: p.rule("p", ["s32"], lambda h, b, x: (h.bind([("x", x), ("x", x)]), b.search("in", {"a": x})))),
        (E.ColumnMissing, ("p", "x"), lambda p: p.fact("p", {})),
        (E.ColumnMissing, ("p", "x"), lambda p: p.rule("p", ["s32"], lambda h, b, x: b.search("in", {"a": x}))),
        (E.ClauseHeadEDB, ("in",), lambda p: p.fact("in", {"a": 1, "b": "x"})),
        (E.ClauseHeadEDB, ("in",), lambda p: p.rule("in", ["s32"], lambda h, b, x: (h.bind({"a": x}).set("b", "x"), b.search("p", {"x": x})))),
        (E.ColumnMissing, ("in", "b"), lambda p: p.fact("in", {"a": 1})),
        (E.NonGroundFact, ("p", "x", "v"), lambda p: p.fact("p", {"x": Var("v", "s32")})),
        (E.ColumnValueTypeConflict, ("p", "x"), lambda p: p.fact("p", {"x": "text"})),
        (E.ColumnValueTypeConflict, ("p", "x"), lambda p: p.fact("p", {"x": 2**31})),
        (E.ColumnValueTypeConflict, ("p", "x"), lambda p: p.fact("p", {"x": True})),
        (E.ColumnValueTypeConflict, ("p", "x"), lambda p: p.fact("p", {"x": Typed("u8", 1)})),
        (E.ColumnValueTypeConflict, ("in", "a"), lambda p: p.rule("p", ["s64"], lambda h, b, x: b.search("in", {"a": x}))),
        (E.ColumnValueTypeConflict, ("in", "a"), lambda p: p.rule("p", ["s32"], lambda h, b, x: b.search("in", {"a": "text"}))),
        (E.ColumnValueTypeConflict, ("in", "b"), lambda p: p.rule("p", ["s32"], lambda h, b, x: b.search("in", {"a": x}).except_("in", {"b": 1}))),
        (E.ColumnValueTypeConflict, ("p", "x"), lambda p: p.rule("p", ["string"], lambda h, b, x: (h.bind({"x": x}), b.search("in", {"b": x})))),
        (E.ColumnValueTypeConflict, ("p", "x"), lambda p: p.rule("p", ["s32"], lambda h, b, x: (h.set("x", "text"), b.search("in", {"a": x})))),
        (E.ClauseNotRangeRestricted, ("x", "x0"), lambda p: p.rule("p", ["s32"], lambda h, b, x: h.bind({"x": x}))),
        (E.ClauseNotRangeRestricted, ("x", "x0"), lambda p: p.rule("p", ["s32", "s64"], lambda h, b, x, n: (h.bind({"x": x}), b.group_by(n, "in", {"a": x}, count)))),
        (E.ClauseNotDomainIndependent, ("x0",), lambda p: p.rule("p", ["s32"], lambda h, b, x: (h.set("x", 1), b.except_("q", {"x": x})))),
        (E.ClauseNotDomainIndependent, ("x0",), lambda p: p.rule("p", ["s32"], lambda h, b, x: (h.set("x", 1), b.when([x], lambda x: x > 1)))),
        (E.ClauseNotDomainIndependent, ("x0",), lambda p: p.rule("p", ["s32"], lambda h, b, n: (h.bind({"x": n}), b.when([n], lambda n: n > 1).group_by(n, "in", {}, count)))),
        (E.AggregationBoundTarget, ("x0",), lambda p: p.rule("p", ["s32"], lambda h, b, x: (h.bind({"x": x}), b.search("in", {"a": x}).group_by(x, "in", {}, count)))),
        (E.AggregationUnboundArgument, ("in", "x1"), lambda p: p.rule("p", ["s32", "s32"], lambda h, b, x, y: (h.bind({"x": x}), b.group_by(x, "in", {}, min_(y))))),
        (E.ContentAddressedIDB, ("q",), lambda p: p.rule("p", ["s32", "cid"], lambda h, b, x, i: (h.bind({"x": x}), b.search_cid("q", i, {"x": x})))),
        (E.TypeMismatch, ("s33", "any"), lambda p: p.output("r", {"x": "s33"})),
    ],
)
def test_errors(error, args, define):
    raises(error, args, define)


def test_body_errors_come_before_head_errors():
    raises(E.UnrecognizedRelation, ("none",), lambda p: p.rule("p", ["s32"], lambda h, b, x: (h.bind({"zzz": x}), b.search("none", {}))))
    raises(E.ClauseNotDomainIndependent, ("x0",), lambda p: p.rule("p", ["s32"], lambda h, b, x: (h.bind({"x": x}), b.except_("none", {}).when([x], lambda x: x))))


@pytest.mark.parametrize("kind", ["negation", "aggregation"])
def test_unstratifiable(kind):
    def define(p):
        p.output("t", {"x": "s32"}).output("p", {"x": "s32"}).output("q", {"x": "s32"})
        for head, other in (("p", "q"), ("q", "p")):
            if kind == "negation":
                p.rule(head, ["s32"], lambda h, b, x, other=other: (h.bind({"x": x}), b.search("t", {"x": x}).except_(other, {"x": x})))
            else:
                p.rule(head, ["s32"], lambda h, b, x, other=other: (h.bind({"x": x}), b.group_by(x, other, {}, count)))

    with pytest.raises(E.ProgramUnstratifiable):
        build(define)


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("bool", True, 1), ("s8", -128, 128), ("u8", 255, -1), ("s16", 2**15 - 1, 2**15), ("u16", 2**16 - 1, 2**16), ("s32", -(2**31), 2**31), ("u32", 2**32 - 1, 2**32),
        ("s64", 2**63 - 1, 2**63), ("u64", 2**64 - 1, 2**64), ("f32", 1.5, 1), ("f64", 1.5, "1"), ("char", "é", "ab"), ("string", "text", 1), ("cid", b"id", "id"),
    ],
)
def test_literals_of_each_type(kind, good, bad):
    p = Program().output("r", {"x": kind}).fact("r", {"x": good})
    assert p.facts[0].values["x"] == Typed(kind, good)
    with pytest.raises(E.ColumnValueTypeConflict):
        p.fact("r", {"x": bad})


def test_strata_and_monotony():
    p = program()
    p.rule("q", ["s32"], lambda h, b, x: (h.bind({"x": x}), b.search("in", {"a": x})))
    assert p.is_monotone() and [s.relations for s in p.strata()].index(["q"]) >= 0
    p.rule("p", ["s32"], lambda h, b, x: (h.bind({"x": x}), b.search("in", {"a": x}).except_("q", {"x": x})))
    order = [s.relations[0] for s in p.strata()]
    assert not p.is_monotone() and order.index("q") < order.index("p")
