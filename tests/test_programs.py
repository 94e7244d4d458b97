"""End-to-end programs: facts in, sets of rows out."""


import pytest
from pyspark.sql import functions as F

from hornfels.functions.aggregates import aggregate, count, max_, mean, min_, python_aggregate, stepwise, sum_
from hornfels.functions.predicates import predicate, python_predicate
from hornfels.plans.builder import Program
from hornfels.plans.explain import explain
from hornfels.plans.fixpoint import evaluate
from hornfels.sources import facts
from hornfels.sources.bind import bind, rows
from hornfels.sources.facts import InputTuple
from hornfels.types import from_any


def derive(spark, p, name, tuples=()):
    inputs = facts.inputs(facts.from_tuples(spark, tuples)) if tuples else {}
    kinds = p.declarations[name].columns
    out = evaluate(spark, p, inputs)[name].collect()
    return sorted(tuple(from_any(r[c]) if k == "any" else bytes(r[c]) if k == "cid" else r[c] for c, k in kinds.items()) for r in out)


EDGE = {"from": "s32", "to": "s32"}
CHAIN = [(i, j) for i in range(5) for j in range(i + 1, 5)]


def closure(p):
    p.output("path", EDGE)
    p.rule("path", ["s32"] * 2, lambda h, b, x, y: (h.bind({"from": x, "to": y}), b.search("edge", {"from": x, "to": y})))
    return p.rule("path", ["s32"] * 3, lambda h, b, x, y, z: (h.bind({"from": x, "to": z}), b.search("edge", {"from": x, "to": y}).search("path", {"from": y, "to": z})))


def test_closure_of_facts(spark):
    p = Program().output("edge", EDGE)
    for k in range(4):
        p.fact("edge", {"from": k, "to": k + 1})
    assert derive(spark, closure(p), "path") == CHAIN


def test_closure_of_inputs(spark):
    p = Program().output("edge", EDGE)
    p.rule("edge", ["s32"] * 2, lambda h, b, x, y: (h.bind({"from": x, "to": y}), b.search("evac", {"entity": x, "attribute": "to", "value": y})))
    assert derive(spark, closure(p), "path", [InputTuple(k, "to", k + 1) for k in range(4)]) == CHAIN


VALUES = [InputTuple(*t) for t in [(0, "value", 0), (0, "value", 1), (1, "value", 2), (2, "value", 2)]]


def test_negation_of_inputs(spark):
    more = [InputTuple(3, "value", 23), InputTuple(1, "ignored", True), InputTuple(2, "ignored", False), InputTuple(3, "ignored", True, (VALUES[0].cid,))]
    p = Program().output("result", {"entity": "s32", "value": "s32"})
    p.rule("result", ["s32"] * 2, lambda h, b, e, v: (h.bind({"entity": e, "value": v}), b.search("evac", {"entity": e, "attribute": "value", "value": v}).except_("evac", {"entity": e, "attribute": "ignored", "value": True})))
    assert derive(spark, p, "result", VALUES + more) == [(0, 0), (0, 1), (2, 2)]


def test_negation_of_derived(spark):
    p = Program().output("ignored", {"entity": "s32"}).output("result", {"entity": "s32", "value": "s32"}).fact("ignored", {"entity": 1})
    p.rule("result", ["s32"] * 2, lambda h, b, e, v: (h.bind({"entity": e, "value": v}), b.search("evac", {"entity": e, "attribute": "value", "value": v}).except_("ignored", {"entity": e})))
    assert derive(spark, p, "result", VALUES) == [(0, 0), (0, 1), (2, 2)]


def test_parents_and_roots_by_links(spark):
    t, c = {}, {}
    for name, parent, value in (("00", None, 0), ("01", "00", 0), ("02", "01", 0), ("03", "02", 0), ("04", "02", 1), ("10", "00", 0), ("11", "10", 0), ("12", "11", 0)):
        t[name] = InputTuple(int(name[0]), "node", value, (c[parent],) if parent else ())
        c[name] = t[name].cid
    p = Program().output("parent", {"tree": "s32", "parent": "cid", "child": "cid"}).output("root", {"tree": "s32", "id": "cid"})
    p.rule(
        "parent",
        ["s32", "cid", "cid"],
        lambda h, b, n, q, i: (h.bind({"tree": n, "parent": q, "child": i}), b.search_cid("evac", i, {"entity": n, "attribute": "node"}).search("links", {"from": i, "to": q}).search_cid("evac", q, {"entity": n, "attribute": "node"})),
    )
    p.rule("root", ["s32", "cid"], lambda h, b, n, i: (h.bind({"tree": n, "id": i}), b.search_cid("evac", i, {"entity": n, "attribute": "node"}).except_("parent", {"tree": n, "child": i})))
    assert derive(spark, p, "root", list(t.values())) == sorted([(0, c["00"]), (1, c["10"])])
    pairs = [(0, "00", "01"), (0, "01", "02"), (0, "02", "03"), (0, "02", "04"), (1, "10", "11"), (1, "11", "12")]
    assert derive(spark, p, "parent", list(t.values())) == sorted((n, c[a], c[b]) for n, a, b in pairs)


def test_two_hops_over_links(spark):
    t = []
    for k, up in enumerate([None, 0, 1, 1, 2, 3, 4]):
        t.append(InputTuple(k, "node", k, (t[up].cid,) if up is not None else ()))
    p = Program().output("hop", {"from": "cid", "to": "cid"})
    p.rule("hop", ["cid"] * 3, lambda h, b, x, y, z: (h.bind({"from": x, "to": z}), b.search("links", {"from": x, "to": y}).search("links", {"from": y, "to": z})))
    assert derive(spark, p, "hop", t) == sorted((t[a].cid, t[b].cid) for a, b in [(2, 0), (3, 0), (4, 1), (5, 1), (6, 2)])


TRIANGLES = sorted((a, b, c) for a in range(1, 6) for b in range(1, 6) for c in range(1, 6) if a + b < c)
NUMBERS = [InputTuple(0, "n", k) for k in range(1, 6)]


@predicate
def longer(a, b, c):
    return a + b < c


@pytest.mark.parametrize("test", [longer, lambda a, b, c: a + b < c, "python"])
def test_conditions(spark, test):
    test = python_predicate(lambda a, b, c: a + b < c) if test == "python" else test
    p = Program().output("triangle", {"a": "s32", "b": "s32", "c": "s32"})
    side = {"entity": 0, "attribute": "n"}
    p.rule("triangle", ["s32"] * 3, lambda h, b, x, y, z: (h.bind({"a": x, "b": y, "c": z}), b.search("evac", side | {"value": x}).search("evac", side | {"value": y}).search("evac", side | {"value": z}).when([x, y, z], test)))
    assert derive(spark, p, "triangle", NUMBERS) == TRIANGLES and len(TRIANGLES) == 10


@pytest.mark.parametrize(("spec", "expected"), [(count, 5), (sum_, 15), (min_, 1), (max_, 5), (mean, 3)])
def test_aggregates(spark, spec, expected):
    p = Program().output("num", {"n": "s32"}).output("out", {"n": "s32"})
    p.rule("num", ["s32"], lambda h, b, n: (h.bind({"n": n}), b.search("evac", {"value": n})))
    p.rule("out", ["s32", "s32"], lambda h, b, m, n: (h.bind({"n": m}), b.group_by(m, "num", {"n": n}, spec() if spec is count else spec(n))))
    assert derive(spark, p, "out", NUMBERS) == [(expected,)]


def numbers(p, values=range(1, 6), kind="s32"):
    p.output("num", {"n": kind})
    for k in values:
        p.fact("num", {"n": k})
    return p


@aggregate
def products(x, y):
    return F.sum(x * y)


class Products:
    def __init__(self):
        self.total = 0

    def step(self, x, y):
        self.total += int(x) * int(y)

    def finish(self):
        return self.total


FOLDED = stepwise(lambda: F.lit(0), lambda s, r: s + r["c0"] * r["c1"])


@pytest.mark.parametrize("function", [products, FOLDED, python_aggregate(Products)])
def test_aggregate_of_two_arguments(spark, function):
    p = numbers(Program()).output("pair", {"x": "s32", "y": "s32"}).output("out", {"z": "s32"})
    p.rule("pair", ["s32"] * 2, lambda h, b, x, y: (h.bind({"x": x, "y": y}), b.search("num", {"n": x}).search("num", {"n": y})))
    p.rule("out", ["s32"] * 3, lambda h, b, z, x, y: (h.bind({"z": z}), b.group_by(z, "pair", {"x": x, "y": y}, function(x, y))))
    assert derive(spark, p, "out") == [(225,)]


def test_aggregate_by_key(spark):
    p = numbers(Program()).output("out", {"x": "s32", "y": "s32", "z": "s32"}).output("pair", {"x": "s32", "y": "s32"})
    p.rule("pair", ["s32"] * 2, lambda h, b, x, y: (h.bind({"x": x, "y": y}), b.search("num", {"n": x}).search("num", {"n": y})))
    p.rule("out", ["s32"] * 3, lambda h, b, x, y, z: (h.bind({"x": x, "y": y, "z": z}), b.search("pair", {"x": x, "y": y}).group_by(z, "pair", {"x": x, "y": y}, products(x, y))))
    assert derive(spark, p, "out") == [(x, y, x * y) for x in range(1, 6) for y in range(1, 6)]


def test_self_join_of_strings(spark):
    columns = {"id": "string", "x": "string", "y": "string"}
    p = Program().output("pair1", columns).output("pair2", columns)
    for i, x, y in ("a12", "b34", "a56"):
        p.fact("pair1", {"id": i, "x": x, "y": y})
    p.rule("pair2", ["string"] * 3, lambda h, b, i, x, y: (h.bind({"id": i, "x": x, "y": y}), b.search("pair1", {"id": i, "x": x}).search("pair1", {"id": i, "y": y})))
    assert ["".join(r) for r in derive(spark, p, "pair2")] == ["a12", "a16", "a52", "a56", "b34"]


def test_least_of_any_type(spark):
    p = Program().output("p", {"x": "any"}).output("least", {"x": "any"})
    for v in (5, 12, -7, "text", True):
        p.fact("p", {"x": v})
    p.rule("least", ["any"], lambda h, b, x: (h.bind({"x": x}), b.group_by(x, "p", {"x": x}, min_(x))))
    assert derive(spark, p, "least") == [(True,)]  # types are ordered before values


def test_typed_variables_filter_values_of_any_type(spark):
    p = Program().output("p", {"x": "any"}).output("ints", {"x": "s32"}).output("back", {"x": "any"})
    for v in (5, "5", 2**40):
        p.fact("p", {"x": v})
    p.rule("ints", ["s32"], lambda h, b, x: (h.bind({"x": x}), b.search("p", {"x": x})))
    p.rule("back", ["any"], lambda h, b, x: (h.bind({"x": x}), b.search("ints", {"x": x}).search("p", {"x": x})))
    assert derive(spark, p, "ints") == [(5,)] and derive(spark, p, "back") == [(5,)]


def test_empty_groups(spark):
    p = numbers(Program()).output("none", {"n": "s32"}).output("zero", {"k": "s32", "n": "s32"}).output("gone", {"k": "s32", "n": "s32"}).output("total", {"n": "s32"})
    p.rule("zero", ["s32"] * 2, lambda h, b, k, n: (h.bind({"k": k, "n": n}), b.search("num", {"n": k}).group_by(n, "none", {"n": k}, count)))
    p.rule("gone", ["s32"] * 2, lambda h, b, k, n: (h.bind({"k": k, "n": n}), b.search("num", {"n": k}).group_by(n, "none", {"n": k}, max_(k))))
    p.rule("total", ["s32"] * 2, lambda h, b, n, k: (h.bind({"n": n}), b.group_by(n, "none", {"n": k}, sum_(k))))
    assert derive(spark, p, "zero") == [(k, 0) for k in range(1, 6)]
    assert derive(spark, p, "gone") == [] and derive(spark, p, "total") == [(0,)]


def test_means_truncate_and_sums_overflow(spark):
    p = numbers(Program(), (-3, -4), "s8").output("out", {"n": "s8"})
    p.rule("out", ["s8"] * 2, lambda h, b, m, n: (h.bind({"n": m}), b.group_by(m, "num", {"n": n}, mean(n))))
    assert derive(spark, p, "out") == [(-3,)]
    p = numbers(Program(), (100, 101), "s8").output("out", {"n": "s8"})
    p.rule("out", ["s8"] * 2, lambda h, b, m, n: (h.bind({"n": m}), b.group_by(m, "num", {"n": n}, sum_(n))))
    with pytest.raises(Exception, match="OVERFLOW|overflow|CAST"):
        derive(spark, p, "out")


def test_conditions_before_an_aggregate_hold(spark):
    p = numbers(Program()).output("out", {"k": "s32", "n": "s32"})
    p.rule("out", ["s32"] * 2, lambda h, b, k, n: (h.bind({"k": k, "n": n}), b.search("num", {"n": k}).when([k], lambda k: k > 3).group_by(n, "num", {"n": k}, count)))
    assert derive(spark, p, "out") == [(4, 1), (5, 1)]


def test_repeated_variable_equates(spark):
    p = Program().output("r", {"a": "s32", "b": "any"}).output("same", {"a": "s32"})
    for a, b in ((1, 1), (1, 2), (2, "2")):
        p.fact("r", {"a": a, "b": b})
    p.rule("same", ["s32"], lambda h, b, x: (h.bind({"a": x}), b.search("r", {"a": x, "b": x})))
    assert derive(spark, p, "same") == [(1,)]


def test_relations_without_columns(spark):
    p = Program().output("yes").output("no").output("a", {"n": "s32"}).output("b", {"n": "s32"})
    p.fact("yes")
    p.rule("a", [], lambda h, b: (h.set("n", 1), b.search("yes").except_("no")))
    p.rule("b", [], lambda h, b: (h.set("n", 1), b.search("no")))
    assert derive(spark, p, "a") == [(1,)] and derive(spark, p, "b") == []


def test_rules_without_a_body_and_as_data(spark):
    p = Program().output("a", {"n": "s32"}).output("b", {"n": "s32"})
    p.rule_from("a", {"n": 7}, [])
    from hornfels.plans.terms import Var

    n = Var("n", "s32")
    p.rule_from("b", {"n": n}, [{"op": "search", "rel": "a", "where": {"n": n}}, {"op": "when", "vars": [n], "test": lambda n: n > 1}])
    assert derive(spark, p, "b") == [(7,)]


def test_ids_of_links_never_match(spark):
    p = Program().output("out", {"from": "cid"})
    p.rule("out", ["cid", "cid"], lambda h, b, x, i: (h.bind({"from": x}), b.search_cid("links", i, {"from": x})))
    a = InputTuple(0, "a", 0)
    assert derive(spark, p, "out", [a, InputTuple(1, "a", 1, (a.cid,))]) == []


def test_rows_that_differ_by_links_count_twice(spark):
    a = InputTuple(0, "a", 0)
    p = Program().output("n", {"n": "s32"})
    p.rule("n", ["s32"], lambda h, b, n: (h.bind({"n": n}), b.group_by(n, "evac", {}, count)))
    assert derive(spark, p, "n", [a, a, InputTuple(0, "a", 0, (a.cid,))]) == [(2,)]


def test_cycles_mutual_and_nonlinear_recursion(spark):
    p = Program().input("edge", EDGE).output("path", EDGE).output("odd", EDGE).output("even", EDGE)
    p.rule("path", ["s32"] * 2, lambda h, b, x, y: (h.bind({"from": x, "to": y}), b.search("edge", {"from": x, "to": y})))
    p.rule("path", ["s32"] * 3, lambda h, b, x, y, z: (h.bind({"from": x, "to": z}), b.search("path", {"from": x, "to": y}).search("path", {"from": y, "to": z})))
    p.rule("odd", ["s32"] * 2, lambda h, b, x, y: (h.bind({"from": x, "to": y}), b.search("edge", {"from": x, "to": y})))
    for head, body in (("even", "odd"), ("odd", "even")):
        p.rule(head, ["s32"] * 3, lambda h, b, x, y, z, body=body: (h.bind({"from": x, "to": z}), b.search("edge", {"from": x, "to": y}).search(body, {"from": y, "to": z})))
    ring = rows(spark, p.declarations["edge"], [{"from": k, "to": (k + 1) % 4} for k in range(4)])
    out = evaluate(spark, p, {"edge": ring})
    everything = {(a, b) for a in range(4) for b in range(4)}
    assert {tuple(r) for r in out["path"].collect()} == everything
    assert {tuple(r) for r in out["odd"].collect()} == {(a, b) for a, b in everything if (b - a) % 2}
    assert {tuple(r) for r in out["even"].collect()} == {(a, b) for a, b in everything if (b - a) % 2 == 0}


def test_complement_of_a_closure(spark):
    p = Program().output("v", {"v": "s32"}).output("edge", EDGE).output("apart", EDGE)
    for k in range(3):
        p.fact("v", {"v": k})
    p.fact("edge", {"from": 0, "to": 1})
    closure(p)
    p.rule("apart", ["s32"] * 2, lambda h, b, x, y: (h.bind({"from": x, "to": y}), b.search("v", {"v": x}).search("v", {"v": y}).except_("path", {"from": x, "to": y})))
    assert derive(spark, p, "apart") == sorted({(a, b) for a in range(3) for b in range(3)} - {(0, 1)})


def test_text_of_a_program():
    p = closure(Program(preamble=False).input("edge", EDGE))
    shown = explain(p)
    assert "stratum 0 (recursive): path" in shown and "path(from: x0, to: x2) :- edge(from: x0, to: x1), path(from: x1, to: x2)." in shown




def test_atoms_are_joined_where_they_share_a_variable(spark):
    """Written without a link between the first two; only groups without any link are crossed."""
    p = Program(preamble=False).input("a", {"x": "s32"}).input("b", {"y": "s32"}).input("c", {"x": "s32", "y": "s32"}).output("r", {"x": "s32", "y": "s32"})
    p.rule("r", ["s32"] * 2, lambda h, b, x, y: (h.bind({"x": x, "y": y}), b.search("a", {"x": x}).search("b", {"y": y}).search("c", {"x": x, "y": y})))
    bound = {"a": rows(spark, p.declarations["a"], [{"x": k} for k in range(3)]), "b": rows(spark, p.declarations["b"], [{"y": k} for k in range(3)])}
    bound["c"] = rows(spark, p.declarations["c"], [{"x": 1, "y": 2}, {"x": 2, "y": 9}, {"x": 0, "y": 0}])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = evaluate(spark, p, bound)["r"]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert sorted(tuple(r) for r in out.collect()) == [(0, 0), (1, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    from hornfels.plans.compile_rule import join_order

    assert join_order([{"x"}, {"y"}, {"x", "y"}, {"z"}, {"y", "z"}]) == [0, 2, 1, 4, 3] and join_order([{"x"}, {"y"}]) == [0, 1]


@pytest.mark.parametrize("storage", ["set", "cached", "bistore", "hexastore"])
def test_storage_does_not_change_results(spark, storage):
    p = Program(facts=storage, links=storage).output("edge", EDGE, storage=storage)
    p.rule("edge", ["s32"] * 2, lambda h, b, x, y: (h.bind({"from": x, "to": y}), b.search("evac", {"entity": x, "attribute": "to", "value": y})))
    assert derive(spark, closure(p), "path", [InputTuple(k, "to", k + 1) for k in range(4)]) == CHAIN
    with pytest.raises(ValueError):
        Program().output("other", EDGE, storage="heap")


def _peers():
    p = Program(preamble=False).input("of", {"who": "s64", "group": "s32"}).output("peers", {"a": "s64", "b": "s64"})
    p.rule("peers", ["s64", "s64", "s32"], lambda h, b, x, y, g: (h.bind({"a": x, "b": y}), b.search("of", {"who": x, "group": g}).search("of", {"who": y, "group": g})))
    return p


@pytest.mark.parametrize("twice", [False, True])
def test_groups_that_meet_themselves_are_dealt_over_tasks(spark, monkeypatch, twice):
    """One large group and some small ones; ``twice``: rows that stand in two groups make no pair twice."""
    from hornfels.plans import pairs

    for name, value in (("FEW", 10_000), ("BLOCK", 16), ("TASK", 10_000)):
        monkeypatch.setattr(pairs, name, value)
    stands = [(k, 0 if k < 400 else k % 7) for k in range(450)] + [(k, 1) for k in range(30) if twice]
    of = spark.createDataFrame(stands, "who long, group int")
    p = _peers()
    out = evaluate(spark, p, {"of": bind(of, p.declarations["of"])})["peers"]
    groups = {}
    for who, group in stands:
        groups.setdefault(group, set()).add(who)
    expected = {(a, b) for g in groups.values() for a in g for b in g}
    got = out.withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == len(expected) and {(r.a, r.b) for r in got} == expected
    counts = {}
    for r in got:
        counts[r.part] = counts.get(r.part, 0) + 1
    assert len(counts) > 8 and max(counts.values()) < len(expected) / 6
