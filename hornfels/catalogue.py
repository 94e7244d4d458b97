"""Registered programs over the test tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.functions.aggregates import aggregate, count, max_, mean, min_, sum_
from hornfels.functions.content import fact_cid
from hornfels.functions.predicates import predicate, python_predicate
from hornfels.plans.builder import Program
from hornfels.plans.compile_rule import CID
from hornfels.plans.fixpoint import evaluate
from hornfels.sources.bind import bind
from hornfels.sources.facts import from_columns, inputs
from hornfels.sources.scratch import materialize, new_folder
from hornfels.types import Typed, pack, unpack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = {
    "region": {"r_regionkey": "s32", "r_name": "string"},
    "nation": {"n_nationkey": "s32", "n_name": "string", "n_regionkey": "s32"},
    "customer": {"c_custkey": "s64", "c_nationkey": "s32", "c_acctbal": "f64", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "s64", "s_name": "string", "s_nationkey": "s32"},
    "part": {"p_partkey": "s64", "p_brand": "string", "p_size": "s32"},
    "orders": {"o_orderkey": "s64", "o_custkey": "s64", "o_orderstatus": "string", "o_totalprice": "f64", "o_orderpriority": "string"},
    "conversations": {"conv_id": "s64", "turn": "s64"},
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(sql: str | None = None):
    """Registers a query and its SQL under the function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _program(*tables: str) -> Program:
    p = Program(preamble=False)
    for t in tables:
        p.input(t, TABLES[t])
    return p


def _run(spark: SparkSession, sf_dir: str, p: Program, result: str, **bound: DataFrame) -> DataFrame:
    """Binds the program's inputs to the tables of the same names, unless given, and gives one relation."""
    frames = {d.name: bind(bound[d.name] if d.name in bound else _table(spark, sf_dir, d.name), d) for d in p.declarations.values() if not d.derived}
    return evaluate(spark, p, frames)[result]


# projection, selection, predicates


@register("SELECT DISTINCT c_mktsegment AS segment FROM customer")
def proj_customer_segment(spark, sf_dir):
    p = _program("customer").output("seg", {"segment": "string"})
    p.rule("seg", ["string"], lambda h, b, s: (h.bind({"segment": s}), b.search("customer", {"c_mktsegment": s})))
    return _run(spark, sf_dir, p, "seg")


@register("SELECT DISTINCT c_custkey, 'vip' AS tag FROM customer")
def proj_literal_head(spark, sf_dir):
    p = _program("customer").output("tagged", {"c_custkey": "s64", "tag": "string"})
    p.rule("tagged", ["s64"], lambda h, b, k: (h.bind({"c_custkey": k}).set("tag", "vip"), b.search("customer", {"c_custkey": k})))
    return _run(spark, sf_dir, p, "tagged")


@register("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def sel_literal(spark, sf_dir):
    p = _program("orders").output("done", {"o_orderkey": "s64"})
    p.rule("done", ["s64"], lambda h, b, k: (h.bind({"o_orderkey": k}), b.search("orders", {"o_orderkey": k, "o_orderstatus": "F"})))
    return _run(spark, sf_dir, p, "done")


_BIG = "SELECT DISTINCT o_orderkey FROM orders WHERE o_totalprice > 200000"


@register(_BIG)
def pred_when(spark, sf_dir):
    p = _program("orders").output("big", {"o_orderkey": "s64"})
    p.rule("big", ["s64", "f64"], lambda h, b, k, t: (h.bind({"o_orderkey": k}), b.search("orders", {"o_orderkey": k, "o_totalprice": t}).when([t], lambda t: t > 200000)))
    return _run(spark, sf_dir, p, "big")


@predicate
def is_big(total):
    return total > 200000


@register(_BIG)
def pred_udf(spark, sf_dir):
    p = _program("orders").output("big", {"o_orderkey": "s64"})
    p.rule("big", ["s64", "f64"], lambda h, b, k, t: (h.bind({"o_orderkey": k}), b.search("orders", {"o_orderkey": k, "o_totalprice": t}).predicate([t], is_big)))
    return _run(spark, sf_dir, p, "big")


@register("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey % 7 = 3")
def pred_python(spark, sf_dir):
    p = _program("customer").output("some", {"c_custkey": "s64"})
    p.rule("some", ["s64"], lambda h, b, k: (h.bind({"c_custkey": k}), b.search("customer", {"c_custkey": k}).when([k], python_predicate(lambda k: k % 7 == 3))))
    return _run(spark, sf_dir, p, "some")


# joins


@register("SELECT DISTINCT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_nation_region(spark, sf_dir):
    p = _program("nation", "region").output("in_region", {"nation": "string", "region": "string"})
    p.rule("in_region", ["string", "string", "s32"], lambda h, b, n, r, k: (h.bind({"nation": n, "region": r}), b.search("nation", {"n_name": n, "n_regionkey": k}).search("region", {"r_regionkey": k, "r_name": r})))
    return _run(spark, sf_dir, p, "in_region")


@register("""SELECT DISTINCT n_name AS nation, l_returnflag AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def join_star(spark, sf_dir):
    p = _program("orders", "customer", "nation").input("lineitem", {"l_orderkey": "s64", "l_returnflag": "string"}).output("flags", {"nation": "string", "flag": "string"})
    p.rule(
        "flags",
        ["string", "string", "s64", "s64", "s32"],
        lambda h, b, n, f, o, c, k: (
            h.bind({"nation": n, "flag": f}),
            b.search("lineitem", {"l_orderkey": o, "l_returnflag": f}).search("orders", {"o_orderkey": o, "o_custkey": c}).search("customer", {"c_custkey": c, "c_nationkey": k}).search("nation", {"n_nationkey": k, "n_name": n}),
        ),
    )
    return _run(spark, sf_dir, p, "flags")


@register("SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
def join_self(spark, sf_dir):
    p = _program("supplier").output("peers", {"a": "s64", "b": "s64"})
    p.rule("peers", ["s64", "s64", "s32"], lambda h, b, x, y, n: (h.bind({"a": x, "b": y}), b.search("supplier", {"s_suppkey": x, "s_nationkey": n}).search("supplier", {"s_suppkey": y, "s_nationkey": n})))
    return _run(spark, sf_dir, p, "peers")


@register("SELECT DISTINCT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def join_cross(spark, sf_dir):
    p = _program("region").output("pairs", {"a": "string", "b": "string"})
    p.rule("pairs", ["string", "string"], lambda h, b, x, y: (h.bind({"a": x, "b": y}), b.search("region", {"r_name": x}).search("region", {"r_name": y})))
    return _run(spark, sf_dir, p, "pairs")


@register("SELECT DISTINCT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, sf_dir):
    p = _program("nation").output("pairs", {"a": "s32", "b": "s32"})
    p.rule(
        "pairs",
        ["s32", "s32", "s32"],
        lambda h, b, x, y, r: (h.bind({"a": x, "b": y}), b.search("nation", {"n_nationkey": x, "n_regionkey": r}).search("nation", {"n_nationkey": y, "n_regionkey": r}).when([x, y], lambda x, y: x < y)),
    )
    return _run(spark, sf_dir, p, "pairs")


@register("SELECT DISTINCT s_suppkey FROM supplier WHERE s_suppkey = s_nationkey")
def join_repeated_variable(spark, sf_dir):
    p = Program(preamble=False).input("supplier", {"s_suppkey": "s64", "s_nationkey": "s64"}).output("same", {"s_suppkey": "s64"})
    p.rule("same", ["s64"], lambda h, b, x: (h.bind({"s_suppkey": x}), b.search("supplier", {"s_suppkey": x, "s_nationkey": x})))
    return _run(spark, sf_dir, p, "same")


@register("SELECT DISTINCT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_exists(spark, sf_dir):
    p = _program("customer", "orders").output("buyers", {"c_custkey": "s64"})
    p.rule("buyers", ["s64"], lambda h, b, c: (h.bind({"c_custkey": c}), b.search("customer", {"c_custkey": c}).search("orders", {"o_custkey": c})))
    return _run(spark, sf_dir, p, "buyers")


# negation


@register("SELECT DISTINCT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_orders_no_lineitem(spark, sf_dir):
    p = _program("orders").input("lineitem", {"l_orderkey": "s64"}).output("bare", {"o_orderkey": "s64"})
    p.rule("bare", ["s64"], lambda h, b, o: (h.bind({"o_orderkey": o}), b.search("orders", {"o_orderkey": o}).except_("lineitem", {"l_orderkey": o})))
    return _run(spark, sf_dir, p, "bare")


@register("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_idb(spark, sf_dir):
    p = _program("customer", "orders").output("big_buyer", {"c": "s64"}).output("small", {"c_custkey": "s64"})
    p.rule("big_buyer", ["s64", "f64"], lambda h, b, c, t: (h.bind({"c": c}), b.search("orders", {"o_custkey": c, "o_totalprice": t}).when([t], is_big)))
    p.rule("small", ["s64"], lambda h, b, c: (h.bind({"c_custkey": c}), b.search("customer", {"c_custkey": c}).except_("big_buyer", {"c": c})))
    return _run(spark, sf_dir, p, "small")


@register("SELECT DISTINCT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_literal(spark, sf_dir):
    p = _program("customer", "orders").output("calm", {"c_custkey": "s64"})
    p.rule("calm", ["s64"], lambda h, b, c: (h.bind({"c_custkey": c}), b.search("customer", {"c_custkey": c}).except_("orders", {"o_custkey": c, "o_orderpriority": "1-URGENT"})))
    return _run(spark, sf_dir, p, "calm")


@register("SELECT DISTINCT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'X')")
def anti_empty(spark, sf_dir):
    p = _program("region", "orders").output("odd", {"k": "s64"}).output("all_regions", {"r_name": "string"})
    p.rule("odd", ["s64"], lambda h, b, k: (h.bind({"k": k}), b.search("orders", {"o_orderkey": k, "o_orderstatus": "X"})))
    p.rule("all_regions", ["string"], lambda h, b, r: (h.bind({"r_name": r}), b.search("region", {"r_name": r}).except_("odd")))
    return _run(spark, sf_dir, p, "all_regions")


# set operations and facts

_URGENT, _PENDING = "SELECT o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT'", "SELECT o_custkey AS c FROM orders WHERE o_orderstatus = 'P'"


def _sets(spark, sf_dir, define) -> DataFrame:
    p = _program("orders").output("urgent", {"c": "s64"}).output("pending", {"c": "s64"}).output("out", {"c": "s64"})
    p.rule("urgent", ["s64"], lambda h, b, c: (h.bind({"c": c}), b.search("orders", {"o_custkey": c, "o_orderpriority": "1-URGENT"})))
    p.rule("pending", ["s64"], lambda h, b, c: (h.bind({"c": c}), b.search("orders", {"o_custkey": c, "o_orderstatus": "P"})))
    define(p)
    return _run(spark, sf_dir, p, "out")


@register(f"{_URGENT} UNION {_PENDING}")
def set_union(spark, sf_dir):
    def define(p):
        p.rule("out", ["s64"], lambda h, b, c: (h.bind({"c": c}), b.search("urgent", {"c": c})))
        p.rule("out", ["s64"], lambda h, b, c: (h.bind({"c": c}), b.search("pending", {"c": c})))

    return _sets(spark, sf_dir, define)


@register(f"{_URGENT} INTERSECT {_PENDING}")
def set_intersect(spark, sf_dir):
    return _sets(spark, sf_dir, lambda p: p.rule("out", ["s64"], lambda h, b, c: (h.bind({"c": c}), b.search("urgent", {"c": c}).search("pending", {"c": c}))))


@register(f"{_URGENT} EXCEPT {_PENDING}")
def set_except(spark, sf_dir):
    return _sets(spark, sf_dir, lambda p: p.rule("out", ["s64"], lambda h, b, c: (h.bind({"c": c}), b.search("urgent", {"c": c}).except_("pending", {"c": c}))))


@register("SELECT * FROM (VALUES (0, 1), (1, 2), (2, 3)) t(a, b)")
def fact_edges(spark, sf_dir):
    p = Program(preamble=False).output("edge", {"a": "s32", "b": "s32"})
    for k in (0, 1, 2, 1):
        p.fact("edge", {"a": k, "b": k + 1})
    return evaluate(spark, p, {})["edge"]


# aggregation


@register("SELECT count(*) AS n FROM (SELECT DISTINCT * FROM orders)")
def agg_count_global(spark, sf_dir):
    p = _program("orders").output("n_orders", {"n": "s64"})
    p.rule("n_orders", ["s64"], lambda h, b, n: (h.bind({"n": n}), b.group_by(n, "orders", {}, count)))
    return _run(spark, sf_dir, p, "n_orders")


@register("SELECT o_custkey AS c, count(*) AS n FROM (SELECT DISTINCT * FROM orders) GROUP BY o_custkey")
def agg_count_group(spark, sf_dir):
    p = _program("orders").output("per", {"c": "s64", "n": "s64"})
    p.rule("per", ["s64", "s64"], lambda h, b, c, n: (h.bind({"c": c, "n": n}), b.search("orders", {"o_custkey": c}).group_by(n, "orders", {"o_custkey": c}, count)))
    return _run(spark, sf_dir, p, "per")


_LINES = {"l_orderkey": "s64", "l_partkey": "s64", "l_suppkey": "s64", "l_linenumber": "s32", "l_quantity": "f64", "l_extendedprice": "f64", "l_discount": "f64", "l_tax": "f64", "l_returnflag": "string", "l_linestatus": "string"}
_LINES_SQL = "(SELECT DISTINCT " + ", ".join(_LINES) + " FROM lineitem)"


@register(f"SELECT o_orderkey AS o, count(l_orderkey) AS n FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN {_LINES_SQL} ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def agg_count_empty(spark, sf_dir):
    p = _program("orders").input("lineitem", _LINES).output("per", {"o": "s64", "n": "s64"})
    p.rule("per", ["s64", "s64"], lambda h, b, o, n: (h.bind({"o": o, "n": n}), b.search("orders", {"o_orderkey": o}).group_by(n, "lineitem", {"l_orderkey": o}, count)))
    return _run(spark, sf_dir, p, "per")


def _by_brand(spark, sf_dir, kind: str, function) -> DataFrame:
    p = _program("part").output("out", {"brand": "string", "v": kind})
    p.rule("out", ["string", kind, "s32"], lambda h, b, g, v, s: (h.bind({"brand": g, "v": v}), b.search("part", {"p_brand": g}).group_by(v, "part", {"p_brand": g, "p_size": s}, function(s))))
    return _run(spark, sf_dir, p, "out")


@register("SELECT p_brand AS brand, CAST(sum(p_size) AS INT) AS v FROM part GROUP BY p_brand")
def agg_sum_group(spark, sf_dir):
    return _by_brand(spark, sf_dir, "s32", sum_)


@register("SELECT p_brand AS brand, CAST(sum(p_size) // count(p_size) AS INT) AS v FROM part GROUP BY p_brand")
def agg_mean_int(spark, sf_dir):
    return _by_brand(spark, sf_dir, "s32", mean)


def _by_flag(spark, sf_dir, function) -> DataFrame:
    p = Program(preamble=False).input("lineitem", _LINES).output("out", {"flag": "string", "v": "f64"})
    p.rule("out", ["string", "f64", "f64"], lambda h, b, g, v, q: (h.bind({"flag": g, "v": v}), b.search("lineitem", {"l_returnflag": g}).group_by(v, "lineitem", {"l_returnflag": g, "l_quantity": q}, function(q))))
    return _run(spark, sf_dir, p, "out")


@register("SELECT l_returnflag AS flag, min(l_quantity) AS v FROM lineitem GROUP BY l_returnflag")
def agg_min_group(spark, sf_dir):
    return _by_flag(spark, sf_dir, min_)


@register("SELECT l_returnflag AS flag, max(l_quantity) AS v FROM lineitem GROUP BY l_returnflag")
def agg_max_group(spark, sf_dir):
    return _by_flag(spark, sf_dir, max_)


@register("SELECT o_orderstatus AS status, round(avg(o_totalprice), 2) AS v FROM orders GROUP BY o_orderstatus")
def agg_mean_float(spark, sf_dir):
    p = _program("orders").output("out", {"status": "string", "v": "f64"})
    p.rule("out", ["string", "f64", "f64"], lambda h, b, g, v, t: (h.bind({"status": g, "v": v}), b.search("orders", {"o_orderstatus": g}).group_by(v, "orders", {"o_orderstatus": g, "o_totalprice": t}, mean(t))))
    return _run(spark, sf_dir, p, "out").withColumn("v", F.round("v", 2))


@aggregate
def sum_of_products(x, y):
    return F.sum(x * y)


@aggregate
def sum_of_least(x, y):
    return F.sum(F.least(x, y))


@register("SELECT p_brand AS brand, CAST(sum(p_size * p_partkey) AS BIGINT) AS v FROM part GROUP BY p_brand")
def agg_udaf_product(spark, sf_dir):
    p = Program(preamble=False).input("part", {"p_partkey": "s64", "p_brand": "string", "p_size": "s64"}).output("out", {"brand": "string", "v": "s64"})
    p.rule("out", ["string", "s64", "s64", "s64"], lambda h, b, g, v, k, s: (h.bind({"brand": g, "v": v}), b.search("part", {"p_brand": g}).group_by(v, "part", {"p_brand": g, "p_partkey": k, "p_size": s}, sum_of_products(k, s))))
    return _run(spark, sf_dir, p, "out")


@register("SELECT CAST(sum(least(p_size, p_partkey)) AS BIGINT) AS v FROM part")
def agg_sum_of_min(spark, sf_dir):
    p = Program(preamble=False).input("part", {"p_partkey": "s64", "p_size": "s64"}).output("out", {"v": "s64"})
    p.rule("out", ["s64", "s64", "s64"], lambda h, b, v, k, s: (h.bind({"v": v}), b.group_by(v, "part", {"p_partkey": k, "p_size": s}, sum_of_least(k, s))))
    return _run(spark, sf_dir, p, "out")


@register("SELECT p_brand AS brand, count(*) AS n, max(p_size) AS largest FROM part GROUP BY p_brand")
def agg_two_terms(spark, sf_dir):
    p = _program("part").output("out", {"brand": "string", "n": "s64", "largest": "s32"})
    p.rule(
        "out",
        ["string", "s64", "s32", "s32"],
        lambda h, b, g, n, m, s: (h.bind({"brand": g, "n": n, "largest": m}), b.search("part", {"p_brand": g}).group_by(n, "part", {"p_brand": g}, count).group_by(m, "part", {"p_brand": g, "p_size": s}, max_(s))),
    )
    return _run(spark, sf_dir, p, "out")


@register("SELECT o_custkey AS c, count(*) AS n FROM (SELECT DISTINCT * FROM orders) GROUP BY o_custkey HAVING count(*) > 15")
def agg_then_filter(spark, sf_dir):
    p = _program("orders").output("per", {"c": "s64", "n": "s64"}).output("many", {"c": "s64", "n": "s64"})
    p.rule("per", ["s64", "s64"], lambda h, b, c, n: (h.bind({"c": c, "n": n}), b.search("orders", {"o_custkey": c}).group_by(n, "orders", {"o_custkey": c}, count)))
    p.rule("many", ["s64", "s64"], lambda h, b, c, n: (h.bind({"c": c, "n": n}), b.search("per", {"c": c, "n": n}).when([n], lambda n: n > 15)))
    return _run(spark, sf_dir, p, "many")


@register(f"SELECT p_partkey AS k, count(l_partkey) AS n FROM (SELECT DISTINCT p_partkey FROM part WHERE p_size > 25) LEFT JOIN {_LINES_SQL} ON l_partkey = p_partkey GROUP BY p_partkey")
def agg_after_predicate(spark, sf_dir):
    p = _program("part").input("lineitem", _LINES).output("out", {"k": "s64", "n": "s64"})
    p.rule(
        "out",
        ["s64", "s64", "s32"],
        lambda h, b, k, n, s: (h.bind({"k": k, "n": n}), b.search("part", {"p_partkey": k, "p_size": s}).when([s], lambda s: s > 25).group_by(n, "lineitem", {"l_partkey": k}, count)),
    )
    return _run(spark, sf_dir, p, "out")


@register("""SELECT c_custkey AS c, count(o_custkey) AS n FROM
(SELECT DISTINCT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT'))
LEFT JOIN (SELECT DISTINCT * FROM orders) ON o_custkey = c_custkey GROUP BY c_custkey""")
def agg_after_negation(spark, sf_dir):
    p = _program("customer", "orders").output("out", {"c": "s64", "n": "s64"})
    p.rule(
        "out",
        ["s64", "s64"],
        lambda h, b, c, n: (h.bind({"c": c, "n": n}), b.search("customer", {"c_custkey": c}).except_("orders", {"o_custkey": c, "o_orderpriority": "1-URGENT"}).group_by(n, "orders", {"o_custkey": c}, count)),
    )
    return _run(spark, sf_dir, p, "out")


# recursion

_EDGES = "edge AS (SELECT DISTINCT conv_id, turn AS a, turn + 1 AS b FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1))"
_PATHS = f"WITH RECURSIVE {_EDGES}, path AS (SELECT * FROM edge UNION SELECT e.conv_id, e.a, p.b FROM edge e JOIN path p ON e.conv_id = p.conv_id AND e.b = p.a)"


def _turns(spark, sf_dir) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return turns.join(after, ["conv_id", "turn"], "left_semi").select("conv_id", F.col("turn").alias("a"), (F.col("turn") + 1).alias("b"))


_PATH = {"conv_id": "s64", "a": "s64", "b": "s64"}


def _closure(nonlinear: bool = False) -> Program:
    p = Program(preamble=False).input("edge", _PATH).output("path", _PATH)
    p.rule("path", ["s64"] * 3, lambda h, b, c, x, y: (h.bind({"conv_id": c, "a": x, "b": y}), b.search("edge", {"conv_id": c, "a": x, "b": y})))
    first = "path" if nonlinear else "edge"
    p.rule("path", ["s64"] * 4, lambda h, b, c, x, y, z: (h.bind({"conv_id": c, "a": x, "b": z}), b.search(first, {"conv_id": c, "a": x, "b": y}).search("path", {"conv_id": c, "a": y, "b": z})))
    return p


@register(f"{_PATHS} SELECT * FROM path")
def rec_tc_turns(spark, sf_dir):
    return _run(spark, sf_dir, _closure(), "path", edge=_turns(spark, sf_dir))


@register(f"{_PATHS} SELECT * FROM path")
def rec_nonlinear(spark, sf_dir):
    return _run(spark, sf_dir, _closure(nonlinear=True), "path", edge=_turns(spark, sf_dir))


@register(f"{_PATHS} SELECT conv_id, a, b, CASE WHEN (b - a) % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM path")
def rec_mutual(spark, sf_dir):
    p = Program(preamble=False).input("edge", _PATH).output("odd", _PATH).output("even", _PATH).output("out", _PATH | {"parity": "string"})
    p.rule("odd", ["s64"] * 3, lambda h, b, c, x, y: (h.bind({"conv_id": c, "a": x, "b": y}), b.search("edge", {"conv_id": c, "a": x, "b": y})))
    for head, body in (("even", "odd"), ("odd", "even")):
        p.rule(head, ["s64"] * 4, lambda h, b, c, x, y, z, body=body: (h.bind({"conv_id": c, "a": x, "b": z}), b.search("edge", {"conv_id": c, "a": x, "b": y}).search(body, {"conv_id": c, "a": y, "b": z})))
    for name in ("odd", "even"):
        p.rule("out", ["s64"] * 3, lambda h, b, c, x, y, name=name: (h.bind({"conv_id": c, "a": x, "b": y}).set("parity", name), b.search(name, {"conv_id": c, "a": x, "b": y})))
    return _run(spark, sf_dir, p, "out", edge=_turns(spark, sf_dir))


_RING = "edge AS (SELECT n_nationkey AS a, CAST((n_nationkey + 5) % 25 AS INT) AS b FROM nation)"


def _ring(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 5) % 25).alias("b"))


def _reach(p: Program) -> Program:
    p.input("edge", {"a": "s32", "b": "s32"}).output("reach", {"a": "s32", "b": "s32"})
    p.rule("reach", ["s32"] * 2, lambda h, b, x, y: (h.bind({"a": x, "b": y}), b.search("edge", {"a": x, "b": y})))
    p.rule("reach", ["s32"] * 3, lambda h, b, x, y, z: (h.bind({"a": x, "b": z}), b.search("edge", {"a": x, "b": y}).search("reach", {"a": y, "b": z})))
    return p


_REACH = f"WITH RECURSIVE {_RING}, reach AS (SELECT * FROM edge UNION SELECT e.a, r.b FROM edge e JOIN reach r ON e.b = r.a)"


@register(f"{_REACH} SELECT * FROM reach")
def rec_cyclic(spark, sf_dir):
    return _run(spark, sf_dir, _reach(Program(preamble=False)), "reach", edge=_ring(spark, sf_dir))


@register(f"{_REACH} SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x, nation y EXCEPT SELECT a, b FROM reach")
def rec_then_negate(spark, sf_dir):
    p = _reach(_program("nation")).output("apart", {"a": "s32", "b": "s32"})
    p.rule("apart", ["s32"] * 2, lambda h, b, x, y: (h.bind({"a": x, "b": y}), b.search("nation", {"n_nationkey": x}).search("nation", {"n_nationkey": y}).except_("reach", {"a": x, "b": y})))
    return _run(spark, sf_dir, p, "apart", edge=_ring(spark, sf_dir))


_PARENT = "parent AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'r' || r_regionkey, 'root' FROM region)"


@register(f"""WITH RECURSIVE {_PARENT}, sg AS (
SELECT a.child AS x, b.child AS y FROM parent a JOIN parent b ON a.parent = b.parent
UNION SELECT a.child, b.child FROM sg JOIN parent a ON a.parent = sg.x JOIN parent b ON b.parent = sg.y) SELECT x, y FROM sg""")
def rec_same_generation(spark, sf_dir):
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    edges = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    edges = edges.unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("root").alias("parent")))
    p = Program(preamble=False).input("parent", {"child": "string", "parent": "string"}).output("sg", {"x": "string", "y": "string"})
    p.rule("sg", ["string"] * 3, lambda h, b, x, y, q: (h.bind({"x": x, "y": y}), b.search("parent", {"child": x, "parent": q}).search("parent", {"child": y, "parent": q})))
    p.rule("sg", ["string"] * 4, lambda h, b, x, y, u, v: (h.bind({"x": x, "y": y}), b.search("parent", {"child": x, "parent": u}).search("parent", {"child": y, "parent": v}).search("sg", {"x": u, "y": v})))
    return _run(spark, sf_dir, p, "sg", parent=edges)


# facts of any type, content ids, epochs


def _event_facts(spark, sf_dir) -> DataFrame:
    """(user_id, event_type, value) as facts; the value of error events is their type's name instead of a number."""
    e = _table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "error", pack(F.lit("error"), "string")).otherwise(pack(F.col("value"), "f64"))
    return from_columns(e, pack(F.col("user_id"), "s64"), pack(F.col("event_type"), "string"), value)


@register("SELECT DISTINCT user_id, event_type, value FROM events WHERE event_type <> 'error'")
def eav_pivot(spark, sf_dir):
    p = Program().output("numbers", {"user_id": "s64", "event_type": "string", "value": "f64"})
    p.rule("numbers", ["s64", "string", "f64"], lambda h, b, u, t, v: (h.bind({"user_id": u, "event_type": t, "value": v}), b.search("evac", {"entity": u, "attribute": t, "value": v})))
    return evaluate(spark, p, inputs(_event_facts(spark, sf_dir)))["numbers"]


@register("SELECT user_id, min(value) AS value FROM events WHERE event_type <> 'error' GROUP BY user_id")
def any_min(spark, sf_dir):
    p = Program().output("least", {"user_id": "s64", "value": "any"})
    p.rule("least", ["s64", "any", "any"], lambda h, b, u, m, v: (h.bind({"user_id": u, "value": m}), b.search("evac", {"entity": u}).group_by(m, "evac", {"entity": u, "value": v}, min_(v))))
    out = evaluate(spark, p, inputs(_event_facts(spark, sf_dir)))["least"]
    return out.filter(F.col("value.t") == 10).select("user_id", unpack(F.col("value"), "f64").alias("value"))


def _turn_facts(spark, sf_dir) -> DataFrame:
    """Turns of conversations as facts: conversation, role, text hash; each but the first links to the one before."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    entity = pack(F.col("conv_id"), "s64")
    facts = from_columns(turns, entity, pack(F.col("turn"), "s64"), pack(F.col("digest"), "string"))
    first = materialize(facts.select(F.col("entity.i").cast("long").alias("conv_id"), F.col("attribute.i").cast("long").alias("turn"), F.col(CID).alias("prev")))
    linked = turns.join(first.withColumn("turn", F.col("turn") + 1), ["conv_id", "turn"], "left")
    links = F.when(F.col("prev").isNotNull(), F.array("prev"))
    return from_columns(linked, entity, pack(F.col("turn"), "s64"), pack(F.col("digest"), "string"), links).select("entity", "attribute", "value", "links", CID)


@register("SELECT DISTINCT c.conv_id, c.turn FROM conversations c JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn - 1")
def links_explode(spark, sf_dir):
    """Facts that link to another one."""
    p = Program().output("follows", {"conv_id": "s64", "turn": "s64"})
    p.rule("follows", ["s64", "s64", "cid", "cid"], lambda h, b, c, t, i, j: (h.bind({"conv_id": c, "turn": t}), b.search_cid("evac", i, {"entity": c, "attribute": t}).search("links", {"from": i, "to": j})))
    return evaluate(spark, p, inputs(_turn_facts(spark, sf_dir)))["follows"]


_INT = """(CASE WHEN {0} < 24 THEN printf('%02x', {0}) WHEN {0} < 256 THEN '18' || printf('%02x', {0}) WHEN {0} < 65536 THEN '19' || printf('%04x', {0})
WHEN {0} < 4294967296 THEN '1a' || printf('%08x', {0}) ELSE '1b' || printf('%016x', {0}) END)"""
_FACT = "'a466656e74697479a163533634' || " + _INT.format("conv_id") + " || '6461747472a163533634' || " + _INT.format("turn") + " || '6376616ca166537472696e677820' || hex(d) || '656c696e6b73'"


@register(f"""WITH t AS (SELECT conv_id, turn, encode(md5(coalesce(text, ''))) AS d FROM conversations),
f AS (SELECT conv_id, turn, {_FACT} AS body FROM t),
g AS (SELECT *, '01711220' || sha256(unhex(body || '80')) AS own FROM f)
SELECT g.conv_id, g.turn, upper('01711220' || sha256(unhex(g.body || CASE WHEN p.own IS NULL THEN '80' ELSE '81d82a582500' || p.own END))) AS id
FROM g LEFT JOIN g p ON p.conv_id = g.conv_id AND p.turn = g.turn - 1""")
def cid_lookup(spark, sf_dir):
    """Content ids of all turns, in hexadecimal."""
    p = Program().output("ids", {"conv_id": "s64", "turn": "s64", "id": "cid"})
    p.rule("ids", ["s64", "s64", "cid"], lambda h, b, c, t, i: (h.bind({"conv_id": c, "turn": t, "id": i}), b.search_cid("evac", i, {"entity": c, "attribute": t})))
    return evaluate(spark, p, inputs(_turn_facts(spark, sf_dir)))["ids"].withColumn("id", F.hex("id"))


def register_program() -> Program:
    """Last-writer-wins registers, one for each store and key.

    A write names the writes it has seen by links.  A first write has no links; a later one answers a first write of
    its register, or an answer.  From the first write of smallest content id the way goes down to the answer of
    smallest id, again and again; the write without answers at its end is the register's value.
    """
    register = {"store": "any", "key": "any"}
    p = Program()
    p.output("written", {"id": "cid", **register, "value": "any"}).output("first", {"id": "cid", **register}).output("answer", {"id": "cid", "to": "cid"})
    p.output("chosen", {"id": "cid"}).output("head", {**register, "id": "cid", "value": "any"})

    def of(s, k):
        return {"store": s, "key": k}

    p.rule("written", ["cid", "any", "any", "any"], lambda h, b, i, s, k, v: (h.bind({"id": i, "value": v, **of(s, k)}), b.search_cid("evac", i, {"entity": s, "attribute": k, "value": v})))
    p.rule("first", ["cid", "any", "any"], lambda h, b, i, s, k: (h.bind({"id": i, **of(s, k)}), b.search("written", {"id": i, **of(s, k)}).except_("links", {"from": i})))
    p.rule(
        "answer",
        ["cid", "cid", "any", "any"],
        lambda h, b, i, j, s, k: (h.bind({"id": i, "to": j}), b.search("written", {"id": i, **of(s, k)}).search("links", {"from": i, "to": j}).search("first", {"id": j, **of(s, k)})),
    )
    p.rule("answer", ["cid", "cid"], lambda h, b, i, j: (h.bind({"id": i, "to": j}), b.search("written", {"id": i}).search("links", {"from": i, "to": j}).search("answer", {"id": j})))
    p.rule("chosen", ["cid", "any", "any", "cid"], lambda h, b, m, s, k, i: (h.bind({"id": m}), b.search("first", of(s, k)).group_by(m, "first", {"id": i, **of(s, k)}, min_(i))))
    p.rule("chosen", ["cid", "cid", "cid"], lambda h, b, m, j, i: (h.bind({"id": m}), b.search("chosen", {"id": j}).group_by(m, "answer", {"id": i, "to": j}, min_(i))))
    p.rule(
        "head",
        ["cid", "any", "any", "any"],
        lambda h, b, i, s, k, v: (h.bind({"id": i, "value": v, **of(s, k)}), b.search("chosen", {"id": i}).search("written", {"id": i, "value": v, **of(s, k)}).except_("answer", {"to": i})),
    )
    return p


def _chain(batches):
    """Content ids of the writes of registers, each linked to the one before; rows come by register and turn."""
    register = before = None
    for batch in batches:
        out = []
        for conv, role, digest in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "digest")]):
            if (conv, role) != register:
                register, before = (conv, role), None
            id_ = fact_cid(Typed("s64", conv), role, digest, [] if before is None else [before])
            out.append((conv, role, digest, before, id_))
            before = id_
        types = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, types)], ["conv_id", "role", "digest", "prev", "id"])


@register("""WITH w AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k, text FROM conversations)
SELECT conv_id, role, md5(coalesce(text, '')) AS value FROM w WHERE k = 1""")
def kv_head(spark, sf_dir):
    """Each turn writes its role's register in its conversation and links to the write that it replaces."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    chained = turns.repartition("conv_id", "role").sortWithinPartitions("conv_id", "role", "turn").mapInArrow(_chain, "conv_id long, role string, digest string, prev binary, id binary")
    links = F.when(F.col("prev").isNull(), F.array().cast("array<binary>")).otherwise(F.array("prev"))
    facts = chained.select(pack(F.col("conv_id"), "s64").alias("entity"), pack(F.col("role"), "string").alias("attribute"), pack(F.col("digest"), "string").alias("value"), links.alias("links"), F.col("id").alias(CID))
    facts = materialize(facts)
    head = evaluate(spark, register_program(), inputs(facts))["head"]
    return head.select(unpack(F.col("store"), "s64").alias("conv_id"), unpack(F.col("key"), "string").alias("role"), unpack(F.col("value"), "string").alias("value"))


def _epochs(spark, sf_dir):
    """Events in four epochs by time, as (facts, client)."""
    from hornfels.streaming.client import Client

    p = Program().output("seen", {"user_id": "s64", "event_type": "string"})
    p.rule("seen", ["s64", "string"], lambda h, b, u, t: (h.bind({"user_id": u, "event_type": t}), b.search("evac", {"entity": u, "attribute": t})))
    return _fill(spark, sf_dir, Client(spark, p))


def _fill(spark, sf_dir, client):
    e = _table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high = e.agg(F.min("at"), F.max("at")).first()
    for k in range(4):
        since, before = low + (high - low + 1) * k // 4, low + (high - low + 1) * (k + 1) // 4
        part = e.filter((F.col("at") >= since) & (F.col("at") < before))
        client.insert_frame(from_columns(part, pack(F.col("user_id"), "s64"), pack(F.col("event_type"), "string"), pack(F.col("value"), "f64")))
        client.commit()
    return client


@register("SELECT DISTINCT user_id, event_type FROM events")
def stream_incremental(spark, sf_dir):
    """A monotone program over four epochs: only what is new is derived in each."""
    return _epochs(spark, sf_dir).relation("seen")


@register("SELECT DISTINCT user_id, event_type FROM events")
def stream_structured(spark, sf_dir):
    """The same program over a structured stream of the table's files: each micro-batch is an epoch."""
    from hornfels.streaming.client import Client
    from hornfels.streaming.streams import stream_into

    p = Program().output("seen", {"user_id": "s64", "event_type": "string"})
    p.rule("seen", ["s64", "string"], lambda h, b, u, t: (h.bind({"user_id": u, "event_type": t}), b.search("evac", {"entity": u, "attribute": t})))
    client = Client(spark, p)
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events.parquet*")

    def facts(df):
        return from_columns(df, pack(F.col("user_id"), "s64"), pack(F.col("event_type"), "string"), pack(F.col("value"), "f64"))

    stream_into(client, stream, facts, new_folder(spark)).awaitTermination()
    return client.relation("seen")


@register("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, value FROM events) GROUP BY user_id")
def stream_recompute(spark, sf_dir):
    """An aggregate over four epochs: evaluated anew in each."""
    from hornfels.streaming.client import Client

    p = Program().output("per", {"user_id": "s64", "n": "s64"})
    p.rule("per", ["s64", "s64"], lambda h, b, u, n: (h.bind({"user_id": u, "n": n}), b.search("evac", {"entity": u}).group_by(n, "evac", {"entity": u}, count)))
    return _fill(spark, sf_dir, Client(spark, p)).relation("per")


@register("""SELECT DISTINCT user_id, event_type FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)
WHERE epoch_us(ts) < lo + (hi - lo + 1) * 2 // 4""")
def epoch_asof(spark, sf_dir):
    """Two epochs back from the fourth."""
    client = _epochs(spark, sf_dir)
    client.rewind()
    client.rewind()
    return client.relation("seen")
