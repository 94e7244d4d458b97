"""From a rule to a DataFrame.

The environment is a DataFrame with one column for each variable bound so far.  Atoms join it on shared variables
(those that share one first),
an atom of which no other variable is used later only restricts it (a semi join), negations are anti joins, and an
aggregation groups its relation once by the variables that the environment binds and joins the result.  Catalyst
then pushes filters and columns down and picks the joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.plans.pairs import join_pairs
from hornfels.plans.terms import Aggregation, Atom, Bindings, Declaration, Fact, Rule, Var
from hornfels.types import ANY, FLOATS, Typed, convert, has_type, lit, pack, spark_type

CID = "_cid"


def _name(v: Var) -> str:
    return f"v_{v.name}"


def _match(frame: DataFrame, decl: Declaration, pairs: Bindings, kinds: dict[str, str], cid=None, keep: set[str] | None = None) -> DataFrame:
    """Rows that fit literals and repeated variables, as columns of variables (those in ``keep``)."""
    columns: dict[str, Column] = {}
    conditions: list[Column] = []
    terms = [(F.col(f"`{c}`"), decl.columns[c], t) for c, t in pairs]
    if cid is not None:
        conditions.append(F.col(CID).isNotNull())
        terms.append((F.col(CID), "cid", cid if isinstance(cid, Var) else Typed("cid", bytes(cid))))
    for column, kind, term in terms:
        if not isinstance(term, Var):
            conditions.append(column == lit(term, kind))
            continue
        value, condition = convert(column, kind, kinds.setdefault(term.name, term.type))
        if condition is not None:
            conditions.append(condition)
        if term.name in columns:
            conditions.append(columns[term.name] == value)
        else:
            columns[term.name] = value
    for condition in conditions:
        frame = frame.filter(condition)
    return frame.select(*[c.alias(f"v_{v}") for v, c in columns.items() if keep is None or v in keep])


def _used_by(pairs: Bindings) -> set[str]:
    return {t.name for _, t in pairs if isinstance(t, Var)}


def join_order(variables: list[set[str]]) -> list[int]:
    """The order in which atoms with these variables are joined: as written, but each one after the first shares a
    variable with those before it wherever one can; only groups of atoms without any link are crossed."""
    left, order, bound = list(range(len(variables))), [], set()
    while left:
        k = next((k for k in left if variables[k] & bound), left[0])
        left.remove(k)
        order.append(k)
        bound |= variables[k]
    return order


def _meets_itself(a: Atom, b: Atom, shared: set[str], kinds: dict[str, str]) -> bool:
    """Whether two atoms search one relation by the same columns, so that groups of rows meet as a whole.

    Floats as keys are left to the ordinary join, which keeps the sign of a zero.
    """
    places = [sorted((t.name, c) for c, t in x.bindings if isinstance(t, Var) and t.name in shared) for x in (a, b)]
    return a.relation == b.relation and a.cid is None and b.cid is None and places[0] == places[1] and not any(kinds[v] == ANY or kinds[v] in FLOATS for v in shared)


def compile_rule(spark: SparkSession, rule: Rule, declarations: dict[str, Declaration], frame_of: Callable[[str, int], DataFrame]) -> tuple[DataFrame, bool]:
    """The head's rows, and whether they are distinct as they are.

    ``frame_of(relation, k)``: rows for the k-th atom; -1 for other terms.
    """
    kinds: dict[str, str] = {}
    rest: set[str] = _used_by(rule.columns)
    for condition in rule.conditions:
        rest |= {v.name for v in condition.variables}
    for term in (*rule.negations, *rule.aggregations):
        rest |= _used_by(term.bindings)
    atom_vars = [_used_by(a.bindings) | ({a.cid.name} if isinstance(a.cid, Var) else set()) for a in rule.atoms]
    env: DataFrame | None = None
    bound: set[str] = set()
    pairs: set[str] = set()  # the own variables of both sides of a join of many rows with many
    single, tasks = False, 0
    order = join_order(atom_vars)
    for place, k in enumerate(order):
        atom = rule.atoms[k]
        later = rest.union(*(atom_vars[j] for j in order[place + 1 :]))
        rows = _match(frame_of(atom.relation, k), declarations[atom.relation], atom.bindings, kinds, atom.cid, later | bound)
        own = atom_vars[k]
        if env is None:
            env = rows
        else:
            shared = [f"v_{v}" for v in sorted(own & bound)]
            fresh = (own - bound) & later
            met = None
            if place == 1 and shared and fresh and bound - own and _meets_itself(rule.atoms[order[0]], atom, own & bound, kinds):
                met = join_pairs(env, rows, shared)
            if met:
                env, single, tasks = met
                pairs = (bound - own) | fresh
                single = single or (own & bound) <= _used_by(rule.columns)
            elif shared:
                env = env.join(rows, shared, "inner" if fresh else "left_semi")
            elif fresh:
                env = env.crossJoin(rows)
            else:
                env = env.join(rows.limit(1).select(F.lit(1).alias("_there")), F.lit(True), "left_semi")
        bound |= own & later
    if env is None:
        env = spark.range(1).select()
    for condition in rule.conditions:
        env = env.filter(condition.test(*[F.col(_name(v)) for v in condition.variables]))
    for negation in rule.negations:
        rows = _match(frame_of(negation.relation, -1), declarations[negation.relation], negation.bindings, kinds)
        keys = [f"v_{v}" for v in sorted(_used_by(negation.bindings))]
        env = env.join(rows, keys, "left_anti") if keys else env.join(rows.limit(1).select(F.lit(1).alias("_there")), F.lit(True), "left_anti")
    for aggregation in rule.aggregations:
        env = _aggregate(env, aggregation, declarations, frame_of, kinds, bound)
        kinds[aggregation.target.name] = aggregation.target.type
        bound.add(aggregation.target.name)
    head = declarations[rule.head]
    out: dict[str, Column] = {}
    for column, term in rule.columns:
        if isinstance(term, Var):
            value, condition = convert(F.col(_name(term)), kinds[term.name], head.columns[column])
            if condition is not None:
                env = env.filter(condition)
        else:
            value = lit(term, head.columns[column])
        out[column] = value.cast(spark_type(head.columns[column])).alias(column)
    env = env.select(*[out[c] for c in head.columns])
    if not pairs or not pairs <= _used_by(rule.columns):
        return env, False
    if len(rule.atoms) == 2 and not rule.aggregations and single:
        return env, True
    return env.repartition(tasks, *[F.col(f"`{c}`") for c in head.columns]), False  # about as many rows as pairs


def _aggregate(env: DataFrame, term: Aggregation, declarations, frame_of, kinds: dict[str, str], bound: set[str]) -> DataFrame:
    decl, target, spec = declarations[term.relation], term.target, term.function.spec
    local = dict(kinds)
    for arg in term.function.args:
        if arg.name not in bound:
            local[arg.name] = arg.type
    rows = _match(frame_of(term.relation, -1), decl, term.bindings, local)
    keys = [f"v_{v}" for v in sorted(_used_by(term.bindings) & bound)]
    args = [F.col(_name(a)) for a in term.function.args]
    kind = local[term.function.args[0].name] if term.function.args else target.type
    value = spec.build(args, kind, target.type)
    if target.type == ANY and spec.name in ("count", "sum", "mean"):
        value = pack(value, "s64" if spec.name == "count" else kind)
    elif target.type == ANY and kind != ANY:
        value = pack(value, kind)
    elif target.type != ANY and kind == ANY and spec.name in ("min", "max"):
        rows = rows.filter(has_type(args[0], target.type))
        value = spec.build([convert(args[0], ANY, target.type)[0]], target.type, target.type)
    value = value.alias("_agg")
    grouped = rows.groupBy(*keys).agg(value) if keys else rows.agg(value)
    if spec.empty is None:
        grouped = grouped.filter(F.col("_agg").isNotNull())
        env = env.join(grouped, keys) if keys else env.crossJoin(grouped)
        return env.withColumnRenamed("_agg", _name(target))
    empty = lit(Typed(kind if kind != ANY else "s64", spec.empty), target.type) if target.type == ANY else F.lit(spec.empty).cast(spark_type(target.type))
    env = env.join(grouped, keys, "left") if keys else env.crossJoin(grouped)
    return env.withColumn(_name(target), F.coalesce("_agg", empty)).drop("_agg")


def compile_facts(spark: SparkSession, facts: list[Fact], decl: Declaration) -> DataFrame:
    """One row for each fact."""
    if not decl.columns:
        return spark.range(1).select()
    rows = [F.struct(*[lit(f.values[c], kind).cast(spark_type(kind)).alias(c) for c, kind in decl.columns.items()]) for f in facts]
    return spark.range(1).select(F.inline(F.array(*rows)))
