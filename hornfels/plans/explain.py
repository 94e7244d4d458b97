"""Programs as text."""

from __future__ import annotations

from hornfels.plans.builder import Program
from hornfels.plans.terms import Bindings, Rule, Typed, Var


def _term(t) -> str:
    return t.name if isinstance(t, Var) else repr(t.value) if isinstance(t, Typed) else repr(t)


def _atom(name: str, pairs: Bindings) -> str:
    return f"{name}({', '.join(f'{c}: {_term(t)}' for c, t in pairs)})"


def rule_text(rule: Rule) -> str:
    body = [_atom(a.relation, a.bindings) + (f" @ {_term(a.cid)}" if a.cid is not None else "") for a in rule.atoms]
    body += [f"{getattr(c.test, '__name__', 'test')}({', '.join(v.name for v in c.variables)})" for c in rule.conditions]
    body += ["not " + _atom(n.relation, n.bindings) for n in rule.negations]
    body += [f"{g.target.name} = {g.function.spec.name}({', '.join(a.name for a in g.function.args)}) of {_atom(g.relation, g.bindings)}" for g in rule.aggregations]
    return _atom(rule.head, rule.columns) + (" :- " + ", ".join(body) if body else "") + "."


def explain(program: Program) -> str:
    """Declarations, then strata with their facts and rules."""
    lines = [f"{'output' if d.derived else 'input'} {d.name}({', '.join(f'{c}: {k}' for c, k in d.columns.items())})" for d in program.declarations.values()]
    lines.append("incremental" if program.is_monotone() else "recomputed each epoch")
    for k, stratum in enumerate(program.strata()):
        lines.append(f"stratum {k}{' (recursive)' if stratum.recursive else ''}: {', '.join(stratum.relations)}")
        lines += [f"  {_atom(f.head, list(f.values.items()))}." for f in stratum.facts]
        lines += [f"  {rule_text(r)}" for r in stratum.rules]
    return "\n".join(lines)
