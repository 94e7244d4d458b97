"""Evaluation of programs: strata in order, recursive ones by semi-naive iteration.

An iteration derives rows from the last iteration's new rows only: a rule with several atoms of its own stratum has
one variant for each of them, in which that atom reads the new rows, atoms before it all rows and atoms after it
the rows from before.  New rows are distinct and anti-joined with those known, and written to the shared scratch
folder, so plans stay short and a lost executor costs a few tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.errors import UnrecognizedRelation
from hornfels.plans.builder import Program
from hornfels.plans.compile_rule import CID, compile_facts, compile_rule
from hornfels.plans.stratify import Stratum
from hornfels.plans.terms import Rule
from hornfels.sources.layout import lay_out
from hornfels.sources.scratch import materialize
from hornfels.types import spark_type

PARTS = 8
"""Written parts of a relation after which they are joined into one."""


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _distinct(df: DataFrame) -> DataFrame:
    return df.distinct() if df.columns else df.limit(1)


def _minus(df: DataFrame, known: DataFrame) -> DataFrame:
    if not df.columns:
        return df.join(known.limit(1).select(F.lit(1).alias("_there")), F.lit(True), "left_anti")
    return df.join(known, df.columns, "left_anti")


class Evaluation:
    """The state of a program over bound inputs: all rows of each relation, kept from run to run."""

    def __init__(self, spark: SparkSession, program: Program):
        self.spark, self.program = spark, program
        self.strata = program.strata()
        self.frames: dict[str, DataFrame] = {}
        self.iterations = 0
        self._rules_made = False
        self._cached: list[DataFrame] = []

    def empty(self, name: str) -> DataFrame:
        decl = self.program.declarations[name]
        columns = [F.lit(None).cast(spark_type(k)).alias(c) for c, k in decl.columns.items()]
        if not decl.derived:
            columns.append(F.lit(None).cast("binary").alias(CID))
        return self.spark.range(0).select(*columns)

    def frame(self, name: str) -> DataFrame:
        if name not in self.program.declarations:
            raise UnrecognizedRelation(name)
        return self.frames.get(name) if name in self.frames else self.empty(name)

    def _derive(self, rule: Rule, frame_of: Callable[[str, int], DataFrame] | None = None) -> DataFrame:
        return self._compile(rule, frame_of)[0]

    def _compile(self, rule: Rule, frame_of: Callable[[str, int], DataFrame] | None = None) -> tuple[DataFrame, bool]:
        return compile_rule(self.spark, rule, self.program.declarations, frame_of or (lambda name, k: self.frame(name)))

    def run(self, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Evaluate from nothing."""
        self.reset()
        self.frames = {n: self._laid(n, df) for n, df in inputs.items()}
        self.iterations = 0
        for stratum in self.strata:
            self._run_stratum(stratum)
        return self.frames

    def _uses(self, name: str) -> int:
        return sum(1 for r in self.program.rules for n, _ in r.relations() if n == name)

    def _facts(self, stratum: Stratum, name: str) -> list[DataFrame]:
        own = [f for f in stratum.facts if f.head == name]
        return [compile_facts(self.spark, own, self.program.declarations[name])] if own else []

    def _run_stratum(self, stratum: Stratum) -> None:
        members = set(stratum.relations)
        if not stratum.recursive:
            name = stratum.relations[0]
            made = [self._compile(r) for r in stratum.rules]
            parts = [rows for rows, _ in made] + self._facts(stratum, name)
            done = len(parts) == 1 and all(distinct for _, distinct in made) and bool(made)
            frame = parts[0] if done else _distinct(_union(parts)) if parts else self.empty(name)
            own = self.program.declarations[name].storage != "set"
            self.frames[name] = self._laid(name, frame) if own else materialize(frame) if self._uses(name) > 1 else frame
            return
        looping = [r for r in stratum.rules if any(a.relation in members for a in r.atoms)]
        for name in {n for r in looping for n, _ in r.relations() if n not in members}:
            self.frames[name] = materialize(self.frame(name))
        new = {}
        for name in stratum.relations:
            parts = [self._derive(r) for r in stratum.rules if r.head == name and r not in looping] + self._facts(stratum, name)
            new[name] = materialize(_distinct(_union(parts)) if parts else self.empty(name))
        self._loop(stratum, looping, {n: self.empty(n) for n in members}, new)

    def _loop(self, stratum: Stratum, looping: list[Rule], old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Iterate from rows known (``old``) and new ones; sets the frames and returns all rows that came in."""
        members = set(stratum.relations)
        parts = {n: [old[n], new[n]] for n in members}
        came = {n: [new[n]] for n in members}
        alive = {n for n in members if not new[n].isEmpty()}
        while alive:
            self.iterations += 1
            total = {n: _union(parts[n]) for n in members}
            fresh: dict[str, list[DataFrame]] = {n: [] for n in members}
            for rule in looping:
                for focus, atom in enumerate(rule.atoms):
                    if atom.relation not in alive:
                        continue

                    def frame_of(name: str, k: int, focus=focus) -> DataFrame:
                        if name not in members:
                            return self.frame(name)
                        return new[name] if k == focus else total[name] if k < focus else old[name]

                    fresh[rule.head].append(self._derive(rule, frame_of))
            old = total
            new = {n: materialize(_minus(_distinct(_union(f)), total[n])) for n, f in fresh.items() if f}
            alive = {n for n in new if not new[n].isEmpty()}
            for n in members:
                if n in alive:
                    parts[n].append(new[n])
                    came[n].append(new[n])
                    if len(parts[n]) > PARTS:
                        parts[n] = [materialize(_union(parts[n]))]
                else:
                    new[n] = self.empty(n)
        for n in members:
            self.frames[n] = _union(parts[n])
        return {n: _union(came[n]) for n in members}

    def extend(self, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Add new input rows to a monotone program's state; returns the new rows of each relation.

        ``inputs`` hold rows that are not known yet.  Only their consequences are derived.
        """
        first = not self._rules_made
        before = {n: self.frame(n) for n in self.program.declarations}
        deltas = {n: materialize(df) if n not in self.program.declarations or self.program.declarations[n].storage == "set" else self._laid(n, df) for n, df in inputs.items()}
        for name, delta in deltas.items():
            self.frames[name] = before[name].unionByName(delta) if name in self.frames else delta
        for stratum in self.strata:
            members = set(stratum.relations)
            new: dict[str, DataFrame] = {}
            for name in stratum.relations:
                made: list[DataFrame] = self._facts(stratum, name) if first else []
                for rule in (r for r in stratum.rules if r.head == name):
                    if first and not rule.atoms:
                        made.append(self._derive(rule))
                    for focus, atom in enumerate(rule.atoms):
                        if atom.relation not in deltas:
                            continue

                        def frame_of(n: str, k: int, focus=focus) -> DataFrame:
                            return deltas[n] if k == focus else before[n] if k > focus else self.frame(n)

                        made.append(self._derive(rule, frame_of))
                new[name] = materialize(_minus(_distinct(_union(made)), before[name])) if made else self.empty(name)
            if stratum.recursive:
                looping = [r for r in stratum.rules if any(a.relation in members for a in r.atoms)]
                new = self._loop(stratum, looping, {n: before[n] for n in members}, new)
            else:
                name = stratum.relations[0]
                self.frames[name] = before[name].unionByName(new[name])
            deltas |= {n: df for n, df in new.items() if not df.isEmpty()}
        self._rules_made = True
        return {n: deltas[n] if n in deltas else self.empty(n) for n in self.program.declarations}

    def _laid(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self.program.declarations:
            return df
        out = lay_out(df, self.program.declarations[name])
        if self.program.declarations[name].storage == "cached":
            self._cached.append(out)
        return out

    def reset(self) -> None:
        for df in self._cached:
            df.unpersist()
        self.frames, self._rules_made, self._cached = {}, False, []


def evaluate(spark: SparkSession, program: Program, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All relations of a program over bound inputs (see :func:`hornfels.sources.bind.bind`)."""
    return Evaluation(spark, program).run(inputs)
