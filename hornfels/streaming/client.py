"""A program over a log of facts that grows by epochs.

``insert`` stages facts; ``commit`` makes them an epoch, brings the program to its fixpoint and calls the sinks.  A
monotone program derives only the consequences of new facts and hands its sinks the new rows; any other program is
evaluated over all facts up to the active epoch, and its sinks get all rows again (there are no retractions; a sink
registered with ``changes=True`` gets the rows that were not there before, and with them those that went).

``rewind`` and ``replay`` move the active epoch; facts committed meanwhile stay staged until it is the latest again.

The log is a table in a folder, one part for each epoch, with a small file for each epoch's id beside it that says which
of them are complete.  A client over a folder that holds a log goes on from its last epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hornfels.errors import UnrecognizedRelation
from hornfels.functions.content import epoch_cid_of
from hornfels.plans.builder import Program
from hornfels.plans.compile_rule import CID
from hornfels.plans.fixpoint import Evaluation
from hornfels.sources import facts as facts_of
from hornfels.sources.facts import InputTuple
from hornfels.sources.scratch import materialize, new_folder, read_marks, write_mark
from hornfels.streaming.clock import Timestamp

_LOGGED = StructType([*facts_of.SCHEMA.fields, StructField("epoch", LongType())])


@dataclass(frozen=True)
class FixpointEvent:
    time: Timestamp
    epoch_cid: bytes


class Client:
    def __init__(self, spark: SparkSession, program: Program, on_fixpoint: Callable[[FixpointEvent], None] | None = None, log: str | None = None):
        """log: the folder of the log; by default one that goes with the application."""
        self.spark, self.program, self.on_fixpoint = spark, program, on_fixpoint
        self.monotone = program.is_monotone()
        self.evaluation = Evaluation(spark, program)
        self.folder = log or new_folder(spark)
        self.staged: list[DataFrame] = []
        self.sinks: dict[str, list[tuple[Callable, bool]]] = {}
        self.events: list[FixpointEvent] = []
        self._shown: dict[str, DataFrame] = {}
        marks = read_marks(spark, f"{self.folder}/ids")  # one for each complete epoch
        self.epoch_ids = [bytes.fromhex(marks[name]) for name in sorted(marks)]
        self.active = len(self.epoch_ids)  # number of epochs in view
        if self.active:
            self._evaluate(None)

    # input

    def insert(self, *tuples: InputTuple | Iterable[InputTuple]) -> None:
        """Stage facts."""
        rows = [t for x in tuples for t in ([x] if isinstance(x, InputTuple) else x)]
        if rows:
            self.staged.append(facts_of.from_tuples(self.spark, rows))

    insert_tuple = insert

    def insert_frame(self, facts: DataFrame) -> None:
        """Stage a table of facts (see :mod:`hornfels.sources.facts`)."""
        self.staged.append(facts)

    def register_iterable(self, tuples: Iterable[InputTuple], batch: int = 1000) -> None:
        """Stage what an iterable yields, in batches."""
        held: list[InputTuple] = []
        for t in tuples:
            held.append(t)
            if len(held) >= batch:
                self.insert(held)
                held = []
        self.insert(held)

    def register_sink(self, relation: str, sink: Callable[..., None], changes: bool = False) -> None:
        """``sink(rows)`` after each fixpoint; with ``changes``, ``sink(new, gone)``."""
        if relation not in self.program.declarations:
            raise UnrecognizedRelation(relation)
        self.sinks.setdefault(relation, []).append((sink, changes))

    # epochs

    def commit(self) -> FixpointEvent | None:
        """Make what is staged the next epoch.  Without new facts there is no epoch, but for the first."""
        last = len(self.epoch_ids)
        if self.active < last:
            return None
        new = self.spark.createDataFrame([], facts_of.SCHEMA)
        for f in self.staged:
            new = new.unionByName(f.select(*facts_of.SCHEMA.names))
        self.staged = []
        new = new.dropDuplicates([CID])
        if last:
            new = new.join(self.facts().select(CID), CID, "left_anti").select(*facts_of.SCHEMA.names)
        place = f"{self.folder}/facts/epoch={last + 1}"
        new.write.mode("overwrite").parquet(place)  # what a commit that failed has left goes
        new = self.spark.read.schema(facts_of.SCHEMA).parquet(place)
        n = new.count()
        if last and not n:
            return None
        id_ = epoch_cid_of(new.select(CID), self.epoch_ids[-1] if last else None, n)
        write_mark(self.spark, f"{self.folder}/ids/{last + 1:012d}", id_.hex())
        self.epoch_ids.append(id_)
        self.active += 1
        return self._reach(new if self.monotone else None)

    def rewind(self) -> FixpointEvent | None:
        """Make the epoch before the active one active; the first is the floor."""
        if self.active <= 1:
            return None
        self.active -= 1
        return self._reach(None)

    def replay(self) -> FixpointEvent | None:
        """Move forward again."""
        if self.active >= len(self.epoch_ids):
            return None
        self.active += 1
        return self._reach(None)

    rewind_epoch, replay_epoch = rewind, replay

    def facts(self, epoch: int | None = None) -> DataFrame:
        """The facts as of an epoch (from 1; the active one by default) with the epoch that brought each."""
        upto = self.active if epoch is None else epoch
        if not self.epoch_ids:
            return self.spark.createDataFrame([], _LOGGED)
        return self.spark.read.schema(_LOGGED).parquet(f"{self.folder}/facts").filter(F.col("epoch") <= min(upto, len(self.epoch_ids)))

    def _evaluate(self, new: DataFrame | None) -> dict[str, DataFrame]:
        """Bring the program to its fixpoint with new facts, or over all; returns the rows for the sinks."""
        if new is not None:
            return self.evaluation.extend(facts_of.inputs(new))
        self.evaluation.reset()
        inputs = facts_of.inputs(self.facts())
        return self.evaluation.extend(inputs) if self.monotone else self.evaluation.run(inputs)

    def _reach(self, new: DataFrame | None) -> FixpointEvent:
        came = self._evaluate(new)
        event = FixpointEvent(Timestamp(self.active, self.evaluation.iterations), self.epoch_ids[self.active - 1])
        for relation, sinks in self.sinks.items():
            rows = came.get(relation, self.evaluation.empty(relation))
            for sink, changes in sinks:
                if not changes:
                    sink(rows)
                    continue
                now = materialize(self.evaluation.frame(relation))
                before = self._shown.get(relation, self.evaluation.empty(relation))
                sink(now.subtract(before), before.subtract(now))
                self._shown[relation] = now
        self.events.append(event)
        if self.on_fixpoint:
            self.on_fixpoint(event)
        return event

    def relation(self, name: str) -> DataFrame:
        """All rows of a relation as of the active epoch."""
        return self.evaluation.frame(name)

    def flush(self) -> None:
        """Everything staged is committed and every sink has seen it: sinks run inside ``commit``."""
        if self.staged:
            self.commit()
