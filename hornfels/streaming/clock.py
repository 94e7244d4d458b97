"""Logical time of an evaluation: (epoch, iteration) pairs under the product order."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Timestamp:
    epoch: int = 0
    iteration: int = 0

    def clock_start(self) -> Timestamp:
        return Timestamp(0, 0)

    def epoch_start(self) -> Timestamp:
        return Timestamp(self.epoch, 0)

    def advance_epoch(self) -> Timestamp:
        return Timestamp(self.epoch + 1, 0)

    def advance_iteration(self) -> Timestamp:
        return Timestamp(self.epoch, self.iteration + 1)

    def join(self, other: Timestamp) -> Timestamp:
        return Timestamp(max(self.epoch, other.epoch), max(self.iteration, other.iteration))

    def meet(self, other: Timestamp) -> Timestamp:
        return Timestamp(min(self.epoch, other.epoch), min(self.iteration, other.iteration))

    def compare(self, other: Timestamp) -> int | None:
        """-1, 0, 1, or None if neither is before the other."""
        if self == other:
            return 0
        j = self.join(other)
        return 1 if j == self else -1 if j == other else None
