"""Errors of building and running programs; each carries what it is about in ``args``."""

from __future__ import annotations


class HornError(Exception):
    """Any error of this library."""


class InternalEngineError(HornError):
    """A bug of the engine."""


class ProgramUnstratifiable(HornError):
    """A relation depends on itself through negation or aggregation."""


class ClauseNotRangeRestricted(HornError):
    """(column, variable): a head variable that the body does not bind."""


class ClauseNotDomainIndependent(HornError):
    """(variable): used by a predicate or a negation, but bound by no positive atom."""


class DuplicateDeclarationCol(HornError):
    """(relation, column)"""


class ConflictingRelationDeclaration(HornError):
    """(relation): declared twice."""


class ConflictingColumnBinding(HornError):
    """(relation, column): bound twice."""


class UnrecognizedColumnBinding(HornError):
    """(relation, column)"""


class ColumnMissing(HornError):
    """(relation, column): a fact or head that leaves a column unset."""


class UnrecognizedRelation(HornError):
    """(relation)"""


class ClauseHeadEDB(HornError):
    """(relation): inputs cannot be derived."""


class TypeMismatch(HornError):
    """(type, type)"""


class ColumnValueTypeConflict(HornError):
    """(relation, column, value or variable, type of the column)"""


class NonGroundFact(HornError):
    """(relation, column, variable)"""


class AggregationUnboundGroupBy(HornError):
    """(relation, column, variable): kept for completeness; an unbound key shows as ClauseNotRangeRestricted."""


class AggregationUnboundArgument(HornError):
    """(relation, variable): an argument that the aggregation's bindings do not mention."""


class AggregationBoundTarget(HornError):
    """(variable): the target is bound already."""


class ContentAddressedIDB(HornError):
    """(relation): only inputs have content ids."""
