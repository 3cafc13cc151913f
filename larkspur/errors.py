"""Errors of the engine."""


class EngineError(Exception):
    """Any refusal of a statement."""


class SyntaxError_(EngineError):
    """The statement can't be parsed."""


class CatalogError(EngineError):
    """A table, column or index is missing, or there already."""


class ConstraintError(EngineError):
    """NOT NULL, PRIMARY KEY, UNIQUE, a length or a range is violated."""


class SerializationError(EngineError):
    """Another transaction has committed something this one relies on."""
