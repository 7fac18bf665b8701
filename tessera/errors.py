"""Errors of the engine; all derive from EngineError."""


class EngineError(Exception):
    pass


class SqlSyntaxError(EngineError):
    """The text is not in the dialect."""


class NameError_(EngineError):
    """A table, view, index or column is unknown, ambiguous or taken."""


class TypeError_(EngineError):
    """A value does not fit its column."""


class LockTimeout(EngineError):
    """Another transaction writes the table."""


class WriteConflict(EngineError):
    """The table changed after this transaction took its snapshot."""
