"""Every error that the engine raises on purpose."""

from __future__ import annotations


class StrataError(Exception):
    """Base of all errors of this package."""


class ParseError(StrataError):
    """The text is no statement of the dialect."""


class AnalysisError(StrataError):
    """Names, types or arity don't fit; raised before anything runs."""


class ExecutionError(StrataError):
    """A value made the statement fail while it ran."""


class InvalidArgument(StrataError):
    """An argument of the Python interface can't be served."""


class KeyNotFound(StrataError):
    """A point read found nothing."""


class ReservedKey(InvalidArgument):
    """The key is empty or lies in the reserved range."""


class TxConflict(StrataError):
    """Another transaction has written one of the keys since this one began."""


class TxDone(StrataError):
    """The transaction has already finished."""


class EngineClosed(StrataError):
    """The engine has been closed."""


class CorruptStore(StrataError):
    """Stored metadata or a backup stream can't be trusted."""
