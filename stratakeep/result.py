"""What a statement gives: columns and rows, or a number of rows affected."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from .errors import ExecutionError
from .functions.render import render_json, render_table
from .plans.compile import DIVISION_BY_0


@contextmanager
def running() -> Iterator[None]:
    """Value errors of the dialect come out as its own error."""
    try:
        yield
    except PySparkException as e:
        if DIVISION_BY_0 in str(e):
            raise ExecutionError(DIVISION_BY_0) from e
        raise


class Result:
    """``columns`` (name, type) are known before the first row; rows stream from the executors.

    ``ordered`` is the lazy result in the dialect's row order, which iteration follows.
    ``dataframe`` has the same rows for further work in Spark: without a LIMIT, where order decides
    nothing, it isn't sorted.  Names may repeat.
    """

    def __init__(self, columns: list[tuple[str, str]] | None = None, dataframe: DataFrame | None = None, rows_affected: int = 0, ordered: DataFrame | None = None):
        self.columns, self.dataframe, self.rows_affected = columns or [], dataframe, rows_affected
        self.ordered = dataframe if ordered is None else ordered
        self.closed = False

    def rows(self) -> list[tuple]:
        """All rows at once."""
        if self.ordered is None or self.closed:
            return []
        with running():
            return [tuple(r) for r in self.ordered.collect()]

    def __iter__(self) -> Iterator[tuple]:
        """Rows one by one; a partition at a time is held."""
        if self.ordered is not None and not self.closed:
            with running():
                for row in self.ordered.toLocalIterator():
                    if self.closed:
                        return
                    yield tuple(row)

    def close(self) -> None:
        """Ends iteration; may be called again."""
        self.closed = True

    def __enter__(self) -> Result:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def render(self, style: str = "table") -> str:
        if style not in ("table", "json"):
            raise ValueError(f'unsupported output format "{style}" (want table or json)')
        return (render_table if style == "table" else render_json)(self.columns, self.rows(), self.rows_affected)
