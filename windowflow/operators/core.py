"""Descriptions of the operators; ``plans.batch`` and ``streaming.lower`` turn them into DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.aggregates import Agg
from ..functions.expressions import Expr, Predicate
from .window import WindowSpec


@dataclass
class Select:
    """Keeps the rows that satisfy a predicate."""

    predicate: Predicate

    def describe(self) -> str:
        return f"select {self.predicate.describe()}"


@dataclass
class Project:
    """Emits the time and (name, expression) pairs."""

    columns: list[tuple[str, Expr]]

    def describe(self) -> str:
        return "project " + ", ".join(f"{e.describe()} as {n}" for n, e in self.columns)


@dataclass
class Aggregate:
    """Windowed aggregation.

    keys are (name, expression) pairs, having a predicate over the output, arg_max the name of an aggregate
    whose largest rows of each window stay (ties too). where filters as the measure demands: before
    windows of time, inside windows of rows. Only closed windows are emitted unless emit_open. count_as names a
    trailing count of a window's rows. fill adds the windows in which nothing happened, between the first and the last, to
    ungrouped windows of time on tables.
    """

    window: WindowSpec
    aggs: list[Agg]
    keys: list[tuple[str, object]] = field(default_factory=list)
    where: Predicate | None = None
    having: Predicate | None = None
    arg_max: str | None = None
    post: Callable[[DataFrame], DataFrame] | None = None
    emit_open: bool = False
    lowering: str = "auto"
    order: tuple[str, ...] = ()
    count_as: str = ""
    fill: bool = False

    def __post_init__(self):
        if not self.aggs:
            raise ValueError("an aggregation needs an aggregate")
        names = [a.name for a in self.all_aggs] + [n for n, _ in self.keys]
        if len(set(names)) != len(names):
            raise ValueError("two outputs have the same name")
        if self.fill and (self.keys or self.window.measure != "range"):
            raise ValueError("only ungrouped windows of time can be filled")

    @property
    def all_aggs(self) -> list[Agg]:
        return [*self.aggs, Agg("cnt", None, self.count_as)] if self.count_as else list(self.aggs)

    @property
    def incremental(self) -> bool:
        return self.window.measure != "session" and 2 * self.window.slide < self.window.size

    def describe(self) -> str:
        what = ", ".join(f"{a.kind}({'*' if a.of is None else a.of}) as {a.name}" for a in self.all_aggs)
        by = f" by {', '.join(n for n, _ in self.keys)}" if self.keys else ""
        return f"aggregate {what}{by} over {self.window.describe()}{' in panes' if self.incremental else ''}"


@dataclass
class StaticJoin:
    """Inner equi-join with a static table, of whose rows with one key the first (by ``first_by``) counts."""

    table: DataFrame
    stream_key: str
    table_key: str
    columns: tuple[str, ...]
    first_by: tuple[str, ...] = ()
    broadcast_rows: int = 1_000_000

    def describe(self) -> str:
        return f"join table on {self.stream_key} = {self.table_key}"


@dataclass
class ThetaJoin:
    """Windowed stream-stream join with any predicate of (left, right) columns, or none.

    ``small``: on tables, a left side of windows of time is broadcast after a count that it has at most so many rows (0: never, nor counted).
    """

    left: WindowSpec
    right: WindowSpec
    predicate: Callable | None = None
    label: str = ""
    small: int = 0

    def describe(self) -> str:
        return f"join {self.left.describe()} with {self.right.describe()}" + (f" where {self.label}" if self.label else "")


@dataclass
class NoOp:
    def describe(self) -> str:
        return "pass"


@dataclass
class Custom:
    """Any function of a DataFrame to a DataFrame, on tables and streams; on a stream it may keep state of its own (``applyInPandasWithState``)."""

    function: Callable[[DataFrame], DataFrame]
    label: str = "custom"

    def describe(self) -> str:
        return self.label
