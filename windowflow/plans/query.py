"""Queries and applications: pipelines of operators connected to a graph."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.core import ThetaJoin
from . import batch
from .durable import durable


@dataclass
class Query:
    """A pipeline over one input, or over two if its first operator is a ThetaJoin."""

    ident: int
    operators: list
    name: str = ""
    time: str | None = None
    conf: dict[str, str] = field(default_factory=dict)
    upstream: list[Query] = field(default_factory=list)
    downstream: list[Query] = field(default_factory=list)

    @property
    def inputs(self) -> int:
        return 2 if isinstance(self.operators[0], ThetaJoin) else 1

    def connect_to(self, other: Query) -> Query:
        """This query's output becomes an input of the other; of a join's two, the first one is left."""
        if len(other.upstream) >= other.inputs:
            raise ValueError(f"query {other.ident} takes {other.inputs} inputs")
        if len(self.downstream) >= 2:
            raise ValueError("a query feeds at most two others")
        self.downstream.append(other)
        other.upstream.append(self)
        return other

    def describe(self) -> list[str]:
        return [op.describe() for op in self.operators]

    def lower(self, *inputs: DataFrame, using=batch.lower) -> DataFrame:
        if len(inputs) != self.inputs:
            raise ValueError(f"query {self.ident} takes {self.inputs} inputs, not {len(inputs)}")
        df, time = inputs[0], self.time
        for i, op in enumerate(self.operators):
            df = using(op, df, inputs[1] if i == 0 and len(inputs) == 2 else None, time)
            time = time if time in df.columns else None
        return df

    @contextlib.contextmanager
    def configured(self, spark: SparkSession) -> Iterator[None]:
        """The session has this query's settings inside, and its own again afterwards.

        A streaming query keeps the settings with which it was started; a batch result has them if its action runs inside.
        """
        before = {k: spark.conf.get(k, None) for k in self.conf}
        try:
            for k, v in self.conf.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                if v is None:
                    spark.conf.unset(k)
                else:
                    spark.conf.set(k, v)


class Application:
    """A set of connected queries with unique numbers."""

    def __init__(self, queries: list[Query]):
        if len({q.ident for q in queries}) != len(queries):
            raise ValueError("two queries have the same number")
        self.queries = queries

    def sources(self) -> list[Query]:
        return [q for q in self.queries if not q.upstream]

    def sinks(self) -> list[Query]:
        return [q for q in self.queries if not q.downstream]

    def run(self, inputs: dict[int, tuple[DataFrame, ...]], using=batch.lower) -> dict[int, DataFrame]:
        """The sinks' DataFrames; ``inputs`` has those of every source query by number."""
        done: dict[int, DataFrame] = {}
        waiting = list(self.queries)
        while waiting:
            ready = [q for q in waiting if all(u.ident in done for u in q.upstream)]
            if not ready:
                raise ValueError("the queries form a circle")
            for q in ready:
                given = tuple(done[u.ident] for u in q.upstream) or tuple(inputs[q.ident])
                out = q.lower(*given, using=using)
                # what feeds two queries is computed once
                done[q.ident] = durable(out) if len(q.downstream) > 1 and not out.isStreaming else out
                waiting.remove(q)
        return {q.ident: done[q.ident] for q in self.sinks()}
