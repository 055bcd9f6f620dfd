"""Window aggregates as partial states that can be merged, so panes are aggregated once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import as_column

NAMES = ("sum", "cnt", "avg", "min", "max", "w_avg")


@dataclass(frozen=True)
class Agg:
    """One aggregate: kind, argument, output name; w_avg has a weight. ``exact`` sums in DECIMAL(38,6)."""

    kind: str
    of: object = None
    name: str = ""
    weight: object = None
    exact: bool = False

    def __post_init__(self):
        kind = self.kind.lower()
        if kind not in NAMES:
            raise ValueError(f"no aggregate {self.kind!r}")
        if kind == "w_avg" and self.weight is None:
            raise ValueError("w_avg needs a weight")
        object.__setattr__(self, "kind", kind)
        object.__setattr__(self, "name", self.name or f"{kind}_{self.of if self.of is not None else 'all'}")

    @property
    def invertible(self) -> bool:
        return self.kind not in ("min", "max")

    def _number(self, x: Column) -> Column:
        return x.cast("decimal(18,6)") if self.exact else x.cast("double")

    def partial(self, df: DataFrame, keep: Column | None) -> dict[str, Column]:
        """State columns over rows; rows that fail ``keep`` don't count."""
        where = (lambda c: F.when(keep, c)) if keep is not None else (lambda c: c)
        x = as_column(self.of, df) if self.of is not None else F.lit(1)
        n = f"_s_{self.name}"
        if self.kind == "cnt":
            return {n: F.count(where(F.lit(1)))}
        if self.kind in ("min", "max"):
            return {n: getattr(F, self.kind)(where(x))}
        if self.kind == "sum":
            return {n: F.sum(where(x if str(dict(df.dtypes).get(self.of)) in ("int", "bigint") else self._number(x)))}
        if self.kind == "avg":
            return {n: F.sum(where(self._number(x))), f"{n}_n": F.count(where(x))}
        w = as_column(self.weight, df)
        return {n: F.sum(where(self._number(x * w))), f"{n}_n": F.sum(where(self._number(w)))}

    def states(self) -> dict[str, str]:
        """State columns and the function (sum, min or max) that merges each."""
        out = {f"_s_{self.name}": self.kind if self.kind in ("min", "max") else "sum"}
        if self.kind in ("avg", "w_avg"):
            out[f"_s_{self.name}_n"] = "sum"
        return out

    def merged(self) -> dict[str, Column]:
        """State columns over states."""
        return {n: getattr(F, how)(n) for n, how in self.states().items()}

    def result(self) -> Column:
        n = F.col(f"_s_{self.name}")
        if self.kind in ("avg", "w_avg"):
            d = F.col(f"_s_{self.name}_n").cast("double")
            n = F.when(d != 0, n.cast("double") / d)
        elif self.kind == "cnt":
            n = F.coalesce(n, F.lit(0)).cast("long")
        elif self.kind == "sum" and self.exact:
            n = n.cast("double")
        return n.alias(self.name)


def either(how: str, a: Column, b: Column) -> Column:
    """Two states merged; null is the state of no rows."""
    if how == "sum":
        return F.coalesce(a + b, a, b)
    return F.least(a, b) if how == "min" else F.greatest(a, b)
