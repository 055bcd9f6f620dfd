"""Expressions and predicates over a stream's columns by position.

Each describes itself in infix form and becomes a Column once the schema of its input is known.
Division of two integers truncates toward zero; any other is a division of doubles.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INTEGERS = ("tinyint", "smallint", "int", "bigint")


class Expr:
    def column(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def integral(self, df: DataFrame) -> bool:
        raise NotImplementedError

    def describe(self) -> str:
        raise NotImplementedError

    def __add__(self, other):
        return Arithmetic("+", self, lift(other))

    def __sub__(self, other):
        return Arithmetic("-", self, lift(other))

    def __mul__(self, other):
        return Arithmetic("*", self, lift(other))

    def __truediv__(self, other):
        return Arithmetic("/", self, lift(other))

    def __eq__(self, other):
        return Compare("==", self, lift(other))

    def __ne__(self, other):
        return Compare("!=", self, lift(other))

    def __lt__(self, other):
        return Compare("<", self, lift(other))

    def __ge__(self, other):
        return Compare(">=", self, lift(other))

    def __gt__(self, other):
        return Compare(">", self, lift(other))

    def __le__(self, other):
        return Compare("<=", self, lift(other))

    __hash__ = object.__hash__


@dataclass(eq=False)
class Ref(Expr):
    """A column by position (0 is the time) or name."""

    at: int | str

    def name(self, df: DataFrame) -> str:
        return df.columns[self.at] if isinstance(self.at, int) else self.at

    def column(self, df: DataFrame) -> Column:
        return F.col(f"`{self.name(df)}`")

    def integral(self, df: DataFrame) -> bool:
        return dict(df.dtypes)[self.name(df)] in _INTEGERS

    def describe(self) -> str:
        return f"#{self.at}" if isinstance(self.at, int) else self.at


@dataclass(eq=False)
class Const(Expr):
    """A constant; kind is int, long, float, double, wide (128 bits, below 10^38) or string."""

    value: object
    kind: str = "int"

    def column(self, df: DataFrame) -> Column:
        if self.kind == "wide":
            return F.lit(Decimal(self.value)).cast("decimal(38,0)")
        return F.lit(self.value).cast({"long": "bigint"}.get(self.kind, self.kind))

    def integral(self, df: DataFrame) -> bool:
        return self.kind in ("int", "long")

    def describe(self) -> str:
        return repr(self.value) if self.kind in ("int", "double", "string") else f"{self.value}:{self.kind}"


def lift(x) -> Expr:
    if isinstance(x, (Expr, Predicate)):
        return x
    if isinstance(x, str):
        return Const(x, "string")
    if isinstance(x, float):
        return Const(x, "double")
    return Const(x, "int" if -(2**31) <= x < 2**31 else "long" if -(2**63) <= x < 2**63 else "wide")


@dataclass(eq=False)
class Arithmetic(Expr):
    sign: str
    left: Expr
    right: Expr

    def column(self, df: DataFrame) -> Column:
        a, b = self.left.column(df), self.right.column(df)
        if self.sign == "/" and self.integral(df):
            return F.call_function("div", a, b)
        return {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}[self.sign](a, b)

    def integral(self, df: DataFrame) -> bool:
        return self.left.integral(df) and self.right.integral(df)

    def describe(self) -> str:
        return f"({self.left.describe()} {self.sign} {self.right.describe()})"


class Predicate:
    def column(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def describe(self) -> str:
        raise NotImplementedError

    def __and__(self, other):
        return All((self, other))

    def __or__(self, other):
        return Any_((self, other))


@dataclass
class Compare(Predicate):
    sign: str
    left: Expr
    right: Expr

    def column(self, df: DataFrame) -> Column:
        by = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">=": operator.ge, ">": operator.gt, "<=": operator.le}
        return by[self.sign](self.left.column(df), self.right.column(df))

    def describe(self) -> str:
        return f"{self.left.describe()} {self.sign} {self.right.describe()}"


@dataclass
class All(Predicate):
    parts: tuple

    def column(self, df: DataFrame) -> Column:
        return functools.reduce(operator.and_, (p.column(df) for p in self.parts))

    def describe(self) -> str:
        return "(" + " and ".join(p.describe() for p in self.parts) + ")"


@dataclass
class Any_(Predicate):
    parts: tuple

    def column(self, df: DataFrame) -> Column:
        return functools.reduce(operator.or_, (p.column(df) for p in self.parts))

    def describe(self) -> str:
        return "(" + " or ".join(p.describe() for p in self.parts) + ")"


def columns_of(x: Expr | Predicate, df: DataFrame) -> set[str]:
    """The columns of ``df`` that an expression or predicate looks at; all of them if it is of a class unknown here."""
    if isinstance(x, Ref):
        return {x.name(df)}
    if isinstance(x, (Arithmetic, Compare)):
        return columns_of(x.left, df) | columns_of(x.right, df)
    if isinstance(x, (All, Any_)):
        return set().union(*(columns_of(p, df) for p in x.parts))
    return set() if isinstance(x, Const) else set(df.columns)


def as_column(x, df: DataFrame) -> Column:
    """An Expr, Predicate, Column, function of the DataFrame, or a column's position or name as a Column."""
    if isinstance(x, (Expr, Predicate)):
        return x.column(df)
    if isinstance(x, (int, str)):
        return Ref(x).column(df)
    return x if isinstance(x, Column) else x(df)
