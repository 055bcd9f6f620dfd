"""Sliding windows on streams by intervals of starts that hold the same panes.

Closed panes go to one of BUCKETS tasks by their key. There a window is a merge backwards over the end of one stretch of time, as long as a
window, and one forwards over the beginning of the next, as on tables; it changes only where a pane enters or leaves. The
state is the panes that open windows still need, one value a bucket, not a row for every window and key.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.aggregates import Agg
from ..operators.window import WindowSpec

#: Parts of the keys; each is a value of state, and one task works at it.
BUCKETS = 128
#: The same where every part says its largest rows of each window, so that few come together.
BEST_BUCKETS = 32
#: Panes that are merged at once in a task.
SOME = 1_000_000
#: What Spark looks for in a column to take it for a window of event time behind the watermark.
WINDOW_MARKS = {"spark.timeWindow": True, "spark.watermarkDelayMs": 0}
#: Numbers of the panes with which an interval's first and last window begin.
FROM, TO = "_from", "_to"
_MERGE = {"sum": np.add, "max": np.maximum, "min": np.fmin}
_KEYS = ("tinyint", "smallint", "int", "bigint", "string", "date")
_EMPTY = {"string": "", "date": "1970-01-01"}


def plain(panes: DataFrame, w: WindowSpec, keys: list[str], aggs: list[Agg]) -> bool:
    """Whether keys and states have types that numpy merges as Spark does."""
    types = dict(panes.dtypes)
    return all(types[k] in _KEYS for k in keys) and all(types[n] in ("double", "bigint", "int") for a in aggs for n in a.states())


def _neutral(how: str, kind: str) -> float | int:
    """What changes nothing when it is merged; Spark takes NaN for the largest number."""
    if how == "sum":
        return 0
    if kind == "double":
        return float("nan") if how == "min" else float("-inf")
    edge = np.iinfo(np.int64 if kind == "bigint" else np.int32)
    return int(edge.max if how == "min" else edge.min)


def scan(x: np.ndarray, part: np.ndarray, longest: int, merge) -> np.ndarray:
    """Running merges within runs of equal ``part``, none longer than ``longest``."""
    d = 1
    while d < longest:
        x = np.concatenate([x[:d], np.where(part[d:] == part[:-d], merge(x[d:], x[:-d]), x[d:])])
        d *= 2
    return x


def merged(key: np.ndarray, at: np.ndarray, states: dict[str, tuple[np.ndarray, object]], n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Intervals of the starts ``first`` to ``last`` of windows of ``n`` panes: a pane with their key, from, to, merged states.

    Panes have the number ``key`` of their key and the number ``at`` of their time, both sorted, each pair once.
    """
    # every start at which a pane enters or leaves a window
    size = len(at)
    wide = int(at.max() - min(at.min(), first)) + 2 * n + 4
    low = int(min(at.min(), first)) - n
    place = key * wide + (at - low)
    begins = np.unique(np.concatenate([key * wide + (np.clip(x, first, last + 1) - low) for x in (at - n + 1, at + 1)]))
    of, start = begins // wide, begins % wide + low
    # up to the key's next start, or the last one
    stop = np.where(np.append(of[1:] == of[:-1], False), np.append(start[1:], 0) - 1, last)
    a, b = np.searchsorted(place, begins), np.searchsorted(place, begins + n)
    kept = (a < b) & (start <= stop)
    of, start, stop, a, b = of[kept], start[kept], stop[kept], a[kept], b[kept] - 1
    stretch = at // n
    part = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (stretch[1:] != stretch[:-1]))) if size else key
    longest = int(np.bincount(part).max()) if size else 0
    back, ahead = stretch[a] == start // n, stretch[b] == start // n + 1
    out = {}
    for name, (x, merge) in states.items():
        left = scan(x[::-1], part[::-1], longest, merge)[::-1][a]
        right = scan(x, part, longest, merge)[b]
        out[name] = np.where(back & ahead, merge(left, right), np.where(back, left, right))
    return a, start, stop, out


class Spans(StatefulProcessor):
    """Closed panes of a bucket's keys to intervals of windows, as soon as the watermark has passed their ends."""

    def __init__(self, columns: list[str], keys: list[str], how: dict[str, str], n: int, step: int, pane: int, best: str | None):
        self.columns, self.keys, self.how, self.n, self.step, self.pane, self.best = columns, keys, how, n, step, pane, best

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getValueState("panes", "held binary")

    def close(self) -> None: ...

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        return self.advance(key, list(rows), timerValues, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self.advance(key, [], timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def advance(self, key, new: list[pd.DataFrame], times, expired: int | None) -> Iterator[pd.DataFrame]:
        # the first start that is still open, the time at which the bucket wants to be called, and panes
        at, timer, held = pickle.loads(self.held.get()[0]) if self.held.exists() else (None, None, None)
        new = [x.set_axis(["_p", "_bucket", *self.keys, *self.how], axis=1) for x in new]  # Spark renames columns that begin with _
        panes = pd.concat([x for x in (held, *new) if x is not None], ignore_index=True) if new else held
        last = times.getCurrentWatermarkInMs() // (1000 * self.pane) - self.n
        if panes is not None and len(panes):
            first = int(panes["_p"].min()) - self.n + 1
            at = first if at is None else max(at, first)
            yield from self.closed(key, panes, at, last)
            at = max(at, last + 1)
            panes = panes[panes["_p"] >= at].reset_index(drop=True)
        due = (max(at, int(panes["_p"].min()) - self.n + 1) + self.n) * self.pane * 1000 if panes is not None and len(panes) else None
        if due != timer or expired == timer:
            if timer is not None and expired != timer:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.held.update((pickle.dumps((at, due, panes)),))

    def closed(self, key, panes: pd.DataFrame, first: int, last: int) -> Iterator[pd.DataFrame]:
        if first > last:
            return
        ident = panes.groupby(self.keys, sort=False).ngroup().to_numpy() if self.keys else np.zeros(len(panes), dtype=np.int64)
        order = np.lexsort((panes["_p"].to_numpy(), ident))
        panes, ident = panes.iloc[order], ident[order].astype(np.int64)
        number = panes["_p"].to_numpy()
        pieces = max(1, -(-len(panes) // SOME))
        edges = [first + (last + 1 - first) * i // pieces for i in range(pieces + 1)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            near = (number >= a) & (number < b - 1 + self.n)
            if a == b or not near.any():
                continue
            some = panes[near] if pieces > 1 else panes
            own = ident[near] if pieces > 1 else ident
            states = {c: (some[c].to_numpy(), _MERGE[how]) for c, how in self.how.items()}
            of, start, stop, out = merged(own, some["_p"].to_numpy(), states, self.n, a, b - 1)
            start, stop = -(-start // self.step) * self.step, stop // self.step * self.step
            found = pd.DataFrame({"_from": start, "_to": stop, "_end": (stop + self.n) * self.pane} | {k: some[k].to_numpy()[of] for k in self.keys} | out)
            found = found[found["_from"] <= found["_to"]]
            if self.best:
                found = largest(found, self.best, self.step)
            found["_end"] = pd.to_datetime(found["_end"], unit="s", utc=True) - pd.Timedelta(1, "us")
            for i in range(0, len(found), 100_000):
                yield found[self.columns].iloc[i : i + 100_000]


def largest(found: pd.DataFrame, value: str, step: int) -> pd.DataFrame:
    """Of intervals those that hold the largest value of some start, cut down to the starts at which they do."""
    low = int(found["_from"].min())
    many = ((found["_to"] - found["_from"]) // step + 1).to_numpy()
    row = np.repeat(np.arange(len(found)), many)
    place = (found["_from"].to_numpy()[row] - low) // step + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    x = found[value].to_numpy()[row]
    best = np.full(int(place.max()) + 1, x.min())
    np.maximum.at(best, place, x)
    kept = x == best[place]
    row, place = row[kept], place[kept]
    # runs of starts of one interval
    fresh = np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1))
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(row)) - 1
    out = found.iloc[row[heads]].copy()
    out["_from"], out["_to"] = place[heads] * step + low, place[tails] * step + low
    return out


def looked_through(keys: list[str], aggs: list[Agg], arg_max: str | None) -> bool:
    """Whether ``spans`` leaves of a bucket only the largest rows of every window."""
    return bool(arg_max and keys and any(a.name == arg_max and a.kind == "cnt" for a in aggs))


def spans(panes: DataFrame, w: WindowSpec, keys: list[str], aggs: list[Agg], origin: int | None, arg_max: str | None = None) -> DataFrame:
    """_from and _to (numbers of panes), _end (event time), keys and states from closed panes (_w, keys and states)."""
    types, how = dict(panes.dtypes), {n: h for a in aggs for n, h in a.states().items()}
    # a null state is a neutral one that counts no rows; null keys are bits of one number
    best = f"_s_{arg_max}" if looked_through(keys, aggs, arg_max) else None
    buckets = BEST_BUCKETS if best else BUCKETS
    counted = [n for n, h in how.items() if not (n.endswith("_n") and h == "sum") and not any(a.kind == "cnt" and f"_s_{a.name}" == n for a in aggs)]
    bits = [F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)]
    nulls = [sum(bits[1:], bits[0]).cast("long").alias("_nulls")] if keys else []
    packed = panes.select(
        F.floor(F.unix_seconds("_w.start") / F.lit(w.pane)).cast("long").alias("_p"), (F.pmod(F.xxhash64(*keys), F.lit(buckets)) if keys else F.lit(0).cast("long")).alias("_bucket"),
        *[F.coalesce(F.col(k).cast("string") if types[k] == "date" else F.col(k), F.lit(_EMPTY.get(types[k], 0)).cast("string" if types[k] == "date" else types[k])).alias(k) for k in keys], *nulls,
        *[F.coalesce(F.col(n), F.lit(_neutral(h, types[n])).cast(types[n])).alias(n) for n, h in how.items()],
        *[F.when(F.col(n).isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias(f"_k{n}") for n in counted],
    )
    by = [*keys, *(["_nulls"] if keys else [])]
    merges = how | {f"_k{n}": "sum" for n in counted}
    kinds = dict(packed.dtypes)
    columns = ["_from", "_to", "_end", *by, *merges]
    schema = "_from long, _to long, _end timestamp, " + ", ".join(f"`{c}` {kinds[c]}" for c in columns[3:])
    made = packed.groupBy("_bucket").transformWithStateInPandas(
        Spans(columns, by, merges, w.panes, w.panes_per_slide, w.pane, best), schema, "Append", "EventTime", eventTimeColumnName="_end"
    )
    if origin is not None:
        made = made.withColumn("_from", F.greatest("_from", F.lit(-(-(origin // w.slide * w.slide) // w.pane))))
    null = lambda i: F.col("_nulls").bitwiseAND(F.lit(1 << i)) == 0
    return made.filter("_from <= _to").select(
        "_from", "_to", "_end", *[F.when(null(i), F.col(k).cast(types[k])).alias(k) for i, k in enumerate(keys)],
        *[(F.when(F.col(f"_k{n}") > 0, F.col(n)) if n in counted else F.col(n)).alias(n) for n in how],
    )


def window(df: DataFrame, name: str, first: Column, length: Column, pane: int) -> DataFrame:
    """``df`` with the window of event time that begins with pane number ``first`` and is ``length`` panes long."""
    ends = [F.timestamp_seconds(at * pane) for at in (first, first + length)]
    return df.withColumn(name, F.struct(ends[0].alias("start"), ends[1].alias("end"))).withMetadata(name, WINDOW_MARKS)


def unpacked(packed: DataFrame, w: WindowSpec) -> DataFrame:
    """The windows of committed intervals (FROM, TO, keys, results)."""
    starts = packed.withColumn("_s", F.explode(F.sequence(FROM, TO, F.lit(w.panes_per_slide).cast("long"))))
    start = F.col("_s") * w.pane
    return starts.select(start.alias("window_start"), (start + w.size).alias("window_end"), *[c for c in packed.columns if c not in (FROM, TO)])


def expanded(spans: DataFrame, w: WindowSpec) -> DataFrame:
    """Every window (_w) of ``spans`` with its keys and states."""
    rows = spans.drop("_end").withColumn("_s", F.explode(F.sequence("_from", "_to", F.lit(w.panes_per_slide).cast("long"))))
    return window(rows, "_w", F.col("_s"), F.lit(w.panes), w.pane).drop("_from", "_to", "_s")
