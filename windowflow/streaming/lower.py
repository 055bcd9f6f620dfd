"""The operators on unbounded streams (Structured Streaming, append mode).

The time column holds seconds. Every stateful operator has a watermark of ``delay`` behind the largest time
that reaches it (after its filter), so a window is emitted once a row at or after its end has been seen.
``_event_time`` carries event time from one stateful operator to the next.

Sliding windows of time take chained aggregations: rows into panes of gcd(size, slide), and closed panes into windows, so a
row updates one state, whatever the overlap. Where windows overlap much, closed panes become intervals of windows (``intervals``), whose state is
panes; for decimals and other types that numpy doesn't merge, they go into blocks of 1, 2, 4, ... panes first, and
a closed block into the windows that hold it but not the block around it: a pane then costs about 2 log2(size / pane) updates,
not size / slide. Windows and joins of rows need the stream's one order, which
one task keeps; their states are panes and the last rows, not the stream.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.aggregates import Agg
from ..functions.expressions import as_column, columns_of
from ..operators.core import Aggregate, Custom, NoOp, Project, Select, StaticJoin, ThetaJoin
from ..operators.window import WindowSpec
from ..plans import batch
from . import intervals

EVENT_TIME = "_event_time"
#: Parts of a window that look for its largest rows on their own.
SALTS = 64
#: Windows per pane from which intervals, or blocks of panes, stand between panes and windows.
BLOCKS_FROM = 32
#: Rows whose pairs one row of a join of row windows holds.
A_BLOCK = 1024


def lowering(delay: str = "0 seconds", origin: int | None = None, packed=()):
    """A function like ``plans.batch.lower`` for streams; windows that start before origin's are dropped.

    The operators in ``packed`` leave windows as intervals (``intervals.unpacked``) where they make them and nothing looks at single windows.
    """

    def lower(op, df: DataFrame, right: DataFrame | None = None, time: str | None = None) -> DataFrame:
        time = time or df.columns[0]
        if isinstance(op, (Select, NoOp, Custom)):
            return batch.lower(op, df, time=time)
        if isinstance(op, Project):
            kept = [EVENT_TIME] if EVENT_TIME in df.columns else []
            return df.select(time, *[as_column(e, df).alias(n) for n, e in op.columns], *kept)
        if isinstance(op, StaticJoin):
            return batch.static_join(op, df)
        if isinstance(op, ThetaJoin):
            return (_theta if op.left.measure == "range" else _theta_rows)(op, df, right, time, delay)
        if op.window.measure == "rows":
            return _rows(op, df, time)
        return _windows(op, df, time, delay, origin, any(op is x for x in packed))

    return lower


def _timed(df: DataFrame, time: str, delay: str) -> DataFrame:
    if EVENT_TIME in df.columns:  # made by a stateful operator upstream, with its watermark
        return df
    return df.withColumn(EVENT_TIME, F.timestamp_seconds(F.col(time))).withWatermark(EVENT_TIME, delay)


def _windows(op: Aggregate, df: DataFrame, time: str, delay: str, origin: int | None, packed: bool = False) -> DataFrame:
    if op.where is not None:
        df = df.filter(op.where.column(df))
    df = _timed(df, time, delay)
    w, aggs, having, few = op.window, op.all_aggs, op.having, False
    keys = [n for n, _ in op.keys]
    states = reduce(lambda a, b: a | b, (a.partial(df, None) for a in aggs), {})
    seconds = lambda n: f"{n} seconds"
    first = F.session_window(EVENT_TIME, w.session_gap) if w.measure == "session" else F.window(EVENT_TIME, seconds(w.pane))
    out = df.groupBy(first.alias("_w"), *[as_column(e, df).alias(n) for n, e in op.keys]).agg(*[c.alias(n) for n, c in states.items()])
    if w.measure == "range" and not w.tumbling:
        merged = reduce(lambda a, b: a | b, (a.merged() for a in aggs), {})
        states = [c.alias(n) for n, c in merged.items()]
        if w.size // w.slide >= BLOCKS_FROM:
            if intervals.plain(out, w, keys, aggs):
                spans = intervals.spans(out, w, keys, aggs, origin, op.arg_max)
                if packed and not op.arg_max and op.post is None:
                    whole = spans.select(intervals.FROM, intervals.TO, *keys, *[a.result() for a in aggs])
                    if having is None:
                        return whole
                    if not columns_of(having, whole) & {intervals.FROM, intervals.TO, "window_start", "window_end"}:
                        return whole.filter(having.column(whole))
                out, few = intervals.expanded(spans, w), intervals.looked_through(keys, aggs, op.arg_max)
            else:
                out = _by_blocks(out, w, keys, states)
        else:
            out = out.groupBy(F.window(F.window_time("_w"), seconds(w.size), seconds(w.slide)).alias("_v"), *keys).agg(*states).withColumnRenamed("_v", "_w")
    out = out.select("_w", *keys, *[a.result() for a in aggs])
    if op.arg_max:
        out = _largest(out, op.arg_max, [] if few else keys)  # of few rows a window no parts are made
    end = F.col("_w.end") + F.expr("INTERVAL 1 MICROSECOND") if w.measure == "session" else F.col("_w.end")
    out = out.select(
        F.unix_seconds("_w.start").alias("window_start"),
        F.unix_seconds(end).alias("window_end"),
        *[c for c in out.columns if c != "_w"],
        *([F.window_time("_w").alias(EVENT_TIME)] if w.measure == "range" else []),
    )
    if origin is not None and w.measure == "range":
        out = out.filter(F.col("window_start") >= origin // w.slide * w.slide)
    if op.post is not None:
        out = op.post(out)
    return out.filter(having.column(out)) if having is not None else out


def _by_blocks(panes: DataFrame, w: WindowSpec, keys: list[str], states: list[Column]) -> DataFrame:
    """Windows from panes (_w, keys and states) by way of aligned blocks of 1, 2, 4, ... panes.

    A window is the union of the blocks that lie in it while the block of twice the length around them doesn't. A block
    ends no later than such a window, so no window waits longer than it would for its panes.
    """
    n, step, lengths = w.panes, w.panes_per_slide, [1 << k for k in range(w.panes.bit_length())]
    number = lambda end: F.floor(F.unix_seconds(end) / F.lit(w.pane)).cast("long")
    at = panes.withColumn("_p", number("_w.start")).withColumn("_n", F.explode(F.array(*[F.lit(x).cast("long") for x in lengths])))
    blocks = intervals.window(at, "_b", F.col("_p") - F.pmod("_p", "_n"), F.col("_n"), w.pane).groupBy("_b", *keys).agg(*states)

    # the first pane of the first and of the last window that takes a block
    b, m = F.col("_at"), F.col("_n")
    top, left = m == lengths[-1], F.pmod(b, 2 * m) == 0
    low = F.when(top | left, b + m - n).otherwise(b - m + 1)
    high = F.when(~top & left, b + 2 * m - n - 1).otherwise(b)
    taken = blocks.withColumn("_at", number("_b.start")).withColumn("_n", number("_b.end") - F.col("_at"))
    starts = F.filter(F.sequence(low, high), lambda x: F.pmod(x, F.lit(step)) == 0)
    visits = taken.withColumn("_s", F.explode(starts)).drop("_at", "_n")
    return intervals.window(visits, "_v", F.col("_s"), F.lit(n), w.pane).groupBy("_v", *keys).agg(*states).withColumnRenamed("_v", "_w")


def _largest(out: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The rows of every window with its largest value, ties too: the largest of every part of it first, then those of all parts."""
    names = [c for c in out.columns if c != "_w"]

    def best(df: DataFrame, *part) -> DataFrame:
        held = df.groupBy("_w", *part).agg(F.collect_list(F.struct(*names)).alias("_g"))
        held = held.withColumn("_best", F.array_max(F.transform("_g", lambda x: x[value])))
        return held.select("_w", F.explode(F.filter("_g", lambda x: x[value] == F.col("_best"))).alias("_x")).select("_w", "_x.*")

    parts = best(out.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS))), "_salt") if keys else out
    return best(parts)


def _theta(op: ThetaJoin, left: DataFrame, right: DataFrame, time: str, delay: str) -> DataFrame:
    clash = {c: f"r_{c}" if c in left.columns else c for c in right.columns}
    left, right = _timed(left, time, delay), _timed(right, time, delay)
    right = right.select(*[F.col(c).alias(n) for c, n in clash.items() if c != EVENT_TIME], F.col(EVENT_TIME).alias("_r_event_time"))
    names = [c for c in left.columns if c != EVENT_TIME], [n for c, n in clash.items() if c != EVENT_TIME]
    wide = max(1, op.left.size + op.right.size)
    rt = F.col(clash.get(time, time))
    a = left.withColumn("_b", F.floor(F.col(time) / F.lit(wide)))
    b = right.withColumn("_c", F.explode(F.sequence(F.floor((rt - op.left.size) / F.lit(wide)), F.floor((rt + op.right.size) / F.lit(wide)))))
    near = F.expr(
        f"_b = _c AND {EVENT_TIME} >= _r_event_time - INTERVAL {op.left.size} SECONDS AND {EVENT_TIME} <= _r_event_time + INTERVAL {op.right.size} SECONDS"
    )
    out = a.join(b, near)
    if op.predicate is not None:
        out = out.filter(op.predicate(lambda c: F.col(c), lambda c: F.col(clash.get(c, c))))
    return out.select(*names[0], *names[1])


_STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _in_order(c: str, kind: str) -> list[Column]:
    """Columns that pandas sorts as Spark sorts the column: nulls first, whole numbers as such."""
    whole = {"date": F.unix_date, "timestamp": F.unix_micros}.get(kind, F.col)(c)
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp"):
        return [F.col(c).isNotNull(), F.coalesce(whole.cast("long"), F.lit(0))]
    return [F.col(c).cast("string" if kind == "string" else "double")] if kind in ("string", "float", "double") or kind.startswith("decimal") else []


def _theta_rows(op: ThetaJoin, left: DataFrame, right: DataFrame, time: str, delay: str) -> DataFrame:
    """Windows of rows on both sides: a row meets the other side's last rows that came before it.

    Rows come in the order of time, at equal times the right side's first, and then of their columns, within a micro-batch; micro-batches
    must come in that order too. One task puts rows in that order and cuts them into blocks, each with the rows of both sides' windows before it, which
    are its state. Pairs are made from blocks in other tasks, and what the predicate says is decided by Spark.
    """
    left, right = left.drop(EVENT_TIME), right.drop(EVENT_TIME)
    clash = {c: f"r_{c}" if c in left.columns else c for c in right.columns}
    kinds = [df.schema for df in (left, right)]
    # rows of two sides are never compared by their columns, so sides of the same types share these
    names = ["_o", "_o" if [k for _, k in left.dtypes] == [k for _, k in right.dtypes] else "_p"]
    keys = [[x.alias(f"{o}{i}") for i, x in enumerate(x for c, k in df.dtypes for x in _in_order(c, k))] for df, o in zip((left, right), names, strict=True)]
    packed = [
        df.select(F.lit(0).alias("_one"), F.col(t).cast("long").alias("_t"), F.lit(side).alias("_side"), F.to_json(F.struct(*df.columns), _STAMPS).alias("_row"), *own)
        for df, t, side, own in ((left, time if time in left.columns else left.columns[0], 1, keys[0]), (right, time if time in right.columns else right.columns[0], 0, keys[1]))
    ]
    rows = packed[0].unionByName(packed[1], allowMissingColumns=True)
    order = ["_t", "_side", *rows.columns[4:], "_row"]
    bounds = {1: (op.left.size, op.left.slide), 0: (op.right.size, op.right.slide)}

    def cut(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # of each side: how many rows have come, and the last of them
        seen, held = pickle.loads(state.get[0]) if state.exists else ([0, 0], [[], []])
        new = pd.concat(list(frames)).sort_values(order, kind="stable", na_position="first")
        sides, texts, found = new["_side"].to_numpy(), new["_row"].to_numpy(), []
        for k in range(0, len(new), A_BLOCK):
            own, text = sides[k : k + A_BLOCK], texts[k : k + A_BLOCK]
            have = [held[x] + text[own == x].tolist() for x in (0, 1)]
            base = [seen[x] - len(held[x]) for x in (0, 1)]
            came = [seen[x] + np.cumsum(own == x) - (own == x) for x in (0, 1)]  # rows of a side before each row
            of, other = np.where(own == 1, came[1] - base[1], came[0] - base[0]), np.where(own == 1, came[0], came[1])
            size, slide = (np.where(own == 1, bounds[0][i], bounds[1][i]) for i in (0, 1))
            first = slide * np.maximum(0, -((size - other) // slide))  # the first row of the other side's window
            asks = other > first
            said = {"_own": own, "_of": of, "_first": first - np.where(own == 1, base[0], base[1]), "_n": other - first}
            found.append({"_k": seen[0] + seen[1], "_l": have[1], "_r": have[0]} | {c: x[asks].astype(np.int32) for c, x in said.items()})
            seen = [seen[x] + int((own == x).sum()) for x in (0, 1)]
            held = [have[x][-sum(bounds[x]) :] for x in (0, 1)]
            if len(found) == 32 or k + A_BLOCK >= len(new):
                yield pd.DataFrame(found)
                found = []
        state.update((pickle.dumps((seen, held)),))

    schema = "_k long, _l array<string>, _r array<string>, _own array<int>, _of array<int>, _first array<int>, _n array<int>"
    blocks = rows.groupBy("_one").applyInPandasWithState(cut, schema, "held binary", "append", GroupStateTimeout.NoTimeout)
    blocks = blocks.select("_k", "_l", "_r", F.arrays_zip("_own", "_of", "_first", "_n").alias("_asks")).repartition("_k")
    parsed = lambda c, kind: F.transform(c, lambda x: F.from_json(x, kind, _STAMPS)).alias(c)
    blocks = blocks.select(parsed("_l", kinds[0]), parsed("_r", kinds[1]), "_asks")
    pair = lambda x, y: F.struct(x.alias("l"), y.alias("r"))

    def pairs(a: Column) -> Column:
        at, first, n = F.col("_l"), a["_first"] + 1, a["_n"]
        mine = F.transform(F.slice("_r", first, n), lambda y: pair(F.get(at, a["_of"]), y))
        return F.when(a["_own"] == 1, mine).otherwise(F.transform(F.slice("_l", first, n), lambda x: pair(x, F.get(F.col("_r"), a["_of"]))))

    both = blocks.select(F.explode(F.flatten(F.transform("_asks", pairs))).alias("_x"))
    out = both.select(*[F.col(f"_x.l.`{c}`") for c in left.columns], *[F.col(f"_x.r.`{c}`").alias(n) for c, n in clash.items()])
    return out.filter(op.predicate(lambda c: F.col(c), lambda c: F.col(clash.get(c, c)))) if op.predicate is not None else out


def _pane_states(rows: pd.DataFrame, by: list[str], aggs: list[Agg]) -> pd.DataFrame:
    """Per pane and key: the latest time, passing rows, and the aggregates' states over those."""
    passing = rows["_pass"]
    out = rows[by].assign(_t=rows["_t"], _rows=passing.astype("int64"))
    for a in aggs:
        x = rows[f"_x_{a.name}"].where(passing)
        out[f"s_{a.name}"] = x
        out[f"n_{a.name}"] = rows[f"_y_{a.name}"].where(passing) if a.weight is not None else x.notna().astype("int64")
    return out.groupby(by, dropna=False, sort=False).agg(_merging(aggs)).reset_index()


def _window_states(panes: pd.DataFrame, keys: list[str], w: WindowSpec, first: int, last: int, aggs: list[Agg]) -> pd.DataFrame:
    """The states of the windows ``first`` to ``last``, of one grouping over all of them; ``panes`` are sorted."""
    ends = np.searchsorted(panes["_pane"].to_numpy(), [first * w.panes_per_slide, last * w.panes_per_slide + w.panes])
    panes = panes.iloc[ends[0] : ends[1]]
    at = panes["_pane"].to_numpy()
    low = np.maximum(first, -((w.panes - 1 - at) // w.panes_per_slide))
    many = np.maximum(0, np.minimum(last, at // w.panes_per_slide) - low + 1)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    spread = panes.iloc[np.repeat(np.arange(len(panes)), many)].assign(_window=np.repeat(low, many) + place)
    return spread.groupby(["_window", *keys], dropna=False, sort=False).agg(_merging(aggs)).reset_index()


def _merging(aggs: list[Agg]) -> dict[str, str]:
    return {"_t": "max", "_rows": "sum"} | {f"s_{a.name}": a.kind if a.kind in ("min", "max") else "sum" for a in aggs} | {f"n_{a.name}": "sum" for a in aggs}


def _result(a: Agg, own: pd.DataFrame) -> pd.Series:
    s, n = own[f"s_{a.name}"], own[f"n_{a.name}"]
    if a.kind == "cnt":
        return own["_rows"].astype("int64")
    return s / n.where(n != 0) if a.kind in ("avg", "w_avg") else s.where(n > 0)


def _rows(op: Aggregate, df: DataFrame, time: str) -> DataFrame:
    """Row windows by a counter over one key: the stream has one order, so one task keeps it.

    Rows of a micro-batch are sorted by time and tie-break, numbered and aggregated into panes; the state holds the
    panes that open windows still need. What a micro-batch holds at most is set at the source (files or bytes per trigger).
    """
    keys, w, aggs = [n for n, _ in op.keys], op.window, op.all_aggs
    passing = op.where.column(df) if op.where is not None else F.lit(True)
    args = [(as_column(a.of, df) if a.of is not None else F.lit(1)).cast("double") for a in aggs]
    args = [(x * as_column(a.weight, df) if a.weight is not None else x).alias(f"_x_{a.name}") for a, x in zip(aggs, args, strict=True)]
    args += [as_column(a.weight, df).cast("double").alias(f"_y_{a.name}") for a in aggs if a.weight is not None]
    order = [F.col(c).alias(f"_o_{c}") for c in op.order]
    rows = df.select(
        F.lit(0).alias("_one"), F.col(time).cast("long").alias("_t"), *order, F.coalesce(passing, F.lit(False)).alias("_pass"), *[as_column(e, df).alias(n) for n, e in op.keys], *args
    )
    sort = ["_t", *[f"_o_{c}" for c in op.order]]
    results = ", ".join(f"`{a.name}` {'long' if a.kind == 'cnt' else 'double'}" for a in aggs)
    types = dict(rows.dtypes)
    schema = "window_id long, max_ts long, " + "".join(f"`{k}` {types[k]}, " for k in keys) + results

    def count(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, at, held = pickle.loads(state.get[0]) if state.exists else (0, 0, None)
        new = pd.concat(list(frames)).sort_values(sort, kind="stable")
        new["_pane"] = (n + np.arange(len(new))) // w.pane
        n += len(new)
        panes = pd.concat([x for x in (held, _pane_states(new, ["_pane", *keys], aggs)) if x is not None]).sort_values("_pane", kind="stable")
        closed = max(0, (n - w.size - at) // w.slide + 1)
        # as many windows at once as hold some 500,000 rows of panes
        some = max(1, 500_000 * max(1, n // w.pane - at // w.pane) // (w.panes * max(1, len(panes))))
        for k in range(0, closed, some):
            own = _window_states(panes, keys, w, at // w.slide + k, at // w.slide + min(closed, k + some) - 1, aggs)
            own = own[own["_rows"] > 0] if keys else own
            said = {"window_id": own["_window"].astype("int64"), "max_ts": own["_t"].astype("int64")} | {k: own[k] for k in keys}
            said |= {a.name: _result(a, own) for a in aggs}
            yield pd.DataFrame(said)[["window_id", "max_ts", *keys, *[a.name for a in aggs]]]
        at += closed * w.slide
        panes = panes[panes["_pane"] >= at // w.pane]
        state.update((pickle.dumps((n, at, panes)),))

    return rows.groupBy("_one").applyInPandasWithState(count, schema, "held binary", "append", GroupStateTimeout.NoTimeout)
