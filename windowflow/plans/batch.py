"""Operators on bounded streams (batch DataFrames).

Windows are aggregated in two steps: rows into panes of gcd(size, slide), once, and panes into windows. Where
a window has many panes, running merges over panes do the second step, so the work per pane doesn't grow with
size / slide. They work on stretches of time as long as a window, so no task holds a key's (or an
ungrouped stream's) whole time, and a key costs nothing where it has no rows. Windows of rows are windows of time over row numbers, which are
made by a range partitioning and counts per partition instead of one global sort.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import Agg, either
from ..functions.expressions import as_column
from ..operators.core import Aggregate, Custom, NoOp, Project, Select, StaticJoin, ThetaJoin
from ..operators.window import WindowSpec
from .durable import durable

#: Windows per pane from which running merges are used.
FRAME_FROM = 8
#: Parts of a stretch of time, by key, that may lie in different tasks.
SALTS = 16
#: Panes for which a task merges windows, about; each is at two places there, and cut in up to three.
A_TASK = 400_000
#: Time buckets of a join in a span as long as both its windows.
PARTS = 4


def lower(op, df: DataFrame, right: DataFrame | None = None, time: str | None = None) -> DataFrame:
    """The operator's result; time is the name of the time column (by default the first)."""
    time = time or df.columns[0]
    if isinstance(op, NoOp):
        return df
    if isinstance(op, Custom):
        return op.function(df)
    if isinstance(op, Select):
        return df.filter(op.predicate.column(df))
    if isinstance(op, Project):
        return df.select(time, *[as_column(e, df).alias(n) for n, e in op.columns])
    if isinstance(op, StaticJoin):
        return static_join(op, df)
    if isinstance(op, ThetaJoin):
        return theta_join(op, df, right, time)
    if isinstance(op, Aggregate):
        return aggregate(op, df, time)
    raise TypeError(f"no operator: {op!r}")


def aggregate(op: Aggregate, df: DataFrame, time: str) -> DataFrame:
    keys, best_only = [n for n, _ in op.keys], False
    if op.window.measure == "session":
        out = _sessions(op, df, time)
    elif op.window.measure == "rows":
        out = _row_windows(op, df, time)
    else:
        if op.where is not None:
            df = df.filter(op.where.column(df))
        panes = pane_table(df, F.col(time), op.window.pane, op.all_aggs, op.keys)
        if op.arg_max and (op.lowering == "frame" or op.lowering == "auto" and framed(op.window)):
            out, best_only = _framed_best(panes, op, keys), True
        else:
            out = roll_up(panes, op.window, op.all_aggs, keys, op.emit_open, op.lowering)
        out = _filled(out, op) if op.fill else out
    if op.arg_max and not best_only:
        at = [c for c in ("window_start", "window_id") if c in out.columns]
        out = durable(out)  # read twice
        best = durable(out.groupBy(*at).agg(F.max(op.arg_max).alias("_best")))  # written, so that a hot window's rows can be split
        out = out.join(best, at).filter(F.col(op.arg_max) == F.col("_best")).drop("_best")
    if op.post is not None:
        out = op.post(out)
    return out.filter(op.having.column(out)) if op.having is not None else out


def _filled(out: DataFrame, op: Aggregate) -> DataFrame:
    """``out`` with a row for every window between its first and its last; counts of windows without rows are 0, all else is null."""
    w, out = op.window, durable(out)
    starts = F.sequence(F.min("window_start"), F.max("window_start"), F.lit(w.slide).cast("long"))
    every = out.agg(starts.alias("s")).select(F.explode("s").alias("window_start"))
    counts = {a.name for a in op.all_aggs if a.kind == "cnt"}
    rest = [F.coalesce(c, F.lit(0)).cast("long").alias(c) if c in counts else F.col(c) for c in out.columns[2:]]
    return every.join(out.drop("window_end"), "window_start", "left").select("window_start", (F.col("window_start") + w.size).alias("window_end"), *rest)


def pane_table(df: DataFrame, at: Column, pane: int, aggs: list[Agg], keys, keep: Column | None = None, extra: dict | None = None) -> DataFrame:
    """Partial states per pane and key, with the pane's largest time (``_last``)."""
    states = reduce(lambda a, b: a | b, (a.partial(df, keep) for a in aggs), {})
    states |= {"_last": F.max(at), "_rows": F.count(F.when(keep, 1)) if keep is not None else F.count(F.lit(1))} | (extra or {})
    pane_of = (F.floor(at / F.lit(pane)) * pane).cast("long")
    return df.groupBy(pane_of.alias("_pane"), *[as_column(e, df).alias(n) for n, e in keys]).agg(*[c.alias(n) for n, c in states.items()])


def framed(w: WindowSpec) -> bool:
    return w.pane == w.slide and w.size // w.slide >= FRAME_FROM


def roll_up(panes: DataFrame, w: WindowSpec, aggs: list[Agg], keys: list[str], emit_open: bool = False, lowering: str = "auto", end: Column | None = None, extra: dict | None = None) -> DataFrame:
    """Windows from panes: window_start, window_end, keys, results; only closed ones unless ``emit_open``.

    ``end`` says up to where time has come; by default that is the largest time seen.
    """
    merged = reduce(lambda a, b: a | b, (a.merged() for a in aggs), {}) | {"_seen": F.max("_last")} | (extra or {})
    if lowering == "auto":
        lowering = "frame" if framed(w) else "explode"
    if lowering == "frame":
        panes = durable(panes)  # they are read twice
    if extra:
        merged["_rows"] = F.sum("_rows")
    # every state is named in both uses of the panes, so that their shuffles are the same and Spark makes one
    unused = {"_pane", "_last", *keys} | ({"_rows"} if "_rows" not in merged else set())
    latest = F.max(F.struct("_last", *[c for c in panes.columns if c not in unused]))["_last"]
    bounds = panes.agg(F.min("_pane").alias("_min"), (end if end is not None else latest).alias("_max"))
    if lowering == "frame":
        spans = _spans(panes, w, aggs, keys, bounds, emit_open)
        return _expanded(spans, w).select("window_start", (F.col("window_start") + w.size).alias("window_end"), *keys, *[a.name for a in aggs])
    first = (F.floor((F.col("_pane") - w.size) / F.lit(w.slide)) + 1) * w.slide
    last = F.floor(F.col("_pane") / F.lit(w.slide)) * w.slide
    spread = panes if w.tumbling else panes.withColumn("window_start", F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(w.slide).cast("long"))))
    if w.tumbling:
        spread = spread.withColumn("window_start", F.col("_pane"))
    out = spread.groupBy("window_start", *keys).agg(*[c.alias(n) for n, c in merged.items()])
    # one row: where the first window may start and how far time has come
    out = out.join(F.broadcast(bounds)).filter((F.col("_seen") <= F.col("_max")) & (F.col("window_start") >= F.floor(F.col("_min") / F.lit(w.slide)) * w.slide))
    if not emit_open:
        out = out.filter(F.col("window_start") + w.size <= F.col("_max"))
    more = [F.col(n) for n in (extra or {})]
    rows = [F.col("_rows")] if extra else []
    return out.select("window_start", (F.col("window_start") + w.size).alias("window_end"), *keys, *[a.result() for a in aggs], *more, *rows)


def _spans(panes: DataFrame, w: WindowSpec, aggs: list[Agg], keys: list[str], bounds: DataFrame, emit_open: bool) -> DataFrame:
    """``_framed`` intervals of the windows that may be emitted, with the aggregates' results."""
    if w.pane != w.slide:
        raise ValueError("a frame needs a size that is a multiple of the slide")
    out = _framed(panes, w, keys, reduce(lambda a, b: a | b, (a.states() for a in aggs), {}) | {"_rows": "sum"})
    floor = lambda c: (F.floor(c / F.lit(w.slide)) * w.slide).cast("long")
    out = out.join(F.broadcast(bounds)).withColumn("_from", F.greatest("_from", floor(F.col("_min"))))
    if not emit_open:
        out = out.withColumn("_to", F.least("_to", floor(F.col("_max") - w.size)))
    return out.filter("_from <= _to").select(*keys, "_stretch", "_from", "_to", *[a.result() for a in aggs])


def _expanded(spans: DataFrame, w: WindowSpec) -> DataFrame:
    return spans.withColumn("window_start", F.explode(F.sequence("_from", "_to", F.lit(w.slide).cast("long"))))


def _framed_best(panes: DataFrame, op: Aggregate, keys: list[str]) -> DataFrame:
    """The rows of every window with the largest ``arg_max``, without writing or joining all others."""
    w, panes = op.window, durable(panes)
    bounds = panes.agg(F.min("_pane").alias("_min"), F.max("_last").alias("_max"))
    spans = durable(_spans(panes, w, op.all_aggs, keys, bounds, op.emit_open))
    out = _best_of(spans, w, op.arg_max)
    return out.select("window_start", (F.col("window_start") + w.size).alias("window_end"), *keys, *[a.name for a in op.all_aggs])


def _framed(panes: DataFrame, w: WindowSpec, keys: list[str], states: dict[str, str]) -> DataFrame:
    """Intervals of window starts with the same merged states, by running merges: keys, _stretch, _from, _to (the last start) and
    states; the size is a multiple of the slide, a pane.

    Time is cut into stretches one window long. A window that starts in a stretch holds the end of it and
    the beginning of the next one, so a running merge backwards over the one and one forwards over
    the other give every window, for any aggregate, at a constant cost per pane. Both change only where a pane leaves or enters,
    so a pane makes at most three intervals; only panes are shuffled, and starts are expanded from intervals where they are needed.
    ``panes`` is a durable table.
    """
    own = F.floor(F.col("_pane") / F.lit(w.size)).cast("long")
    first = F.col("_pane") - w.size + w.pane  # the first start whose window holds the pane
    visits = F.array(F.struct(own.alias("stretch"), F.col("_pane").alias("at"), F.lit(True).alias("own")))
    earlier = F.struct((own - 1).alias("stretch"), first.alias("at"), F.lit(False).alias("own"))
    visits = F.when(first < own * w.size, F.array_append(visits, earlier)).otherwise(visits)
    placed = panes.select(*keys, *states, F.explode(visits).alias("_v"))
    placed = placed.select(*keys, *states, F.col("_v.stretch").alias("_stretch"), F.col("_v.at").alias("_pane_at"), F.col("_v.own").alias("_own"))
    # by stretch first, so that few stretches come together in a task, whose windows are then few too
    placed = placed.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)) if keys else F.lit(0))
    tasks = -(-panes.count() // A_TASK)  # of a table that was written, so no rows are read
    usual = int(panes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(*([tasks] if tasks > usual else []), "_stretch", "_salt")
    # a pane's own place, the start after it, and the stretch's first start; nothing of it counts at the last two
    begin, end = F.col("_stretch") * w.size, (F.col("_stretch") + 1) * w.size
    cuts = F.array(F.struct(F.col("_pane_at").alias("at"), F.lit(True).alias("counts")), F.struct(begin.alias("at"), F.lit(False).alias("counts")))
    after = F.struct((F.col("_pane_at") + w.pane).alias("at"), F.lit(False).alias("counts"))
    cuts = F.when(F.col("_own") & (F.col("_pane_at") + w.pane < end), F.array_append(cuts, after)).otherwise(cuts)
    placed = placed.withColumn("_c", F.explode(cuts))
    side = {"_a": F.col("_c.counts") & F.col("_own"), "_b": F.col("_c.counts") & ~F.col("_own")}
    placed = placed.select(*keys, "_salt", "_stretch", F.col("_c.at").alias("_at"), *[F.when(on, F.col(c)).alias(f"{s}{c}") for s, on in side.items() for c in states])
    part = Window.partitionBy("_stretch", "_salt", *keys)
    back = part.orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = part.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.coalesce(F.lead("_at").over(part.orderBy("_at")), (F.col("_stretch") + 1) * w.size)
    merged = placed.select(
        *keys, "_stretch", F.col("_at").alias("_from"), (following - w.slide).alias("_to"),
        *[getattr(F, how)(f"{s}{c}").over(frame).alias(f"{s}{c}") for s, frame in (("_a", back), ("_b", ahead)) for c, how in states.items()],
    ).filter("_from <= _to")
    out = merged.select(*keys, "_stretch", "_from", "_to", *[either(how, F.col(f"_a{c}"), F.col(f"_b{c}")).alias(c) for c, how in states.items()])
    return out.filter("_rows > 0")


def _best_of(spans: DataFrame, w: WindowSpec, value: str) -> DataFrame:
    """Of intervals of starts within stretches, every start with its largest values, ties too.

    A stretch's largest value by start is one array, as long as a window has slides, by which the intervals are looked through before they are expanded.
    """
    starts = F.sequence("_from", "_to", F.lit(w.slide).cast("long"))
    place = lambda x: ((x - F.col("_stretch") * w.size) / F.lit(w.slide)).cast("int")
    best = spans.select("_stretch", value, F.explode(starts).alias("_x")).groupBy("_stretch", "_x").agg(F.max(value).alias("_n"))
    # starts without rows have no value: the array is by place
    best = best.groupBy("_stretch").agg(F.map_from_entries(F.collect_list(F.struct(place(F.col("_x")).alias("k"), F.col("_n").alias("v")))).alias("_m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(w.size // w.slide - 1)), lambda k: F.element_at("_m", k))
    best = durable(best.select("_stretch", every.alias("_best")))  # written, so that a hot stretch can be split
    found = F.filter(starts, lambda x: F.get(F.col("_best"), place(x)) == F.col(value))
    return spans.join(best, "_stretch").withColumn("window_start", F.explode(found)).drop("_best")


def numbered(df: DataFrame, order: list[str], name: str = "_rn", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their number from 0 in the stream's order, first numbers per partition).

    Rows are range-partitioned and sorted within partitions; a partition's first number is the count of
    the rows before it. The second frame has a row per partition, which bounds its broadcast.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = durable(ranged.withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    out = placed.join(F.broadcast(offsets.drop("_size")), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_before", "_place", "_part")
    return out, offsets


def _row_windows(op: Aggregate, df: DataFrame, time: str) -> DataFrame:
    """window_id, max_ts, keys, results of the complete windows of rows.

    Rows are numbered before the predicate, which works inside the window only.
    """
    keys = [n for n, _ in op.keys]
    rows, offsets = numbered(df, [time, *op.order])
    keep = op.where.column(rows) if op.where is not None else None
    panes = pane_table(rows, F.col("_rn"), op.window.pane, op.all_aggs, op.keys, keep, {"_ts": F.max(time)})
    total = offsets.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("_total"))
    panes = panes.join(F.broadcast(total))
    out = roll_up(panes, op.window, op.all_aggs, keys, op.emit_open, "explode", end=F.max("_total"), extra={"_ts": F.max("_ts")})
    if keys:
        out = out.filter(F.col("_rows") > 0)
    return out.select((F.col("window_start") / op.window.slide).cast("long").alias("window_id"), F.col("_ts").alias("max_ts"), *keys, *[a.name for a in op.all_aggs])


def _sessions(op: Aggregate, df: DataFrame, time: str) -> DataFrame:
    if op.where is not None:
        df = df.filter(op.where.column(df))
    states = reduce(lambda a, b: a | b, (a.partial(df, None) for a in op.all_aggs), {})
    keys = [n for n, _ in op.keys]
    out = df.groupBy(F.session_window(F.timestamp_seconds(time), op.window.session_gap).alias("_w"), *[as_column(e, df).alias(n) for n, e in op.keys]).agg(*[c.alias(n) for n, c in states.items()])
    out = out.select(F.unix_seconds("_w.start").alias("window_start"), F.unix_seconds(F.col("_w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("window_end"), *keys, *[a.result() for a in op.all_aggs])
    if op.emit_open:
        return out
    return out.join(F.broadcast(df.agg(F.max(time).alias("_max")))).filter("window_end <= _max").drop("_max")


def multi_window(df: DataFrame, time: str, windows: dict[str, WindowSpec], aggs: list[Agg], keys=()) -> DataFrame:
    """Several windows over one stream from one pane table at the gcd of all sizes and slides."""
    pane = math.gcd(*[x for w in windows.values() for x in (w.size, w.slide)])
    panes = durable(pane_table(df, F.col(time), pane, aggs, list(keys)))
    names = [n for n, _ in keys]

    def one(name: str, w: WindowSpec) -> DataFrame:
        coarse = panes.withColumn("_pane", (F.floor(F.col("_pane") / F.lit(w.pane)) * w.pane).cast("long"))
        states = reduce(lambda a, b: a | b, (a.merged() for a in aggs), {}) | {"_last": F.max("_last"), "_rows": F.sum("_rows")}
        coarse = coarse.groupBy("_pane", *names).agg(*[c.alias(n) for n, c in states.items()])
        return roll_up(coarse, w, aggs, names).withColumn("query", F.lit(name))

    return reduce(DataFrame.unionByName, (one(n, w) for n, w in windows.items()))


def static_join(op: StaticJoin, df: DataFrame) -> DataFrame:
    """Broadcasts the table only after counting that it has at most ``broadcast_rows`` rows."""
    table = op.table.select(F.col(op.table_key).alias("_key"), *op.columns, *[c for c in op.first_by if c not in op.columns])
    first = F.min(F.struct(*[F.col(c) for c in (*op.first_by, *[c for c in op.columns if c not in op.first_by])])).alias("_first")
    table = table.groupBy("_key").agg(first).select("_key", *[F.col(f"_first.{c}").alias(c) for c in op.columns])
    if op.table.limit(op.broadcast_rows + 1).count() <= op.broadcast_rows:
        table = F.broadcast(table)
    return df.join(table, df[op.stream_key] == table["_key"]).drop("_key")


def theta_join(op: ThetaJoin, left: DataFrame, right: DataFrame, time: str) -> DataFrame:
    """left ++ right, right's columns with the prefix r_ where a name is taken twice.

    Range windows: left.time - right.time between -size(left) and size(right). Row windows: a row meets
    the other side's last rows that came before it; at equal times the right side comes first.
    """
    clash = {c: f"r_{c}" if c in left.columns else c for c in right.columns}
    right = right.select(*[F.col(c).alias(n) for c, n in clash.items()])
    r_time = clash[time] if time in clash else right.columns[0]
    out = (_theta_range if op.left.measure == "range" else _theta_rows)(op, left, right, time, r_time)
    if op.predicate is not None:
        out = out.filter(op.predicate(lambda c: F.col(c), lambda c: F.col(clash.get(c, c))))
    return out.select(*left.columns, *right.columns)


def _in_buckets(left: DataFrame, right: DataFrame, at: Column, lo: Column, hi: Column, wide: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_b``, a PARTS-th as wide as both windows; a right row visits PARTS + 1 buckets.

    Of the pairs that share a bucket about 1 in PARTS + 1 is too far apart; it would be half of them in buckets as wide as both windows. Where
    much happens at once pairs grow with the square of the rows, and visits only with the rows.
    """
    step = wide // PARTS or wide
    a = left.withColumn("_b", F.floor(at / F.lit(step)))
    return a, right.withColumn("_b", F.explode(F.sequence(F.floor(lo / F.lit(step)), F.floor(hi / F.lit(step)))))


def _theta_range(op: ThetaJoin, left: DataFrame, right: DataFrame, lt: str, rt: str) -> DataFrame:
    """An equi-join on time buckets."""
    lo, hi = F.col(rt) - op.left.size, F.col(rt) + op.right.size
    a, b = _in_buckets(left, right, F.col(lt), lo, hi, max(1, op.left.size + op.right.size))
    if op.small and not left.isStreaming and left.limit(op.small + 1).count() <= op.small:
        a = F.broadcast(a)  # the other side, which may be windows expanded from few panes, isn't shuffled
    return a.join(b, "_b").filter((F.col(lt) >= lo) & (F.col(lt) <= hi))


def _theta_rows(op: ThetaJoin, left: DataFrame, right: DataFrame, lt: str, rt: str) -> DataFrame:
    n1, n2, s1, s2 = op.left.size, op.right.size, op.left.slide, op.right.slide
    packed = [df.select(F.lit(side).alias("_side"), F.col(t).alias("_t"), F.struct(*df.columns).alias("_row")) for df, t, side in ((left, lt, 1), (right, rt, 0))]
    kinds = [p.schema["_row"].dataType for p in packed]
    none = [F.lit(None).cast(k) for k in kinds]
    sides = packed[0].select("_side", "_t", F.col("_row").alias("_l"), none[1].alias("_r"))
    sides = sides.unionByName(packed[1].select("_side", "_t", none[0].alias("_l"), F.col("_row").alias("_r")))
    rows = durable(numbered(sides, ["_t", "_side", "_l", "_r"])[0])
    # rows of either side that came before: a row's own sequence number, and where the other side stands
    rows = rows.join(_running(rows), "_rn")
    a = rows.filter("_side = 1").select(F.col("_lefts").alias("_ls"), F.col("_rights").alias("_rc"), "_l")
    b = rows.filter("_side = 0").select(F.col("_rights").alias("_rs"), F.col("_lefts").alias("_lc"), "_r")

    def meet(asking: DataFrame, count: str, asked: DataFrame, seq: str, size: int, slide: int) -> DataFrame:
        gone = F.greatest(F.lit(0), F.ceil((F.col(count) - size) / F.lit(slide))) * slide
        probes = asking.withColumn("_from", gone).filter(F.col("_from") < F.col(count))
        probes = probes.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / F.lit(size)), F.floor((F.col(count) - 1) / F.lit(size)))))
        found = probes.join(asked.withColumn("_b", F.floor(F.col(seq) / F.lit(size))), "_b")
        return found.filter((F.col(seq) >= F.col("_from")) & (F.col(seq) < F.col(count))).select("_l", "_r")

    both = meet(a, "_rc", b, "_rs", n2, s2).union(meet(b, "_lc", a, "_ls", n1, s1))
    return both.select("_l.*", "_r.*")


def offsets(sums: DataFrame, block: int = 1 << 14) -> DataFrame:
    """``sums`` (_k, _n) with ``_before``, the sum of _n over smaller _k, in two levels, so that no task sees more than ``block`` keys' rows or blocks' sums."""
    own = F.floor(F.col("_k") / F.lit(block))
    sums = sums.withColumn("_b", own)
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("_b").agg(F.sum("_n").alias("_n"))
    blocks = blocks.select("_b", before(Window.orderBy("_b")).alias("_base"))
    inside = sums.withColumn("_inside", before(Window.partitionBy("_b").orderBy("_k")))
    return inside.join(blocks, "_b").select("_k", "_n", (F.col("_base") + F.col("_inside")).alias("_before"))


def _running(rows: DataFrame) -> DataFrame:
    """_rn with the numbers of left and right rows before it, by blocks and offsets of blocks."""
    block = 1 << 16
    at = rows.select("_rn", "_side", F.floor(F.col("_rn") / F.lit(block)).alias("_k"))
    before = offsets(at.groupBy("_k").agg(F.sum("_side").alias("_n"))).drop("_n")
    own = F.coalesce(F.sum("_side").over(Window.partitionBy("_k").orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = at.withColumn("_own", own).join(before, "_k").withColumn("_lefts", F.col("_before") + F.col("_own"))
    return out.select("_rn", "_lefts", (F.col("_rn") - F.col("_lefts")).alias("_rights"))
