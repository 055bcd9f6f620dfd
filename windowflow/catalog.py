"""The registered queries on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .apps import benchmarks
from .functions.aggregates import Agg
from .functions.expressions import Const, Ref
from .functions.stats import column_stats
from .operators.core import Aggregate, Custom, NoOp, Project, Select, StaticJoin, ThetaJoin
from .operators.window import WindowSpec
from .plans import batch
from .plans.query import Application, Query
from .sources import generators, readers, sinks
from .sources.generators import pick_sql
from .plans.durable import new_folder
from .streaming.bounded import add_file, in_files, run_in_parts, run_to_end
from .streaming.runtime import Runtime

HOUR, DAY = 3600, 86400
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _register(sql: str):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _epoch(c: str):
    """Seconds since 1970 of a wall-clock time, whatever the session's time zone."""
    return F.unix_date(F.to_date(c)).cast("long") * DAY + F.hour(c) * HOUR + F.minute(c) * 60 + F.second(c).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select(_epoch("ts").alias("s"), "event_id", "user_id", "event_type", "value")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.select(_epoch("l_shipdate").alias("s"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")


EV = "SELECT CAST(floor(epoch(ts)) AS BIGINT) AS s, event_id, user_id, event_type, value FROM events"
LI = "SELECT CAST(floor(epoch(l_shipdate)) AS BIGINT) AS s, * FROM lineitem"


def _range_sql(size: int, slide: int, aggs: str, keys: str = "", where: str = "true", source: str = EV, having: str = "true") -> str:
    """Windows by expanding every row: the plain meaning of what panes compute."""
    k = f"{keys}, " if keys else ""
    return f"""
WITH e AS (SELECT * FROM ({source}) WHERE {where}), b AS (SELECT min(s) AS lo, max(s) AS hi FROM e),
w AS (SELECT unnest(range((CAST(floor((s - {size}) / {slide}.0) AS BIGINT) + 1) * {slide}, (s // {slide}) * {slide} + 1, {slide})) AS window_start, * FROM e),
o AS (SELECT window_start, window_start + {size} AS window_end, {k}{aggs} FROM w, b
  WHERE window_start >= (lo // {slide}) * {slide} AND window_start + {size} <= hi GROUP BY window_start{', ' + keys if keys else ''})
SELECT * FROM o WHERE {having}"""


def _rows_sql(size: int, slide: int, aggs: str, keys: str = "", where: str = "true", source: str = EV, order: str = "s, event_id") -> str:
    k, g = (f"{keys}, ", f", {keys}") if keys else ("", "")
    return f"""
WITH e AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS rn, * FROM ({source})), n AS (SELECT count(*) AS n FROM e),
w AS (SELECT unnest(range(greatest(0, CAST(floor((rn - {size}) / {slide}.0) AS BIGINT) + 1), rn // {slide} + 1)) AS window_id, * FROM e),
t AS (SELECT window_id, max(s) AS max_ts FROM w GROUP BY window_id),
u AS (SELECT window_id, {k}{'max(s) AS max_ts, ' if keys else ''}{aggs} , count(*) FILTER (WHERE {where}) AS passing FROM w, n WHERE window_id * {slide} + {size} <= n.n GROUP BY window_id{g})
SELECT u.* EXCLUDE (passing){'' if keys else ', t.max_ts'} FROM u JOIN t USING (window_id) {'WHERE passing > 0' if keys else ''}"""


def _sum(c: str, name: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,6))) AS DOUBLE) AS {name}"


def _avg(c: str, name: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,6))) AS DOUBLE) / count({c}) AS {name}"


SUM, CNT = Agg("sum", "value", "total", exact=True), Agg("cnt", None, "n")
AVG, MIN, MAX = Agg("avg", "value", "mean", exact=True), Agg("min", "value", "low"), Agg("max", "value", "high")
TYPE, USER = ("event_type", "event_type"), ("user_id", "user_id")


# --- stateless operators


@_register(f"SELECT * FROM ({EV}) WHERE event_type = 'click'")
def selection_eq(spark, sf_dir):
    return batch.lower(Select(Ref("event_type") == "click"), events(spark, sf_dir))


@_register(f"SELECT * FROM ({EV}) WHERE (user_id < 40 AND value >= 10.0) OR event_type <> 'view' AND user_id > 100 AND value <= 50.0")
def selection_and_or(spark, sf_dir):
    low = (Ref("user_id") < 40) & (Ref("value") >= 10.0)
    high = ((Ref("event_type") != "view") & (Ref("user_id") > 100)) & (Ref("value") <= 50.0)
    return batch.lower(Select(low | high), events(spark, sf_dir))


@_register(f"SELECT s, (event_id // 7) - user_id * (5 + 3) AS a, CAST(-user_id AS BIGINT) AS b, -(user_id // 2) AS c, value * 2.0 AS d, value / 4.0 AS e FROM ({EV})")
def projection_arith(spark, sf_dir):
    e, u, v = Ref("event_id"), Ref("user_id"), Ref("value")
    five = Ref("user_id") * 0 + 5
    cols = [("a", e / 7 - u * (five + 3)), ("b", u * -1), ("c", (u * -1) / 2), ("d", v * 2.0), ("e", v / 4.0)]
    return batch.lower(Project(cols), events(spark, sf_dir))


@_register(f"SELECT s, user_id AS u, value + 1.0 AS v FROM ({EV}) WHERE user_id = 3")
def filter_project(spark, sf_dir):
    q = Query(1, [Select(Ref(2) == 3), NoOp(), Project([("u", Ref(2)), ("v", Ref("value") + 1.0)])])
    return q.lower(events(spark, sf_dir))


# --- windows of rows


def _rows(spark, sf_dir, size, slide, aggs, **more):
    return batch.lower(Aggregate(WindowSpec.rows(size, slide), aggs, order=("event_id",), **more), events(spark, sf_dir))


@_register(_rows_sql(100, 100, _sum("value", "total")))
def row_tumbling_sum(spark, sf_dir):
    return _rows(spark, sf_dir, 100, 100, [SUM])


@_register(_rows_sql(250, 100, f"{_sum('value', 'total')}, min(value) AS low, max(value) AS high, {_avg('value', 'mean')}, count(*) AS n"))
def row_sliding_sum(spark, sf_dir):
    return _rows(spark, sf_dir, 250, 100, [SUM, MIN, MAX, AVG, CNT])


@_register(_rows_sql(128, 128, "count(*) AS n, max(value) AS high", "event_type"))
def row_tumbling_grouped(spark, sf_dir):
    return _rows(spark, sf_dir, 128, 128, [CNT, MAX], keys=[TYPE])


@_register(_rows_sql(200, 50, f"CAST(sum(CAST(value AS DECIMAL(18,6))) FILTER (WHERE user_id < 75) AS DOUBLE) AS total, count(*) FILTER (WHERE user_id < 75) AS n", "event_type", "user_id < 75"))
def row_sliding_filtered(spark, sf_dir):
    return _rows(spark, sf_dir, 200, 50, [SUM, CNT], keys=[TYPE], where=Ref("user_id") < 75)


# --- windows of time


def _range(spark, sf_dir, size, slide, aggs, **more):
    return batch.lower(Aggregate(WindowSpec.range(size, slide), aggs, **more), events(spark, sf_dir))


_ALL = f"{_sum('value', 'total')}, count(*) AS n, {_avg('value', 'mean')}, min(value) AS low, max(value) AS high"


@_register(_range_sql(6 * HOUR, 6 * HOUR, _ALL))
def range_tumbling_all(spark, sf_dir):
    return _range(spark, sf_dir, 6 * HOUR, 6 * HOUR, [SUM, CNT, AVG, MIN, MAX])


@_register(_range_sql(6 * HOUR, 4 * HOUR, _ALL, "event_type"))
def range_sliding_all(spark, sf_dir):
    """Slide between half the size and the size, and no divisor of it."""
    return _range(spark, sf_dir, 6 * HOUR, 4 * HOUR, [SUM, CNT, AVG, MIN, MAX], keys=[TYPE])


@_register(_range_sql(12 * HOUR, 3 * HOUR, "CAST(sum(CAST(value * user_id AS DECIMAL(18,6))) AS DOUBLE) / CAST(sum(CAST(user_id AS DECIMAL(18,6))) AS DOUBLE) AS weighted", "event_type"))
def range_sliding_w_avg(spark, sf_dir):
    return _range(spark, sf_dir, 12 * HOUR, 3 * HOUR, [Agg("w_avg", "value", "weighted", weight="user_id", exact=True)], keys=[TYPE])


@_register(_range_sql(6 * HOUR, HOUR, _sum("value", "total"), "event_type"))
def range_sliding_sum_grouped(spark, sf_dir):
    """CM1: a sum per category."""
    return _range(spark, sf_dir, 6 * HOUR, HOUR, [SUM], keys=[TYPE])


@_register(_range_sql(6 * HOUR, HOUR, _sum("value", "total"), "user_id", "event_type = 'click'"))
def range_sliding_filter_grouped(spark, sf_dir):
    """CM2: the same per job, for one type of event."""
    return _range(spark, sf_dir, 6 * HOUR, HOUR, [SUM], keys=[USER], where=Ref("event_type") == "click")


@_register(_range_sql(60 * HOUR, 600, _avg("value", "mean")))
def range_sliding_avg_global(spark, sf_dir):
    """SG1: one average, windows of 360 slides, by a frame over panes."""
    return _range(spark, sf_dir, 60 * HOUR, 600, [AVG])


@_register(_range_sql(48 * HOUR, HOUR, f"{_avg('value', 'mean')}, max(value) AS high", "event_type"))
def range_sliding_frame_grouped(spark, sf_dir):
    return _range(spark, sf_dir, 48 * HOUR, HOUR, [AVG, MAX], keys=[TYPE], lowering="frame")


_MULTI = f"SELECT s, value, event_type, user_id % 5 AS household, user_id // 50 AS house FROM ({EV})"


@_register(_range_sql(12 * HOUR, HOUR, _avg("value", "mean"), "event_type, household, house", source=_MULTI))
def range_sliding_avg_multi_key(spark, sf_dir):
    """SG2: an average per three keys, one of them computed by integer division."""
    u = lambda df: F.pmod("user_id", F.lit(5))
    return _range(spark, sf_dir, 12 * HOUR, HOUR, [AVG], keys=[TYPE, ("household", u), ("house", Ref("user_id") / 50)])


@_register(
    f"""WITH g AS ({_range_sql(12 * HOUR, HOUR, _avg('value', 'mean'))}),
l AS ({_range_sql(12 * HOUR, HOUR, _avg('value', 'local_mean') + ', count(*) AS n', 'event_type')})
SELECT g.window_start, g.window_end, g.mean, l.window_start AS r_window_start, l.window_end AS r_window_end, l.event_type, l.local_mean, l.n
FROM g JOIN l ON g.window_start = l.window_start WHERE g.mean < l.local_mean"""
)
def local_over_global_join(spark, sf_dir):
    """SG3: windows whose local average is above the global one, as a graph of three queries."""
    w = WindowSpec.range(12 * HOUR, HOUR)
    whole, local = Query(1, [Aggregate(w, [AVG])]), Query(2, [Aggregate(w, [Agg("avg", "value", "local_mean", exact=True), CNT], [TYPE])])
    at_once = ThetaJoin(WindowSpec("range", 1, 1), WindowSpec("range", 1, 1), lambda left, r: (left("mean") < r("local_mean")) & (left("window_start") == r("window_start")))
    meet = Query(3, [at_once])
    whole.connect_to(meet)
    local.connect_to(meet)
    df = events(spark, sf_dir)
    return Application([whole, local, meet]).run({1: (df,), 2: (df,)})[3]


@_register(_range_sql(24 * HOUR, 2 * HOUR, _avg("value", "mean"), "event_type, segment", source=f"SELECT s, value, event_type, user_id // 10 AS segment FROM ({EV})", having="mean < 40"))
def segment_speed_having(spark, sf_dir):
    """LRB1: segments by integer division, HAVING on the average."""
    return _range(spark, sf_dir, 24 * HOUR, 2 * HOUR, [AVG], keys=[TYPE, ("segment", Ref("user_id") / 10)], having=Ref("mean") < 40)


_COUNTS = _range_sql(6 * HOUR, 3 * HOUR, "count(*) AS n", "event_type, segment", source=f"SELECT s, event_type, user_id // 10 AS segment FROM ({EV})")


@_register(_rows_sql(64, 64, "count(*) AS m", "event_type", source=f"SELECT window_start AS s, event_type, segment, n FROM ({_COUNTS})", order="s, event_type, segment"))
def cascade_count(spark, sf_dir):
    """LRB2 and LRB3: counts per window of time, then counts over windows of those rows."""
    first = Query(1, [Aggregate(WindowSpec.range(6 * HOUR, 3 * HOUR), [CNT], [TYPE, ("segment", Ref("user_id") / 10)])])
    second = Query(2, [Aggregate(WindowSpec.rows(64), [Agg("cnt", None, "m")], [TYPE], order=("event_type", "segment"))])
    first.connect_to(second)
    return Application([first, second]).run({1: (events(spark, sf_dir),)})[2]


@_register(_range_sql(60 * DAY, 30 * DAY, ", ".join(_avg(c, n) for c, n in (("l_quantity", "quantity"), ("l_extendedprice", "price"), ("l_discount", "discount"))), source=LI))
def multi_avg(spark, sf_dir):
    """ME1: three averages at once."""
    aggs = [Agg("avg", c, n, exact=True) for c, n in (("l_quantity", "quantity"), ("l_extendedprice", "price"), ("l_discount", "discount"))]
    return batch.lower(Aggregate(WindowSpec.range(60 * DAY, 30 * DAY), aggs), lineitem(spark, sf_dir))


@_register(f"WITH c AS ({_range_sql(12 * HOUR, HOUR, 'count(*) AS n', 'user_id')}) SELECT * FROM c QUALIFY n = max(n) OVER (PARTITION BY window_start)")
def hot_items(spark, sf_dir):
    """NBQ5: the keys with the most rows of each window, ties kept."""
    return _range(spark, sf_dir, 12 * HOUR, HOUR, [CNT], keys=[USER], arg_max="n")


_YSB = f"SELECT s, c_mktsegment FROM ({EV}) JOIN customer ON c_custkey = user_id WHERE event_type = 'view'"


@_register(_range_sql(12 * HOUR, 12 * HOUR, "count(*) AS n, max(s) AS latest", "c_mktsegment", source=_YSB))
def campaign_count(spark, sf_dir):
    """YSB: filter, join with a static table, count and latest time per campaign."""
    table = spark.read.parquet(f"{sf_dir}/customer.parquet")
    q = Query(1, [
        Select(Ref("event_type") == "view"),
        StaticJoin(table, "user_id", "c_custkey", ("c_mktsegment",)),
        Aggregate(WindowSpec.range(12 * HOUR), [CNT, Agg("max", "s", "latest")], [("c_mktsegment", "c_mktsegment")]),
    ])
    return q.lower(events(spark, sf_dir))


# --- joins


def _sides(spark, sf_dir):
    df = events(spark, sf_dir).select("s", "event_id", "user_id", "event_type", "value")
    return df.filter("event_type = 'click'").drop("event_type"), df.filter("event_type = 'view'").drop("event_type")


_L, _R = (f"(SELECT s, event_id, user_id, value FROM ({EV}) WHERE event_type = '{t}')" for t in ("click", "view"))
_BOTH = "l.s, l.event_id, l.user_id, l.value, r.s AS r_s, r.event_id AS r_event_id, r.user_id AS r_user_id, r.value AS r_value"


def _theta(spark, sf_dir, w1, w2, predicate):
    left, right = _sides(spark, sf_dir)
    return batch.lower(ThetaJoin(w1, w2, predicate), left, right, "s")


@_register(f"SELECT {_BOTH} FROM {_L} l JOIN {_R} r ON l.user_id = r.user_id AND l.s - r.s BETWEEN -7200 AND 3600")
def theta_range_join(spark, sf_dir):
    return _theta(spark, sf_dir, WindowSpec.range(7200), WindowSpec.range(3600), lambda a, b: a("user_id") == b("user_id"))


@_register(f"SELECT {_BOTH} FROM {_L} l JOIN {_R} r ON l.value < r.value AND l.s - r.s BETWEEN -1800 AND 900")
def theta_range_join_nonequi(spark, sf_dir):
    return _theta(spark, sf_dir, WindowSpec.range(1800), WindowSpec.range(900), lambda a, b: a("value") < b("value"))


@_register(f"SELECT {_BOTH} FROM {_L} l JOIN {_R} r ON l.s - r.s BETWEEN -600 AND 600")
def windowed_cross(spark, sf_dir):
    return _theta(spark, sf_dir, WindowSpec.range(600), WindowSpec.range(600), None)


def _theta_rows_sql(n1: int, n2: int, s1: int, s2: int, on: str) -> str:
    bound = lambda c, n, s: f"{s} * greatest(0, CAST(ceil(({c} - {n}) / {s}.0) AS BIGINT))"
    return f"""
WITH u AS (SELECT 1 AS side, * FROM {_L} UNION ALL SELECT 0, * FROM {_R}),
q AS (SELECT *, coalesce(sum(side) OVER w, 0) AS lc, coalesce(sum(1 - side) OVER w, 0) AS rc FROM u
  WINDOW w AS (ORDER BY s, side, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT * FROM q WHERE side = 1), r AS (SELECT * FROM q WHERE side = 0)
SELECT {_BOTH} FROM l JOIN r ON {on} AND
  (r.rc < l.rc AND r.rc >= {bound('l.rc', n2, s2)} OR l.lc < r.lc AND l.lc >= {bound('r.lc', n1, s1)})"""


@_register(_theta_rows_sql(32, 48, 1, 1, "l.user_id = r.user_id"))
def theta_row_join(spark, sf_dir):
    return _theta(spark, sf_dir, WindowSpec("rows", 32, 1), WindowSpec("rows", 48, 1), lambda a, b: a("user_id") == b("user_id"))


@_register(_theta_rows_sql(16, 16, 4, 8, "l.value < r.value"))
def theta_row_join_slide(spark, sf_dir):
    return _theta(spark, sf_dir, WindowSpec.rows(16, 4), WindowSpec.rows(16, 8), lambda a, b: a("value") < b("value"))


# --- sessions, sharing, statistics


@_register(
    f"""WITH e AS ({EV}), m AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) < 14400 THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM m),
o AS (SELECT min(s) AS window_start, max(s) + 14400 AS window_end, user_id, count(*) AS n, {_sum('value', 'total')} FROM g GROUP BY user_id, k)
SELECT * FROM o WHERE window_end <= (SELECT max(s) FROM e)"""
)
def session_count(spark, sf_dir):
    return batch.lower(Aggregate(WindowSpec.session(4 * HOUR), [CNT, SUM], [USER]), events(spark, sf_dir))


@_register(" UNION ALL ".join(f"SELECT *, '{n}' AS query FROM ({_range_sql(z, d, _sum('value', 'total'), 'event_type')})" for n, z, d in (("hour", HOUR, HOUR), ("six", 6 * HOUR, 2 * HOUR), ("day", DAY, 6 * HOUR))))
def multi_window_sum(spark, sf_dir):
    windows = {"hour": WindowSpec.range(HOUR), "six": WindowSpec.range(6 * HOUR, 2 * HOUR), "day": WindowSpec.range(DAY, 6 * HOUR)}
    return batch.multi_window(events(spark, sf_dir), "s", windows, [SUM], [TYPE])


@_register(_range_sql(48 * HOUR, HOUR, f"{_sum('value', 'total')}, count(*) AS n", "event_type"))
def pane_equivalence(spark, sf_dir):
    """The frame over panes; the SQL expands every row."""
    return _range(spark, sf_dir, 48 * HOUR, HOUR, [SUM, CNT], keys=[TYPE], lowering="frame")


@_register(
    f"""WITH e AS (SELECT row_number() OVER (ORDER BY s, event_id) AS rn, * FROM ({EV})),
p AS ({' UNION ALL '.join(f"SELECT '{c}' AS name, {c} AS v, rn FROM e" for c in ('s', 'event_id', 'user_id'))}),
r AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY name ORDER BY rn) THEN 0 ELSE 1 END AS run FROM p)
SELECT name, count(*) AS n, count(DISTINCT v) AS n_distinct, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high, CAST(sum(run) AS BIGINT) AS runs,
  count(*) >= 5 * sum(run) AS rle FROM r GROUP BY name"""
)
def column_statistics(spark, sf_dir):
    return column_stats(events(spark, sf_dir), ["s", "event_id"], ["s", "event_id", "user_id"]).select("name", "n", "n_distinct", "low", "high", "runs", "rle")


# --- the benchmark applications on generated rows


def _generated(rows: int, columns: str, where: str = "true", at: str = "id // 100") -> str:
    """``rows`` generated rows for every 10,000 events, so that the applications grow with the tables."""
    return f"SELECT {at} AS s, {columns} FROM (SELECT unnest(range(count(*) * {rows} // 10000)) AS id FROM events) WHERE {where}"


def _rows_for(spark: SparkSession, sf_dir: str, rows: int) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").count() * rows // 10_000


def _long_sql(size: int, source: str, keys: str = "") -> str:
    """Averages over windows much longer than the stream has closed ones, at a slide of 1."""
    k = f", {keys}" if keys else ""
    return f"""WITH e AS ({source}), b AS (SELECT min(s) AS lo, max(s) AS hi FROM e),
w AS (SELECT unnest(range(lo, hi - {size} + 1)) AS window_start FROM b)
SELECT window_start, window_start + {size} AS window_end{k}, sum(value) / count(*) AS mean FROM w JOIN e ON s >= window_start AND s < window_start + {size} GROUP BY window_start{k}"""


def _app(name: str, rows: int, sql: str) -> None:
    def run(spark, sf_dir):
        return benchmarks.run(spark, name, _rows_for(spark, sf_dir, rows))

    run.__name__ = f"app_{name}"
    _register(sql)(run)


_CM = _generated(40_000, f"CAST({pick_sql(6, 4)} AS INTEGER) AS category, {pick_sql(1, 500)} AS jobId, {pick_sql(4, 9)} AS kind, {pick_sql(8, 1024)} / 1024.0::DOUBLE AS cpu")
_app("cm1", 40_000, _range_sql(60, 1, "sum(cpu) AS cpu", "category", source=_CM))
_app("cm2", 40_000, _range_sql(60, 1, "sum(cpu) AS cpu", "jobId", "kind = 3", source=_CM))


def _grid(rows: int) -> str:
    keys = f"CAST({pick_sql(3, 10)} AS INTEGER) AS plug, CAST({pick_sql(4, 8)} AS INTEGER) AS household, CAST({pick_sql(5, 40)} AS INTEGER) AS house"
    return _generated(rows, f"{pick_sql(1, 6400)} / 64.0::DOUBLE AS value, {keys}")


_PLUG, _MEAN = "plug, household, house", "sum(value) / count(*) AS "
_app("sg1", 370_000, _long_sql(3600, _grid(370_000)))
_app("sg2", 16_000, _range_sql(128, 1, _MEAN + "mean", _PLUG, source=_grid(16_000)))
_app("sg3_filtered", 370_000, _long_sql(3600, f"SELECT * FROM ({_grid(370_000)}) WHERE plug = 3", _PLUG))
_app(
    "sg3", 14_000,
    f"""WITH g AS ({_range_sql(128, 1, _MEAN + "mean", source=_grid(14_000))}), l AS ({_range_sql(128, 1, _MEAN + "local_mean, count(*) AS n", _PLUG, source=_grid(14_000))})
SELECT g.*, l.window_start AS r_window_start, l.window_end AS r_window_end, {_PLUG}, local_mean, n
FROM g JOIN l ON g.window_start - l.window_start BETWEEN -1 AND 1 AND mean < local_mean""",
)


def _road(rows: int) -> str:
    keys = f"CAST({pick_sql(1, 1000)} AS INTEGER) AS vehicle, CAST({pick_sql(3, 4)} AS INTEGER) AS highway, CAST({pick_sql(5, 2)} AS INTEGER) AS direction"
    return _generated(rows, f"{keys}, {pick_sql(6, 528_000)} // 5280 AS segment, {pick_sql(2, 5120)} / 64.0::DOUBLE AS speed")


_LRB2 = _range_sql(30, 1, "count(*) AS n", "vehicle, highway, direction, segment", source=_road(4000))
_app("lrb1", 40_000, _range_sql(300, 1, "sum(speed) / count(*) AS mean", "highway, direction, segment", source=_road(40_000), having="mean < 40"))
_app("lrb2", 4000, _LRB2)
_app("lrb3", 4000, _rows_sql(1024, 1024, "count(*) AS m", "highway, direction, segment", source=f"SELECT window_start AS s, * FROM ({_LRB2})", order="s, vehicle, highway, direction, segment"))
_MF = [(f"mf0{i}", pick_sql(i, 20_000)) for i in (1, 2, 3)]
_app("me1", 40_000, _range_sql(60, 1, ", ".join(f"sum({c}) / count(*)::DOUBLE AS mean_{c}" for c, _ in _MF), source=_generated(40_000, ", ".join(f"{x} AS {c}" for c, x in _MF))))
_BID = "(id // 3 * 50 + id % 3 + 1)"
_LOT = f"({_BID} // 50 * 3 + id % 3 + 1000)"
_AUCTION = _generated(40_000, f"CASE WHEN {pick_sql(1, 100)} < 90 THEN {_LOT} // 20 * 20 ELSE {_LOT} END AS id", at=f"{_BID} // 1000")
_app("nbq5", 40_000, f"WITH c AS ({_range_sql(60, 1, 'count(*) AS n', 'id', source=_AUCTION)}) SELECT * FROM c QUALIFY n = max(n) OVER (PARTITION BY window_start)")
_app("ysb", 250_000, _range_sql(100, 100, "count(*) AS n, max(s) AS latest", "campaign_id", source=_generated(250_000, "(id % 1000) // 10 AS campaign_id", "(id % 100000) % 3 = 0", "id // 1000")))


# --- the same on streams: every row passes a file source, stateful operators with watermarks and a file sink


def _first(df: DataFrame, slide: int) -> int | None:
    """Where the first window may start: windows before it would be cut off by the stream's beginning."""
    at = df.agg(F.min("s")).first()[0]
    return None if at is None else at // slide * slide


def _stream(spark, sf_dir, app: Application, origin: int | None = None) -> DataFrame:
    df = in_files(spark, events(spark, sf_dir), "s")
    return run_to_end(spark, app, {q.ident: (df,) * q.inputs for q in app.sources()}, origin)


_SIX = WindowSpec.range(6 * HOUR, 3 * HOUR)


@_register(f"SELECT s, user_id AS u, value * 2.0 AS v FROM ({EV}) WHERE event_type = 'click' AND value > 20.0")
def stream_select_project(spark, sf_dir):
    keep = Select((Ref("event_type") == "click") & (Ref("value") > 20.0))
    return _stream(spark, sf_dir, Application([Query(1, [keep, Project([("u", Ref("user_id")), ("v", Ref("value") * 2.0)])])]))


@_register(_range_sql(6 * HOUR, 3 * HOUR, _ALL, "event_type"))
def stream_range_sliding(spark, sf_dir):
    app = Application([Query(1, [Aggregate(_SIX, [SUM, CNT, AVG, MIN, MAX], [TYPE])])])
    return _stream(spark, sf_dir, app, _first(events(spark, sf_dir), _SIX.slide))


@_register(_range_sql(12 * HOUR, 12 * HOUR, _sum("value", "total"), "user_id", having="total > 150"))
def stream_having(spark, sf_dir):
    return _stream(spark, sf_dir, Application([Query(1, [Aggregate(WindowSpec.range(12 * HOUR), [SUM], [USER], having=Ref("total") > 150)])]))


@_register(f"WITH c AS ({_range_sql(12 * HOUR, 6 * HOUR, 'count(*) AS n', 'user_id')}) SELECT * FROM c QUALIFY n = max(n) OVER (PARTITION BY window_start)")
def stream_hot_items(spark, sf_dir):
    app = Application([Query(1, [Aggregate(WindowSpec.range(12 * HOUR, 6 * HOUR), [CNT], [USER], arg_max="n")])])
    return _stream(spark, sf_dir, app, _first(events(spark, sf_dir), 6 * HOUR))


@_register(_range_sql(12 * HOUR, 12 * HOUR, "count(*) AS n", "c_mktsegment", source=_YSB))
def stream_campaign_count(spark, sf_dir):
    join = StaticJoin(spark.read.parquet(f"{sf_dir}/customer.parquet"), "user_id", "c_custkey", ("c_mktsegment",))
    count = Aggregate(WindowSpec.range(12 * HOUR), [CNT], [("c_mktsegment", "c_mktsegment")])
    return _stream(spark, sf_dir, Application([Query(1, [Select(Ref("event_type") == "view"), join, count])]))


@_register(_rows_sql(128, 64, "count(*) AS n, max(value) AS high", "event_type"))
def stream_row_windows(spark, sf_dir):
    count = Aggregate(WindowSpec.rows(128, 64), [CNT, MAX], [TYPE], order=("event_id",))
    return _stream(spark, sf_dir, Application([Query(1, [count])]))


@_register(
    f"""WITH e AS ({EV}), m AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) < 14400 THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM m),
o AS (SELECT min(s) AS window_start, max(s) + 14400 AS window_end, user_id, count(*) AS n FROM g GROUP BY user_id, k)
SELECT * FROM o WHERE window_end <= (SELECT max(s) FROM e)"""
)
def stream_sessions(spark, sf_dir):
    return _stream(spark, sf_dir, Application([Query(1, [Aggregate(WindowSpec.session(4 * HOUR), [CNT], [USER])])]))


@_register(f"SELECT {_BOTH} FROM {_L} l JOIN {_R} r ON l.user_id = r.user_id AND l.s - r.s BETWEEN -7200 AND 3600")
def stream_theta_join(spark, sf_dir):
    df = in_files(spark, events(spark, sf_dir), "s")
    sides = tuple(df.filter(F.col("event_type") == t).drop("event_type") for t in ("click", "view"))
    meet = ThetaJoin(WindowSpec.range(7200), WindowSpec.range(3600), lambda a, b: a("user_id") == b("user_id"))
    return run_to_end(spark, Application([Query(1, [meet], time="s")]), {1: sides})


@_register(_range_sql(6 * HOUR, 3 * HOUR, f"{_sum('value', 'total')}, count(*) AS n", "event_type"))
def stream_recovery(spark, sf_dir):
    """The events in three parts, each read by a new runtime that recovers windows from the one before."""
    df = events(spark, sf_dir)
    lo, hi = df.agg(F.min("s"), F.max("s")).first()
    cuts = [] if lo is None else [lo + (hi - lo) * k // 3 for k in (1, 2)]
    edges = [None, *cuts, None]
    parts = [df.filter((F.col("s") >= a if a is not None else F.lit(True)) & (F.col("s") < b if b is not None else F.lit(True))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return run_in_parts(spark, lambda: Application([Query(1, [Aggregate(_SIX, [SUM, CNT], [TYPE])])]), parts, _first(df, _SIX.slide))


@_register(_theta_rows_sql(32, 48, 1, 1, "l.user_id = r.user_id"))
def stream_theta_row_join(spark, sf_dir):
    df = in_files(spark, events(spark, sf_dir), "s")
    sides = tuple(df.filter(F.col("event_type") == t).drop("event_type") for t in ("click", "view"))
    meet = ThetaJoin(WindowSpec("rows", 32, 1), WindowSpec("rows", 48, 1), lambda a, b: a("user_id") == b("user_id"))
    return run_to_end(spark, Application([Query(1, [meet], time="s")]), {1: sides})


def _app_stream(name: str, rows: int, sql: str, staged: bool = False, join_on_read: bool = False) -> None:
    def run(spark, sf_dir):
        return benchmarks.run_stream(spark, name, _rows_for(spark, sf_dir, rows), staged, join_on_read)

    run.__name__ = f"stream_{name}"
    _register(sql)(run)


def _grown(name: str, old: int, new: int) -> str:
    """An application's SQL over another number of rows."""
    return _SQL[f"app_{name}"].replace(f"* {old} // 10000", f"* {new} // 10000")


_app_stream("cm1", 20_000, _grown("cm1", 40_000, 20_000))
_app_stream("cm2", 20_000, _grown("cm2", 40_000, 20_000))
_app_stream("sg1", 370_000, _SQL["app_sg1"])
_app_stream("sg2", 16_000, _SQL["app_sg2"])
_app_stream("sg3", 14_000, _SQL["app_sg3"], join_on_read=True)
_app_stream("lrb1", 40_000, _SQL["app_lrb1"])
_app_stream("lrb2", 4000, _SQL["app_lrb2"])
_app_stream("lrb3", 4000, _SQL["app_lrb3"], staged=True)
_app_stream("nbq5", 8000, _grown("nbq5", 40_000, 8000))
_app_stream("ysb", 250_000, _SQL["app_ysb"])


def _counted(delay_days: int = 0) -> str:
    found = _range_sql(6 * HOUR, 3 * HOUR, f"{_sum('value', 'total')}, count(*) AS n", "event_type")
    return f"SELECT * FROM ({found}) WHERE window_end <= (SELECT max(s) FROM ({EV})) - {delay_days * DAY}"


def _count_six() -> Application:
    return Application([Query(1, [Aggregate(_SIX, [SUM, CNT], [TYPE])])])


@_register(_counted())
def stream_late_rows(spark, sf_dir):
    """Rows of the first day come again, a thousand dearer, after all others: they are behind the watermark and don't count.

    Spark drops rows behind the watermark that the batch before the last one had set, so these come two batches late.
    """
    df, folder = events(spark, sf_dir), new_folder(spark, "late")
    first, last = (x or 0 for x in df.agg(F.min("s"), F.max("s")).first())
    add_file(df.filter(F.col("s") < (first + last) // 2), folder)
    add_file(df.filter(F.col("s") >= (first + last) // 2), folder)
    add_file(df.filter(F.col("s") < first + DAY).withColumn("value", F.col("value") + 1000), folder)
    stream = readers.file_stream(spark, folder, df.schema)
    return run_to_end(spark, _count_six(), {1: (stream,)}, _first(df, _SIX.slide))


@_register(_counted(20))
def stream_delayed_rows(spark, sf_dir):
    """Halves of the stream in the wrong order, with a watermark that waits for them: every row counts."""
    df, folder = events(spark, sf_dir), new_folder(spark, "delayed")
    lo, hi = (x or 0 for x in df.agg(F.min("s"), F.max("s")).first())
    add_file(df.filter(F.col("s") >= (lo + hi) // 2), folder)
    add_file(df.filter(F.col("s") < (lo + hi) // 2), folder)
    stream = readers.file_stream(spark, folder, df.schema)
    return run_to_end(spark, _count_six(), {1: (stream,)}, _first(df, _SIX.slide), delay="20 days")


@_register(_counted())
def stream_crash(spark, sf_dir):
    """The run dies in the middle of a batch, written but not committed; another one recovers from its checkpoint."""
    df, folder = events(spark, sf_dir), new_folder(spark, "crash")
    stream, origin = in_files(spark, df, "s"), _first(df, _SIX.slide)
    for fail_at in (3, None):
        run = Runtime(spark, _count_six(), f"{folder}/checkpoints", origin=origin)
        schema = run.plans({1: (stream,)})[1].schema
        try:
            run.start({1: (stream,)}, {1: sinks.each_batch(f"{folder}/out", fail_at)})
            run.wait()
        except Exception as e:
            if "failure injected" not in str(e):
                raise
        finally:
            run.stop()
    return spark.read.schema(schema).parquet(f"{folder}/out/*")


@_register(f"SELECT 8 AS batches, count(*) AS n, max(n_file) AS most, true AS ordered FROM ({EV}) CROSS JOIN (SELECT max(n) AS n_file FROM (SELECT count(*) AS n FROM ({EV}), (SELECT min(s) AS lo, max(s) - min(s) + 1 AS w FROM ({EV})) GROUP BY (s - lo) * 8 // w))")
def stream_rates(spark, sf_dir):
    """One file a batch into a discarding sink: what the metrics say of rows, batches, and percentiles of latency."""
    run = Runtime(spark, _count_six(), f"{new_folder(spark, 'rates')}/checkpoints")
    run.start({1: (in_files(spark, events(spark, sf_dir), "s"),)}, {1: sinks.discard()})
    run.wait()
    said = run.metrics.settled(8)
    run.stop()
    latency = list(said["latency_ms"].values())
    return spark.createDataFrame([(said["batches"], said["rows"], said["most_rows"], latency == sorted(latency) and latency[0] > 0)], "batches int, n long, most long, ordered boolean")


@_register(f"SELECT s, event_id, value * 2.0 AS v FROM ({EV}) WHERE event_type = 'click'")
def socket_loop(spark, sf_dir):
    """Rows from one TCP socket to another, through a selection and a projection."""
    rows = events(spark, sf_dir).select("s", "event_id", "event_type", "value")
    wanted = rows.filter("event_type = 'click'").count()
    app = Application([Query(1, [Select(Ref("event_type") == "click"), Project([("event_id", Ref("event_id")), ("v", Ref("value") * 2.0)])])])
    run = Runtime(spark, app, f"{new_folder(spark, 'socket')}/checkpoints", every="200 milliseconds")
    feeder, receiver = sinks.Feeder(readers.csv_blocks(rows), taken=run.metrics.rows), sinks.Receiver()
    source = readers.socket_stream(spark, "127.0.0.1", feeder.port, "s long, event_id long, event_type string, value double")
    try:
        run.start({1: (source,)}, {1: sinks.tcp("127.0.0.1", receiver.port)})
        sinks.wait_for(receiver, wanted, feeder, run)
        found = [(r["s"], r["event_id"], None if r.get("v") is None else float(r["v"])) for r in receiver.rows.values()]
    finally:
        run.stop()
        feeder.close()
        receiver.close()
    return spark.createDataFrame(found, "s long, event_id long, v double")


# --- sources, graphs and descriptions on tables


@_register(f"SELECT s + k * 3000000 AS s, event_id, user_id, event_type, value FROM ({EV}), (SELECT unnest(range(3)) AS k)")
def shifted_replay(spark, sf_dir):
    """The stream three times, each time 3,000,000 seconds later."""
    return readers.shifted(events(spark, sf_dir), "s", 3, 3_000_000)


@_register(f"SELECT event_type AS kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM ({EV}) GROUP BY event_type UNION ALL SELECT 'malformed', 3, 0")
def text_source(spark, sf_dir):
    """The events as separated text with three lines that aren't rows: those are counted, not lost in silence."""
    folder, schema = new_folder(spark, "text"), "s long, event_id long, event_type string, value double"
    lines = events(spark, sf_dir).select(F.concat_ws(" ", "s", "event_id", "event_type", "value").alias("value"))
    bad = spark.createDataFrame([("not a row",), ("17 x click 1.0",), ("",)], "value string").replace("", "1 2 click much")
    lines.unionByName(bad).write.text(folder)
    rows = readers.text_file(spark, folder, schema).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return rows.unionByName(readers.malformed_lines(spark, folder, schema).agg(F.lit("malformed").alias("kind"), F.count("*").alias("n"), F.lit(0).cast("long").alias("ids")))


@_register(f"WITH e AS (SELECT id AS s, {pick_sql(1, 1000, 1)} AS a, {pick_sql(2, 1000, 1)} AS b FROM (SELECT unnest(range(count(*))) AS id FROM events)) SELECT s // 100 * 100 AS window_start, s // 100 * 100 + 100 AS window_end, CAST(sum(a) AS DOUBLE) AS total, CAST(max(b) AS INTEGER) AS high FROM e GROUP BY s // 100 HAVING s // 100 * 100 + 100 <= (SELECT max(s) FROM e)")
def random_source(spark, sf_dir):
    rows = generators.random_rows(spark, _rows_for(spark, sf_dir, 10_000))
    return batch.lower(Aggregate(WindowSpec.range(100), [Agg("sum", Ref("attr1"), "total"), Agg("max", "attr2", "high")]), rows)


@_register(_range_sql(6 * HOUR, 6 * HOUR, f"{_sum('value', 'total')}, count(*) AS count", "event_type"))
def trailing_count(spark, sf_dir):
    return _range(spark, sf_dir, 6 * HOUR, 6 * HOUR, [SUM], keys=[TYPE], count_as="count")


@_register(
    f"""WITH o AS ({_range_sql(1800, 900, "count(*) AS n, max(value) AS high", where="user_id < 4")}), b AS (SELECT min(window_start) AS lo, max(window_start) AS hi FROM o),
c AS (SELECT unnest(range(lo, hi + 1, 900)) AS window_start FROM b)
SELECT window_start, window_start + 1800 AS window_end, coalesce(n, 0) AS n, high FROM c LEFT JOIN o USING (window_start)"""
)
def calendar_windows(spark, sf_dir):
    """Ungrouped windows in which nothing happened, on request."""
    return _range(spark, sf_dir, 1800, 900, [CNT, MAX], where=Ref("user_id") < 4, fill=True)


@_register(f"WITH c AS ({_range_sql(6 * HOUR, 3 * HOUR, 'count(*) AS n', 'user_id')}) SELECT 'busy' AS branch, * FROM c WHERE n >= 3 UNION ALL SELECT 'odd', * FROM c WHERE user_id > 100")
def fan_out(spark, sf_dir):
    """One query feeds two others; its windows are computed once."""
    count = Query(1, [Aggregate(_SIX, [CNT], [USER])])
    busy, odd = Query(2, [Select(Ref("n") >= 3)]), Query(3, [Select(Ref("user_id") > 100)])
    count.connect_to(busy)
    count.connect_to(odd)
    done = Application([count, busy, odd]).run({1: (events(spark, sf_dir),)})
    return done[2].select(F.lit("busy").alias("branch"), "*").unionByName(done[3].select(F.lit("odd").alias("branch"), "*"))


@_register(f"SELECT s, CAST(value + 0.5::FLOAT AS DOUBLE) AS f, event_id + 5000000000 AS l, CAST(1000000000000000000000000000000 + event_id AS VARCHAR) AS w FROM ({EV})")
def constants(spark, sf_dir):
    """Constants of every kind: float, long, and one of 128 bits."""
    cols = [("f", Ref("value") + Const(0.5, "float")), ("l", Ref("event_id") + Const(5_000_000_000, "long")), ("w", Const(10**30, "wide") + Ref("event_id"))]
    return batch.lower(Project(cols), events(spark, sf_dir)).withColumn("w", F.col("w").cast("decimal(38,0)").cast("string"))


@_register(f"SELECT event_type, CAST(hour_ AS INTEGER) AS hour_, count(*) AS n FROM (SELECT event_type, s // 3600 % 24 AS hour_ FROM ({EV})) GROUP BY ALL")
def custom_operator(spark, sf_dir):
    """Any function of a DataFrame as an operator of a query."""
    hours = Custom(lambda df: df.groupBy("event_type", F.floor(F.col("s") / 3600 % 24).cast("int").alias("hour_")).agg(F.count("*").alias("n")), "rows per hour of the day")
    return Query(1, [Select(Ref("value") == Ref("value")), hours]).lower(events(spark, sf_dir))


_PRINTED = {
    "sum": (Ref(1) + Ref("value"), "(#1 + value)"),
    "nested": (Ref("a") * 3 - Const(7, "long") / (Ref(2) - 1.5), "((a * 3) - (7:long / (#2 - 1.5)))"),
    "predicate": ((Ref("k") == "x") & ((Ref(0) >= 4) | (Ref(1) != Ref(2))), "(k == 'x' and (#0 >= 4 or #1 != #2))"),
    "select": (Select(Ref("speed") < 40), "select speed < 40"),
    "project": (Project([("b", Ref("a") * 2)]), "project (a * 2) as b"),
    "aggregate": (Aggregate(WindowSpec.range(60, 1), [Agg("sum", "cpu", "cpu"), Agg("cnt", None, "n")], [("job", "job")]), "aggregate sum(cpu) as cpu, cnt(*) as n by job over range 60/1 in panes"),
    "join": (ThetaJoin(WindowSpec.rows(8), WindowSpec.rows(4, 2), label="a == b"), "join rows 8/8 with rows 4/2 where a == b"),
}


def _values(rows, names: str) -> str:
    one = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


@_register(_values([(k, said) for k, (_, said) in _PRINTED.items()], "name, printed"))
def printed_forms(spark, sf_dir):
    return spark.createDataFrame([(k, x.describe()) for k, (x, _) in _PRINTED.items()], "name string, printed string")


_SHAPES = [(size, slide) for size in (1, 4, 6, 10, 60) for slide in (-1, 0, 1, 4, 6, 7, 60)]


@_register(f"SELECT size, slide, CASE WHEN slide > 0 AND slide <= size THEN gcd(size, slide) END AS pane, CASE WHEN slide > 0 AND slide <= size THEN size // gcd(size, slide) END AS panes FROM ({_values(_SHAPES, 'size, slide')})")
def window_shapes(spark, sf_dir):
    """Which windows are accepted, and their panes."""

    def shape(size: int, slide: int) -> tuple:
        try:
            w = WindowSpec.range(size, slide)
        except ValueError:
            return size, slide, None, None
        return size, slide, w.pane, w.panes

    return spark.createDataFrame([shape(*x) for x in _SHAPES], "size int, slide int, pane int, panes int")


@_register(_values([("AVG", "avg", True), ("Sum", "sum", True), ("cnt", "cnt", True), ("MIN", "min", False), ("max", "max", False), ("median", "none", False)], "name, kind, invertible"))
def aggregate_names(spark, sf_dir):
    """Aggregates by name, whatever its case, and whether a row can be taken out of their states again."""

    def look(name: str) -> tuple:
        try:
            a = Agg(name, "value")
        except ValueError:
            return name, "none", False
        return name, a.kind, a.invertible

    return spark.createDataFrame([look(x) for x in ("AVG", "Sum", "cnt", "MIN", "max", "median")], "name string, kind string, invertible boolean")


@_register(_values([("repeated number", True), ("third input", True), ("third output", True), ("valid", False)], "graph, refused"))
def graph_checks(spark, sf_dir):
    """Graphs that are refused: two queries of one number, more inputs than a query takes, more than two outputs."""
    make = lambda i: Query(i, [Select(Ref(0) < 1)])

    def refused(build) -> bool:
        try:
            build()
        except ValueError:
            return True
        return False

    def inputs():
        a, b, c = map(make, range(3))
        a.connect_to(c)
        b.connect_to(c)

    def outputs():
        a, *rest = map(make, range(4))
        for q in rest:
            a.connect_to(q)

    found = {"repeated number": lambda: Application([make(1), make(1)]), "third input": inputs, "third output": outputs, "valid": lambda: Application([make(1), make(2)])}
    return spark.createDataFrame([(k, refused(f)) for k, f in found.items()], "graph string, refused boolean")


@_register(_values([(1, "7", True), (2, "3", True)], "query, inside, restored"))
def query_settings(spark, sf_dir):
    """A query's settings hold while it runs and leave the session's as they were."""
    key = "spark.sql.shuffle.partitions"
    before, rows = spark.conf.get(key), []
    for q in (Query(1, [NoOp()], conf={key: "7"}), Query(2, [NoOp()], conf={key: "3"})):
        with q.configured(spark):
            inside = spark.conf.get(key)
        rows.append((q.ident, inside, spark.conf.get(key) == before))
    return spark.createDataFrame(rows, "query int, inside string, restored boolean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
