"""The benchmark applications as query graphs over the generators' streams; every source takes the same stream."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.aggregates import Agg
from ..functions.expressions import Ref
from ..operators.core import Aggregate, Project, Select, StaticJoin, ThetaJoin
from ..operators.window import WindowSpec
from ..plans.query import Application, Query
from ..sources import generators
from ..streaming.bounded import in_parts, run_staged, run_to_end

_range, _rows = WindowSpec.range, WindowSpec.rows
_SEGMENT = ("segment", Ref("position") / 5280)
_PLUGS = [(c, c) for c in ("plug", "household", "house")]


def cm1(spark: SparkSession) -> Application:
    return Application([Query(1, [Aggregate(_range(60, 1), [Agg("sum", "cpu", "cpu")], [("category", "category")])])])


def cm2(spark: SparkSession) -> Application:
    return Application([Query(1, [Aggregate(_range(60, 1), [Agg("sum", "cpu", "cpu")], [("jobId", "jobId")], where=Ref("eventType") == 3)])])


def sg1(spark: SparkSession) -> Application:
    return Application([Query(1, [Aggregate(_range(3600, 1), [Agg("avg", "value", "mean")])])])


def sg2(spark: SparkSession) -> Application:
    return Application([Query(1, [Aggregate(_range(128, 1), [Agg("avg", "value", "mean")], _PLUGS)])])


def sg3_filtered(spark: SparkSession) -> Application:
    return Application([Query(1, [Aggregate(_range(3600, 1), [Agg("avg", "value", "mean")], _PLUGS, where=Ref("plug") == 3)])])


def sg3(spark: SparkSession) -> Application:
    whole = Query(1, [Aggregate(_range(128, 1), [Agg("avg", "value", "mean")])])
    local = Query(2, [Aggregate(_range(128, 1), [Agg("avg", "value", "local_mean"), Agg("cnt", None, "n")], _PLUGS)])
    meet = Query(3, [ThetaJoin(_range(1), _range(1), lambda a, b: a("mean") < b("local_mean"), small=1_000_000)])
    whole.connect_to(meet)
    local.connect_to(meet)
    return Application([whole, local, meet])


def lrb1(spark: SparkSession) -> Application:
    keys = [("highway", "highway"), ("direction", "direction"), _SEGMENT]
    return Application([Query(1, [Aggregate(_range(300, 1), [Agg("avg", "speed", "mean")], keys, having=Ref("mean") < 40)])])


def _lrb2() -> Query:
    keys = [("vehicle", "vehicle"), ("highway", "highway"), ("direction", "direction"), _SEGMENT]
    return Query(1, [Aggregate(_range(30, 1), [Agg("cnt", None, "n")], keys)])


def lrb2(spark: SparkSession) -> Application:
    return Application([_lrb2()])


def lrb3(spark: SparkSession) -> Application:
    keys = [(c, c) for c in ("highway", "direction", "segment")]
    first, second = _lrb2(), Query(2, [Aggregate(_rows(1024), [Agg("cnt", None, "m")], keys, order=("vehicle", "highway", "direction", "segment"))])
    first.connect_to(second)
    return Application([first, second])


def me1(spark: SparkSession) -> Application:
    return Application([Query(1, [Aggregate(_range(60, 1), [Agg("avg", c, f"mean_{c}") for c in ("mf01", "mf02", "mf03")])])])


def nbq5(spark: SparkSession) -> Application:
    return Application([Query(1, [Aggregate(_range(60, 1), [Agg("cnt", None, "n")], [("id", "id")], arg_max="n")])])


def ysb(spark: SparkSession) -> Application:
    join = StaticJoin(generators.campaigns(spark), "ad_id", "ad_id", ("campaign_id",))
    count = Aggregate(_range(100), [Agg("cnt", None, "n"), Agg("max", "timestamp", "latest")], [("campaign_id", "campaign_id")])
    keep = Project([("ad_id", Ref("ad_id")), ("event_type", Ref("event_type"))])
    return Application([Query(1, [keep, Select(Ref("event_type") == 0), join, count])])


#: name: (application, generator)
APPS = {
    "cm1": (cm1, generators.cluster_monitoring), "cm2": (cm2, generators.cluster_monitoring), "sg1": (sg1, generators.smart_grid),
    "sg2": (sg2, generators.smart_grid), "sg3_filtered": (sg3_filtered, generators.smart_grid), "sg3": (sg3, generators.smart_grid),
    "lrb1": (lrb1, generators.linear_road), "lrb2": (lrb2, generators.linear_road), "lrb3": (lrb3, generators.linear_road),
    "me1": (me1, generators.manufacturing), "nbq5": (nbq5, generators.auctions), "ysb": (ysb, generators.yahoo),
}


def run(spark: SparkSession, name: str, rows: int):
    """The application's result over that many generated rows, as a batch."""
    make, stream = APPS[name]
    app, df = make(spark), stream(spark, rows)
    return next(iter(app.run({q.ident: (df,) * q.inputs for q in app.sources()}).values()))


def run_stream(spark: SparkSession, name: str, rows: int, staged: bool = False, join_on_read: bool = False):
    """The application's result over that many generated rows that come in eight micro-batches, each written by as many tasks as its rows need."""
    make, stream = APPS[name]
    edges = [rows * k // 8 for k in range(9)]
    parts = max(1, -(-rows // (8 * generators.A_TASK)))
    tables = [stream(spark, generators.ids(spark, a, b, parts)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    app, df = make(spark), in_parts(spark, tables, parts)
    inputs = {q.ident: (df,) * q.inputs for q in app.sources()}
    return run_staged(spark, app, inputs, 0, join_on_read) if staged or join_on_read else run_to_end(spark, app, inputs, 0)
