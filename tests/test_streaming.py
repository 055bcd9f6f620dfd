import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_windows import AGGS, SCHEMA, stream

from windowflow.functions.aggregates import Agg
from windowflow.functions.expressions import Ref
from windowflow.operators.core import Aggregate, Select, ThetaJoin
from windowflow.operators.window import WindowSpec
from windowflow.plans.durable import new_folder
from windowflow.plans.query import Application, Query
from windowflow.sources import generators, readers, sinks
from windowflow.apps import benchmarks
from windowflow.streaming import bounded, intervals, lower
from windowflow.streaming.bounded import in_parts, run_to_end
from windowflow.streaming.runtime import Metrics, Runtime


def feed(spark, path, rows, parts=4):
    """Files of rows in the stream's order, read one by one."""
    n = -(-len(rows) // parts)
    for i in range(0, len(rows), n):
        spark.createDataFrame(rows[i : i + n], SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    return readers.file_stream(spark, str(path), spark.createDataFrame([], SCHEMA).schema)


def both(spark, tmp_path, make, rows, others=None):
    """The results of a stream, in two runs on one checkpoint, and of the same rows as a batch."""
    source = tmp_path / "in"
    inputs = lambda: (feed(spark, source, []),)
    half = len(rows) // 2
    for i, part in enumerate((rows[:half], rows[half:])):
        df = feed(spark, source, part)
        app = make()
        run = Runtime(spark, app, str(tmp_path / "check"), origin=rows[0][0])
        run.start({q.ident: (df,) * q.inputs for q in app.sources()}, {q.ident: sinks.files(str(tmp_path / f"out{q.ident}")) for q in app.sinks()})
        run.wait()
        run.stop()
    app = make()
    whole = spark.createDataFrame(rows, SCHEMA)
    want = app.run({q.ident: (whole,) * q.inputs for q in app.sources()})
    (ident, df), = want.items()
    cols = sorted(df.columns)
    norm = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in (r[c] for c in cols)) for r in rows)
    return norm(spark.read.parquet(str(tmp_path / f"out{ident}")).collect()), norm(df.collect())


MAKE = {
    "range": lambda: Application([Query(1, [Select(Ref("v") < -5.0), Aggregate(WindowSpec.range(10, 2), AGGS, [("k", "k")])])]),
    "having": lambda: Application([Query(1, [Aggregate(WindowSpec.range(10), AGGS, [("k", "k")], having=Ref("n") > 3)])]),
    "arg_max": lambda: Application([Query(1, [Aggregate(WindowSpec.range(10, 5), [Agg("cnt", None, "n")], [("k", "k")], arg_max="n")])]),
    "rows": lambda: Application([Query(1, [Aggregate(WindowSpec.rows(10, 4), AGGS, [("k", "k")], where=Ref("v") < -5.0, order=("id",))])]),
    "join": lambda: Application([Query(1, [ThetaJoin(WindowSpec.range(2), WindowSpec.range(1), lambda a, b: a("k") != b("k"))])]),
}


@pytest.mark.parametrize("name", sorted(MAKE))
def test_stream_equals_batch_after_a_restart(spark, tmp_path, name):
    got, want = both(spark, tmp_path, MAKE[name], stream(7, 80))
    assert want
    assert got == want


def test_sessions(spark, tmp_path):
    rows = stream(8, 80)
    got, want = both(spark, tmp_path, lambda: Application([Query(1, [Aggregate(WindowSpec.session(3), AGGS, [("k", "k")])])]), rows)
    assert want
    # a session that ends when the last row comes waits for the next one: Spark ends sessions that lie before the watermark
    ends = sorted(["high", "k", "low", "mean", "n", "total", "window_end", "window_start"]).index("window_end")
    assert set(want) - set(got) <= {r for r in want if r[ends] == rows[-1][0]} and set(got) <= set(want)


def test_sliding_windows_update_one_state_a_row(spark, tmp_path):
    """Rows go into panes; only panes are expanded to windows."""
    app = MAKE["range"]()
    run = Runtime(spark, app, str(tmp_path / "check"))
    plan = run.plans({1: (feed(spark, tmp_path / "in", stream(7, 40)),)})[1]._jdf.queryExecution().analyzed().toString()
    run.stop()
    first, last = plan.rindex("Aggregate ["), plan.index("Aggregate [")
    assert plan.count("Aggregate [") == 2
    assert "Expand" not in plan[first:] and "Expand" in plan[last:first]


@pytest.mark.parametrize("window", [(13, 1), (16, 1), (10, 3), (14, 4)])
def test_windows_by_blocks(spark, tmp_path, monkeypatch, window):
    monkeypatch.setattr(lower, "BLOCKS_FROM", 2)
    got, want = both(spark, tmp_path, lambda: Application([Query(1, [Aggregate(WindowSpec.range(*window), AGGS, [("k", "k")])])]), stream(11, 80))
    assert want and got == want


def test_row_windows_hold_panes(spark):
    rows = pd.DataFrame({"_pane": [0, 0, 1, 1], "k": ["a", None, "a", "a"], "_t": [1, 2, 3, 4], "_pass": [True, True, False, True], "_x_total": [1.0, None, 5.0, 7.0], "_x_low": [1.0, 2.0, 3.0, 4.0]})
    got = lower._pane_states(rows, ["_pane", "k"], [Agg("sum", "v", "total"), Agg("min", "v", "low")])
    assert len(got) == 3
    last = got[got["_pane"] == 1].iloc[0]
    assert (last["_t"], last["_rows"], last["s_total"], last["n_total"], last["s_low"]) == (4, 1, 7.0, 1, 4.0)


@pytest.mark.parametrize("sizes", [(3, 5, 1, 1), (4, 4, 2, 4)])
def test_row_joins(spark, tmp_path, sizes):
    n1, n2, s1, s2 = sizes
    meet = ThetaJoin(WindowSpec.rows(n1, s1), WindowSpec.rows(n2, s2), lambda a, b: a("k") != b("k"))
    rows = [(i, *r[1:]) for i, r in enumerate(stream(9, 60))]  # a time of two files would be out of order on the stream
    got, want = both(spark, tmp_path, lambda: Application([Query(1, [meet])]), rows)
    assert want and got == want


def test_settings_stay_with_their_query(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    q = Query(1, [Select(Ref("v") < 0.0)], conf={key: "9", "spark.sql.streaming.noDataMicroBatches.enabled": "false"})
    with pytest.raises(RuntimeError), q.configured(spark):
        assert spark.conf.get(key) == "9"
        raise RuntimeError
    assert spark.conf.get(key) == before


def test_metrics_weigh_latency_by_rows():
    m = Metrics()
    m.progress = [("q", 0, 10, 0.0, 100), ("q", 1, 0, 0.0, 900), ("q", 2, 90, 0.0, 300)]
    said = m.summary()
    assert (said["rows"], said["batches"], said["most_rows"]) == (100, 2, 90)
    assert said["latency_ms"] == {5: 100, 25: 300, 50: 300, 75: 300, 99: 300}


def test_a_session_on_a_stream_ends_a_whole_gap_after_its_last_row(spark, tmp_path):
    for rows in ([(0, "a"), (2, "a")], [(5, "a")], [(20, "a")]):
        spark.createDataFrame(rows, "s long, k string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = readers.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    app = Application([Query(1, [Aggregate(WindowSpec.session(3), [Agg("cnt", None, "n")], [("k", "k")])])])
    got = run_to_end(spark, app, {1: (df,)}, folder=str(tmp_path / "run"))
    assert sorted(map(tuple, got.collect())) == [(0, 5, "a", 2), (5, 8, "a", 1)]


class Standing:
    """A runtime in which nothing happens, or whose query has ended."""

    def __init__(self, active):
        self.running, self.metrics = [self], Metrics()
        self.isActive = active

    def exception(self):
        return None


@pytest.mark.parametrize(("lines", "active", "error"), [(["1"], True, TimeoutError), (["1"], False, RuntimeError)])
def test_a_socket_loop_that_fails_is_no_result(lines, active, error):
    feeder, receiver = sinks.Feeder(lines), sinks.Receiver()
    receiver.rows[0, 0, 0] = {}
    try:
        with pytest.raises(error):
            sinks.wait_for(receiver, 2, feeder, Standing(active), stalled=0.5)
    finally:
        feeder.close()
        receiver.close()


def test_the_receiver_keeps_equal_rows(spark, tmp_path):
    receiver = sinks.Receiver()
    spark.createDataFrame([(1, "a")] * 3, "s long, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    df = readers.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    run = Runtime(spark, Application([Query(1, [Select(Ref("s") == 1)])]), str(tmp_path / "check"))
    try:
        run.start({1: (df,)}, {1: sinks.tcp("127.0.0.1", receiver.port)})
        sinks.wait_for(receiver, 3, sinks.Feeder([]), Standing(True), stalled=30)
    finally:
        run.stop()
        receiver.close()
    assert len(receiver.rows) == 3


def test_row_windows_are_grouped_at_once():
    w, panes = WindowSpec.rows(6, 4), pd.DataFrame({"_pane": range(12), "_t": range(12), "_rows": 2, "s_n": 2, "n_n": 2})
    got = lower._window_states(panes, [], w, 1, 4, [Agg("cnt", None, "n")])
    assert got[["_window", "_t", "_rows"]].to_numpy().tolist() == [[i, 2 * i + 2, 6] for i in range(1, 5)]


def test_long_windows_hold_panes_and_no_window_as_state(spark, tmp_path):
    app = Application([Query(1, [Aggregate(WindowSpec.range(64, 1), [Agg("avg", "v", "mean"), Agg("cnt", None, "n")], [("k", "k")])])])
    run = Runtime(spark, app, str(tmp_path / "check"))
    plan = run.plans({1: (feed(spark, tmp_path / "in", stream(7, 4)),)})[1]._jdf.queryExecution().analyzed().toString()
    run.stop()
    assert plan.count("Aggregate [") == 1 and plan.count("TransformWithState") == 1


@pytest.mark.parametrize("n", [1, 5, 16])
def test_intervals_of_windows(n):
    rng = np.random.default_rng(n)
    cells = np.unique(rng.integers(0, [3, 60], (70, 2)), axis=0)
    key, at = cells[:, 0], cells[:, 1]
    x, low = rng.integers(0, 100, len(at)), np.where(rng.random(len(at)) < 0.3, np.nan, rng.random(len(at)))
    of, start, stop, out = intervals.merged(key, at, {"x": (x, np.add), "low": (low, np.fmin)}, n, 7, 50)
    got = {(key[of[i]], s): (out["x"][i], out["low"][i]) for i in range(len(of)) for s in range(start[i], stop[i] + 1)}
    assert len(got) == (stop - start + 1).sum()
    want = {}
    for k in range(3):
        for s in range(7, 51):
            own = (key == k) & (at >= s) & (at < s + n)
            if own.any():
                want[k, s] = (x[own].sum(), np.fmin.reduce(low[own]))
    assert got.keys() == want.keys()
    assert all(got[c][0] == want[c][0] and (got[c][1] == want[c][1] or np.isnan(got[c][1]) and np.isnan(want[c][1])) for c in want)


def test_largest_of_intervals():
    found = pd.DataFrame({"_from": [0, 2, 0], "_to": [1, 6, 6], "_end": 0, "k": ["a", "a", "b"], "n": [5, 2, 2]})
    got = intervals.largest(found, "n", 1)
    assert sorted(got[["k", "n", "_from", "_to"]].itertuples(index=False, name=None)) == [("a", 2, 2, 6), ("a", 5, 0, 1), ("b", 2, 2, 6)]


def test_intervals_keep_null_keys_and_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lower, "BLOCKS_FROM", 2)
    rows = [(t, i, None if i % 3 == 0 else "" if i % 3 == 1 else "a", None if i % 4 < 2 else float(i)) for i, t in enumerate(range(3, 43))]
    day = ("day", lambda df: F.when(F.col("id") % 5 > 0, F.date_add(F.lit("1970-01-01").cast("date"), (F.col("id") % 2).cast("int"))))
    make = lambda: Application([Query(1, [Aggregate(WindowSpec.range(6, 1), AGGS, [("k", "k"), day])])])
    want = make().run({1: (spark.createDataFrame(rows, SCHEMA),)})[1]
    got = run_to_end(spark, make(), {1: (feed(spark, tmp_path / "in", rows, 2),)}, rows[0][0], str(tmp_path / "run"))
    said = [sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()) for df in (got, want)]
    assert said[1] and said[0] == said[1]


@pytest.mark.parametrize("having", [None, Ref("mean") < -25.0, Ref("window_start") >= 20])
def test_windows_are_committed_as_intervals(spark, tmp_path, monkeypatch, having):
    monkeypatch.setattr(lower, "BLOCKS_FROM", 2)
    rows = stream(12, 80)
    make = lambda: Application([Query(1, [Aggregate(WindowSpec.range(12, 2), AGGS, [("k", "k")], having=having)])])
    got = run_to_end(spark, make(), {1: (feed(spark, tmp_path / "in", rows),)}, rows[0][0], str(tmp_path / "run"))
    want = make().run({1: (spark.createDataFrame(rows, SCHEMA),)})[1]
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    held = spark.read.parquet(str(tmp_path / "run" / "out"))
    assert ("_from" in held.columns) == (having is None or having.left.at == "mean")
    assert "_from" not in held.columns or held.count() < got.count()


def test_a_micro_batch_is_written_by_several_tasks(spark):
    df = in_parts(spark, [generators.smart_grid(spark, generators.ids(spark, a, a + 50, 3)) for a in (0, 50)], 3)
    seen = []
    df.writeStream.foreachBatch(lambda x, i: seen.append(x.count())).option("checkpointLocation", new_folder(spark, "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [50, 50]
    with pytest.raises(RuntimeError):
        in_parts(spark, [generators.smart_grid(spark, generators.ids(spark, 0, 50, 3))], 2)


def test_a_join_of_committed_windows_is_no_state(spark, monkeypatch):
    ran = []

    def committed(spark, app, inputs, origin, folder, packed):
        ran.append((app.queries[0].ident, packed))
        return app.run(inputs)[app.queries[0].ident]

    monkeypatch.setattr(bounded, "run_to_end", committed)
    df = generators.smart_grid(spark, 15_000)
    got = bounded.run_staged(spark, benchmarks.sg3(spark), {1: (df,), 2: (df,)}, 0, join_on_read=True)
    assert ran == [(1, True), (2, True)]
    assert got.count() == benchmarks.run(spark, "sg3", 15_000).count() > 0


def test_windows_of_few_rows_are_looked_through_once(spark, tmp_path):
    app = Application([Query(1, [Aggregate(WindowSpec.range(64, 1), [Agg("cnt", None, "n")], [("k", "k")], arg_max="n")])])
    run = Runtime(spark, app, str(tmp_path / "check"))
    plan = run.plans({1: (feed(spark, tmp_path / "in", stream(7, 4)),)})[1]._jdf.queryExecution().analyzed().toString()
    run.stop()
    assert plan.count("Aggregate [") == 2 and plan.count("TransformWithState") == 1


def test_row_windows_of_a_join_take_equal_times_in_the_order_of_numbers_and_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lower, "A_BLOCK", 3)
    meet = ThetaJoin(WindowSpec.rows(4, 2), WindowSpec.rows(3), lambda a, b: a("k") != b("k"))
    rows = [(i // 5, i + 1, "aab"[i % 3], float(i)) for i in range(40)]  # 9 and 10 have one time, and a file has five rows
    got, want = both(spark, tmp_path, lambda: Application([Query(1, [meet])]), rows)
    assert got == want and got
