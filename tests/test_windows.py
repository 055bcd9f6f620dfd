import random

import pytest
from pyspark.sql import functions as F

from windowflow.apps import benchmarks
from windowflow.functions.aggregates import Agg
from windowflow.functions.expressions import Const, Ref
from windowflow.functions.stats import column_stats
from windowflow.operators.core import Aggregate, Project, StaticJoin, ThetaJoin
from windowflow.operators.window import WindowSpec
from windowflow.plans import batch
from windowflow.plans.durable import durable, release
from windowflow.sources import generators

SCHEMA = "t long, id long, k string, v double"
AGGS = [Agg("sum", "v", "total"), Agg("cnt", None, "n"), Agg("min", "v", "low"), Agg("max", "v", "high"), Agg("avg", "v", "mean")]


def stream(seed=0, n=120, gap=True):
    r, t, rows = random.Random(seed), 3, []
    for i in range(n):
        t += r.choice((0, 0, 1, 2, 40 if gap and i == n // 2 else 1))
        rows.append((t, i, r.choice("ab"), float(-r.randint(1, 50))))
    return rows


def result(rows):
    v = [r[3] for r in rows]
    return (sum(v), len(v), min(v), max(v), sum(v) / len(v))


def expected_range(rows, size, slide, keyed):
    out, lo, hi = {}, rows[0][0] // slide * slide, max(r[0] for r in rows)
    for s in range(lo, hi + 1, slide):
        if s + size <= hi:
            own = [r for r in rows if s <= r[0] < s + size]
            for k in {r[2] if keyed else None for r in own}:
                out[(s, k)] = result([r for r in own if not keyed or r[2] == k])
    return out


@pytest.mark.parametrize(("size", "slide", "lowering"), [(10, 10, "auto"), (10, 4, "auto"), (12, 1, "frame"), (12, 1, "explode"), (10, 7, "auto"), (100, 2, "auto")])
@pytest.mark.parametrize("keyed", [False, True])
def test_range_windows(spark, size, slide, lowering, keyed):
    rows = stream()
    op = Aggregate(WindowSpec.range(size, slide), AGGS, [("k", "k")] if keyed else [], lowering=lowering)
    got = {(r.window_start, r.k if keyed else None): (r.total, r.n, r.low, r.high, r["mean"]) for r in batch.lower(op, spark.createDataFrame(rows, SCHEMA)).collect()}
    want = expected_range(rows, size, slide, keyed)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize(("size", "slide"), [(10, 10), (10, 3), (7, 5), (1, 1), (500, 10)])
def test_row_windows(spark, size, slide):
    rows = stream(1)
    op = Aggregate(WindowSpec.rows(size, slide), AGGS, [("k", "k")], where=Ref("v") < -10.0, order=("id",))
    got = {(r.window_id, r.k): (r.total, r.n, r.low, r.high, r["mean"]) for r in batch.lower(op, spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for i in range(0, len(rows) - size + 1, slide):
        own = [r for r in rows[i : i + size] if r[3] < -10]
        want |= {(i // slide, k): result([r for r in own if r[2] == k]) for k in {r[2] for r in own}}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize(("n1", "n2", "s1", "s2"), [(3, 5, 1, 1), (4, 4, 2, 4), (1, 1, 1, 1)])
def test_theta_join_of_rows(spark, n1, n2, s1, s2):
    a, b = stream(2, 40, False), stream(3, 50, False)
    got = batch.lower(ThetaJoin(WindowSpec.rows(n1, s1), WindowSpec.rows(n2, s2), lambda x, y: x("k") == y("k")), spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "t")
    seen, want = ([], []), []
    for t, side, i in sorted([(r[0], 1, r[1]) for r in a] + [(r[0], 0, r[1]) for r in b]):
        other, size, slide = (seen[0], n2, s2) if side else (seen[1], n1, s1)
        first = slide * max(0, -((size - len(other)) // slide))
        want += [(i, j) if side else (j, i) for j in other[first:] if a[i if side else j][2] == b[j if side else i][2]]
        seen[side].append(i)
    assert sorted((r.id, r.r_id) for r in got.collect()) == sorted(want)


def test_theta_join_of_ranges(spark):
    a, b = stream(4, 60), stream(5, 60)
    got = batch.lower(ThetaJoin(WindowSpec.range(3), WindowSpec.range(2)), spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "t")
    assert sorted((r.id, r.r_id) for r in got.collect()) == sorted((x[1], y[1]) for x in a for y in b if -3 <= x[0] - y[0] <= 2)


def test_integer_division_and_wide_numbers(spark):
    df = spark.createDataFrame([(1, -7, 7.0), (2, 7, 7.0)], "t long, i int, f double")
    cols = [("a", Ref("i") / 2), ("b", Ref("f") / 2), ("c", Const(10**30, "wide") + Ref("i") * 0)]
    rows = batch.lower(Project(cols), df).collect()
    assert [(r.a, r.b, int(r.c)) for r in rows] == [(-3, 3.5, 10**30), (3, 3.5, 10**30)]


def test_empty_input_and_static_join(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for w in (WindowSpec.range(5, 2), WindowSpec.rows(5, 2), WindowSpec.session(3), WindowSpec.range(100, 1)):
        assert batch.lower(Aggregate(w, AGGS, [("k", "k")]), empty).count() == 0
    table = spark.createDataFrame([("a", 2), ("a", 1), ("c", 3)], "key string, x int")
    rows = batch.lower(StaticJoin(table, "k", "key", ("x",)), spark.createDataFrame(stream(), SCHEMA)).collect()
    assert {(r.k, r.x) for r in rows} == {("a", 1)}


@pytest.mark.parametrize("exact", [False, True])
def test_running_merges_over_sparse_keys_and_negative_times(spark, exact):
    """Keys with holes longer than several windows; every aggregate; windows from panes of one slide."""
    r = random.Random(11)
    rows = sorted((r.choice((-500, -300, 0, 900)) + r.randint(0, 70), i, r.choice(("a", "b", None)), float(r.randint(-9, 9))) for i in range(150))
    aggs = [Agg("sum", "v", "total", exact=exact), *AGGS[1:4], Agg("avg", "v", "mean", exact=exact)]
    op = Aggregate(WindowSpec.range(60, 2), aggs, [("k", "k")], lowering="frame")
    got = {(x.window_start, x.k): (x.total, x.n, x.low, x.high, x["mean"]) for x in batch.lower(op, spark.createDataFrame(rows, SCHEMA)).collect()}
    want = expected_range(rows, 60, 2, True)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_frame_needs_whole_slides(spark):
    with pytest.raises(ValueError):
        batch.lower(Aggregate(WindowSpec.range(10, 4), AGGS, lowering="frame"), spark.createDataFrame(stream(), SCHEMA))


def test_generated_values_are_those_of_the_sql(spark):
    import duckdb

    want = duckdb.sql(f"SELECT {generators.pick_sql(7, 640, 3)} FROM (SELECT range * 99991 AS id FROM range(2000))").fetchall()
    got = spark.range(0, 2000 * 99991, 99991).select(generators.pick(7, 640, 3)).collect()
    assert [tuple(x) for x in got] == want
    assert len(set(want)) > 500


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("t"))
    rows, _ = batch.numbered(df, ["t"], parts=7)
    assert all(r.t == r._rn for r in rows.collect())


def test_column_statistics(spark):
    df = spark.createDataFrame([(i // 6, 10 * i, 0.001 * i) for i in range(16)], "a long, b long, c double").withColumn("o", F.monotonically_increasing_id())
    got = {r.name: r for r in column_stats(df, ["a", "b"], ["a", "b", "c"]).collect()}
    assert [got[c].rle for c in "abc"] == [True, False, False]
    assert (got["a"].precision, got["b"].precision, got["a"].diff_precision, got["b"].diff_precision) == (2, 8, 2, 8)


@pytest.mark.parametrize("name", sorted(benchmarks.APPS))
def test_applications_run(spark, name):
    rows = {"sg1": 400_000, "sg3_filtered": 400_000, "ysb": 250_000}.get(name, 40_000)
    assert benchmarks.run(spark, name, rows).limit(1).count() == 1


def test_ysb_by_arithmetic(spark):
    rows = benchmarks.run(spark, "ysb", 300_000).collect()
    assert sum(r.n for r in rows if r.window_start == 0) == 33_334


def test_a_session_ends_a_whole_gap_after_its_last_row(spark):
    rows = [(0, 1, "a", 1.0, 1.0), (2, 2, "a", 1.0, 1.0), (5, 3, "a", 1.0, 1.0), (20, 4, "a", 1.0, 1.0)]
    df = spark.createDataFrame([(r[0], r[2]) for r in rows], "s long, k string")
    got = batch.lower(Aggregate(WindowSpec.session(3), [Agg("cnt", None, "n")], [("k", "k")]), df)
    assert sorted(map(tuple, got.collect())) == [(0, 5, "a", 2), (5, 8, "a", 1)]


@pytest.mark.parametrize("lowering", ["frame", "explode"])
def test_the_largest_rows_of_long_windows(spark, lowering):
    rows = stream(5, 150)
    op = Aggregate(WindowSpec.range(12, 1), [Agg("cnt", None, "n")], [("k", "k")], arg_max="n", lowering=lowering)
    got = sorted((r.window_start, r.k, r.n) for r in batch.lower(op, spark.createDataFrame(rows, SCHEMA)).collect())
    counts = {k: v[1] for k, v in expected_range(rows, 12, 1, True).items()}
    best = {}
    for (at, _), n in counts.items():
        best[at] = max(best.get(at, 0), n)
    assert got == sorted((at, k, n) for (at, k), n in counts.items() if n == best[at])


def test_windows_are_not_shuffled(spark):
    """Starts are expanded after the last shuffle, so only panes pass it."""
    op = Aggregate(WindowSpec.range(16, 1), [Agg("avg", "v", "mean")], [("k", "k")])
    plan = batch.lower(op, spark.createDataFrame(stream(6), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "sequence(_from" in plan[: plan.index("Exchange")]


@pytest.mark.parametrize(("small", "broadcast"), [(100, True), (3, False)])
def test_a_small_left_side_of_a_join_is_broadcast(spark, small, broadcast):
    left, right = (spark.createDataFrame([(i, i * k) for i in range(6)], "t long, v long") for k in (1, 2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = batch.lower(ThetaJoin(WindowSpec.range(1), WindowSpec.range(1), small=small), left, right, "t")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == broadcast
        assert got.count() == 16
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tasks_that_write_durable_tables_stay_small(spark):
    """Grouped rows of some 20 MB of shuffle aren't joined up into one task, and the session's settings stay."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, rows = spark.conf.get(key), spark.range(4_000_000).select(F.xxhash64("id").alias("k"))
    table = durable(rows.groupBy("k").count())
    assert len(table.inputFiles()) > 1 and spark.conf.get(key) == before
    release(table)


def test_few_pairs_of_a_join_of_ranges_are_looked_at_in_vain(spark):
    spot = spark.range(4000).select(F.col("id").alias("t"), "id")
    left, right, lo, hi = spot, spot.toDF("u", "j"), F.col("u") - 200, F.col("u") + 100
    a, b = batch._in_buckets(left, right, F.col("t"), lo, hi, 300)
    met = a.join(b, "_b")
    assert met.filter((F.col("t") >= lo) & (F.col("t") <= hi)).count() > met.count() / 1.4
    op = ThetaJoin(WindowSpec.range(200), WindowSpec.range(100), lambda x, y: x("id") < y("j"))
    got = batch.lower(op, left, right, "t").count()
    assert got == sum(min(200, 3999 - i) for i in range(4000))


def test_windows_of_many_panes_are_merged_in_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(batch, "A_TASK", 10)
    rows = [(i // 2, i, "ab"[i % 2], float(-i)) for i in range(400)]
    w, df = WindowSpec.range(20, 1), spark.createDataFrame(rows, SCHEMA)
    panes = durable(batch.pane_table(df, F.col("t"), 1, AGGS, [("k", "k")]))
    assert panes.count() == 400 and batch._framed(panes, w, ["k"], {"_rows": "sum"}).rdd.getNumPartitions() == 40
    got = {(r["window_start"], r["k"]): tuple(r[a.name] for a in AGGS) for r in batch.lower(Aggregate(w, AGGS, [("k", "k")]), df).collect()}
    assert got == expected_range(rows, 20, 1, True)
