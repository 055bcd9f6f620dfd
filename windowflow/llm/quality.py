"""Quality rules with robust multivariate outliers, in DataFrame functions alone.

Base rules count words, symbols, repeated lines and repeated words. The method transforms a document's
statistics to a vector of four numbers and, per language and source, estimates its centre and covariance
by the minimum covariance determinant: from several starts (medians with quartile spreads, with the correlation of
squashed values, with spatial signs, and plain moments), concentration steps refit centre and covariance on the three
quarters of the documents with the smallest Mahalanobis distances, until no determinant shrinks any more; the start that ends with the
smallest determinant counts. Groups of every size are estimated alike and then regularised: an estimate is averaged with
that of all documents, which weighs as much as a few documents more, so a small group leans on it and a large one doesn't. A
document is rejected if its squared distance is beyond a quantile of chi-square.

A group may hold a third of all rows. No step gathers a group: medians come from counts of values on a fixed
grid, and a concentration step is one pass that sums moments per group, start and distance on a fixed grid, all
combined before the shuffle. Groups' estimates reach the documents through a join on group and salt.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, bounded, durable, release

#: The statistic vector.
FEATURES = ("word_length", "symbols", "dup_lines", "repeats")
#: Least deviation that an estimate may claim for each: below it, differences mean nothing.
FLOORS = (0.1, 0.1, 0.08, 0.1)
#: 99.9 % point of the chi-square distribution with four degrees of freedom, one for each statistic.
CHI_SQUARE = 18.467
#: Words that count as one observation of a repeat: repeats come as passages of about a line.
PASSAGE = 9
#: Steps of the grids on which medians, and logarithms of distances, are counted.
GRID, DISTANCES = 256, 64
SALTS = 64
#: Concentration steps of all starts, starts that go on, and the decrease of a log-determinant that counts as none.
FIRST_STEPS, BEST, STILL = 2, 2, 1e-3
#: Documents that the estimate of all documents weighs in a group's centre and in its covariance, which needs more of them.
CENTRE_PRIOR, SPREAD_PRIOR = 5, 50


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda's variable isn't inlined."""
    return F.transform(F.array(value), body)[0]


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and the keys lang, source."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, WS + "+"), "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def starts(s: Column) -> Column:  # s: windows by hash and position
            hit = F.filter(s, lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            return F.aggregate(
                p,
                F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
                lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3), x - a["at"])).alias("n")),
                lambda a: a["n"],
            )

        def of(h: Column) -> Column:  # most texts repeat nothing, and need no sorting to see that
            placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(_let(F.array_sort(placed), starts), covered))

        return F.when(n < 4, F.lit(0)).otherwise(_let(hashes, of))

    counted = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeated(w).alias("n_repeat_words")))
    lines = _let(
        F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0),
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
    )
    key = lambda name: F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        key("lang").alias("lang"),
        key("source").alias("source"),
        F.length(F.regexp_replace(text, WS + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        counted.alias("w"),
        lines.alias("l"),
    ).select(
        "doc_id", "lang", "source", F.col("w.n_words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("l.dup").cast("long").alias("n_dup_lines"), F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
        F.col("l.n").cast("long").alias("n_lines"),
    )


def _share(part: Column, of: Column, n: Column) -> Column:
    """asin(sqrt(share)) less two deviations of a share among n observations, so that one repeated line of a short text means nothing."""
    return F.greatest(F.asin(F.sqrt(part / of)) - 1 / F.sqrt(n), F.lit(0.0))


def _vector(stats: DataFrame) -> DataFrame:
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return (
        stats.withColumn("word_length", F.log(F.col("word_chars") / n + 1))
        .withColumn("symbols", F.log1p(10 * F.col("n_symbols") / n))
        .withColumn("dup_lines", _share(F.col("n_dup_lines"), lines, lines))
        .withColumn("repeats", _share(F.col("n_repeat_words"), n, n / PASSAGE))
    )


def _given(rows: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their group's estimate; rows of a large group meet SALTS copies of it."""
    copies = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(copies, [*keys, "salt"])


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns of a Cholesky factor and a centre."""
    y: list[Column] = []
    for i, name in enumerate(FEATURES):
        rest = reduce(lambda a, j: a - F.col(f"l{i}{j}") * y[j], range(i), F.col(name) - F.col(f"m{i}"))
        y.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, (v * v for v in y))


_N = len(FEATURES)
_PAIRS = [(i, j) for i in range(_N) for j in range(i + 1)]
_ESTIMATE = [f"m{i}" for i in range(_N)] + [f"l{i}{j}" for i, j in _PAIRS] + ["det"]


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of four normal coordinates must be multiplied by to be that of all.

    The distribution function of chi-square with 2k degrees has a closed form.
    """

    def below(q: float, k: int) -> float:
        return 1 - math.exp(-q / 2) * sum((q / 2) ** i / math.factorial(i) for i in range(k))

    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid, _N // 2) < share else (lo, mid)
    return share / below(lo, _N // 2 + 1)


def _factored(sums: DataFrame, keys: list[str], floored: bool = False) -> DataFrame:
    """keys and an estimate from centres m_i and covariances s_ij: the Cholesky factor and the log-determinant; no deviation is below its floor.

    Covariances that are ``floored`` hold their floors already.
    """
    for i, j in _PAIRS:
        spread = F.col(f"s{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j and not floored else F.lit(0.0))
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), spread)
        sums = sums.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return sums.withColumn("det", sum((2 * F.log(f"l{i}{i}") for i in range(_N)), F.lit(0.0))).select(*keys, *_ESTIMATE)


def _marks(rows: DataFrame) -> DataFrame:
    """g, medians m_i and quartile spreads d_i, one coordinate at a time."""
    stacked = rows.select("g", F.posexplode(F.array(*FEATURES)).alias("f", "x")).select("g", "f", F.floor(F.col("x") * GRID).alias("x"))
    counts = stacked.groupBy("g", "f", "x").count()
    ordered = counts.groupBy("g", "f").agg(F.array_sort(F.collect_list(F.struct("x", "count"))).alias("v"), F.sum("count").alias("n"))

    def quantile(share: float) -> Column:
        return F.aggregate(
            "v",
            F.struct(F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("n")),
            lambda a, x: F.struct(F.when(a["n"] >= share * F.col("n"), a["at"]).otherwise(x["x"].cast("long")).alias("at"), (a["n"] + x["count"]).alias("n")),
            lambda a: (a["at"] + 0.5) / GRID,
        )

    marks = ordered.select("g", "f", quantile(0.5).alias("m"), ((quantile(0.75) - quantile(0.25)) / 1.349).alias("s"))
    pick = lambda name, i, least: F.max(F.when(F.col("f") == i, F.greatest(name, F.lit(least))))
    return marks.groupBy("g").agg(
        *[pick("m", i, -1e9).alias(f"m{i}") for i in range(_N)], *[pick("s", i, FLOORS[i]).alias(f"d{i}") for i in range(_N)]
    )


def _starts(rows: DataFrame) -> DataFrame:
    """(g, start) with four first estimates, from the medians and one pass of moments."""
    marks = durable(_marks(rows))
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"d{i}") for i, x in enumerate(FEATURES)]
    flat = [F.tanh(v) for v in z]
    length = F.sqrt(reduce(lambda a, b: a + b, (v * v for v in z)))
    sign = [F.when(length > 0, v / length).otherwise(0.0) for v in z]
    at = _given(rows, marks, ["g"]).select("g", *FEATURES, *[v.alias(f"t{i}") for i, v in enumerate(flat)], *[v.alias(f"y{i}") for i, v in enumerate(sign)])
    moments = at.groupBy("g").agg(
        *[F.avg(x).alias(f"a{i}") for i, x in enumerate(FEATURES)],
        *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i, j in _PAIRS],
        *[F.covar_pop(f"t{i}", f"t{j}").alias(f"t{i}{j}") for i, j in _PAIRS],
        *[F.avg(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"y{i}{j}") for i, j in _PAIRS],
    )
    moments = moments.join(marks, "g").withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(3))))
    s = F.col("start")
    spread = lambda i, j: F.col(f"d{i}") * F.col(f"d{j}")
    tanh = lambda i, j: F.coalesce(F.try_divide(F.col(f"t{i}{j}"), F.sqrt(F.col(f"t{i}{i}") * F.col(f"t{j}{j}"))), F.lit(0.0))
    centre = [F.when(s == 3, F.col(f"a{i}")).otherwise(F.col(f"m{i}")).alias(f"m{i}") for i in range(_N)]
    spreads = [
        F.when(s == 0, spread(i, j) if i == j else F.lit(0.0)).when(s == 1, spread(i, j) * (tanh(i, j) if i != j else 1.0))
        .when(s == 2, spread(i, j) * F.col(f"y{i}{j}") * _N).otherwise(F.col(f"c{i}{j}")).alias(f"s{i}{j}")
        for i, j in _PAIRS
    ]
    out = durable(_factored(moments.select("g", "start", *centre, *spreads), ["g", "start"]))
    release(marks)
    return out


def _concentrated(rows: DataFrame, estimates: DataFrame, share: float) -> DataFrame:
    """The estimates after one concentration step, from one pass over the rows.

    Moments around the old centres are summed for every step of a fixed grid of distances; those of the steps that
    hold the nearest ``share`` of a group give its new estimate.
    """
    moved = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(FEATURES)]
    at = _given(rows, estimates, ["g"]).withColumn("bin", F.floor(F.log1p(_distance()) * DISTANCES))
    sums = {"n": F.count(F.lit(1))} | {f"a{i}": F.sum(moved[i]) for i in range(_N)} | {f"s{i}{j}": F.sum(moved[i] * moved[j]) for i, j in _PAIRS}
    centre = [f"m{i}" for i in range(_N)]
    steps = at.groupBy("g", "start", "bin").agg(*[c.alias(k) for k, c in sums.items()], *[F.first(c).alias(c) for c in centre])
    own = Window.partitionBy("g", "start")
    before = F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = steps.withColumn("before", before).withColumn("all", F.sum("n").over(own)).filter(F.col("before") < share * F.col("all"))
    total = near.groupBy("g", "start").agg(*[F.sum(k).alias(k) for k in sums], *[F.first(c).alias(c) for c in centre])
    mean = [F.col(f"a{i}") / F.col("n") for i in range(_N)]
    spreads = [((F.col(f"s{i}{j}") / F.col("n") - mean[i] * mean[j]) * consistency(share)).alias(f"s{i}{j}") for i, j in _PAIRS]
    return durable(_factored(total.select("g", "start", *[(F.col(c) + mean[i]).alias(c) for i, c in enumerate(centre)], *spreads), ["g", "start"]))


def _smallest(estimates: DataFrame, n: int) -> DataFrame:
    """The ``n`` starts of every group with the smallest determinants, of equal ones the first."""
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.round("det", 9), "start"))
    return durable(estimates.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank"))


def least_determinant(rows: DataFrame, share: float = 0.75) -> DataFrame:
    """g, centre m_i, Cholesky factor l_ij and log-determinant of every group of ``rows`` (g, salt and the features).

    An estimate gives way to the next one only if that has a smaller determinant, so the steps come to an end.
    """
    now, step = _starts(rows), 0
    while True:
        if step == FIRST_STEPS:
            every, now = now, _smallest(now, BEST)
            release(every)
        step += 1
        new = _concentrated(rows, now, share)
        if step <= FIRST_STEPS:  # first estimates needn't be of real subsets, so their determinants say nothing
            release(now)
            now = new
            continue
        old = now.select("g", "start", *[F.col(c).alias(f"old_{c}") for c in _ESTIMATE])
        better = F.col("det") < F.col("old_det") - STILL
        chosen = old.join(new, ["g", "start"]).select(
            "g", "start", better.alias("better"), *[F.when(better, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in _ESTIMATE]
        )
        both = durable(chosen)
        release(now, new)
        now = both.drop("better")
        now._durable_path = both._durable_path
        if both.filter("better").isEmpty():
            break
    out = _smallest(now, 1).drop("start")
    release(now)
    return out


def regularised(estimates: DataFrame, sizes: DataFrame, whole: str = "") -> DataFrame:
    """The estimates of the groups in ``sizes`` (g, n), each averaged with that of the group ``whole``; (n, prior) are the weights."""
    pool = estimates.filter(F.col("g") == whole).select(*[F.col(c).alias(f"w_{c}") for c in _ESTIMATE])  # one row

    def spread(i: int, j: int, of: str) -> Column:
        return reduce(lambda a, k: a + F.col(f"{of}l{i}{k}") * F.col(f"{of}l{j}{k}"), range(1, j + 1), F.col(f"{of}l{i}0") * F.col(f"{of}l{j}0"))

    def mixed(own: Column, other: Column, prior: int) -> Column:
        return (F.col("n") * own + prior * other) / (F.col("n") + prior)

    both = estimates.filter(F.col("g") != whole).join(sizes, "g").join(F.broadcast(pool))
    centre = [mixed(F.col(f"m{i}"), F.col(f"w_m{i}"), CENTRE_PRIOR).alias(f"m{i}") for i in range(_N)]
    spreads = [mixed(spread(i, j, ""), spread(i, j, "w_"), SPREAD_PRIOR).alias(f"s{i}{j}") for i, j in _PAIRS]
    return _factored(both.select("g", *centre, *spreads), ["g"], floored=True)


def robust_outliers(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    support: float = 0.75,
    reject_at: float = CHI_SQUARE,
) -> DataFrame:
    """Base statistics, base_failed, distance and kept for every row of ``docs``.

    Groups are languages and sources, among documents that pass the base rules. A document is kept if
    it passes the base rules and its squared distance is at most ``reject_at``. A null text counts as
    empty and fails the base rules; null languages and sources are a group like any other; a
    repeated row is judged like its first. Missing columns lang or source count as null, further
    columns are dropped, no rows give no rows.
    """
    bounded(docs.sparkSession)
    stats = base_statistics(docs, id_col, text_col).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    )
    stats = durable(_vector(stats))
    passing = stats.filter(~F.col("base_failed"))
    group = F.struct(F.coalesce(F.col("lang").isNull(), F.lit(False)), F.coalesce("lang", F.lit("")), F.col("source").isNull(), F.coalesce("source", F.lit("")))
    salt = F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)).cast("int")
    rows = durable(passing.withColumn("g", F.to_json(group)).withColumn("salt", salt))
    twice = rows.select("salt", *FEATURES, F.explode(F.array("g", F.lit(""))).alias("g"))  # every document counts in its group and in the whole
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    estimates = regularised(least_determinant(twice, support), sizes)

    judged = _given(rows, estimates, ["g"]).withColumn("distance", _distance()).withColumn("kept", F.col("distance") <= reject_at)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = stats.filter("base_failed").select(*names, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.select(*names, "distance", "kept").union(failed)
