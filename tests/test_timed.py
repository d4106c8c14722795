"""Joins, windows and quantiles that split a key's rows: against brute force, ties, nulls, hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewell.operators import neighbours, timed

T0 = 1_700_000_000


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config(map={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}).getOrCreate()


def _at(df, *cols):
    return df.withColumns({c: F.timestamp_micros(F.col(c)) for c in cols})


def test_interval_join_meets_each_pair_once(spark):
    r = random.Random(6)
    span = lambda: (lambda a: (a, a + r.choice([-5, 0, 1, 10**6, 3 * 10**6, 10**8, 10**10, r.randrange(10**9)])))(T0 * 10**6 + r.randrange(10**9))
    left = [(k, r.choice([1, 1, 1, 2, None]), *span()) for k in range(150)] + [(900, 1, None, T0 * 10**6), (901, 1, T0 * 10**6, None), (902, 1, -(10**9), -5)]
    right = [(k, r.choice([1, 1, 2, None]), *span()) for k in range(150)] + [(900, 1, None, None), (901, 1, -(10**8), 10), (902, 3, *span())]
    l = _at(spark.createDataFrame(left, "i long, g int, a long, b long"), "a", "b")  # noqa: E741
    q = _at(spark.createDataFrame(right, "j long, h int, c long, d long"), "c", "d")
    got = sorted((x.i, x.j) for x in timed.interval_join(l, q, [("g", "h")], ("a", "b"), ("c", "d")).collect())
    full = lambda a, b: a is not None and b is not None and a < b
    want = sorted((i, j) for i, g, a, b in left for j, h, c, d in right if g is not None and g == h and full(a, b) and full(c, d) and a < d and c < b)
    assert got == want and len(want) > 1000
    assert timed.interval_join(l.limit(0), q, [("g", "h")], ("a", "b"), ("c", "d")).count() == 0


def test_one_key_of_many_intervals_is_many_tasks(spark):
    one = spark.range(0, 1_000_000, 1, 4).select(F.lit(1).alias("g"), F.col("id").alias("i"), (F.col("id") * 10_000_000 + T0 * 1_000_000).alias("a"))
    one = _at(one.withColumn("b", F.col("a") + 2_000_000), "a", "b")
    out = timed.interval_join(one, one.toDF("h", "j", "c", "d"), [("g", "h")], ("a", "b"), ("c", "d"))
    parts = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(p.n for p in parts) == 1_000_000 and len(parts) >= 4 and max(p.n for p in parts) < 300_000


def test_as_of_over_slices(spark):
    r = random.Random(3)
    left = [(k, r.choice([1, 1, 2, 3, None]), r.choice([None, T0 * 10**6 + r.randrange(10**11)])) for k in range(300)]
    right = [(r.choice([1, 1, 2, None]), T0 * 10**6 + k * 2 * 10**8 + r.randrange(10**8), r.choice([None, k])) for k in range(300)]
    left += [(1000 + k, g, t) for k, (g, t, _) in enumerate(right[:30])]  # at the same instant
    l = _at(spark.createDataFrame(left, "i long, g int, t long"), "t")  # noqa: E741
    q = _at(spark.createDataFrame(right, "g int, u long, v int"), "u")
    for how in ("left", "inner"):
        got = sorted((x.i, x.v if x.v is not None else -1, x.w if x.w is not None else -1) for x in timed.as_of_sliced(l, q.withColumn("w", F.lit(7)), "t", "u", ["g"], ["v", "w"], how, slice_ms=3_600_000).collect())
        want = []
        for i, g, t in left:
            before = [(u, v) for h, u, v in right if h == g and g is not None and t is not None and u <= t]
            if before or how == "left":
                v = max(before)[1] if before else None
                want.append((i, -1 if v is None else v, 7 if before else -1))
        assert got == sorted(want)


def test_trailing_counts_over_slices(spark):
    r = random.Random(5)
    rows = [(k, r.choice([1, 1, 1, 2, None]), T0 * 10**6 + r.randrange(4 * 3_600_000) * 1000 + r.randrange(1000)) for k in range(400)] + [(k, 1, T0 * 10**6) for k in range(400, 420)] + [(999, 1, None)]
    df = _at(spark.createDataFrame(rows, "i long, g int, t long"), "t")
    for back, width in ((3_600_000, 1), (600_000, 1_200_000)):
        got = {x.i: x.n for x in timed.trailing_counts(df, ["g"], "t", back, "n", slice_ms=width).collect()}
        ms = lambda t: t // 1000
        want = {i: 0 if t is None else sum(u is not None and h == g and ms(t) - back <= ms(u) <= ms(t) - 1 for _, h, u in rows) for i, g, t in rows}
        assert got == want


def test_windows_of_one_key_run_in_many_tasks(spark):
    df = _at(spark.range(0, 200_000, 1, 4).select(F.lit(1).alias("g"), F.col("id").alias("i"), (F.col("id") * 10_000_000 + T0 * 1_000_000).alias("t")), "t")
    for out in (timed.trailing_counts(df, ["g"], "t", 60_000, "n"), timed.as_of_sliced(df, df.where("i % 50 = 0").select("g", F.col("t").alias("u"), F.col("i").alias("v")), "t", "u", ["g"], ["v"])):
        parts = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert sum(p.n for p in parts) == 200_000 and len(parts) >= 4 and max(p.n for p in parts) < 60_000
    assert timed.as_of_sliced(df, df.where("i % 50 = 0").select("g", F.col("t").alias("u"), F.col("i").alias("v")), "t", "u", ["g"], ["v"]).where("v <> i - i % 50 or v is null").count() == 0


def test_exact_quantiles(spark):
    r, rows = random.Random(8), []
    for g, n in (("a", 500), ("b", 1), ("c", 2), (None, 40)):
        rows += [(g, r.choice([None, 3, 3, 3, r.randrange(-1000, 1000)])) for _ in range(n)]
    rows += [("d", None)] + [("e", 5)] * 300
    df = spark.createDataFrame(rows, "g string, v long")
    qs = {"lo": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "hi": 1.0}
    for buckets in (1, 7):
        got = {x.g: tuple(x)[1:] for x in timed.exact_quantiles(df, ["g"], "v", qs, {"n_all": F.sum("n")}, buckets).collect()}
        groups = {g: [v for h, v in rows if h == g and v is not None] for g in {g for g, _ in rows}}
        want = {g: (*np.quantile(v, list(qs.values())), len(v)) for g, v in groups.items() if v}
        assert set(got) == set(want) and all(np.allclose(got[g], want[g], rtol=0, atol=1e-9) for g in want)
    assert timed.exact_quantiles(df.limit(0), ["g"], "v", qs).count() == 0


def _near(x, k):
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    sim = np.round(np.clip(unit @ unit.T, -1, 1), 5)
    return {(i, j) for i in range(len(x)) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (-sim[i, j], j))[:k]}


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_pruned_neighbours_are_all_neighbours(spark, spread):
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (12, 5))[r.integers(0, 12, 500)] + r.normal(0, spread, (500, 5))
    x[450:] = x[:50]  # ties
    x[:60] = x[7]  # many alike
    df = spark.createDataFrame([(i, i % 3, [float(e) for e in v]) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>").repartition(3)
    for k, rows, pivots in ((3, 32, 20), (1, 500, 1), (5, 7, 40)):
        assert {(a.vec_id, a.neighbour) for a in neighbours.nearest(df, k, rows, pivots).collect()} == _near(x, k)
    told = neighbours.pruned(df, 3, 16, 24).first()
    assert told.blocks > 20 and told.pairs == told.blocks * (told.blocks - 1)
    assert told.skipped_pct > 60 if spread < 1 else told.met <= told.pairs


def test_neighbours_of_odd_rows(spark):
    schema = "vec_id long, label int, embedding array<double>"
    rows = [(5, 1, [1.0, 0.0]), (6, 2, [0.9, 0.1]), (7, None, [0.0, 0.0]), (8, 1, None), (9, 1, [1.0]), (4, 2, [1.0, None]), (None, 1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, schema)
    got = {(x.vec_id, x.neighbour): x.sim for x in neighbours.nearest(df, 2).collect()}
    assert got == {(5, 6): 0.99388, (5, 4): None, (6, 5): 0.99388, (6, 4): None, (7, 4): None, (7, 5): None, (8, 4): None, (8, 5): None, (9, 4): None, (9, 5): None, (4, 5): None, (4, 6): None}
    assert neighbours.nearest(df.limit(0), 2).count() == 0 and neighbours.nearest(spark.createDataFrame(rows[:1], schema), 2).count() == 0
