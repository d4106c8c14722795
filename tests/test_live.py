"""Streams with state: maintained joins, latest states, resumable sources, lag from progress."""

import datetime
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewell.governance import costs
from tidewell.ml import forecast
from tidewell.streaming import lines, progress, stateful, views


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}).getOrCreate()


LEFT, RIGHT = "k long, g long, v long, ok boolean", "g long, name string"


def _view(spark, base, **more):
    measures = {"n": views.count(), "n_v": views.count(F.col("v")), "v": views.total(F.col("v"))} | more.pop("measures", {})
    left = views.Side(f"{base}/l", LEFT, more.pop("entitled", None))
    return views.MaintainedJoin(spark, f"{base}/view", left, views.Side(f"{base}/r", RIGHT), [("g", "g")], {"name": F.col("name")}, measures, where=F.col("ok"))


class _Tables:
    """Two tables in memory, whose changes are written as logs."""

    def __init__(self, spark, base):
        self.spark, self.base, self.l, self.r, self.log = spark, base, {}, {}, {"l": [], "r": []}

    def put(self, side, key, row):
        table = getattr(self, side)
        self.log[side].append((table.get(key), row))
        if row is None:
            table.pop(key)
        else:
            table[key] = row

    def flush(self):
        for side, ddl in (("l", LEFT), ("r", RIGHT)):
            self.spark.createDataFrame(self.log[side], f"before struct<{ddl}>, after struct<{ddl}>").coalesce(2).write.mode("append").parquet(f"{self.base}/{side}")
            self.log[side] = []

    def groups(self):
        out = defaultdict(list)
        for _, g, v, ok in self.l.values():
            for h, name in self.r.values():
                if g == h and g is not None and ok:
                    out[name].append(v)
        return {name: (len(v), sum(x is not None for x in v), sum(x for x in v if x is not None) if any(x is not None for x in v) else None) for name, v in out.items()}


def _found(view):
    rows = view.current().collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def test_maintained_join_takes_back_what_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "NET_EVERY", 3)  # several snapshots on the way
    r, t = random.Random(2), _Tables(spark, str(tmp_path))
    for g in range(5):
        t.put("r", g, (g, f"name{g % 3}"))
    t.put("r", 9, (None, "no key"))
    for k in range(40):
        t.put("l", k, (k, r.choice([0, 1, 2, 3, 4, 7, None]), r.choice([None, 1, 5, -3]), r.choice([True, True, False, None])))
    t.flush()
    view = _view(spark, str(tmp_path))
    view.run()
    assert view.mode == "incremental" and _found(view) == t.groups() and len(t.groups()) == 3
    for step in range(7):
        for k in r.sample(sorted(t.l), 9):
            t.put("l", k, None if r.random() < 0.4 else (k, r.randrange(6), r.choice([None, 2, 8]), r.random() < 0.8))
        if step % 2:
            g = r.choice(sorted(t.r))
            t.put("r", g, None if step == 3 else (g, f"moved{step}"))
        t.flush()
        view.run()
        assert _found(view) == t.groups()
    for k in sorted(t.l):
        t.put("l", k, None)
    t.flush()
    view.run()
    assert _found(view) == {} == t.groups() and view.inconsistent().count() == 0
    assert _found(views.in_full(view)) == {}


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    t = _Tables(spark, str(tmp_path))
    t.put("r", 1, (1, "a"))
    t.put("l", 1, (1, 1, 4, True))
    t.put("l", 2, (2, 1, None, True))
    t.flush()
    view = _view(spark, str(tmp_path))
    view.run()
    want = _found(view)
    image = lambda side, ddl: spark.read.parquet(f"{tmp_path}/{side}").select(F.struct("before", "after").alias(side))
    view._add(image("l", LEFT).unionByName(image("r", RIGHT), allowMissingColumns=True), 0)  # as after a crash before the commit
    assert _found(view) == want == {"a": (2, 1, 4)}
    again = _view(spark, str(tmp_path))  # a new process goes on where the old one was
    again.run()
    assert _found(again) == want


def test_what_cannot_be_kept_by_increments_is_computed_in_full(spark, tmp_path):
    t = _Tables(spark, str(tmp_path))
    for k in range(4):
        t.put("l", k, (k, 1, k, True))
    t.put("r", 1, (1, "a"))
    t.flush()
    most = _view(spark, f"{tmp_path}", measures={"most": views.other(F.max("v"))})
    assert (most.mode, most.reason) == ("full", "measure most is not additive")
    most.run()
    t.put("l", 3, None)
    t.flush()
    most.run()
    assert _found(most) == {"a": (3, 3, 3, 2)}
    rights = spark.createDataFrame([(1,), (2,)], "k long")
    policy = views.MaintainedJoin(spark, f"{tmp_path}/p", views.Side(f"{tmp_path}/l", LEFT, lambda df: df.join(rights, "k", "left_semi")), views.Side(f"{tmp_path}/r", RIGHT), [("g", "g")], {"name": F.col("name")}, {"n": views.count()})
    assert (policy.mode, policy.reason) == ("full", "the left side is filtered by another table")
    policy.run()
    assert _found(policy) == {"a": (2,)}


def test_errors_of_a_batch_are_raised(spark, tmp_path):
    t = _Tables(spark, str(tmp_path))
    t.put("r", 1, (1, "a"))
    t.put("l", 1, (1, 1, 4, True))
    t.flush()
    view = _view(spark, str(tmp_path))
    view.measures = {"v": views.total(F.col("no_such_column"))}
    with pytest.raises(Exception, match="no_such_column"):
        view.run()


def test_rows_taken_back_that_never_came_are_reported(spark, tmp_path):
    t = _Tables(spark, str(tmp_path))
    t.put("r", 1, (1, "a"))
    t.l[5] = (5, 1, 7, True)
    t.put("l", 5, None)
    t.flush()
    view = _view(spark, str(tmp_path))
    view.run()
    assert [(r.side, r.n) for r in view.inconsistent().collect()] == [("l", -1)]


def _land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_latest_rows_in_any_order(spark, tmp_path):
    log = "k long, ts_ms long, offset long, op string, payload string"
    runs = [
        [(1, 10, 0, "u", "a"), (1, 10, 1, "u", "b"), (1, 9, 7, "u", "old"), (2, 20, 0, "d", None), (3, 5, 0, "u", "c"), (None, 1, 1, "u", "no key")],
        [(2, 15, 9, "u", "late"), (1, 9, 9, "u", "late"), (3, 6, 0, "d", None), (3, 6, 0, "d", None), (4, 1, 0, "u", None)],
        [(2, 25, 0, "u", "again"), (3, 6, 0, "u", "same place"), (4, 1, 0, "u", "same place")],
    ]
    told = []
    for rows in runs:
        out = stateful.latest_rows(_land(spark, f"{tmp_path}/in", rows, log), "k", 3_600_000)
        stateful.run_stateful(out, lambda b, n: told.append(sorted((r.k, r.ts_ms, r.op, r.payload) for r in b.collect())), f"{tmp_path}/state")
    assert told == [[(1, 10, "u", "b"), (2, 20, "d", None), (3, 5, "u", "c")], [(3, 6, "d", None), (4, 1, "u", None)], [(2, 25, "u", "again")]]
    live = stateful.state_of(spark, f"{tmp_path}/state", "live")
    assert sorted((r.k, r.ts_ms, r.payload or "") for r in live.collect()) == [(1, 10, "b"), (2, 25, "again"), (4, 1, "")]
    assert [r.k for r in stateful.state_of(spark, f"{tmp_path}/state", "gone").collect()] == [3]


def test_lifecycles_wait_for_what_may_come_late(spark, tmp_path):
    steps, schema, t = ["PLACED", "PACKED", "PICKED_UP", "DELIVERED"], "order_id long, event_id long, event_ts timestamp, status string", datetime.datetime(2026, 1, 1)
    row = lambda o, k, s, m=None: (o, o * 10 + k, t + datetime.timedelta(minutes=k if m is None else m), s)
    runs = [
        [row(1, 3, "DELIVERED"), row(1, 0, "PLACED"), row(2, 0, "PLACED"), row(2, 1, "CANCELLED"), row(4, 0, "PLACED"), row(4, 1, "PACKED")],
        [row(1, 1, "PACKED"), row(1, 2, "PICKED_UP"), row(1, 2, "PICKED_UP"), row(3, 0, "PLACED"), row(3, 1, "PACKED", 9), row(3, 2, "PICKED_UP"), row(3, 3, "DELIVERED")],
        [row(4, 2, "PICKED_UP"), row(4, 3, "DELIVERED"), row(5, 1, "PACKED")],
    ]
    told = []
    for rows in runs:
        out = stateful.lifecycles(_land(spark, f"{tmp_path}/in", rows, schema), "order_id", steps, "CANCELLED", 1)
        stateful.run_stateful(out, lambda b, n: told.append(sorted((r.order_id, r.outcome, r.overdue) for r in b.collect())), f"{tmp_path}/state")
    assert told[0] == [(1, "MISSING_PACKED", False), (2, "CANCELLED", False), (4, "MISSING_PICKED_UP", False)]
    assert (4, "MISSING_PICKED_UP", True) in told[1] and (1, "CLEAN", False) in told[1] and (3, "OUT_OF_ORDER", False) in told[1]
    assert told[2] == [(4, "CLEAN", False), (5, "MISSING_PICKED_UP", False)]
    end = stateful.state_of(spark, f"{tmp_path}/state", "order")
    assert {r.order_id: (r.outcome, r.n_events, r.expected) for r in end.collect()} == {1: ("CLEAN", 4, None), 2: ("CANCELLED", 2, "PACKED"), 3: ("OUT_OF_ORDER", 4, None), 4: ("CLEAN", 4, None), 5: ("MISSING_PICKED_UP", 1, "PLACED")}


def test_lines_resume_where_they_stopped(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    put = lambda name, text: open(f"{tmp_path}/in/{name}", "a").write(text)  # noqa: E731, SIM115
    body = [f"{k} é" + "x" * (k % 23) for k in range(200)]
    put("a.json", "\n".join(body[:150]) + "\n" + body[150][:2])  # the last line isn't whole yet
    put("b.json", "")
    put("c.txt", "not of this source\n")
    args = (spark, f"{tmp_path}/in", "chan", f"{tmp_path}/out")
    got = lambda: sorted(spark.read.parquet(f"{tmp_path}/out/rows").select("value").toPandas()["value"])
    lines.take_in(*args, splitBytes="37")
    assert got() == sorted(body[:150])
    put("a.json", body[150][2:] + "\n" + "\n".join(body[151:]) + "\n")
    put("b.json", "\nlast\n")
    failed = []

    def broken(batch):
        failed.append(batch.count())
        raise RuntimeError("stopped in the middle")

    with pytest.raises(Exception, match="stopped in the middle"):
        lines.take_in(*args, broken, splitBytes="37")
    assert failed == [52] and got() == sorted(body[:150])
    for _ in range(2):  # goes on, then has nothing to do
        lines.take_in(*args, splitBytes="1000")
        assert got() == sorted([*body, "", "last"])
    rows = spark.read.parquet(f"{tmp_path}/out/rows")
    raw = open(f"{tmp_path}/in/a.json", "rb").read()  # noqa: SIM115
    assert all(raw[r.offset :].startswith(r.value.encode()) for r in rows.where("file = 'a.json'").collect())
    assert rows.where("channel <> 'chan' or load_ts is null").count() == 0
    assert {(r.file, r.bytes, r.n_rows) for r in lines.status(spark, f"{tmp_path}/out", f"{tmp_path}/in").collect()} == {("a.json", len(raw), 200), ("b.json", 6, 2)}
    assert lines.status(spark, f"{tmp_path}/none", "").count() == 0


def test_progress_is_kept_by_route(spark, tmp_path):
    with progress.ProgressLog(spark, f"{tmp_path}/log") as log:
        for run in range(2):
            _land(spark, f"{tmp_path}/in", [(run, k) for k in range(5)], "run int, k int")
            stream = spark.readStream.schema("run int, k int").parquet(f"{tmp_path}/in")
            stream.writeStream.queryName("route").format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    found = progress.by_route(log.read()).collect()
    assert [(r.route, r.n_rows, r.batches) for r in found] == [("route", 10, 2)] and 0 < found[0].least_s <= found[0].most_s
    assert log.read().where("n_rows > 0").select("batch").distinct().count() == 2


def test_costs_come_from_the_runs(spark):
    log = costs.CostLog(spark)
    busy = lambda n: spark.range(0, n, 1, 4).groupBy((F.col("id") % 7).alias("k")).agg(F.sum(F.sqrt("id"))).collect()
    assert len(log.run("a:one", lambda: busy(3_000_000))) == 7
    log.run("a:two", lambda: busy(100))
    log.run("b", lambda: busy(100))
    with pytest.raises(Exception, match="(?i)divi"):
        log.run("c:broken", lambda: spark.range(3).select(F.raise_error(F.lit("division"))).collect())
    log.run("d:nothing", lambda: None)
    busy(1000)  # not under a tag
    rows = {r.tag: r for r in log.read().collect()}
    assert rows["a:one"].executor_ms >= rows["a:two"].executor_ms > 0 and rows["a:one"].shuffle_bytes > 0 and rows["a:one"].stages == 2 and rows["d:nothing"].jobs == 0
    assert rows["c:broken"].failed_stages >= 1 and rows["b"].failed_stages == 0
    by = {r.part: (r.queries, r.pct) for r in costs.shares(log.read()).collect()}
    assert by["a"][0] == 2 and round(sum(p for _, p in by.values()), 2) == 100.0
    third = spark.createDataFrame([("x", 1, 1), ("y", 1, 1), ("z", 1, 1)], "tag string, executor_ms long, jobs long")
    assert sorted(r.pct for r in costs.shares(third).collect()) == [33.33, 33.33, 33.34] and sum(r.pct for r in costs.shares(third.withColumn("executor_ms", F.lit(0))).collect()) == 100.0
    told = costs.idle(log.read()).first()
    assert 0 <= told.idle_pct <= 100 and told.executor_ms == sum(r.executor_ms for r in rows.values())


def test_seasonal_forecast(spark):
    day = datetime.date(2026, 1, 5)
    week = [10, 12, 11, 13, 20, 30, 5]
    rows = [("s", day + datetime.timedelta(days=k), float(week[k % 7] + 0.5 * k)) for k in range(84)]
    rows[60] = ("s", rows[60][1], 400.0)
    rows += [("short", day, 4.0), ("short", day + datetime.timedelta(days=3), 2.0)]
    df = spark.createDataFrame(rows, "name string, day date, n double")
    full = forecast.daily(df, "name", "day", "n")
    assert full.where("name = 'short'").count() == 4
    got = forecast.forecast(full, "name", "day", "n", horizon=9).collect()
    odd = [r for r in got if r.kind == "anomaly"]
    assert rows[60][1] in {r.day for r in odd} and all(r.name == "s" and not r.lo <= r.actual <= r.hi for r in odd)
    clean = spark.createDataFrame(rows[:60], "name string, day date, n double")
    ahead = sorted((r for r in forecast.forecast(clean, "name", "day", "n", horizon=9).collect() if r.kind == "forecast"), key=lambda r: r.day)
    assert [r.day for r in ahead] == [day + datetime.timedelta(days=60 + k) for k in range(9)] and all(abs(r.expected - (week[(60 + k) % 7] + 0.5 * (60 + k))) < 1e-6 for k, r in enumerate(ahead))
    long = sorted((r for r in got if r.kind == "forecast" and r.name == "s"), key=lambda r: r.day)
    assert all(a.hi - a.lo < b.hi - b.lo for a, b in zip(long, long[1:], strict=False))
    assert [(r.expected, r.lo) for r in got if r.name == "short"] == [(1.5, None)] * 9
