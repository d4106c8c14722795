"""The library below the registered queries: tables and their versions, loads, streams, models, policies, marts."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell import marts, ml, sources, streaming
from tidewell import operators as op
from tidewell.governance import Catalog, Policy, Principal, bind_tags, classify, governed, tagged, unprotected
from tidewell.plans import relational
from tidewell.plans.aggregates import global_rank
from tidewell.quality import accepted, alert, check, gate, not_empty, not_null, relationship, results, unique


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}).getOrCreate()


def test_table_versions(spark, tmp_path):
    t = sources.Table(spark, f"{tmp_path}/t")
    with pytest.raises(ValueError, match="no version"):
        t.read()
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    t.replace(df)
    t.append(spark.createDataFrame([("d", 4)], "v string, k long"))  # by name, to the table's types
    t.delete(F.col("v") == "a")  # null is not deleted
    t.update({"v": F.lit("z")}, F.col("k") == 2)
    assert sorted(map(tuple, t.read().collect()), key=str) == [(2, "z"), (3, "c"), (4, "d")] and t.read().dtypes == df.dtypes
    assert t.read(1).count() == 3 and t.read(2).count() == 4 and t.versions() == [1, 2, 3, 4]
    before = t.state()
    t.append(df)
    with pytest.raises(RuntimeError, match="another writer"):  # both began at version 4
        t._commit(before, before["parts"], df.schema, "append")
    t.replace(t.read().where("k > 100"))
    assert t.read().count() == 0 and t.insert_once(df) and not t.insert_once(df)
    assert not t.insert_if_changed(df, t.read()) and t.insert_if_changed(df.where("k = 1"), t.read())


def test_loads_report_what_they_reject(spark, tmp_path):
    for name, body in (("a", '1,x,2.5\n2,"y,z",3\nq,x,1\n3,x\n4,x,no\n5,x,1,9\n'), ("b", "7,,8\n")):
        with open(f"{tmp_path}/{name}.csv", "w") as f:
            f.write(body)
    good, bad = sources.load_csv(spark, f"{tmp_path}/*.csv", "k int, s string, v double")
    assert sorted((r.k, r.s, r.v, r.src_file, r.src_line) for r in good.collect()) == [(1, "x", 2.5, "a.csv", 1), (2, "y,z", 3.0, "a.csv", 2), (7, None, 8.0, "b.csv", 1)]
    assert sorted((r.line, r.error) for r in bad.collect()) == [(3, "k is not int"), (4, "too few columns"), (5, "v is not double"), (6, "too many columns")]
    assert {(r.file, r.loaded, r.rejected) for r in sources.load_report(good, bad).collect()} == {("a.csv", 2, 4), ("b.csv", 1, 0)}
    df = spark.createDataFrame([(1, 2)], "Id int, other int")
    assert sources.by_name(df, "ID long, missing string").collect() == [(1, None)]


def test_dated_files_and_listing(spark, tmp_path):
    for day in ("20260601", "20260602"):
        with open(f"{tmp_path}/settlement_{day}.csv", "w") as f:
            f.write(f"id,paise\n{day[-1]},5\n")
    got = sources.read_dated_csv(spark, str(tmp_path), "id int, paise long").collect()
    assert {(r.id, str(r.file_day)) for r in got} == {(1, "2026-06-01"), (2, "2026-06-02")}
    found = sources.listing(spark, str(tmp_path))
    assert sources.new_files(found, found.where("path like '%01.csv'")).count() == 1
    assert sources.document_text(b"BT (one \\(two\\)) Tj (three) Tj ET") == "one (two)\nthree" and sources.document_text(None).startswith("__EXTRACT_FAILED__")


def test_streams_resume_and_write_once(spark, tmp_path):
    t = sources.Table(spark, f"{tmp_path}/landed")
    lines = lambda *o: spark.createDataFrame([('{"before": null, "after": {"k": %d, "v": "%s"}, "op": "u", "ts_ms": %d, "offset": %d}' % x,) for x in o], "value string")
    lines((1, "a", 10, 0), (2, "b", 10, 1)).write.text(f"{tmp_path}/in")
    for _ in range(2):  # a run again lands nothing
        streaming.land_changes(spark, f"{tmp_path}/in", t, f"{tmp_path}/state", "topic")
    lines((1, "c", 9, 2)).write.mode("append").text(f"{tmp_path}/in")  # late: an earlier time, a later offset
    streaming.land_changes(spark, f"{tmp_path}/in", t, f"{tmp_path}/state", "topic")
    assert t.read().count() == 3 and {(r.k, r.v) for r in streaming.latest_state(t.read(), "k long, v string", "k").collect()} == {(1, "a"), (2, "b")}
    channel = streaming.Channel(sources.Table(spark, f"{tmp_path}/channel"))
    rows = spark.createDataFrame([(i, str(i)) for i in range(5)], "offset long, v string")
    assert [channel.send(rows.where("offset < 3")), channel.send(rows), channel.send(rows), channel.committed()] == [3, 2, 0, 4]


def test_maintained_aggregate_is_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "COMPACT_AFTER", 2)
    spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, v long").repartition(6).write.parquet(f"{tmp_path}/in")
    run = lambda: streaming.maintain(spark, f"{tmp_path}/in", "k int, v long", ["k"], {"n": F.count(F.lit(1)), "s": F.sum("v")}, f"{tmp_path}/out", f"{tmp_path}/state", files_per_batch=1)
    for _ in range(2):
        assert {tuple(r) for r in run().collect()} == {(k, 10, sum(range(k, 30, 3))) for k in range(3)}
    t = sources.Table(spark, f"{tmp_path}/out")
    assert len(t.state()["parts"]) <= 3
    def refused():
        raise streaming.NotIncremental("a policy came")

    assert streaming.refresh(t, refused, lambda: spark.range(1)) == "full: a policy came" and streaming.refresh(t, lambda: spark.range(2), lambda: 1 / 0) == "incremental"
    with pytest.raises(ZeroDivisionError):  # a broken increment is not a reason to compute in full
        streaming.refresh(t, lambda: 1 / 0, lambda: spark.range(1))


def test_change_stream_moves_on_only_when_consumed(spark, tmp_path):
    t = sources.Table(spark, f"{tmp_path}/t")
    t.replace(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    s = streaming.ChangeStream(sources.Table(spark, f"{tmp_path}/o"), {"t": t}, "k", ["v"])
    t.replace(spark.createDataFrame([(1, "x"), (3, "c")], "k int, v string"))
    want = {(1, "DELETE", True, "a"), (1, "INSERT", True, "x"), (2, "DELETE", False, "b"), (3, "INSERT", False, "c")}
    assert {tuple(r) for r in s.pending().collect()} == want == {tuple(r) for r in s.pending().collect()}
    with pytest.raises(ZeroDivisionError):
        s.consume(lambda df: 1 / 0)
    assert s.pending().count() == 4
    s.consume(lambda df: df.count())
    assert s.pending().count() == 0
    again = streaming.ChangeStream(sources.Table(spark, f"{tmp_path}/o"), {"t": t}, "k", ["v"])
    assert again.pending().count() == 0


def test_keyless_as_of(spark):
    r = np.random.default_rng(1)
    left = [(int(i), int(t)) for i, t in enumerate(r.integers(0, 1000, 300))]
    right = sorted({int(t) for t in r.integers(100, 900, 40)})
    got = op.as_of_join(spark.createDataFrame(left, "id long, ts long"), spark.createDataFrame([(t, t * 2) for t in right], "at long, v long"), "ts", "at", [], ["v"])
    want = {(i, t, max((2 * x for x in right if x <= t), default=None)) for i, t in left}
    assert {tuple(x) for x in got.collect()} == want


def test_global_rank(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 7 != 0, F.col("id") % 50).alias("v"))
    got = {r.id: (r.rank, r.total) for r in global_rank(df, [F.desc_nulls_last("v"), F.asc("id")]).collect()}
    order = sorted(range(3000), key=lambda i: (i % 7 == 0, -(i % 50) if i % 7 else 0, i))
    assert got == {i: (k + 1, 3000) for k, i in enumerate(order)}


def test_models(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 2))
    y = r.random(3000) < 1 / (1 + np.exp(-(1.2 * x[:, 0] - 0.3)))
    df = spark.createDataFrame([(float(a), float(b), float(z)) for (a, b), z in zip(x, y, strict=True)], "signal double, placebo double, label double")
    model = ml.fit_risk(df, ["signal", "placebo"], "label")
    found = dict(ml.coefficients(model, ["signal", "placebo"]))
    assert abs(found["signal"] - 1.2) < 0.2 and abs(found["placebo"]) < 0.15
    said = spark.createDataFrame([("signal", 1.2, found["signal"]), ("placebo", 0.0, found["placebo"]), ("odd", 1.0, -1.0), ("far", 1.0, 9.0), ("bad", 0.0, 0.5)], "f string, w double, c double").select("f", ml.verdict("w", "c").alias("v"))
    assert {x.f: x.v for x in said.collect()} == {"signal": "recovered, attenuated", "placebo": "placebo, near zero", "odd": "WRONG SIGN", "far": "off", "bad": "PLACEBO PICKED UP WEIGHT"}
    scored = ml.score(model, df)
    assert scored.withColumn("again", F.expr(ml.sql_score(model, ["signal", "placebo"]))).where("abs(score - again) > 1e-9").isEmpty()
    s = [(z.score, z.label) for z in scored.collect()]
    pos, neg = [a for a, b in s if b], [a for a, b in s if not b]
    auc = np.mean([(a > np.array(neg)).mean() + (a == np.array(neg)).mean() / 2 for a in pos])
    order = sorted(s, reverse=True)
    hits = np.cumsum([b for _, b in order])
    pr = np.sum([h / (k + 1) for k, (h, (_, b)) in enumerate(zip(hits, order, strict=True)) if b]) / len(pos)
    a = ml.areas(scored, "label").first()
    assert a.roc_auc == pytest.approx(auc) and a.pr_auc == pytest.approx(pr, abs=1e-3)
    kept = ml.Registry(spark, f"{tmp_path}/registry")
    assert [kept.save("risk", model, {"TEST": {"n": 3000, "roc_auc": a.roc_auc}}) for _ in range(2)] == [1, 2] and kept.versions("risk") == [1, 2]
    assert ml.score(kept.load("risk"), df).count() == 3000 and kept.metrics().count() == 4


def test_text_folds(spark):
    words = {0: "late cold order rider", 1: "rude staff shouted again"}
    df = spark.createDataFrame([(i, f"{words[i % 2]} number{i % 5} {words[i % 2]}", i % 2) for i in range(40)], "id long, text string, label int")
    folds = ml.stratified_folds(df, "label", "id", 2).groupBy("fold", "label").count().collect()
    assert {r["count"] for r in folds} == {10}
    assert all(r.macro_f1 == 1.0 and r.n == 20 for r in ml.cross_validate(df, "text", "label", "id").collect())
    assert spark.range(1).select(ml.sublinear(F.array(F.lit(0.0), F.lit(1.0), F.lit(math.e))).alias("x")).first().x == pytest.approx([0, 1, 2])


def test_features_know_nothing_of_later(spark):
    marts.assert_no_leakage(marts.FEATURES)
    with pytest.raises(ValueError, match="delivered_ts"):
        marts.assert_no_leakage([*marts.FEATURES, "delivered_ts"])


def test_tone(spark):
    texts = ["The order was wrong, RUDE staff, refund!", "fine", "", None, "never never never again refund invoice"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(fn.tone("t", relational.STRONG, relational.ESCALATION).alias("t")).collect()]
    assert [(t.intensity, t.escalation, t.score, t.band) for t in got] == [(2, 1, 4, "MEDIUM"), (0, 0, 0, "LOW"), (0, 0, None, "UNKNOWN"), (0, 0, None, "UNKNOWN"), (3, 3, 9, "HIGH")]


def test_policies(spark):
    df = spark.createDataFrame([(1, "ann@mail.example", "+91 98450 12345", "x"), (2, "bob@mail.example", "+91 98450 54321", "y")], "k int, mail string, tel string, other string")
    rights = spark.createDataFrame([("analyst", 1)], "role string, k int")
    assert governed(df, Policy(), Principal("analyst")).count() == 0  # no policy, no rows
    assert [r.k for r in governed(df, Policy(rows=("k", rights)), Principal("analyst")).collect()] == [1] and governed(df, Policy(rows=("k", rights)), Principal("guest")).count() == 0
    catalog = Catalog()
    catalog.put("base", df, Policy(rows=("k", rights), masks={"mail": fn.mask_email}))
    catalog.put("derived", df.select("mail"), parents=("base",))
    assert catalog.read("derived", Principal("analyst")).count() == 0  # masks come along, rows stay shut
    assert catalog.read("derived", Principal("guest", user="u")).columns == ["mail"] and catalog.reads[-1] == ("u", "derived", ("mail",))
    assert {(r.column, r.category) for r in classify(df).collect()} == {("mail", "email"), ("tel", "phone")}
    assert [r.column for r in unprotected(classify(df), Policy(masks={"mail": fn.mask_email})).collect()] == ["tel"] and unprotected(classify(df), Policy()).count() == 2
    odd = bind_tags(df.select(tagged(F.col("mail"), "m", "email"), tagged(F.col("other"), "o", "secret")), Principal("viewer")).first()
    assert odd.m == "***REDACTED***" and odd.o is None  # a tag without a mask shuts its column


def test_gate_and_alert(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    rows = results([unique(df, "t", "k", "key"), not_null(df, "t", "v", "v_there"), accepted(df, "t", "v", ["a", "b"], "v_known"), check(df, "t", F.col("k") > 0, "positive"), relationship(df, "t", "v", df.where("k = 1"), "v", "parent"), not_empty(df, "t", "rows")])
    assert {r.check_name: r.passed for r in rows.collect()} == {"key": False, "v_there": False, "v_known": True, "positive": True, "parent": False, "rows": True}
    with pytest.raises(ValueError, match="key"):
        gate(rows)
    gate(rows.where("passed"))
    at = lambda d: F.lit(datetime.date(2026, 6, d))
    assert {r.check_name for r in alert(rows.withColumn("at", at(1)).unionByName(rows.withColumn("at", at(2)).withColumn("passed", F.col("check_name") != "key")), "at").collect()} == {"key"}


def test_matches_do_not_overlap(spark):
    rows = [(1, k, s) for k, s in enumerate("AAAAABAABAAA")] + [(2, k, s) for k, s in enumerate("ABABABBA")] + [(3, 0, "A")]
    df = spark.createDataFrame(rows, "g int, k int, s string")
    starts = lambda pattern: sorted((r.g, r.k, "".join(x.s for x in r.steps)) for r in op.match_strict(df, ["g"], ["k"], "s", list(pattern)).collect())
    assert starts("AA") == [(1, 0, "AA"), (1, 2, "AA"), (1, 6, "AA"), (1, 9, "AA")]
    assert starts("ABA") == [(1, 4, "ABA"), (1, 7, "ABA"), (2, 0, "ABA")] and starts("AB") == [(1, 4, "AB"), (1, 7, "AB"), (2, 0, "AB"), (2, 2, "AB"), (2, 4, "AB")]


def test_nulls_do_not_count_as_repeats(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (None,)], "k int")
    assert unique(df, "t", "k", "key").first().passed and not unique(df.union(df), "t", "k", "key").first().passed
