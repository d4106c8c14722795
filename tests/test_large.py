"""What larger tables bring: long keys, far days, many rows of a key."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewell import plans, registry  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}).getOrCreate()


def same_as_sql(spark, name: str, folder: str, **made) -> int:
    """The query against its SQL on the smallest tables, some of them made anew; how many rows both have."""
    for f in os.listdir(DATA):
        if (df := made.get(f.removesuffix(".parquet"))) is None:
            os.symlink(f"{DATA}/{f}", f"{folder}/{f}")
        else:
            df.coalesce(1).write.parquet(f"{folder}/{f}")
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') and not os.path.islink(f'{folder}/{f}') else ''}'")
    df = registry.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    want = c.execute(f"SELECT {', '.join(chr(34) + x + chr(34) for x in cols)} FROM ({registry.ORACLES[name]})").fetchall()
    assert got == sorted(tuple(str(v) for v in r) for r in want)
    return len(got)


def test_days_past_the_year_9999(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").limit(20)
    last = (dt.date(9999, 12, 31) - dt.date(1970, 1, 1)).days
    assert same_as_sql(spark, "date_arithmetic", str(tmp_path), events=events.withColumn("event_id", F.col("event_id") % 20 + last - 9)) == 20


def test_orders_that_share_a_ticket(spark, tmp_path):
    orders = spark.read.parquet(f"{DATA}/orders.parquet").where("o_orderkey between 10 and 99").withColumn("o_orderkey", F.explode(F.array(F.col("o_orderkey") * 10_000, F.col("o_orderkey") * 100_000 + 10, F.col("o_orderkey") * 100_000)))
    assert same_as_sql(spark, "complaint_parse", str(tmp_path), orders=orders) == orders.count() > 200


def test_lifecycles_share_calls_to_the_state_by_bucket(spark, tmp_path):
    from tidewell.streaming import stateful

    steps, told = ["PLACED", "PACKED", "PICKED_UP", "DELIVERED"], []
    log = spark.range(1200).selectExpr("id div 4 AS order_id", "id AS event_id", "timestamp_seconds(id % 4) AS event_ts", f"element_at(array{tuple(steps)}, cast(id % 4 as int) + 1) AS status")
    for run in (log.where("event_id % 4 <> 1"), log.where("order_id % 3 = 0")):
        run.write.mode("append").parquet(f"{tmp_path}/in")
        out = stateful.lifecycles(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"), "order_id", steps, "CANCELLED", 1, buckets=8)
        stateful.run_stateful(out, lambda b, n: told.append({(r.order_id, r.outcome, r.overdue) for r in b.collect()}), f"{tmp_path}/state")
    assert told[0] == {(o, "MISSING_PACKED", False) for o in range(300)}
    assert told[1] == {(o, "CLEAN", False) for o in range(0, 300, 3)} | {(o, "MISSING_PACKED", True) for o in range(300) if o % 3}
    end = {r.order_id: (r.outcome, r.n_events, r.expected, r.overdue) for r in stateful.state_of(spark, f"{tmp_path}/state", "order").collect()}
    assert end == {o: ("MISSING_PACKED", 3, "PACKED", True) if o % 3 else ("CLEAN", 4, None, False) for o in range(300)}
    assert spark.read.format("statestore").option("stateVarName", "order").load(f"{tmp_path}/state").count() == 8


def test_features_read_no_status_events(spark):
    from tidewell.plans import warehouse

    plan = warehouse._features(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "__slice" in plan  # orders alone, a store's hours among many tasks


def test_blocks_are_not_shuffled_once_a_pair(spark):
    from tidewell import operators as op

    df = spark.range(500).selectExpr("id AS vec_id", "cast(id % 3 as int) AS label", "array(cast(id % 17 as double), 1.0D, cast(id % 5 as double)) AS embedding")
    pairs = op.pair_units(df, rows_per_block=64)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and pairs.groupBy().sum("n").first()[0] == 500 * 499 // 2


def test_a_vector_keeps_few_rows_of_the_blocks_it_meets(spark):
    from tidewell.operators import neighbours

    df = spark.range(1200).selectExpr("id AS vec_id", "cast(id % 3 as int) AS label", "transform(sequence(1, 8), i -> sin(id * i * 1.7D)) AS embedding")
    got = neighbours.nearest(df, 2, 32, 8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "rj" not in plan  # what is ranked holds no block and compares none again
    from tidewell import operators as op

    assert {tuple(r) for r in got.select("vec_id", "neighbour").collect()} == {tuple(r) for r in op.nearest(df, 2).select("vec_id", "neighbour").collect()}


def test_hash_vectors_are_made_in_slices():
    import pyarrow as pa

    from tidewell import functions as fn

    texts = pa.array([None if i % 7 == 0 else "late order " * (i % 5) + "rider" for i in range(1000)])
    got = list(fn.hash_slices(64)(iter([texts, texts.slice(0, 0), texts.slice(3, 100)])))
    assert max(map(len, got)) == 64 and sum(map(len, got)) == 1100  # no batch of vectors is held whole
    rows = [v for a in got for v in a.to_pylist()]
    assert rows[1000:] == rows[3:103] and rows[7] == [0.0] * 256 and all(len(v) == 256 for v in rows)


def test_a_text_is_cut_into_words_once(spark):
    docs = spark.createDataFrame([(1, "RUDE, wrong: refund"), (2, None), (7, "rude")], "doc_id long, text string")
    from tidewell import functions as fn
    from tidewell.plans.relational import ESCALATION, STRONG

    got = docs.select("doc_id", fn.tone("text", STRONG, ESCALATION).alias("t")).select("doc_id", "t.*")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, 2, 1, 3, 4, "MEDIUM"), (2, 0, 0, 0, None, "UNKNOWN"), (7, 1, 0, 1, 1, "LOW")]


def test_order_lines_shuffle_no_text(spark):
    df = registry.QUERIES["mart_fct_order_item"](spark, DATA)
    top, *below = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "yyyyMMdd" in top and not any("yyyyMMdd" in x for x in below)  # a line's id is made above the joins


def test_order_lines_with_odd_days_and_keys(spark, tmp_path):
    line = spark.read.parquet(f"{DATA}/lineitem.parquet")
    odd = line.withColumn("l_shipdate", F.when(F.col("l_linenumber") % 2 == 0, F.expr("l_shipdate + interval 3599 seconds")).otherwise(F.col("l_shipdate"))).withColumn("l_partkey", F.when(F.col("l_suppkey") == 3, F.col("l_partkey") + 10**12).otherwise(F.col("l_partkey")))
    assert same_as_sql(spark, "mart_fct_order_item", str(tmp_path), lineitem=odd) == line.count()


@pytest.mark.parametrize("name", ["conformed_inventory", "mart_fct_inventory_daily"])
def test_stock_is_dealt_by_its_rows(spark, tmp_path, monkeypatch, name):
    from tidewell.plans import warehouse

    monkeypatch.setattr(warehouse, "STOCK_ROWS", 500)
    line = spark.read.parquet(f"{DATA}/lineitem.parquet")
    one = line.where("l_linenumber = 1").withColumns({"l_partkey": F.lit(7).cast("long"), "l_suppkey": F.lit(3).cast("long"), "l_shipdate": F.lit("1998-09-01").cast("timestamp_ntz")})
    both = line.where("l_linenumber > 1").unionByName(one)
    assert same_as_sql(spark, name, str(tmp_path), lineitem=both) < both.count()
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-both.count() // 500)}), REPARTITION_BY_NUM" in plan and plan.count("Sort [") == (name == "conformed_inventory")


def test_tone_of_null_empty_and_turkish_texts(spark, tmp_path):
    texts = [None, "", " ", "wrong again", "İİ İRUDE xİ", "RUDE, never! refund third"]
    docs = spark.createDataFrame([(i, t) for i in [None, -7, -3, *range(20), 10**12 + 7] for t in texts], "doc_id long, text string")
    assert same_as_sql(spark, "tone_object", str(tmp_path), documents=docs) == 144


@pytest.mark.parametrize("name", ["hash_vector_tokens", "hash_vector_text"])
def test_words_with_a_dotted_capital_i(spark, tmp_path, name):
    docs = spark.createDataFrame([(1, "İzmir, DİYARBAKIR xİ"), (2, None), (3, "")], "doc_id long, text string")
    assert same_as_sql(spark, name, str(tmp_path), documents=docs) > 2
