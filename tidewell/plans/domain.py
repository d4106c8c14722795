"""Pipeline computations: checks as rows, governed reads, loads, money identity, maintained state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.governance import Policy, Principal, governed
from tidewell.quality import relationship, results, suite
from tidewell.registry import query
from tidewell.session import scratch, tables
from tidewell.sources import read_evolving, read_with_rejects
from tidewell.streaming import dedupe_stream, maintain


@query("money_identity", """
WITH x AS (SELECT l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS gross, CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS disc FROM lineitem)
SELECT l_orderkey, CAST(sum(gross) AS BIGINT) AS gross, CAST(sum(disc) AS BIGINT) AS discount, CAST(sum(gross) - sum(disc) AS BIGINT) AS net FROM x GROUP BY 1""")
def money_identity(spark, sf_dir):
    (line,) = tables(spark, sf_dir, "lineitem")
    x = line.select("l_orderkey", fn.cents("l_extendedprice").alias("g"), fn.cents(F.col("l_extendedprice") * F.col("l_discount")).alias("d"))
    return x.groupBy("l_orderkey").agg(F.sum("g").alias("gross"), F.sum("d").alias("discount"), F.sum(F.col("g") - F.col("d")).alias("net"))


@query("dq_results", """
SELECT 'orders_key_unique' AS check_name, 'orders' AS target, count(*) = count(DISTINCT o_orderkey) AS passed, CAST(count(*) - count(DISTINCT o_orderkey) AS VARCHAR) AS observed, '0' AS expected FROM orders
UNION ALL SELECT 'status_accepted', 'orders', count_if(o_orderstatus NOT IN ('F', 'O')) = 0, CAST(count_if(o_orderstatus NOT IN ('F', 'O')) AS VARCHAR), '0' FROM orders
UNION ALL SELECT 'line_order', 'lineitem', count(*) = 0, CAST(count(*) AS VARCHAR), '0' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'line_discount', 'lineitem', count_if(l_discount < 0 OR l_discount > 1) = 0, CAST(count_if(l_discount < 0 OR l_discount > 1) AS VARCHAR), '0' FROM lineitem""")
def dq_results(spark, sf_dir):
    orders, line = tables(spark, sf_dir, "orders", "lineitem")
    return results([
        suite(orders, "orders", {"status_accepted": F.col("o_orderstatus").isin("F", "O") | F.col("o_orderstatus").isNull()}, {"orders_key_unique": "o_orderkey"}),
        suite(line, "lineitem", {"line_discount": F.col("l_discount").between(0, 1)}), relationship(line, "lineitem", "l_orderkey", orders, "o_orderkey", "line_order"),
    ])


@query("row_policy", """
SELECT o_orderkey, n_name AS nation, left(c_name, 1) || repeat('*', length(c_name)::INTEGER - 1) AS c_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey IN (1, 4, 7)""")
def row_policy(spark, sf_dir):
    """Rows by entitlement, columns masked by role; a principal without an entitlement sees none."""
    orders, customer, nation = tables(spark, sf_dir, "orders", "customer", "nation")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "c_name", F.col("n_name").alias("nation"), "n_nationkey")
    rights = spark.createDataFrame([("analyst", 1), ("analyst", 4), ("analyst", 7), ("other", 2)], "role string, n_nationkey int")
    policy = Policy(rows=("n_nationkey", rights), masks={"c_name": fn.mask_name})
    return governed(joined, policy, Principal(role="analyst", account="a1")).select("o_orderkey", "nation", "c_name")


@query("share_account", """
SELECT n_name AS nation, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS done, round(count_if(o_orderstatus = 'F')::DOUBLE / count(*), 4) AS rate
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2 GROUP BY 1, 2""")
def share_account(spark, sf_dir):
    """A daily share: aggregated, keyed on the consumer's account."""
    orders, customer, nation = tables(spark, sf_dir, "orders", "customer", "nation")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    rights = spark.createDataFrame([("partner", 2)], "account string, n_regionkey int")
    seen = governed(joined, Policy(rows=("n_regionkey", rights), by="account"), Principal(role="consumer", account="partner"))
    n, done = F.count(F.lit(1)), F.count_if(F.col("o_orderstatus") == "F")
    return seen.groupBy(F.col("n_name").alias("nation"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(n.alias("n"), done.alias("done"), F.round(done / n, 4).alias("rate"))


@query("schema_evolution", "SELECT p_partkey, p_name, CAST(NULL AS VARCHAR) AS p_brand FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey % 2 = 1")
def schema_evolution(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    return read_evolving([part.where("p_partkey % 2 = 0").select("p_partkey", "p_name"), part.where("p_partkey % 2 = 1").select("p_partkey", "p_name", "p_brand")])


@query("rejects_load", """SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'rejected' ELSE 'loaded' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def rejects_load(spark, sf_dir):
    """A CSV with broken rows: good rows load, bad ones are reported."""
    (orders,) = tables(spark, sf_dir, "orders")
    path = scratch(spark, "rejects")
    bad = F.col("o_orderkey") % 50 == 0
    orders.select(F.when(bad, F.concat(F.lit("x"), F.col("o_orderkey"))).otherwise(F.col("o_orderkey").cast("string")), F.col("o_custkey").cast("string"), "o_orderstatus").toDF("a", "b", "c").write.csv(path)
    good, rejected = read_with_rejects(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string")
    n = lambda name, df: df.agg(F.lit(name).alias("outcome"), F.count(F.lit(1)).alias("n"))
    return n("loaded", good).unionByName(n("rejected", rejected))


@query("streaming_dedupe", "SELECT event_id, user_id, event_type FROM events")
def streaming_dedupe(spark, sf_dir):
    """Each event delivered twice; a stream that drops repeats within the watermark keeps one."""
    (events,) = tables(spark, sf_dir, "events")
    base = scratch(spark, "stream")
    e = events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    e.unionByName(e).repartition(4).write.parquet(f"{base}/in")
    return dedupe_stream(spark, f"{base}/in", e.schema, "event_id", "ts", "40 days", f"{base}/out", f"{base}/state").select("event_id", "user_id", "event_type")


@query("streaming_maintained_aggregate", "SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1")
def streaming_maintained_aggregate(spark, sf_dir):
    """Counts and sums kept by micro-batches, one file a batch; equal to the batch aggregate."""
    (events,) = tables(spark, sf_dir, "events")
    base = scratch(spark, "stream")
    e = events.select("user_id", fn.cents("value").alias("cents"))
    e.repartition(3).write.parquet(f"{base}/in")
    measures = {"n": F.count(F.lit(1)), "cents": F.sum("cents")}
    return maintain(spark, f"{base}/in", e.schema, ["user_id"], measures, f"{base}/out", f"{base}/state", files_per_batch=1)
