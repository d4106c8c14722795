"""Change data, history, row patterns, set differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell import operators as op
from tidewell.registry import query
from tidewell.session import tables


@query("merge_upsert", """
WITH s AS (SELECT s_suppkey + CASE WHEN s_suppkey % 10 = 9 THEN 1000000 ELSE 0 END AS k, s_name, CAST(round(s_acctbal * 100) AS BIGINT) + CASE WHEN s_suppkey % 4 = 0 THEN 500 ELSE 0 END AS cents, s_suppkey % 7 = 0 AS d FROM supplier WHERE s_suppkey % 3 <> 1),
t AS (SELECT s_suppkey AS k, s_name, CAST(round(s_acctbal * 100) AS BIGINT) AS cents FROM supplier)
SELECT coalesce(s.k, t.k) AS s_suppkey, coalesce(s.s_name, t.s_name) AS s_name, coalesce(s.cents, t.cents) AS cents,
  CASE WHEN t.k IS NULL THEN 'insert' WHEN s.k IS NULL OR (s.s_name IS NOT DISTINCT FROM t.s_name AND s.cents IS NOT DISTINCT FROM t.cents) THEN 'keep' ELSE 'update' END AS merge_action
FROM t FULL JOIN s ON s.k = t.k WHERE NOT coalesce(s.d, FALSE)""")
def merge_upsert(spark, sf_dir):
    (supplier,) = tables(spark, sf_dir, "supplier")
    t = supplier.select("s_suppkey", "s_name", fn.cents("s_acctbal").alias("cents"))
    k = F.col("s_suppkey")
    s = t.where(k % 3 != 1).select((k + F.when(k % 10 == 9, 1_000_000).otherwise(0)).alias("s_suppkey"), "s_name", (F.col("cents") + F.when(k % 4 == 0, 500).otherwise(0)).alias("cents"), (k % 7 == 0).alias("d"))
    return op.merge_upsert(t, s, "s_suppkey", ["s_name", "cents"], delete=F.col("d"))


_STATES = """
b AS (SELECT c_custkey, c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_custkey % 11 <> 5),
a AS (SELECT c_custkey, CASE WHEN c_custkey % 33 = 0 THEN 'PREMIUM' ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer WHERE c_custkey % 13 <> 2)"""


def _states(customer):
    k = F.col("c_custkey")
    before = customer.where(k % 11 != 5).select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    after = customer.where(k % 13 != 2).select("c_custkey", F.when(k % 33 == 0, F.lit("PREMIUM")).otherwise(F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"))
    return before, after


@query("change_feed", f"""
WITH {_STATES}, j AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.c_custkey IS NOT NULL AS ia, b.c_custkey IS NOT NULL AS ib, a.segment AS sa, b.segment AS sb, a.nation AS na, b.nation AS nb FROM a FULL JOIN b USING (c_custkey)),
c AS (SELECT * FROM j WHERE ia <> ib OR sa IS DISTINCT FROM sb OR na IS DISTINCT FROM nb)
SELECT c_custkey, 'DELETE' AS action, ia AND ib AS is_update, sb AS segment, nb AS nation FROM c WHERE ib UNION ALL SELECT c_custkey, 'INSERT', ia AND ib, sa, na FROM c WHERE ia""")
def change_feed(spark, sf_dir):
    before, after = _states(*tables(spark, sf_dir, "customer"))
    return op.change_feed(before, after, "c_custkey", ["segment", "nation"])


@query("append_only_feed", f"WITH {_STATES} SELECT c_custkey, segment FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.c_custkey = a.c_custkey)")
def append_only_feed(spark, sf_dir):
    before, after = _states(*tables(spark, sf_dir, "customer"))
    return after.join(before, "c_custkey", "left_anti").select("c_custkey", "segment")


@query("scd2_build", f"""
WITH {_STATES}, j AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.c_custkey IS NOT NULL AS ia, b.c_custkey IS NOT NULL AS ib, a.segment AS sa, b.segment AS sb FROM a FULL JOIN b USING (c_custkey)),
k AS (SELECT *, ia AND ib AND sa IS NOT DISTINCT FROM sb AS same FROM j)
SELECT c_custkey, sb AS segment, '1900-01-01' AS valid_from, CASE WHEN same THEN '9999-12-31' ELSE '2024-06-01' END AS valid_to, same AS is_current FROM k WHERE ib
UNION ALL SELECT c_custkey, sa, '2024-06-01', '9999-12-31', TRUE FROM k WHERE ia AND NOT same""")
def scd2_build(spark, sf_dir):
    dim = _dim(spark, sf_dir)
    return dim.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("valid_from", "valid_to")})


def _dim(spark, sf_dir):
    before, after = _states(*tables(spark, sf_dir, "customer"))
    dim = op.scd2_open(before.select("c_custkey", "segment"), F.lit("1900-01-01"))
    return op.scd2_apply(dim, after.select("c_custkey", "segment"), "c_custkey", ["segment"], F.lit("2024-06-01"))


@query("scd2_checks", f"""
WITH {_STATES} SELECT 'more than one current' AS check_name, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'overlaps', 0
UNION ALL SELECT 'current versions', count(*) FROM a""")
def scd2_checks(spark, sf_dir):
    dim = _dim(spark, sf_dir)
    many = dim.where("is_current").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    n = lambda name, df: df.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("n"))
    return n("more than one current", many).unionByName(n("overlaps", op.overlapping_versions(dim, "c_custkey"))).unionByName(n("current versions", dim.where("is_current")))


@query("conform_cdc", """
WITH l AS (SELECT user_id AS k, event_id AS o, (epoch_us(ts) // 1000) AS t, CASE WHEN event_id % 17 = 0 THEN 'd' ELSE 'u' END AS op, event_type FROM events),
r AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC, o DESC) = 1)
SELECT k AS user_id, event_type, t AS ts_ms FROM r WHERE op <> 'd'""")
def conform_cdc(spark, sf_dir):
    """Change envelopes with before, after, op: deletes carry their key in ``before`` alone."""
    (events,) = tables(spark, sf_dir, "events")
    row = F.struct("user_id", "event_type")
    gone = F.col("event_id") % 17 == 0
    log = events.select(F.when(gone, row).alias("before"), F.when(~gone, row).alias("after"), F.when(gone, "d").otherwise("u").alias("op"), fn.millis("ts").alias("ts_ms"), F.col("event_id").alias("offset"))
    return op.conform_cdc(log, "user_id").select("user_id", "event_type", "ts_ms")


@query("feed_equivalence", """
WITH a AS (SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <> 3), b AS (SELECT event_id, user_id, CASE WHEN event_id % 100 = 7 THEN 'click' ELSE event_type END AS event_type FROM events WHERE event_id % 10 <> 4)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def feed_equivalence(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    e = events.select("event_id", "user_id", "event_type")
    b = e.where("event_id % 10 <> 4").withColumn("event_type", F.when(F.col("event_id") % 100 == 7, F.lit("click")).otherwise(F.col("event_type")))
    return op.symmetric_difference(e.where("event_id % 10 <> 3"), b)


@query("union_distinct", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_distinct(spark, sf_dir):
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    return orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).union(customer.where("c_acctbal < 0").select("c_custkey")).distinct()


_LEADS = "SELECT event_id, user_id, event_type AS s0, lead(event_type, 1) OVER w AS s1, lead(event_type, 2) OVER w AS s2, lead(event_type, 3) OVER w AS s3, ts AS t0, lead(ts, 3) OVER w AS t3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query("event_funnel_strict", f"SELECT user_id, event_id AS first_event, date_diff('second', t0, t3) AS seconds FROM ({_LEADS}) WHERE s0 = 'signup' AND s1 = 'view' AND s2 = 'click' AND s3 = 'purchase'")
def event_funnel_strict(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    m = op.match_strict(events, ["user_id"], ["ts", "event_id"], "event_type", ["signup", "view", "click", "purchase"])
    return m.select("user_id", F.col("event_id").alias("first_event"), fn.seconds_between(F.col("steps")[0]["ts"], F.col("steps")[3]["ts"]).alias("seconds"))


@query("event_funnel_optional", f"SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(count_if(s1 = 'view') AS BIGINT) AS n_with_view FROM ({_LEADS}) WHERE s0 = 'signup' AND (s1 = 'error' OR s1 = 'view' AND s2 = 'error') GROUP BY 1")
def event_funnel_optional(spark, sf_dir):
    """signup (view)? error, by the general matcher."""
    (events,) = tables(spark, sf_dir, "events")
    m = op.match_pattern(events, ["user_id"], ["ts", "event_id"], "event_type", {"signup": "S", "view": "V", "error": "E"}, "SV?E")
    return m.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_rows") == 3).alias("n_with_view"))


@query("lifecycle_anomaly", """
WITH g AS (SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path, bool_or(event_type = 'error') AS any_error, bool_or(event_type = 'purchase') AS any_purchase, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, md5(path) AS path_key, any_error, any_purchase, CAST(n AS BIGINT) AS n FROM g WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def lifecycle_anomaly(spark, sf_dir):
    events, orders = tables(spark, sf_dir, "events", "orders")
    g = events.groupBy("user_id").agg(
        F.md5(F.array_join(op.ordered_list("event_type", "ts", "event_id"), ">")).alias("path_key"), F.bool_or(F.col("event_type") == "error").alias("any_error"), F.bool_or(F.col("event_type") == "purchase").alias("any_purchase"), F.count(F.lit(1)).alias("n")
    )
    return g.join(orders.where("o_orderstatus = 'P'"), F.col("user_id") == F.col("o_custkey"), "left_anti")
