"""Aggregates and windows: additive measures, percentiles, ranks, frames, lift, confusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell import ml
from tidewell import operators as op
from tidewell.operators import timed
from tidewell.registry import query
from tidewell.session import tables


@query("dedupe_latest_lineitem", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS shipdate FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1""")
def dedupe_latest_lineitem(spark, sf_dir):
    (line,) = tables(spark, sf_dir, "lineitem")
    out = op.dedupe_latest(line, ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), F.desc("l_partkey"), F.desc("l_suppkey")])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipdate"))


@query("sla_by_nation_priority", """
WITH x AS (SELECT n_name AS nation, o_orderpriority AS priority, l_shipdate > o_orderdate + INTERVAL 60 DAY AS late, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT nation, priority, CAST(count(*) AS BIGINT) AS n_lines, CAST(count_if(late) AS BIGINT) AS n_late, CAST(sum(cents) AS BIGINT) AS revenue_cents, round(count_if(late)::DOUBLE / count(*), 4) AS late_rate FROM x GROUP BY 1, 2""")
def sla_by_nation_priority(spark, sf_dir):
    """Sums and counts are kept, the ratio is derived from them (so states can be added up)."""
    orders, line, customer, nation = tables(spark, sf_dir, "orders", "lineitem", "customer", "nation")
    late = F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 60 days")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    state = joined.groupBy(F.col("n_name").alias("nation"), F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(late).alias("n_late"), F.sum(fn.cents("l_extendedprice")).alias("revenue_cents")
    )
    return state.withColumn("late_rate", F.round(F.col("n_late") / F.col("n_lines"), 4))


@query("leg_percentiles", """
WITH x AS (SELECT l_returnflag AS flag, date_diff('day', o_orderdate, l_shipdate) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT flag, median(days)::DOUBLE AS p50, round(quantile_cont(days, 0.9), 6) AS p90, min(days) AS least, max(days) AS most, round(avg(days), 6) AS mean FROM x GROUP BY 1""")
def leg_percentiles(spark, sf_dir):
    orders, line = tables(spark, sf_dir, "orders", "lineitem")
    x = line.join(orders, line.l_orderkey == orders.o_orderkey).select(F.col("l_returnflag").alias("flag"), F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"))
    also = {"least": F.min("days").cast("long"), "most": F.max("days").cast("long"), "mean": F.sum(F.col("days") * F.col("n")) / F.sum("n")}
    return timed.exact_quantiles(x, ["flag"], "days", {"p50": 0.5, "p90": 0.9}, also).select("flag", "p50", F.round("p90", 6).alias("p90"), "least", "most", F.round("mean", 6).alias("mean"))


@query("trailing_load_1h", """
SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN 3600000 PRECEDING AND 1 PRECEDING) AS BIGINT) AS load FROM events""")
def trailing_load_1h(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return timed.trailing_counts(events.select("event_id", "user_id", "ts"), ["user_id"], "ts", 3_600_000, "load").select("event_id", "load")


@query("correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c_price, round(corr(l_quantity, l_discount), 6) AS c_discount FROM lineitem")
def correlation(spark, sf_dir):
    (line,) = tables(spark, sf_dir, "lineitem")
    return line.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("c_price"), F.round(F.corr("l_quantity", "l_discount"), 6).alias("c_discount"))


@query("quartile_drivers", """
WITH f AS (SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus = 'F' AS hit, ntile(4) OVER (ORDER BY o_totalprice, o_orderkey) AS q1, ntile(4) OVER (ORDER BY o_custkey, o_orderkey) AS q2 FROM orders),
u AS (SELECT 'price' AS driver, q1 AS quartile, hit FROM f UNION ALL SELECT 'customer', q2, hit FROM f)
SELECT driver, CAST(quartile AS INTEGER) AS quartile, CAST(count(*) AS BIGINT) AS n, CAST(count_if(hit) AS BIGINT) AS hits, round(100.0::DOUBLE * count_if(hit) / count(*), 3) AS pct FROM u GROUP BY 1, 2""")
def quartile_drivers(spark, sf_dir):
    """NTILE over the whole table, without one task for it: see :func:`global_ntile`."""
    (orders,) = tables(spark, sf_dir, "orders")
    hit = (F.col("o_orderstatus") == "F").alias("hit")
    each = [global_ntile(orders.select(F.col(c).alias("v"), F.col("o_orderkey").alias("k"), hit), ["v", "k"], 4).select(F.lit(name).alias("driver"), F.col("tile").alias("quartile"), "hit") for name, c in (("price", "o_totalprice"), ("customer", "o_custkey"))]
    u = each[0].unionByName(each[1])
    n, h = F.count(F.lit(1)), F.count_if("hit")
    return u.groupBy("driver", "quartile").agg(n.alias("n"), h.alias("hits"), F.round(100.0 * h / n, 3).alias("pct"))


def global_rank(df, order: list, parts: int | None = None):
    """Adds ``rank`` (from 1) and ``total`` over the whole table in ``order`` (unique): rows are range
    partitioned once (kept, so that counts and ranks see the same bounds), ranked in each part, and
    shifted by the counts of the parts before."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()).persist()
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(F.lit(1))).alias("total"))
    ranked = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return ranked.join(F.broadcast(before), "__p").withColumn("rank", F.col("__r") + F.col("__before")).drop("__p", "__r", "__before")


def global_ntile(df, order: list, n: int):
    """Adds ``tile`` 1..n as NTILE over the whole table: the first total % n tiles are one longer."""
    ranked = global_rank(df, order)
    size, extra, at = F.floor(F.col("total") / n), F.col("total") % n, F.col("rank") - 1
    long_part = extra * (size + 1)
    tile = F.when(at < long_part, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - long_part) / F.greatest(size, F.lit(1))))
    return ranked.withColumn("tile", (tile + 1).cast("int")).drop("rank", "total")


@query("confound_grid", """
WITH f AS (SELECT ntile(4) OVER (ORDER BY o_totalprice, o_orderkey) AS a, ntile(4) OVER (ORDER BY o_custkey, o_orderkey) AS b, o_orderstatus = 'F' AS hit FROM orders)
SELECT CAST(a AS INTEGER) AS price_q, CAST(count_if(hit AND b = 1) AS BIGINT) AS c1, CAST(count_if(hit AND b = 2) AS BIGINT) AS c2, CAST(count_if(hit AND b = 3) AS BIGINT) AS c3, CAST(count_if(hit AND b = 4) AS BIGINT) AS c4 FROM f GROUP BY 1""")
def confound_grid(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    f = global_ntile(orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), ["o_totalprice", "o_orderkey"], 4).withColumnRenamed("tile", "price_q")
    f = global_ntile(f, ["o_custkey", "o_orderkey"], 4)
    hit = F.col("o_orderstatus") == "F"
    return f.groupBy("price_q").agg(*[F.count_if(hit & (F.col("tile") == k)).alias(f"c{k}") for k in (1, 2, 3, 4)])


_SCORED = """
s AS (SELECT d.doc_id, l.quality AS y, CAST(least(n_chars, 8000) AS BIGINT) AS score FROM documents d JOIN labels l USING (doc_id))"""


def _scored(spark, sf_dir):
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return docs.join(labels, "doc_id").select("doc_id", F.col("quality").alias("y"), F.least("n_chars", F.lit(8000).cast("long")).alias("score"))


@query("decile_lift", f"""
WITH {_SCORED}, t AS (SELECT *, ntile(10) OVER (ORDER BY score DESC, doc_id) AS decile FROM s), a AS (SELECT decile, count(*) AS n, sum(y) AS pos FROM t GROUP BY 1)
SELECT CAST(decile AS INTEGER) AS decile, CAST(n AS BIGINT) AS n, CAST(pos AS BIGINT) AS pos, round(pos::DOUBLE / n, 4) AS rate, round(sum(pos) OVER (ORDER BY decile ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(pos) OVER (), 4) AS captured FROM a""")
def decile_lift(spark, sf_dir):
    t = global_ntile(_scored(spark, sf_dir), [F.desc("score"), F.asc("doc_id")], 10).groupBy(F.col("tile").alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("pos"))
    run = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.withColumn("rate", F.round(F.col("pos") / F.col("n"), 4)).withColumn("captured", F.round(F.sum("pos").over(run) / F.sum("pos").over(Window.partitionBy(F.lit(1))), 4))


@query("calibration_buckets", f"""
WITH {_SCORED} SELECT CASE WHEN score >= 8000 THEN 11 ELSE CAST(score // 800 AS INTEGER) + 1 END AS bucket, CAST(count(*) AS BIGINT) AS n, round(avg(score), 4) AS mean_score, round(avg(y), 4) AS observed FROM s GROUP BY 1""")
def calibration_buckets(spark, sf_dir):
    s = _scored(spark, sf_dir)
    bucket = F.width_bucket(F.col("score").cast("double"), F.lit(0.0), F.lit(8000.0), F.lit(10)).cast("int")
    return s.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.avg("y"), 4).alias("observed"))


@query("roc_auc", f"""
WITH {_SCORED}, p AS (SELECT * FROM s WHERE y = 1), q AS (SELECT * FROM s WHERE y = 0)
SELECT CAST(sum(CASE WHEN p.score > q.score THEN 2 WHEN p.score = q.score THEN 1 ELSE 0 END) AS BIGINT) AS twice_pairs, round(sum(CASE WHEN p.score > q.score THEN 2 WHEN p.score = q.score THEN 1 ELSE 0 END)::DOUBLE / (2 * count(*)), 6) AS auc FROM p, q""")
def roc_auc(spark, sf_dir):
    """AUC from counts by score: no pairs are made, and the running counts go through range partitions."""
    by = _scored(spark, sf_dir).groupBy("score").agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("q"))
    t = ml.running_sums(by, F.asc("score"), ["q"]).withColumn("below", F.col("q_upto") - F.col("q"))
    pairs = F.sum(2 * F.col("p") * F.col("below") + F.col("p") * F.col("q"))
    return t.agg(pairs.alias("twice_pairs"), F.round(pairs / (2 * F.sum("p") * F.sum("q")), 6).alias("auc"))


@query("class_metrics", f"""
WITH {_SCORED}, p AS (SELECT y, CASE WHEN score >= 300 THEN 1 ELSE 0 END AS h FROM s), c AS (SELECT unnest([0, 1]) AS class),
m AS (SELECT class, count_if(y = class AND h = class) AS tp, count_if(y <> class AND h = class) AS fp, count_if(y = class AND h <> class) AS fn FROM p, c GROUP BY 1)
SELECT CAST(class AS INTEGER) AS class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp::DOUBLE / nullif(tp + fp, 0), 4) AS "precision", round(tp::DOUBLE / nullif(tp + fn, 0), 4) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM m""")
def class_metrics(spark, sf_dir):
    p = _scored(spark, sf_dir).select("y", F.when(F.col("score") >= 300, 1).otherwise(0).alias("h"))
    cells = p.groupBy("y", "h").agg(F.count(F.lit(1)).alias("n"))
    c = cells.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))
    count = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0))
    y, h = F.col("y") == F.col("class"), F.col("h") == F.col("class")
    m = c.groupBy("class").agg(count(y & h).alias("tp"), count(~y & h).alias("fp"), count(y & ~h).alias("fn"))
    r = lambda a, b: F.round(F.try_divide(F.col(a) if isinstance(a, str) else a, b), 4)
    return m.withColumns({"precision": r("tp", F.col("tp") + F.col("fp")), "recall": r("tp", F.col("tp") + F.col("fn")), "f1": r(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


@query("confusion_pairs", f"WITH {_SCORED} SELECT CAST(y AS INTEGER) AS actual, CASE WHEN score >= 300 THEN 1 ELSE 0 END AS predicted, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2")
def confusion_pairs(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy(F.col("y").cast("int").alias("actual"), F.when(F.col("score") >= 300, 1).otherwise(0).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query("pivot_metrics", "SELECT o_orderpriority AS priority, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS f, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS o, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS p FROM orders GROUP BY 1")
def pivot_metrics(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    long = orders.groupBy(F.col("o_orderpriority").alias("priority"), F.lower("o_orderstatus").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return op.pivot_metrics(long, ["priority"], "metric", "value", ["f", "o", "p"]).fillna(0, ["f", "o", "p"])


@query("pareto_share", """
WITH a AS (SELECT p_brand AS brand, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT brand, CAST(cents AS BIGINT) AS cents, round(100 * cents::DOUBLE / sum(cents) OVER (), 4) AS share, round(100 * sum(cents) OVER (ORDER BY cents DESC, brand ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(cents) OVER (), 4) AS running FROM a""")
def pareto_share(spark, sf_dir):
    line, part = tables(spark, sf_dir, "lineitem", "part")
    a = line.join(part, line.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("brand")).agg(F.sum(fn.cents("l_extendedprice")).alias("cents"))
    total, run = F.sum("cents").over(Window.partitionBy(F.lit(1))), F.sum("cents").over(Window.orderBy(F.desc("cents"), "brand").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return a.select("brand", "cents", F.round(100 * F.col("cents").cast("double") / total, 4).alias("share"), F.round(100 * run.cast("double") / total, 4).alias("running"))


@query("worst_groups", """
SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS n_back FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 8
ORDER BY count_if(l_returnflag = 'R') * 1.0 / count(*) DESC, n DESC, 1, 2 LIMIT 25""")
def worst_groups(spark, sf_dir):
    """A top-25 report over the groups that are large enough."""
    (line,) = tables(spark, sf_dir, "lineitem")
    g = line.groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_back")).where("n >= 8")
    return g.orderBy((F.col("n_back") / F.col("n")).desc(), F.desc("n"), "l_suppkey", "month").limit(25)


@query("distinct_and_lists", """
SELECT o_custkey, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n_priorities, CAST(count(DISTINCT round(o_totalprice)) AS BIGINT) AS n_prices, string_agg(o_orderstatus, ';' ORDER BY o_orderdate, o_orderkey) AS statuses,
  bool_or(o_orderstatus = 'P') AS any_pending, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1""")
def distinct_and_lists(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(
        F.countDistinct("o_orderpriority").alias("n_priorities"), F.countDistinct(F.round("o_totalprice")).alias("n_prices"),
        F.array_join(op.ordered_list("o_orderstatus", "o_orderdate", "o_orderkey"), ";").alias("statuses"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"),
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"),
    )


@query("mode_by_group", "WITH a AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment AS segment, CAST(n AS BIGINT) AS n FROM a QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1")
def mode_by_group(spark, sf_dir):
    (customer,) = tables(spark, sf_dir, "customer")
    a = customer.groupBy("c_nationkey", F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return op.dedupe_latest(a, ["c_nationkey"], [F.desc("n"), F.asc("segment")])


@query("max_of_counts", "SELECT CAST(max(n) AS BIGINT) AS most, CAST(sum(n) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS groups FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)")
def max_of_counts(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("groups"))
