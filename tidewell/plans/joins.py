"""Joins: as-of, validity, interval, semi, anti, containment, pairwise."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell import operators as op
from tidewell.operators import neighbours, timed
from tidewell.registry import query
from tidewell.session import tables


@query("asof_price", """
WITH l AS (SELECT event_id, user_id, ts FROM events), r AS (SELECT user_id, ts AS rts, CAST(round(value * 100) AS BIGINT) AS rate FROM events WHERE event_type = 'purchase')
SELECT l.event_id, l.user_id, r.rate FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.rts""")
def asof_price(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    right = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("rts"), fn.cents("value").alias("rate"))
    return timed.as_of_sliced(events.select("event_id", "user_id", "ts"), right, "ts", "rts", ["user_id"], ["rate"]).select("event_id", "user_id", "rate")


@query("asof_daily_rate", """
WITH r AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT e.event_id, r.total FROM events e ASOF JOIN r ON e.ts >= r.day""")
def asof_daily_rate(spark, sf_dir):
    """As-of without a group key against a daily series."""
    (events,) = tables(spark, sf_dir, "events")
    r = events.where("event_type = 'view'").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.sum(fn.cents("value")).alias("total"))
    return op.as_of_join(events, r, "ts", "day", [], ["total"], how="inner").select("event_id", "total")


@query("order_value_usd", """
WITH r AS (SELECT date_trunc('day', ts)::TIMESTAMP AS rate_day, CAST(7000 + sum(CAST(round(value * 100) AS BIGINT)) % 1500 AS BIGINT) AS rate FROM events GROUP BY 1)
SELECT e.event_id, CAST(round(value * 100) AS BIGINT) AS paise, round(CAST(round(value * 100) AS BIGINT) / (rate / 100.0::DOUBLE) / 100, 4) AS usd FROM events e ASOF JOIN r ON e.ts >= r.rate_day + INTERVAL 1 DAY""")
def order_value_usd(spark, sf_dir):
    """Money at the last rate published before it was spent."""
    (events,) = tables(spark, sf_dir, "events")
    r = events.groupBy(F.date_trunc("day", "ts").alias("day")).agg((F.sum(fn.cents("value")) % 1500 + 7000).alias("rate")).withColumn("day", F.col("day") + F.expr("interval 1 day"))
    out = op.as_of_join(events.select("event_id", "ts", fn.cents("value").alias("paise")), r, "ts", "day", [], ["rate"], how="inner")
    return out.select("event_id", "paise", F.round(F.col("paise") / (F.col("rate") / F.lit(100.0)) / 100, 4).alias("usd"))


_VERSIONS = """
v AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS price, DATE '1900-01-01' AS valid_from, CASE WHEN p_partkey % 10 = 0 THEN DATE '1998-01-01' ELSE DATE '9999-12-31' END AS valid_to FROM part
  UNION ALL SELECT p_partkey, CAST(round(p_retailprice * 115) AS BIGINT), DATE '1998-01-01', DATE '9999-12-31' FROM part WHERE p_partkey % 10 = 0)"""


def _versions(part):
    first = F.when(F.col("p_partkey") % 10 == 0, F.lit("1998-01-01")).otherwise(F.lit("9999-12-31")).cast("date")
    price = lambda k: F.round(F.col("p_retailprice") * k).cast("long").alias("price")
    a = part.select("p_partkey", price(100), F.lit("1900-01-01").cast("date").alias("valid_from"), first.alias("valid_to"))
    b = part.where("p_partkey % 10 = 0").select("p_partkey", price(115), F.lit("1998-01-01").cast("date").alias("valid_from"), F.lit("9999-12-31").cast("date").alias("valid_to"))
    return a.unionByName(b)


@query("validity_join", f"""
WITH {_VERSIONS} SELECT v.p_partkey, v.price, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
FROM lineitem l JOIN v ON l.l_partkey = v.p_partkey AND l.l_shipdate >= v.valid_from AND l.l_shipdate < v.valid_to GROUP BY 1, 2""")
def validity_join(spark, sf_dir):
    part, line = tables(spark, sf_dir, "part", "lineitem")
    dim = _versions(part).withColumn("k", F.col("p_partkey"))
    out = op.validity_join(line.select("l_partkey", "l_quantity", "l_shipdate").withColumnRenamed("l_partkey", "k"), dim, "k", "l_shipdate", how="inner")
    return out.groupBy("p_partkey", "price").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


@query("order_enrichment", """
SELECT o.o_orderkey, c.c_mktsegment AS segment, n.n_name AS nation, r.r_name AS region, coalesce(s.n, 0) AS n_returns
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON s.l_orderkey = o.o_orderkey""")
def order_enrichment(spark, sf_dir):
    orders, customer, nation, region, line = tables(spark, sf_dir, "orders", "customer", "nation", "region", "lineitem")
    back = line.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    out = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(back, "o_orderkey", "left")
    return out.select("o_orderkey", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("n", F.lit(0)).alias("n_returns"))


@query("integrity_report", """
SELECT 'orders without customer' AS check_name, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)
UNION ALL SELECT 'lines without order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'lines without part', count(*) FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_partkey IS NULL
UNION ALL SELECT 'orders with a return', count(*) FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def integrity_report(spark, sf_dir):
    orders, customer, line, part = tables(spark, sf_dir, "orders", "customer", "lineitem", "part")
    n = lambda name, df: df.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("n"))
    return (
        n("orders without customer", orders.join(customer.where("c_custkey % 7 <> 0"), orders.o_custkey == customer.c_custkey, "left_anti"))
        .unionByName(n("lines without order", line.join(orders, line.l_orderkey == orders.o_orderkey, "left_anti")))
        .unionByName(n("lines without part", line.join(part, line.l_partkey == part.p_partkey, "left_anti")))
        .unionByName(n("orders with a return", orders.join(line.where("l_returnflag = 'R'"), orders.o_orderkey == line.l_orderkey, "left_semi")))
    )


@query("interval_overlap", """
WITH i AS (SELECT l_orderkey AS k, l_suppkey, l_linenumber AS n, l_shipdate AS a, l_shipdate + INTERVAL 10 DAY AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)
SELECT x.k AS l_orderkey, CAST(count(*) AS BIGINT) AS n_overlaps FROM i x JOIN i y ON x.k = y.k AND x.i < y.i AND x.a < y.b AND x.b > y.a GROUP BY 1""")
def interval_overlap(spark, sf_dir):
    (line,) = tables(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    i = line.select("l_orderkey", F.col("l_shipdate").alias("a"), (F.col("l_shipdate") + F.expr("interval 10 days")).alias("b"), F.row_number().over(w).alias("i"))
    other = i.toDF("k", "c", "d", "j")
    return timed.interval_join(i, other, [("l_orderkey", "k")], ("a", "b"), ("c", "d")).where("i < j").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_overlaps"))


@query("containment_join", "SELECT CAST(b.item_id AS BIGINT) AS item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def containment_join(spark, sf_dir):
    """Texts that contain a given string: words inside the strings are looked up in the texts' windows of as many words, then the whole is checked.

    The first and last word of a string may be parts of words in a text, so the key is the second to
    fifth word, or what lies between the ends of a shorter string. Strings of one or two words have no
    key; all of them are looked for at once in each text.
    """
    benchmark, docs = tables(spark, sf_dir, "benchmark", "documents")
    words = lambda c: F.split(F.trim(F.regexp_replace(c, "\\s+", " ")), " ")
    b = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("needle"), words("text").alias("w"))
    b = b.select("item_id", "needle", F.least(F.size("w") - 2, F.lit(4)).alias("n"), "w")
    b = b.select("item_id", "needle", "n", F.when(F.col("n") > 0, F.concat_ws(" ", F.expr("slice(w, 2, greatest(n, 0))"))).alias("key"))
    sizes = sorted(r.n for r in b.where("n > 0").select("n").distinct().collect()) or [4]
    d = docs.select("doc_id", "text", words("text").alias("w"), F.explode(F.array(*map(F.lit, sizes))).alias("n"))
    d = d.select("doc_id", "n", F.explode(F.array_distinct(F.expr("transform(if(size(w) < n, array(), sequence(1, size(w) - n + 1)), i -> concat_ws(' ', slice(w, i, n)))"))).alias("key"))
    near = d.join(b.where("key is not null"), ["n", "key"]).select("doc_id", "item_id", "needle").distinct()
    hits = near.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "needle")).select("item_id", "doc_id")
    short = op.containing(docs.select("doc_id", "text"), "doc_id", "text", b.where("key is null").select("item_id", "needle"), "item_id", "needle")
    return hits.unionByName(short)


_NEAR = """
WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""


@query("knn_cosine", _NEAR + "SELECT a AS vec_id, b AS neighbour, sim FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 3")
def knn_cosine(spark, sf_dir):
    """Three nearest neighbours of every row among all rows."""
    (emb,) = tables(spark, sf_dir, "embeddings")
    return neighbours.nearest(emb, 3).select("vec_id", "neighbour", "sim")


@query("nn_classifier", _NEAR + """, q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) = 1)
SELECT CAST(la AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN la = lb THEN 1 ELSE 0 END) AS BIGINT) AS right_ones FROM q GROUP BY 1""")
def nn_classifier(spark, sf_dir):
    """1-NN by cosine over all rows, leave one out."""
    (emb,) = tables(spark, sf_dir, "embeddings")
    return neighbours.nearest(emb, 1).groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("neighbour_label")).alias("right_ones"))


@query("pair_similarity", _NEAR + "SELECT la = lb AS same_label, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(sim * 100000) AS BIGINT)) AS BIGINT) AS sim_units FROM p WHERE a < b GROUP BY 1")
def pair_similarity(spark, sf_dir):
    (emb,) = tables(spark, sf_dir, "embeddings")
    return op.pair_units(emb).groupBy("same_label").agg(F.sum("n").alias("n"), F.sum("sim_units").alias("sim_units"))
