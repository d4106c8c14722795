"""The domain pipeline on the given tables: conformed tables, marts, features, served views.

``domain`` reads the given tables as orders of a delivery service: suppliers are stores, parts are
products with two price versions, orders get the times, events and money that such orders have, all
by arithmetic on their keys. The SQL does the same, and then each table by its definition.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell import marts
from tidewell import operators as op
from tidewell.registry import query
from tidewell.session import tables
from tidewell.sources import spine_of

SPLIT_DAYS = 1500

DOMAIN = """
store AS (SELECT s_suppkey AS store_id, 'DS' || lpad(s_suppkey::VARCHAR, 5, '0') AS store_code, n_name AS city, 12.9::DOUBLE + (s_suppkey % 50) / 100.0::DOUBLE AS lat, 77.5::DOUBLE + (s_suppkey % 70) / 100.0::DOUBLE AS lon, s_suppkey % 9 <> 0 AS is_active
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
customers AS (SELECT c_custkey AS customer_id, c_name AS full_name, c_mktsegment AS segment, 12.9::DOUBLE + (c_custkey % 97) / 400.0::DOUBLE AS home_lat, 77.5::DOUBLE + (c_custkey % 89) / 300.0::DOUBLE AS home_lon FROM customer),
rider AS (SELECT c_custkey AS rider_id, c_name AS full_name, CASE c_custkey % 3 WHEN 0 THEN 'BIKE' WHEN 1 THEN 'EV_BIKE' ELSE 'CYCLE' END AS vehicle_type, c_custkey % 12 <> 0 AS is_active FROM customer),
product AS (SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category_l3, CAST(round(p_retailprice * 100) AS BIGINT) AS price_paise, TIMESTAMP '1900-01-01' AS valid_from, CASE WHEN p_partkey % 10 = 0 THEN TIMESTAMP '1998-01-01' END AS valid_to FROM part
  UNION ALL SELECT p_partkey, p_name, p_type, CAST(round(p_retailprice * 115) AS BIGINT), TIMESTAMP '1998-01-01', NULL FROM part WHERE p_partkey % 10 = 0),
header AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderkey % 10 AS store_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS rider_id,
    o_orderdate::TIMESTAMP + to_seconds((o_orderkey * 7919) % 86400) AS placed_ts, CASE WHEN o_orderstatus = 'P' THEN 'CANCELLED' ELSE 'DELIVERED' END AS status,
    CASE o_orderkey % 4 WHEN 0 THEN 'UPI' WHEN 1 THEN 'CARD' WHEN 2 THEN 'COD' ELSE 'WALLET' END AS payment_method, 1 + o_orderkey % 6 AS item_count, CAST(round(o_totalprice * 100) AS BIGINT) AS gross_paise FROM orders),
header2 AS (SELECT *, placed_ts + to_minutes(20) AS promised_ts, CASE WHEN status = 'DELIVERED' THEN placed_ts + to_seconds(480 + (order_id * 613) % 1080) END AS delivered_ts,
    CASE WHEN order_id % 5 = 0 THEN gross_paise // 10 ELSE 0 END AS discount_paise, CAST(2500 AS BIGINT) AS delivery_fee_paise FROM header),
oh AS (SELECT *, gross_paise - discount_paise + delivery_fee_paise AS order_total_paise FROM header2),
oe AS (SELECT order_id, store_id, rider_id, order_id * 10 + k AS event_id, s AS to_status, lag(s) OVER (PARTITION BY order_id ORDER BY k) AS from_status, placed_ts + to_seconds(CASE WHEN order_id % 40 = 9 AND k = 2 THEN 900 ELSE 110 * k END) AS event_ts FROM (
    SELECT oh.*, unnest(CASE WHEN status = 'DELIVERED' AND order_id % 50 = 3 THEN [0, 2, 3] WHEN status = 'DELIVERED' THEN [0, 1, 2, 3] WHEN order_id % 2 = 0 THEN [0, 1, 4] ELSE [0, 4] END) AS k FROM oh WHERE order_id % 500 <> 77)
  JOIN (VALUES (0, 'PLACED'), (1, 'PACKED'), (2, 'PICKED_UP'), (3, 'DELIVERED'), (4, 'CANCELLED')) n(k, s) USING (k)),
paths AS (SELECT order_id, string_agg(to_status, '>' ORDER BY event_ts, event_id) AS path FROM oe GROUP BY 1),
funnel AS (SELECT order_id, 110 AS pack_sec, 110 AS pick_sec, 110 AS ride_sec, 330 AS total_sec FROM paths WHERE path = 'PLACED>PACKED>PICKED_UP>DELIVERED'),
cancelled AS (SELECT order_id, path = 'PLACED>PACKED>CANCELLED' AS was_packed FROM paths WHERE path IN ('PLACED>CANCELLED', 'PLACED>PACKED>CANCELLED')),
anomaly AS (SELECT order_id, CASE WHEN NOT contains(path, 'PACKED') THEN 'MISSING_PACKED' WHEN NOT contains(path, 'PICKED_UP') THEN 'MISSING_PICKED_UP' WHEN NOT contains(path, 'DELIVERED') THEN 'MISSING_DELIVERED' ELSE 'OUT_OF_ORDER' END AS anomaly_type, path
  FROM paths WHERE order_id NOT IN (SELECT order_id FROM funnel UNION ALL SELECT order_id FROM cancelled)),
dim_store AS (SELECT md5(store_id::VARCHAR) AS store_sk, * FROM store),
dim_customer AS (SELECT md5(customer_id::VARCHAR) AS customer_sk, * FROM customers),
dim_product AS (SELECT md5(product_id || '-' || strftime(valid_from, '%Y-%m-%d %H:%M:%S')) AS product_sk, * REPLACE (coalesce(valid_to, TIMESTAMP '9999-12-31') AS valid_to) FROM product),
fct AS (SELECT md5(o.order_id::VARCHAR) AS order_sk, o.*, md5(customer_id::VARCHAR) AS customer_sk, md5(store_id::VARCHAR) AS store_sk, md5(coalesce(rider_id::VARCHAR, '_dbt_utils_surrogate_key_null_')) AS rider_sk,
    f.total_sec, f.pack_sec, f.pick_sec, f.ride_sec, coalesce(CASE WHEN f.order_id IS NOT NULL THEN 'CLEAN' WHEN c.order_id IS NOT NULL THEN 'CANCELLED' ELSE a.anomaly_type END, 'NO_EVENTS') AS lifecycle_outcome,
    delivered_ts IS NOT NULL AND delivered_ts > promised_ts AS is_breached, date_diff('second', promised_ts, delivered_ts) AS breach_sec
  FROM oh o LEFT JOIN funnel f USING (order_id) LEFT JOIN cancelled c ON c.order_id = o.order_id LEFT JOIN anomaly a ON a.order_id = o.order_id),
feat0 AS (SELECT f.*, s.city, s.store_code, c.segment, 2 * 6371.0 * asin(sqrt(pow(sin((radians(home_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(home_lat)) * pow(sin((radians(home_lon) - radians(lon)) / 2), 2))) AS dist_km,
    hour(placed_ts + to_minutes(330)) AS ist_hour, dayofweek(placed_ts) IN (0, 6) AS we,
    count(*) OVER (PARTITION BY f.store_id ORDER BY epoch_ms(placed_ts) RANGE BETWEEN 3600000 PRECEDING AND 1 PRECEDING) AS store_load_60m
  FROM fct f JOIN dim_store s USING (store_sk) JOIN dim_customer c USING (customer_sk) WHERE status = 'DELIVERED'),
feat AS (SELECT *, (ist_hour IN (12, 13, 19, 20, 21))::INT AS is_peak_hour, we::INT AS is_weekend, (payment_method = 'COD')::INT AS is_cod, is_breached::INT::DOUBLE AS label,
    CASE WHEN placed_ts < (SELECT min(placed_ts)::DATE + 1500 FROM fct) THEN 'TRAIN' ELSE 'TEST' END AS split FROM feat0)"""


def domain(spark, sf_dir) -> SimpleNamespace:
    supplier, nation, customer, part, orders, line = tables(spark, sf_dir, "supplier", "nation", "customer", "part", "orders", "lineitem")
    at = lambda key, base, mod, by: F.lit(base) + (F.col(key) % mod) / F.lit(by)
    stores = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("store_id"), F.concat(F.lit("DS"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("store_code"), F.col("n_name").alias("city"),
        at("s_suppkey", 12.9, 50, 100.0).alias("lat"), at("s_suppkey", 77.5, 70, 100.0).alias("lon"), (F.col("s_suppkey") % 9 != 0).alias("is_active"),
    )
    customers = customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("segment"), at("c_custkey", 12.9, 97, 400.0).alias("home_lat"), at("c_custkey", 77.5, 89, 300.0).alias("home_lon"))
    vehicle = F.element_at(F.array(F.lit("BIKE"), F.lit("EV_BIKE"), F.lit("CYCLE")), (F.col("c_custkey") % 3 + 1).cast("int"))
    riders = customer.select(F.col("c_custkey").alias("rider_id"), F.col("c_name").alias("full_name"), vehicle.alias("vehicle_type"), (F.col("c_custkey") % 12 != 0).alias("is_active"))
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    changed = F.col("p_partkey") % 10 == 0
    version = lambda k: [F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category_l3"), F.round(F.col("p_retailprice") * k).cast("long").alias("price_paise")]
    products = part.select(*version(100), day("1900-01-01").alias("valid_from"), F.when(changed, day("1998-01-01")).alias("valid_to")).unionByName(
        part.where(changed).select(*version(115), day("1998-01-01").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    )
    k = F.col("o_orderkey")
    pay = F.element_at(F.array(*map(F.lit, ("UPI", "CARD", "COD", "WALLET"))), (k % 4 + 1).cast("int"))
    plus = lambda ts, n: F.timestamp_add("SECOND", n.cast("int"), ts)
    headers = orders.select(
        k.alias("order_id"), F.col("o_custkey").alias("customer_id"), (k % 10).alias("store_id"), F.when(k % 7 != 0, F.col("o_custkey")).alias("rider_id"),
        plus(F.col("o_orderdate").cast("timestamp_ntz"), (k * 7919) % 86400).alias("placed_ts"), F.when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise("DELIVERED").alias("status"),
        pay.alias("payment_method"), (k % 6 + 1).alias("item_count"), fn.cents("o_totalprice").alias("gross_paise"),
    )
    headers = headers.withColumns({
        "promised_ts": plus(F.col("placed_ts"), F.lit(1200)), "delivered_ts": F.when(F.col("status") == "DELIVERED", plus(F.col("placed_ts"), (F.col("order_id") * 613) % 1080 + 480)),
        "discount_paise": F.when(F.col("order_id") % 5 == 0, F.expr("gross_paise div 10")).otherwise(0), "delivery_fee_paise": F.lit(2500).cast("long"),
    })
    headers = headers.withColumn("order_total_paise", F.col("gross_paise") - F.col("discount_paise") + F.col("delivery_fee_paise"))
    oid = F.col("order_id")
    steps = F.when((F.col("status") == "DELIVERED") & (oid % 50 == 3), F.array(*map(F.lit, (0, 2, 3)))).when(F.col("status") == "DELIVERED", F.array(*map(F.lit, (0, 1, 2, 3)))).when(oid % 2 == 0, F.array(*map(F.lit, (0, 1, 4)))).otherwise(F.array(F.lit(0), F.lit(4)))
    names = F.array(*map(F.lit, ("PLACED", "PACKED", "PICKED_UP", "DELIVERED", "CANCELLED")))
    events = headers.where(oid % 500 != 77).withColumn("steps", steps).select("*", F.posexplode("steps").alias("pos", "k"))
    seconds = F.when((oid % 40 == 9) & (F.col("k") == 2), 900).otherwise(F.col("k") * 110)
    before = F.when(F.col("pos") > 0, F.element_at(names, F.element_at("steps", F.greatest("pos", F.lit(1))) + 1))
    events = events.select("order_id", "store_id", "rider_id", (oid * 10 + F.col("k")).alias("event_id"), F.element_at(names, F.col("k") + 1).alias("to_status"), before.alias("from_status"), plus(F.col("placed_ts"), seconds).alias("event_ts"))
    lines = line.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_shipdate").cast("date").alias("ship_day"),
        F.col("l_quantity").cast("long").alias("qty"), F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long").alias("unit_price_paise"), fn.cents("l_extendedprice").alias("line_total_paise"),
    )
    item_id = F.concat_ws("-", *[F.col(c).cast("string") for c in ("order_id", "line_number", "product_id", "supplier_id")], F.date_format("ship_day", "yyyyMMdd"))
    items = lines.select(item_id.alias("order_item_id"), "order_id", "product_id", "qty", "unit_price_paise", "line_total_paise")
    return SimpleNamespace(stores=stores, customers=customers, riders=riders, products=products, headers=headers, events=events, lines=lines, item_id=item_id, items=items)


#: Of one task of the stock snapshots.
STOCK_ROWS = 500_000


def _stock(spark, sf_dir):
    """Stock by day, store and product, and over how many tasks it is dealt. Nearly every line has a key of its own: summed
    before the shuffle, they would fill a task's memory and come out as many."""
    (line,) = tables(spark, sf_dir, "lineitem")
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(line.count() / STOCK_ROWS))
    rows = line.select(F.col("l_shipdate").cast("date").alias("snapshot_date"), (F.col("l_suppkey") % 10).alias("store_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("long").alias("qty"))
    stock = rows.repartition(parts, "snapshot_date", "store_id", "product_id").groupBy("snapshot_date", "store_id", "product_id").agg(F.sum("qty").alias("on_hand_qty"))
    return stock.withColumn("reorder_level", F.col("product_id") % 30), parts


def _dims(d: SimpleNamespace) -> SimpleNamespace:
    d.dim_store, d.dim_customer = marts.dimension(d.stores, "store", "store_id"), marts.dimension(d.customers, "customer", "customer_id")
    d.dim_product = marts.dim_product(d.products)
    d.funnel, d.cancelled = marts.order_funnel(d.events), marts.order_cancelled(d.events)
    d.anomaly = marts.order_anomaly(d.events, d.funnel, d.cancelled)
    d.fact = marts.fct_order(d.headers, d.funnel, d.cancelled, d.anomaly)
    return d


def _text(df):
    """Times as text, so that results compare."""
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n, t in df.dtypes if t.startswith("timestamp")} | {n: F.date_format(n, "yyyy-MM-dd") for n, t in df.dtypes if t == "date"})


@query("mart_dim_date", """
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_sk, strftime(d, '%Y-%m-%d') AS calendar_date, CAST(year(d) AS INTEGER) AS calendar_year, CAST(quarter(d) AS INTEGER) AS calendar_quarter, CAST(month(d) AS INTEGER) AS calendar_month, strftime(d, '%b') AS month_name,
  CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofweek(d) AS INTEGER) AS day_of_week, strftime(d, '%a') AS day_name, CAST(week(d) AS INTEGER) AS week_of_year, dayofweek(d) IN (0, 6) AS is_weekend
FROM (SELECT unnest(generate_series((SELECT min(l_shipdate)::DATE FROM lineitem), (SELECT max(l_shipdate)::DATE FROM lineitem), INTERVAL 1 DAY))::DATE AS d)""")
def mart_dim_date(spark, sf_dir):
    (line,) = tables(spark, sf_dir, "lineitem")
    return _text(marts.dim_date(spine_of(line, "l_shipdate")))


@query("mart_dim_store", f"WITH {DOMAIN} SELECT * FROM dim_store")
def mart_dim_store(spark, sf_dir):
    return marts.dimension(domain(spark, sf_dir).stores, "store", "store_id")


@query("mart_dim_customer", f"WITH {DOMAIN} SELECT * FROM dim_customer")
def mart_dim_customer(spark, sf_dir):
    return marts.dimension(domain(spark, sf_dir).customers, "customer", "customer_id")


@query("mart_dim_rider", f"WITH {DOMAIN} SELECT md5(rider_id::VARCHAR) AS rider_sk, * FROM rider")
def mart_dim_rider(spark, sf_dir):
    return marts.dimension(domain(spark, sf_dir).riders, "rider", "rider_id")


@query("mart_dim_product", f"WITH {DOMAIN} SELECT * REPLACE (strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to) FROM dim_product")
def mart_dim_product(spark, sf_dir):
    return _text(marts.dim_product(domain(spark, sf_dir).products))


@query("mart_fct_order", f"""
WITH {DOMAIN} SELECT order_sk, order_id, CAST(strftime(placed_ts, '%Y%m%d') AS INTEGER) AS placed_date_sk, customer_sk, store_sk, rider_sk, strftime(placed_ts, '%Y-%m-%d %H:%M:%S') AS placed_ts, strftime(promised_ts, '%Y-%m-%d %H:%M:%S') AS promised_ts,
  strftime(delivered_ts, '%Y-%m-%d %H:%M:%S') AS delivered_ts, pack_sec::BIGINT AS pack_sec, pick_sec::BIGINT AS pick_sec, ride_sec::BIGINT AS ride_sec, total_sec::BIGINT AS total_sec, status, lifecycle_outcome, is_breached, breach_sec, payment_method, item_count, gross_paise,
  discount_paise, delivery_fee_paise, order_total_paise FROM fct""")
def mart_fct_order(spark, sf_dir):
    return _text(_dims(domain(spark, sf_dir)).fact)


@query("mart_fct_order_item", f"""
WITH {DOMAIN}, i AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS qty,
  CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS unit_price_paise, CAST(round(l_extendedprice * 100) AS BIGINT) AS line_total_paise FROM lineitem)
SELECT md5(order_item_id) AS order_item_sk, order_item_id, i.order_id, md5(i.order_id::VARCHAR) AS order_sk, product_sk, i.product_id, CAST(strftime(placed_ts, '%Y%m%d') AS INTEGER) AS placed_date_sk, qty, unit_price_paise, line_total_paise,
  price_paise AS catalogue_price_paise, unit_price_paise - price_paise AS price_variance_paise
FROM i JOIN oh USING (order_id) LEFT JOIN dim_product p ON p.product_id = i.product_id AND placed_ts >= p.valid_from AND placed_ts < p.valid_to""")
def mart_fct_order_item(spark, sf_dir):
    d = domain(spark, sf_dir)
    return marts.fct_order_item(d.lines, d.headers, marts.dim_product(d.products), d.item_id)


@query("mart_fct_order_status_event", f"""
WITH {DOMAIN} SELECT md5(event_id::VARCHAR) AS event_sk, event_id, order_id, md5(order_id::VARCHAR) AS order_sk, md5(store_id::VARCHAR) AS store_sk, md5(coalesce(rider_id::VARCHAR, '_dbt_utils_surrogate_key_null_')) AS rider_sk,
  CAST(strftime(event_ts, '%Y%m%d') AS INTEGER) AS event_date_sk, from_status, to_status, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts FROM oe""")
def mart_fct_order_status_event(spark, sf_dir):
    return _text(marts.fct_order_status_event(domain(spark, sf_dir).events))


@query("mart_fct_inventory_daily", """
WITH s AS (SELECT l_shipdate::DATE AS d, l_suppkey % 10 AS store_id, l_partkey AS product_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS on_hand_qty, l_partkey % 30 AS reorder_level FROM lineitem GROUP BY ALL)
SELECT md5(strftime(d, '%Y-%m-%d') || '-' || store_id || '-' || product_id) AS inventory_sk, CAST(strftime(d, '%Y%m%d') AS INTEGER) AS snapshot_date_sk, strftime(d, '%Y-%m-%d') AS snapshot_date, md5(store_id::VARCHAR) AS store_sk, store_id, product_id, on_hand_qty, reorder_level,
  on_hand_qty <= reorder_level AS is_below_reorder, greatest(reorder_level - on_hand_qty, 0) AS units_short FROM s""")
def mart_fct_inventory_daily(spark, sf_dir):
    return _text(marts.fct_inventory_daily(_stock(spark, sf_dir)[0]))


@query("lifecycle_partition", f"""
WITH {DOMAIN} SELECT lifecycle_outcome AS outcome, CAST(count(*) AS BIGINT) AS n, (SELECT count(*) FROM funnel) + (SELECT count(*) FROM cancelled) + (SELECT count(*) FROM anomaly) = (SELECT count(DISTINCT order_id) FROM oe) AS adds_up FROM fct GROUP BY 1""")
def lifecycle_partition(spark, sf_dir):
    """Clean, cancelled and anomalous orders part the orders that have events."""
    d = _dims(domain(spark, sf_dir))
    n = d.fact.groupBy(F.col("lifecycle_outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("c"))
    parts = count(d.funnel).unionByName(count(d.cancelled)).unionByName(count(d.anomaly)).agg(F.sum("c").alias("parts"))
    whole = d.events.agg(F.countDistinct("order_id").alias("whole"))
    return n.crossJoin(F.broadcast(parts)).crossJoin(F.broadcast(whole)).select("outcome", "n", (F.col("parts") == F.col("whole")).alias("adds_up"))


@query("order_features", f"""
WITH {DOMAIN} SELECT order_id, strftime(placed_ts, '%Y-%m-%d %H:%M:%S') AS placed_ts, city, segment, payment_method, round(dist_km, 6) AS dist_km, CAST(ist_hour AS INTEGER) AS ist_hour, item_count, gross_paise, store_load_60m, is_peak_hour, is_weekend, is_cod, round(dist_km / 5, 6) AS f_dist_5,
  is_peak_hour::DOUBLE AS f_peak, round(least(store_load_60m, 15) / 15.0::DOUBLE, 6) AS f_load_15, round(item_count / 5.0::DOUBLE, 6) AS f_items_5, is_weekend::DOUBLE AS f_weekend, is_cod::DOUBLE AS f_cod, label, split FROM feat""")
def order_features(spark, sf_dir):
    return _text(_rounded(_features(spark, sf_dir)))


def _features(spark, sf_dir):
    marts.assert_no_leakage(marts.FEATURES)
    d = _dims(domain(spark, sf_dir))
    return marts.order_features(marts.placed_orders(d.headers), d.dim_store, d.dim_customer, SPLIT_DAYS)


def _rounded(df, places: int = 6):
    return df.withColumns({n: F.round(n, places) for n, t in df.dtypes if t == "double"})


@query("feature_split", f"""
WITH {DOMAIN} SELECT split, CAST(count(*) AS BIGINT) AS orders, strftime(min(placed_ts), '%Y-%m-%d') AS from_date, strftime(max(placed_ts), '%Y-%m-%d') AS to_date, round(avg(label) * 100, 2) AS breach_pct, CAST(sum(is_peak_hour) AS BIGINT) AS peak, CAST(sum(item_count) AS BIGINT) AS items FROM feat GROUP BY 1""")
def feature_split(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.groupBy("split").agg(
        F.count(F.lit(1)).alias("orders"), F.date_format(F.min("placed_ts"), "yyyy-MM-dd").alias("from_date"), F.date_format(F.max("placed_ts"), "yyyy-MM-dd").alias("to_date"),
        F.round(F.avg("label") * 100, 2).alias("breach_pct"), F.sum("is_peak_hour").alias("peak"), F.sum("item_count").alias("items"),
    )


@query("feature_class_balance", f"""
WITH {DOMAIN}, r AS (SELECT split, round(avg(label) * 100, 2) AS r FROM feat GROUP BY 1) SELECT CAST(to_json(map(list(split ORDER BY split), list(r ORDER BY split))) AS VARCHAR) AS rates, count(*) = 2 AS two_splits FROM r""")
def feature_class_balance(spark, sf_dir):
    """An object of the breach rate by split."""
    r = _features(spark, sf_dir).groupBy("split").agg(F.round(F.avg("label") * 100, 2).alias("r"))
    rates = F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "r"))))
    return r.agg(F.to_json(rates).alias("rates"), (F.count(F.lit(1)) == 2).alias("two_splits"))


@query("sla_store_hour", f"""
WITH {DOMAIN}, a AS (SELECT store_code, city, strftime(placed_ts, '%Y-%m-%d') AS placed_date, CAST(ist_hour AS INTEGER) AS ist_hour, count(*) AS orders, count_if(is_breached) AS breached, sum(date_diff('second', placed_ts, promised_ts)) AS p, sum(date_diff('second', placed_ts, delivered_ts)) AS d, count(delivered_ts) AS dn,
  sum(order_total_paise) AS gross FROM feat GROUP BY ALL)
SELECT store_code, city, placed_date, ist_hour, CAST(orders AS BIGINT) AS orders, CAST(breached AS BIGINT) AS breached, round(100 * (breached::DOUBLE / orders), 2) AS breach_pct, round(p::DOUBLE / orders / 60, 1) AS avg_promised_min, round(d::DOUBLE / dn / 60, 1) AS avg_actual_min, CAST(gross AS BIGINT) AS gross_paise FROM a""")
def sla_store_hour(spark, sf_dir):
    d = _dims(domain(spark, sf_dir))
    return marts.sla_rates(marts.sla_store_hour(d.fact, d.dim_store))


#: A plain score of the risk that its order is late, by what is known when it is placed.
RISK_SQL = "round(0.05 * least(dist_km, 40) / 4 + 0.02 * item_count + 0.1 * is_peak_hour, 6)"


def _risk():
    return F.round(0.05 * F.least(F.col("dist_km"), F.lit(40.0)) / 4 + 0.02 * F.col("item_count") + 0.1 * F.col("is_peak_hour"), 6)


@query("risk_queue", f"""
WITH {DOMAIN}, t AS (SELECT *, {RISK_SQL} AS p FROM feat WHERE split = 'TEST')
SELECT order_id, store_code, city, date_diff('minute', placed_ts, promised_ts) AS promised_min, item_count, store_load_60m, is_peak_hour = 1 AS is_peak_hour, p AS p_breach, CAST(ntile(10) OVER (ORDER BY p DESC, order_id) AS INTEGER) AS risk_decile, is_breached AS actual_breached, breach_sec FROM t""")
def risk_queue(spark, sf_dir):
    """Orders of the test window by risk, with their decile and, as it is a replay, what happened."""
    from tidewell.plans.aggregates import global_ntile

    d = _dims(domain(spark, sf_dir))
    placed = marts.placed_orders(d.headers)
    f = marts.order_features(placed, d.dim_store, d.dim_customer, SPLIT_DAYS).where("split = 'TEST'").select("order_id", "store_load_60m", "is_peak_hour", _risk().alias("p"))
    out = f.join(placed, "order_id").join(d.dim_store.select("store_sk", "store_code", "city"), "store_sk")
    out = out.select(
        "order_id", "store_code", "city", fn.minutes_between("placed_ts", "promised_ts").alias("promised_min"), "item_count", "store_load_60m", (F.col("is_peak_hour") == 1).alias("is_peak_hour"),
        "p", F.col("is_breached").alias("actual_breached"), "breach_sec",
    )
    ranked = global_ntile(out, [F.desc("p"), F.asc("order_id")], 10)
    return ranked.withColumnRenamed("tile", "risk_decile").withColumnRenamed("p", "p_breach")


@query("queue_capture", f"""
WITH {DOMAIN}, t AS (SELECT *, {RISK_SQL} AS p FROM feat WHERE split = 'TEST'), q AS (SELECT * FROM t ORDER BY p DESC, order_id LIMIT 100)
SELECT CAST(count(*) AS BIGINT) AS queued, CAST(count_if(is_breached) AS BIGINT) AS reached, (SELECT CAST(count_if(is_breached) AS BIGINT) FROM t) AS late_in_all FROM q""")
def queue_capture(spark, sf_dir):
    """How many of the late orders the first hundred of the queue reach."""
    f = _features(spark, sf_dir).where("split = 'TEST'").select("order_id", "label", _risk().alias("p"))
    queue = f.orderBy(F.desc("p"), "order_id").limit(100).agg(F.count(F.lit(1)).alias("queued"), F.count_if(F.col("label") == 1).alias("reached"))
    return queue.crossJoin(F.broadcast(f.agg(F.count_if(F.col("label") == 1).alias("late_in_all"))))


@query("console_by_hour", f"WITH {DOMAIN} SELECT CAST(ist_hour AS INTEGER) AS ist_hour, CAST(count(*) AS BIGINT) AS orders, round(100.0::DOUBLE * count_if(is_breached) / count(*), 2) AS breach_pct FROM feat GROUP BY 1")
def console_by_hour(spark, sf_dir):
    d = _dims(domain(spark, sf_dir))
    s = marts.sla_store_hour(d.fact, d.dim_store).groupBy("ist_hour").agg(F.sum("orders").alias("orders"), F.sum("breached").alias("b"))
    return s.select("ist_hour", "orders", F.round(100.0 * F.col("b") / F.col("orders"), 2).alias("breach_pct"))


@query("console_worst_hours", f"""
WITH {DOMAIN} SELECT store_code, CAST(ist_hour AS INTEGER) AS ist_hour, CAST(count(*) AS BIGINT) AS orders, CAST(count_if(is_breached) AS BIGINT) AS breached FROM feat GROUP BY ALL HAVING count(*) >= 20 ORDER BY count_if(is_breached)::DOUBLE / count(*) DESC, store_code, ist_hour LIMIT 12""")
def console_worst_hours(spark, sf_dir):
    d = _dims(domain(spark, sf_dir))
    s = marts.sla_store_hour(d.fact, d.dim_store).groupBy("store_code", "ist_hour").agg(F.sum("orders").alias("orders"), F.sum("breached").alias("breached")).where("orders >= 20")
    return s.orderBy((F.col("breached") / F.col("orders")).desc(), "store_code", "ist_hour").limit(12)


@query("lines_by_product", """
WITH a AS (SELECT l_partkey AS product_id, count(*) AS lines, sum(CAST(l_quantity AS BIGINT)) AS qty FROM lineitem GROUP BY 1)
SELECT product_id, CAST(lines AS BIGINT) AS lines, CAST(qty AS BIGINT) AS qty, (SELECT sum(lines) FROM a) = (SELECT count(*) FROM lineitem) AS agrees FROM a""")
def lines_by_product(spark, sf_dir):
    """A product aggregate and, beside it, whether it still sums to its source."""
    d = domain(spark, sf_dir)
    a = d.items.groupBy("product_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("qty").alias("qty"))
    both = a.agg(F.sum("lines").alias("x")).crossJoin(d.items.agg(F.count(F.lit(1)).alias("y")))
    return a.crossJoin(F.broadcast(both)).select("product_id", "lines", "qty", (F.col("x") == F.col("y")).alias("agrees"))


BODY_SQL = "'Ticket CMP-' || lpad(order_id::VARCHAR, 6, '0') || '    Order ' || order_id || '    Store ' || store_code || chr(10) || 'Raised ' || strftime(placed_ts, '%Y-%m-%dT%H:%M:%S') || 'Z    Channel: ' || CASE WHEN order_id % 3 = 0 THEN 'call_centre' ELSE 'app' END || '    City: Pune' || chr(10) || chr(10) || 'The order came' || chr(10) || 'late   again, ' || payment_method || ' paid.' || chr(10)"


def _complaints(spark, sf_dir):
    d = domain(spark, sf_dir)
    h = d.headers.join(d.stores.select("store_id", "store_code"), "store_id")
    body = F.concat(
        F.lit("Ticket CMP-"), F.lpad(F.col("order_id").cast("string"), 6, "0"), F.lit("    Order "), F.col("order_id"), F.lit("    Store "), F.col("store_code"), F.lit("\nRaised "), F.date_format("placed_ts", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("Z    Channel: "), F.when(F.col("order_id") % 3 == 0, "call_centre").otherwise("app"), F.lit("    City: Pune\n\nThe order came\nlate   again, "), F.col("payment_method"), F.lit(" paid.\n"),
    )
    docs = h.select(F.concat(F.lit("CMP-"), F.lpad(F.col("order_id").cast("string"), 6, "0")).alias("ticket_id"), body.alias("body"), "order_id")
    labels = docs.where("order_id % 100 = 0").select("ticket_id", F.col("order_id").alias("source_order_id"), F.when(F.col("order_id") % 200 == 0, "LATE").otherwise("RUDE").alias("reason_code"))
    return docs.drop("order_id"), labels


@query("complaint_parse", f"""
WITH {DOMAIN}, b AS (SELECT 'CMP-' || lpad(order_id::VARCHAR, 6, '0') AS ticket_id, {BODY_SQL} AS body, CASE WHEN order_id % 200 = 0 THEN 'LATE' WHEN order_id % 100 = 0 THEN 'RUDE' END AS reason_code FROM oh JOIN store USING (store_id)),
p AS (SELECT *, trim(regexp_replace(regexp_extract(body, 'City: [A-Za-z]+\\s*(.*)$', 1, 's'), '\\s+', ' ', 'g')) AS t, TRY_CAST(regexp_extract(body, 'Order ([0-9]+)', 1) AS BIGINT) AS o FROM b)
SELECT ticket_id, o + 899999 AS order_id, o AS source_order_id, regexp_extract(body, 'Store (DS[0-9]+)', 1) AS store_code, replace(regexp_extract(body, 'Raised ([0-9-]+T[0-9:]+)Z', 1), 'T', ' ') AS raised_ts, regexp_extract(body, 'Channel: ([a-z_]+)', 1) AS channel,
  regexp_extract(body, 'City: ([A-Za-z]+)', 1) AS city, t AS complaint_text, CAST(length(t) AS INTEGER) AS text_chars, CAST(len(string_split(t, ' ')) AS INTEGER) AS word_count, reason_code, reason_code IS NOT NULL AS is_labelled FROM p""")
def complaint_parse(spark, sf_dir):
    """Complaint texts, made for every order, parsed back. A ticket has six digits of its order, so longer orders share one."""
    return _text(marts.parse_complaint(*_complaints(spark, sf_dir), on=("ticket_id", "source_order_id")))


@query("triage_routing", """
WITH p AS (SELECT doc_id, round(least(n_chars, 1000) / 1000.0::DOUBLE, 4) AS confidence, CASE WHEN n_chars % 3 = 0 THEN 'LATE' WHEN n_chars % 3 = 1 THEN 'RUDE' ELSE 'OTHER' END AS predicted FROM documents),
r AS (SELECT * FROM (VALUES ('LATE', 'delivery', TRUE), ('RUDE', 'people', FALSE)) r(reason_code, team, is_sla)) SELECT CASE WHEN confidence >= 0.235 THEN 'AUTO' ELSE 'REVIEW' END AS routing, team, is_sla, CAST(count(*) AS BIGINT) AS n FROM p LEFT JOIN r ON reason_code = predicted GROUP BY ALL""")
def triage_routing(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    predicted = F.element_at(F.array(F.lit("LATE"), F.lit("RUDE"), F.lit("OTHER")), (F.col("n_chars") % 3 + 1).cast("int"))
    p = docs.select("doc_id", F.round(F.least("n_chars", F.lit(1000)) / 1000.0, 4).alias("confidence"), predicted.alias("predicted"))
    reasons = spark.createDataFrame([("LATE", "delivery", True), ("RUDE", "people", False)], "reason_code string, team string, is_sla boolean")
    return marts.triage(p, F.broadcast(reasons)).groupBy("routing", "team", "is_sla").agg(F.count(F.lit(1)).alias("n"))


@query("data_health", """
WITH r AS (SELECT event_type AS check_name, 'events' AS target, value > 50 AS passed, ts AS check_ts, event_id FROM events) SELECT check_name, target, passed, strftime(check_ts, '%Y-%m-%d %H:%M:%S') AS check_ts FROM r QUALIFY row_number() OVER (PARTITION BY check_name, target ORDER BY check_ts DESC, event_id DESC) = 1""")
def data_health(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    r = events.select(F.col("event_type").alias("check_name"), F.lit("events").alias("target"), (F.col("value") > 50).alias("passed"), F.struct("ts", "event_id").alias("check_ts"))
    return marts.data_health(r).withColumn("check_ts", F.date_format("check_ts.ts", "yyyy-MM-dd HH:mm:ss"))


@query("model_scoreboard", """
SELECT model_name, model_version, split, max(CASE WHEN metric = 'n' THEN v END) AS n, max(CASE WHEN metric = 'accuracy' THEN v END) AS accuracy, max(CASE WHEN metric = 'brier' THEN v END) AS brier FROM
  (SELECT p_brand AS model_name, p_size AS model_version, CASE WHEN p_partkey % 2 = 0 THEN 'TRAIN' ELSE 'TEST' END AS split, CASE p_partkey % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'accuracy' ELSE 'brier' END AS metric, p_retailprice AS v FROM part) GROUP BY ALL""")
def model_scoreboard(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    metric = F.element_at(F.array(F.lit("n"), F.lit("accuracy"), F.lit("brier")), (F.col("p_partkey") % 3 + 1).cast("int"))
    long = part.select(F.col("p_brand").alias("model_name"), F.col("p_size").alias("model_version"), F.when(F.col("p_partkey") % 2 == 0, "TRAIN").otherwise("TEST").alias("split"), metric.alias("metric"), F.col("p_retailprice").alias("value"))
    return marts.scoreboard(long, ("n", "accuracy", "brier"))


@query("schema_checks", f"""
WITH {DOMAIN} SELECT 'fct_order_key' AS check_name, count(*) = count(DISTINCT order_sk) AS passed FROM fct
UNION ALL SELECT 'money_identity', count_if(gross_paise - discount_paise + delivery_fee_paise <> order_total_paise) = 0 FROM fct
UNION ALL SELECT 'order_store', count_if(store_sk NOT IN (SELECT store_sk FROM dim_store)) = 0 FROM fct
UNION ALL SELECT 'order_customer', count_if(customer_sk NOT IN (SELECT customer_sk FROM dim_customer)) = 0 FROM fct
UNION ALL SELECT 'order_status', count_if(status NOT IN ('DELIVERED', 'CANCELLED')) = 0 FROM fct
UNION ALL SELECT 'product_version', count(*) = count(DISTINCT product_sk) FROM dim_product""")
def schema_checks(spark, sf_dir):
    """The marts' own tests as rows."""
    from tidewell.quality import accepted, check, relationship, results, unique

    d = _dims(domain(spark, sf_dir))
    rows = [
        unique(d.fact, "fct_order", "order_sk", "fct_order_key"), check(d.fact, "fct_order", F.expr("gross_paise - discount_paise + delivery_fee_paise = order_total_paise"), "money_identity"),
        relationship(d.fact, "fct_order", "store_sk", d.dim_store, "store_sk", "order_store"), relationship(d.fact, "fct_order", "customer_sk", d.dim_customer, "customer_sk", "order_customer"),
        accepted(d.fact, "fct_order", "status", ["DELIVERED", "CANCELLED"], "order_status"), unique(d.dim_product, "dim_product", "product_sk", "product_version"),
    ]
    return results(rows).select("check_name", "passed")


@query("conformed_orders", f"""
WITH {DOMAIN} SELECT order_id, CAST(customer_id AS INTEGER) AS customer_id, strftime(placed_ts, '%Y-%m-%d %H:%M:%S') AS placed_ts, strftime(delivered_ts, '%Y-%m-%d %H:%M:%S') AS delivered_ts, CASE WHEN order_id % 10 = 4 THEN 'CHANGED' ELSE status END AS status, gross_paise FROM oh WHERE order_id % 10 <> 3""")
def conformed_orders(spark, sf_dir):
    """Order headers from their change log: read, some changed and some deleted later, delivered twice."""
    h = domain(spark, sf_dir).headers
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    row = lambda status: F.struct("order_id", "customer_id", "store_id", "rider_id", stamp("placed_ts").alias("placed_ts"), stamp("promised_ts").alias("promised_ts"), stamp("delivered_ts").alias("delivered_ts"), status.alias("status"), "payment_method", "gross_paise")
    record = lambda df, before, after, kind, at: df.select(F.to_json(F.struct(before.alias("before"), after.alias("after"), F.lit(kind).alias("op"), F.lit(at).alias("ts_ms"))).alias("payload"), (F.col("order_id") + at).alias("offset"))
    none = F.lit(None).cast("string")
    first = record(h, none, row(F.col("status")), "r", 0)
    changed = record(h.where("order_id % 10 = 4"), row(F.col("status")), row(F.lit("CHANGED")), "u", 1_000_000_000)
    gone = record(h.where("order_id % 10 = 3"), row(F.col("status")), none, "d", 2_000_000_000)
    log = first.unionByName(changed).unionByName(gone)
    out = marts.conformed(log.unionByName(first), "order_header")
    return _text(out.select("order_id", "customer_id", "placed_ts", "delivered_ts", "status", "gross_paise"))


@query("conformed_inventory", """
SELECT strftime(l_shipdate, '%Y-%m-%d') AS snapshot_date, CAST(l_suppkey % 10 AS INTEGER) AS store_id, CAST(l_partkey AS INTEGER) AS product_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS INTEGER) AS on_hand_qty FROM lineitem GROUP BY ALL""")
def conformed_inventory(spark, sf_dir):
    """Stock snapshots, whose key is three columns and whose day comes as a number."""
    stock, parts = _stock(spark, sf_dir)
    row = F.struct(F.datediff("snapshot_date", F.lit("1970-01-01").cast("date")).alias("snapshot_date"), "store_id", "product_id", "on_hand_qty", "reorder_level")
    log = stock.select(F.to_json(F.struct(F.lit(None).cast("string").alias("before"), row.alias("after"), F.lit("r").alias("op"), F.lit(5).alias("ts_ms"))).alias("payload"), F.lit(0).cast("long").alias("offset"))
    return _text(marts.conformed(log, "inventory_daily", parts).select("snapshot_date", "store_id", "product_id", "on_hand_qty"))


@query("late_model")
def late_model(spark, sf_dir):
    """Lateness fitted on the orders before the split and scored on both sides of it: metrics by split,
    and whether the model as a SQL expression scores alike."""
    from tidewell import ml

    f = _features(spark, sf_dir).persist()
    names = list(marts.FEATURES)
    model = ml.fit_risk(f.where("split = 'TRAIN'"), names, "label")
    scored = ml.score(model, f).withColumn("by_sql", F.expr(ml.sql_score(model, names)))
    out = None
    for split in ("TRAIN", "TEST"):
        part = scored.where(F.col("split") == split)
        alike = part.agg((F.max(F.abs(F.col("score") - F.col("by_sql"))) < 1e-9).alias("sql_alike"))
        one = ml.metrics(part, "label").crossJoin(ml.areas(part, "label")).crossJoin(alike).select(F.lit(split).alias("split"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("late_model_coefficients")
def late_model_coefficients(spark, sf_dir):
    """Its coefficients, with what is to be said of each beside no weight at all: lateness here depends on the order's key alone."""
    from tidewell import ml

    names = list(marts.FEATURES)
    model = ml.fit_risk(_features(spark, sf_dir).where("split = 'TRAIN'"), names, "label")
    return spark.createDataFrame([(n, 0.0, c) for n, c in ml.coefficients(model, names)], "feature string, weight double, fitted double").select("feature", F.round("fitted", 3).alias("fitted"), ml.verdict("weight", "fitted").alias("verdict"))
