"""State kept by streams over the given tables: maintained joins, latest states, resumable sources, lag."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell import marts
from tidewell.plans.warehouse import DOMAIN, domain
from tidewell.registry import query
from tidewell.session import scratch, tables
from tidewell.streaming import lines, progress, stateful, views

_SLA_CHANGED = f"""
WITH {DOMAIN}, s AS (SELECT store_id, store_code, CASE WHEN store_id % 3 = 1 THEN 'MOVED' ELSE city END AS city FROM store WHERE store_id <> 9),
o AS (SELECT store_id, placed_ts, promised_ts, order_total_paise, CASE WHEN order_id % 10 = 4 THEN delivered_ts + to_minutes(30) ELSE delivered_ts END AS delivered_ts, CASE WHEN order_id % 20 = 4 THEN 'CANCELLED' ELSE status END AS status FROM oh WHERE order_id % 10 <> 3)
SELECT store_code, city, strftime(placed_ts, '%Y-%m-%d') AS placed_date, CAST(hour(placed_ts + to_minutes(330)) AS INTEGER) AS ist_hour, count(*) AS orders, CAST(count_if(delivered_ts > promised_ts) AS BIGINT) AS breached,
  CAST(sum(date_diff('second', placed_ts, promised_ts)) AS BIGINT) AS promised_sec, CAST(sum(date_diff('second', placed_ts, delivered_ts)) AS BIGINT) AS delivered_sec, count(delivered_ts) AS delivered_n, CAST(sum(order_total_paise) AS BIGINT) AS gross_paise
FROM o JOIN s USING (store_id) WHERE status = 'DELIVERED' GROUP BY ALL"""

_ORDER = "order_id long, store_id long, placed_ts timestamp_ntz, promised_ts timestamp_ntz, delivered_ts timestamp_ntz, status string, order_total_paise long"
_STORE = "store_id long, store_code string, city string"


def _changes(df, row: str, before=None, after=None):
    """Change rows of ``df``; the images are maps of the columns that differ, None for an image that isn't there."""
    names = [c.split(" ")[0] for c in row.split(", ")]
    image = lambda x: F.lit(None) if x is None else F.struct(*[x.get(c, F.col(c)).alias(c) for c in names])
    return df.select(image(before).cast(f"struct<{row}>").alias("before"), image(after).cast(f"struct<{row}>").alias("after"))


def sla_view(spark, base: str) -> views.MaintainedJoin:
    """Delivered orders by store and local hour: counts and sums alone, kept by increments."""
    seconds = lambda c: F.timestamp_diff("SECOND", "placed_ts", c)
    return views.MaintainedJoin(
        spark, f"{base}/view", views.Side(f"{base}/orders", _ORDER), views.Side(f"{base}/stores", _STORE), [("store_id", "store_id")],
        {"store_code": F.col("store_code"), "city": F.col("city"), "placed_date": F.date_format("placed_ts", "yyyy-MM-dd"), "ist_hour": F.hour(F.col("placed_ts") + F.expr("interval 330 minutes"))},
        {
            "orders": views.count(), "breached": views.total((F.coalesce(F.col("delivered_ts") > F.col("promised_ts"), F.lit(False))).cast("long")), "promised_sec": views.total(seconds("promised_ts")),
            "delivered_sec": views.total(seconds("delivered_ts")), "delivered_n": views.count(F.col("delivered_ts")), "gross_paise": views.total(F.col("order_total_paise")),
        },
        where=F.col("status") == "DELIVERED",
    )


@query("sla_store_hour_maintained", _SLA_CHANGED)
def sla_store_hour_maintained(spark, sf_dir):
    """Three batches: most orders and all stores; late changes of orders, new ones, stores that move; deleted and
    cancelled orders and a closed store. Each takes back what it changes."""
    d = domain(spark, sf_dir)
    base = scratch(spark, "sla")
    h = d.headers
    late, moved, off = {"delivered_ts": F.col("delivered_ts") + F.expr("interval 30 minutes")}, {"city": F.lit("MOVED")}, {"status": F.lit("CANCELLED")}
    view = sla_view(spark, base)
    steps = [
        (_changes(h.where("order_id % 10 <> 7"), _ORDER, after={}), _changes(d.stores, _STORE, after={})),
        (_changes(h.where("order_id % 10 = 4"), _ORDER, {}, late).unionByName(_changes(h.where("order_id % 10 = 7"), _ORDER, after={})), _changes(d.stores.where("store_id % 3 = 1"), _STORE, {}, moved)),
        (_changes(h.where("order_id % 10 = 3"), _ORDER, {}).unionByName(_changes(h.where("order_id % 20 = 4"), _ORDER, late, late | off)), _changes(d.stores.where("store_id = 9"), _STORE, {})),
    ]
    for orders, stores in steps:
        orders.write.mode("append").parquet(f"{base}/orders")
        stores.write.mode("append").parquet(f"{base}/stores")
        view.run()
    return view.current()


_EVENT = "user_id long, event_type string"
_LATEST = "SELECT user_id, event_type, epoch_us(ts) // 1000 AS ts_ms, event_id AS \"offset\" FROM (SELECT *, event_id % 17 = 0 AS gone FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) = 1) WHERE NOT gone"


@query("latest_state_stream", _LATEST)
def latest_state_stream(spark, sf_dir):
    """A change log that lands newest first, in three runs and each record twice; the state after the last run is the answer."""
    (events,) = tables(spark, sf_dir, "events")
    base, gone = scratch(spark, "latest"), F.col("event_id") % 17 == 0
    row = F.struct("user_id", "event_type")
    log = events.select("user_id", fn.millis("ts").alias("ts_ms"), F.col("event_id").alias("offset"), F.when(gone, "d").otherwise("u").alias("op"), F.when(~gone, F.to_json(row)).alias("payload"))
    ends = log.agg(F.expr("percentile_approx(offset, array(0.67, 0.33))")).first()[0]
    for low, high in ((ends[0], None), (ends[1], ends[0]), (None, ends[1])):
        part = log.where((F.lit(True) if low is None else F.col("offset") > low) & (F.lit(True) if high is None else F.col("offset") <= high))
        part.unionByName(part).write.mode("append").parquet(f"{base}/in")
        changes = stateful.latest_rows(spark.readStream.schema(log.schema).parquet(f"{base}/in"), "user_id", tombstone_ms=86_400_000)
        stateful.run_stateful(changes, lambda batch, n: batch.write.format("noop").mode("overwrite").save(), f"{base}/state")
    live = stateful.state_of(spark, f"{base}/state", "live")
    return live.select("user_id", F.from_json("payload", _EVENT)["event_type"].alias("event_type"), "ts_ms", "offset")


@query("lifecycle_stream", f"""
WITH {DOMAIN} SELECT order_id, CASE WHEN f.order_id IS NOT NULL THEN 'CLEAN' WHEN c.order_id IS NOT NULL THEN 'CANCELLED' ELSE anomaly_type END AS outcome, CAST(len(string_split(p.path, '>')) AS INTEGER) AS n_events
FROM paths p LEFT JOIN funnel f USING (order_id) LEFT JOIN cancelled c USING (order_id) LEFT JOIN anomaly a USING (order_id)""")
def lifecycle_stream(spark, sf_dir):
    """Order events in three runs, the later statuses of an order before its earlier ones and each of them twice."""
    base = scratch(spark, "lifecycle")
    events = domain(spark, sf_dir).events.select("order_id", "event_id", "event_ts", F.col("to_status").alias("status"))
    for first in (3, 1, 0):
        part = events.where((F.col("event_id") % 10 >= first) & (F.col("event_id") % 10 < {3: 10, 1: 3, 0: 1}[first]))
        part.unionByName(part).write.mode("append").parquet(f"{base}/in")
        out = stateful.lifecycles(spark.readStream.schema(events.schema).parquet(f"{base}/in"), "order_id", ["PLACED", "PACKED", "PICKED_UP", "DELIVERED"], "CANCELLED", wait_ms=3_600_000)
        stateful.run_stateful(out, lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}"), f"{base}/state")
    return stateful.state_of(spark, f"{base}/state", "order").select("order_id", "outcome", "n_events")


@query("channel_lines", "SELECT event_id, event_type FROM events")
def channel_lines(spark, sf_dir):
    """Events as lines of files that grow between three runs of a channel; the last run finds nothing new."""
    (events,) = tables(spark, sf_dir, "events")
    base = scratch(spark, "lines")
    for part in (0, 1, None):
        if part is not None:
            events.where(F.col("event_id") % 2 == part).select("event_id", "event_type").write.mode("append").json(f"{base}/in")
        parse = lambda df: df.select("file", "offset", F.from_json("value", "event_id long, event_type string").alias("v")).select("file", "offset", "v.*")
        lines.take_in(spark, f"{base}/in", "events", f"{base}/out", parse, splitBytes="262144")
    return spark.read.parquet(f"{base}/out/rows").select("event_id", "event_type")


@query("progress_by_route", "SELECT * FROM (SELECT 'at once' AS route, count(*) AS n_rows, CAST(1 AS BIGINT) AS batches, TRUE AS timed FROM events UNION ALL SELECT 'file by file', count(*), 3, TRUE FROM events)")
def progress_by_route(spark, sf_dir):
    """The same events by two routes, each batch as the streams themselves report it: all there is at once, and a file a batch."""
    (events,) = tables(spark, sf_dir, "events")
    base = scratch(spark, "progress")
    rows = events.select("event_id", "event_type", "value")
    rows.withColumn("file", F.col("event_id") % 3).repartition(3, "file").sortWithinPartitions("file").write.partitionBy("file").parquet(f"{base}/in")
    schema = rows.schema
    with progress.ProgressLog(spark, f"{base}/progress") as log:
        for route, most in (("at once", 1000), ("file by file", 1)):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most).parquet(f"{base}/in")
            out = stream.writeStream.queryName(route).format("parquet").option("path", f"{base}/{most}").option("checkpointLocation", f"{base}/state{most}")
            out.trigger(availableNow=True).start().awaitTermination()
    return progress.by_route(log.read()).select("route", "n_rows", "batches", ((F.col("least_s") >= 0) & (F.col("most_s") >= F.col("median_s"))).alias("timed"))


@query("cost_of_runs", "SELECT part, CAST(queries AS BIGINT) AS queries, TRUE AS ran, 100.0 AS all_pct, TRUE AS idle_told FROM (VALUES ('serve', 2), ('stage', 1), ('model', 1)) v(part, queries) WHERE (SELECT count(*) FROM lineitem) > 0")
def cost_of_runs(spark, sf_dir):
    """Four queries run under tags; executor time by the tags' prefix as the runs' stages report it, and the idle share."""
    from tidewell.governance import costs
    from tidewell.plans import aggregates

    line, orders = tables(spark, sf_dir, "lineitem", "orders")
    log = costs.CostLog(spark)
    save = lambda df: lambda: df.write.format("noop").mode("overwrite").save()
    log.run("serve:sla", save(aggregates.sla_by_nation_priority(spark, sf_dir)))
    log.run("serve:percentiles", save(aggregates.leg_percentiles(spark, sf_dir)))
    log.run("stage:join", save(line.join(orders, line.l_orderkey == orders.o_orderkey)))
    log.run("model:correlation", save(aggregates.correlation(spark, sf_dir)))
    runs = log.read()
    by, free = costs.shares(runs), costs.idle(runs)
    total = by.agg(F.round(F.sum("pct"), 2).alias("all_pct"))
    out = by.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(free))
    return out.select("part", "queries", ((F.col("jobs") > 0) & (F.col("units") > 0) & F.col("pct").between(0, 100)).alias("ran"), "all_pct", F.col("idle_pct").between(0, 100).alias("idle_told"))


_SEASON = """
WITH RECURSIVE o AS (SELECT c_nationkey AS nation, o_orderdate::DATE AS day, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
e AS (SELECT nation, min(day) AS a, max(day) AS b FROM o GROUP BY 1),
d AS (SELECT nation, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM e),
x AS (SELECT d.nation, list(coalesce(n, 0)::DOUBLE ORDER BY d.day) AS x, max(d.day) AS last FROM d LEFT JOIN o ON o.nation = d.nation AND o.day = d.day GROUP BY 1),
i AS (SELECT *, list_sum(x[1:7]) / 7 AS l0, (list_sum(x[8:14]) / 7 - list_sum(x[1:7]) / 7) / 7 AS b0 FROM x WHERE len(x) >= 14),
r AS (SELECT nation, 7 AS t, l0 + 3 * b0 AS level, b0 AS trend, list_transform(x[1:7], lambda v, k: v - (l0 + (k - 4) * b0)) AS s, NULL::DOUBLE AS y, NULL::DOUBLE AS err FROM i
  UNION ALL SELECT nation, t + 1, level + trend + 0.2::DOUBLE * err, trend + 0.2::DOUBLE * 0.1::DOUBLE * err, s[2:7] || [s[1] + 0.1::DOUBLE * err], y, err
  FROM (SELECT r.nation, r.t, r.level, r.trend, r.s, r.level + r.trend + r.s[1] AS y, i.x[r.t + 1] - (r.level + r.trend + r.s[1]) AS err FROM r JOIN i USING (nation) WHERE r.t < len(i.x))),
g AS (SELECT nation, sqrt(sum(err * err) / count(err)) AS sigma FROM r GROUP BY 1),
h AS (SELECT unnest(range(1, 15)) AS h), w AS (SELECT a.h, 1 + coalesce(sum(pow(0.2::DOUBLE * (1 + b.h * 0.1::DOUBLE) + CASE WHEN b.h % 7 = 0 THEN 0.1::DOUBLE ELSE 0 END, 2)), 0) AS grown FROM h a LEFT JOIN h b ON b.h < a.h GROUP BY 1),
f AS (SELECT i.nation, 'forecast' AS kind, i.last + h::INTEGER AS day, NULL::DOUBLE AS actual, level + h * trend + s[(h - 1) % 7 + 1] AS expected, 1.96::DOUBLE * sigma * sqrt(grown) AS w FROM r JOIN i USING (nation) JOIN g USING (nation), w WHERE r.t = len(i.x)),
m AS (SELECT i.nation, 'anomaly' AS kind, i.last - (len(i.x) - r.t)::INTEGER AS day, i.x[r.t] AS actual, r.y AS expected, 1.96::DOUBLE * sigma AS w FROM r JOIN i USING (nation) JOIN g USING (nation) WHERE abs(err) > 1.96::DOUBLE * sigma)
SELECT nation, kind, strftime(day, '%Y-%m-%d') AS day, actual, round(expected, 6) AS expected, round(expected - w, 6) AS lo, round(expected + w, 6) AS hi FROM (SELECT * FROM f UNION ALL SELECT * FROM m)"""


@query("seasonal_forecast", _SEASON)
def seasonal_forecast(spark, sf_dir):
    """Orders a day by nation: two weeks ahead with intervals, and the days outside the intervals of the day before."""
    from tidewell.ml import forecast as fc

    orders, customer = tables(spark, sf_dir, "orders", "customer")
    n = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    out = fc.forecast(fc.daily(n, "nation", "day", "n"), "nation", "day", "n")
    return out.select("nation", "kind", F.date_format("day", "yyyy-MM-dd").alias("day"), "actual", *[F.round(c, 6).alias(c) for c in ("expected", "lo", "hi")])


def _conformed(table: str, rows, key: str, changed: dict, columns: list[str]):
    """``rows`` through a change log (read, every tenth key changed later, another tenth deleted, all of it delivered twice) and conformed again."""
    names = [c.split(" ")[0] for c in marts.CONFORMED[table][1].split(", ")]
    image = lambda new: F.struct(*[new.get(c, F.col(c) if c in rows.columns else F.lit(None)).alias(c) for c in names])
    none, number = F.lit(None).cast("string"), F.col(key).cast("long")
    record = lambda df, before, after, op, at: df.select(F.to_json(F.struct(before.alias("before"), after.alias("after"), F.lit(op).alias("op"), F.lit(at).alias("ts_ms"))).alias("payload"), (number + at).alias("offset"))
    first = record(rows, none, image({}), "r", 0)
    later = record(rows.where(number % 10 == 4), image({}), image(changed), "u", 1_000_000_000_000)
    gone = record(rows.where(number % 10 == 3), image({}), none, "d", 2_000_000_000_000)
    log = gone.unionByName(first).unionByName(later)
    return marts.conformed(log.unionByName(log), table).select(*columns)


_DAY = "%Y-%m-%d"


@query("conformed_store", f"WITH {DOMAIN} SELECT CAST(store_id AS INTEGER) AS store_id, store_code, CASE WHEN store_id % 10 = 4 THEN 'MOVED' ELSE city END AS city, lat, is_active, strftime(DATE '2020-01-01' + (store_id % 700)::INTEGER, '{_DAY}') AS opened_on FROM store WHERE store_id % 10 <> 3")
def conformed_store(spark, sf_dir):
    rows = domain(spark, sf_dir).stores.withColumn("opened_on", (F.lit(18262) + F.col("store_id") % 700).cast("int"))
    return _conformed("store", rows, "store_id", {"city": F.lit("MOVED")}, ["store_id", "store_code", "city", "lat", "is_active", F.date_format("opened_on", "yyyy-MM-dd").alias("opened_on")])


@query("conformed_customer", f"WITH {DOMAIN} SELECT CAST(customer_id AS INTEGER) AS customer_id, full_name, CASE WHEN customer_id % 10 = 4 THEN NULL ELSE segment END AS segment, home_lat, home_lon FROM customers WHERE customer_id % 10 <> 3")
def conformed_customer(spark, sf_dir):
    """A value that becomes null is a change, not a missing one."""
    return _conformed("customer", domain(spark, sf_dir).customers, "customer_id", {"segment": F.lit(None).cast("string")}, ["customer_id", "full_name", "segment", "home_lat", "home_lon"])


@query("conformed_product", "SELECT CAST(p_partkey AS INTEGER) AS product_id, p_name AS name, p_type AS category_l3, CAST(CASE WHEN p_partkey % 10 = 4 THEN 1 ELSE round(p_retailprice * 100) END AS BIGINT) AS price_paise, '1998-01-01 00:00:00' AS updated_at FROM part WHERE p_partkey % 10 <> 3")
def conformed_product(spark, sf_dir):
    rows = domain(spark, sf_dir).products.where("valid_from < timestamp_ntz'1990-01-01'").withColumnRenamed("product_name", "name").withColumn("updated_at", F.lit("1998-01-01T00:00:00Z"))
    return _conformed("product", rows, "product_id", {"price_paise": F.lit(1).cast("long")}, ["product_id", "name", "category_l3", "price_paise", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at")])


@query("conformed_rider", f"WITH {DOMAIN} SELECT CAST(rider_id AS INTEGER) AS rider_id, full_name, vehicle_type, CASE WHEN rider_id % 10 = 4 THEN FALSE ELSE is_active END AS is_active FROM rider WHERE rider_id % 10 <> 3")
def conformed_rider(spark, sf_dir):
    return _conformed("rider", domain(spark, sf_dir).riders, "rider_id", {"is_active": F.lit(False)}, ["rider_id", "full_name", "vehicle_type", "is_active"])


@query("conformed_order_item", """
WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS order_item_id, any_value(l_orderkey) AS order_id, CAST(max(l_partkey) AS INTEGER) AS product_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS INTEGER) AS qty FROM lineitem GROUP BY 1)
SELECT order_item_id, order_id, product_id, CASE WHEN order_item_id % 10 = 4 THEN 0 ELSE qty END AS qty FROM i WHERE order_item_id % 10 <> 3""")
def conformed_order_item(spark, sf_dir):
    (line,) = tables(spark, sf_dir, "lineitem")
    rows = line.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"), F.col("l_orderkey").alias("order_id")).agg(F.max("l_partkey").alias("product_id"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    return _conformed("order_item", rows, "order_item_id", {"qty": F.lit(0).cast("long")}, ["order_item_id", "order_id", "product_id", "qty"])


@query("conformed_order_status_event", f"WITH {DOMAIN} SELECT event_id::VARCHAR AS event_id, order_id, from_status, to_status, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts FROM oe")
def conformed_order_status_event(spark, sf_dir):
    """Events delivered at least once: of those with one id the earliest stays; no change log, so nothing is deleted."""
    from tidewell import operators as op

    events = domain(spark, sf_dir).events
    late = events.where("event_id % 3 = 0").withColumn("event_ts", F.col("event_ts") + F.expr("interval 5 seconds"))
    landed = events.unionByName(late).unionByName(events)
    out = op.dedupe_latest(landed, ["event_id"], [F.asc("event_ts")])
    return out.select(F.col("event_id").cast("string").alias("event_id"), "order_id", "from_status", "to_status", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("event_ts"))
