"""Sources, sinks, DML and change streams: the given tables are written out in each form and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell import sources, streaming
from tidewell.registry import query
from tidewell.session import scratch, tables

_CUST = "SELECT c_custkey, c_mktsegment AS segment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer"


def _cust(spark, sf_dir):
    (customer,) = tables(spark, sf_dir, "customer")
    return customer.select("c_custkey", F.col("c_mktsegment").alias("segment"), fn.cents("c_acctbal").alias("cents"))


@query("table_replace", f"SELECT segment, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM ({_CUST}) GROUP BY 1")
def table_replace(spark, sf_dir):
    """Create or replace a table from a query, twice."""
    t = sources.Table(spark, scratch(spark, "table"))
    t.replace(_cust(spark, sf_dir).limit(1))
    t.replace(_cust(spark, sf_dir))
    return t.read().groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("table_append", f"WITH c AS ({_CUST}) SELECT * FROM c UNION ALL SELECT c_custkey + 1000000, segment, -cents FROM c WHERE cents < 0")
def table_append(spark, sf_dir):
    t = sources.Table(spark, scratch(spark, "table"))
    t.replace(_cust(spark, sf_dir))
    t.append(t.read().where("cents < 0").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), "segment", (-F.col("cents")).alias("cents")))
    return t.read()


@query("table_delete", f"SELECT * FROM ({_CUST}) WHERE NOT (cents < 0 AND segment <> 'BUILDING')")
def table_delete(spark, sf_dir):
    t = sources.Table(spark, scratch(spark, "table"))
    t.replace(_cust(spark, sf_dir))
    t.delete((F.col("cents") < 0) & (F.col("segment") != "BUILDING"))
    return t.read()


@query("table_update", f"""
WITH c AS ({_CUST}), m AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN (SELECT n FROM m WHERE o_custkey = c_custkey) > 10 THEN 'OFTEN' ELSE segment END AS segment, cents FROM c""")
def table_update(spark, sf_dir):
    """An update from a correlated subquery: the table joined to what it depends on, rewritten."""
    (orders,) = tables(spark, sf_dir, "orders")
    t = sources.Table(spark, scratch(spark, "table"))
    t.replace(_cust(spark, sf_dir))
    m = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    now = t.read().join(m, F.col("o_custkey") == F.col("c_custkey"), "left")
    t.replace(now.select("c_custkey", F.when(F.col("n") > 10, "OFTEN").otherwise(F.col("segment")).alias("segment"), "cents"), "update")
    t.update({"cents": F.col("cents") + 1}, F.col("segment") == "nobody")
    return t.read()


@query("insert_guards", "SELECT CAST(count(*) AS BIGINT) AS n, 2 AS versions, TRUE AS once, FALSE AS again, FALSE AS unchanged FROM nation")
def insert_guards(spark, sf_dir):
    """A seed goes in once; a snapshot only if it differs from the last."""
    (nation,) = tables(spark, sf_dir, "nation")
    t = sources.Table(spark, scratch(spark, "seed"))
    t.replace(nation.limit(0))
    once, again = t.insert_once(nation), t.insert_once(nation)
    unchanged = t.insert_if_changed(nation, t.read())
    return t.read().agg(F.count(F.lit(1)).alias("n"), *[F.lit(v).alias(n) for n, v in (("versions", len(t.versions())), ("once", once), ("again", again), ("unchanged", unchanged))])


@query("table_history", "SELECT * FROM (VALUES (1, 'replace', 1), (2, 'append', 2), (3, 'delete', 1)) h(version, action, parts)")
def table_history(spark, sf_dir):
    (region,) = tables(spark, sf_dir, "region")
    t = sources.Table(spark, scratch(spark, "history"))
    t.replace(region)
    t.append(region)
    t.delete(F.col("r_regionkey") == 1)
    return t.history()


@query("action_log", """
SELECT r_name AS acted_by, 'region' AS subject_type, r_regionkey::VARCHAR AS subject_id, CASE WHEN r_regionkey % 2 = 0 THEN 'call' ELSE 'close' END AS action, 'O''Brien; DROP ' || r_name AS note, CASE WHEN r_regionkey % 2 = 0 THEN 'TEST' ELSE 'AUTO' END AS mode FROM region""")
def action_log(spark, sf_dir):
    """A write-back log, a row an action on a region, with bound values and a JSON context."""
    (region,) = tables(spark, sf_dir, "region")
    t = sources.Table(spark, scratch(spark, "actions"))
    for r in region.orderBy("r_regionkey").collect():  # five
        even = r.r_regionkey % 2 == 0
        sources.log_action(t, "2026-06-01 10:00:00", acted_by=r.r_name, subject_type="region", subject_id=str(r.r_regionkey), action="call" if even else "close", note=f"O'Brien; DROP {r.r_name}", context='{"mode": "%s"}' % ("TEST" if even else "AUTO"))
    return t.read().select("acted_by", "subject_type", "subject_id", "action", "note", F.get_json_object("context", "$.mode").alias("mode"))


@query("csv_rejects", """
SELECT CASE o_orderkey % 40 WHEN 0 THEN 'o_orderkey is not bigint' WHEN 1 THEN 'too few columns' WHEN 2 THEN 'o_total is not bigint' ELSE 'too many columns' END AS error, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 40 < 4 GROUP BY 1
UNION ALL SELECT 'loaded', count(*) FROM orders WHERE o_orderkey % 40 >= 4""")
def csv_rejects(spark, sf_dir):
    """What a load of a partly broken CSV would reject, and why, before anything is written."""
    (orders,) = tables(spark, sf_dir, "orders")
    path, k = scratch(spark, "csv"), F.col("o_orderkey")
    key, total = F.when(k % 40 == 0, F.lit("abc")).otherwise(k.cast("string")), F.when(k % 40 == 2, F.lit("12x")).otherwise(fn.cents("o_totalprice").cast("string"))
    line = F.when(k % 40 == 1, key).when(k % 40 == 3, F.concat_ws(",", key, "o_orderstatus", total, F.lit("more"))).otherwise(F.concat_ws(",", key, "o_orderstatus", total))
    orders.select(line).write.text(path)
    good, bad = sources.load_csv(spark, path, "o_orderkey bigint, o_status string, o_total bigint")
    return bad.groupBy("error").agg(F.count(F.lit(1)).alias("n")).unionByName(good.agg(F.lit("loaded").alias("error"), F.count(F.lit(1)).alias("n")))


@query("ndjson_provenance", """
SELECT CAST(count(*) AS BIGINT) AS loaded, (SELECT CAST(count(*) AS BIGINT) FROM events WHERE event_id % 50 = 0) AS rejected, 1 AS first_line, TRUE AS lines_are_distinct FROM events WHERE event_id % 50 <> 0""")
def ndjson_provenance(spark, sf_dir):
    """Gzip JSON lines with file and line; broken lines are reported and do not stop the load. Lines of a file meet in one task, so files are bounded."""
    (events,) = tables(spark, sf_dir, "events")
    path = scratch(spark, "ndjson")
    whole = F.to_json(F.struct("event_id", "user_id", "event_type"))
    events.select(F.when(F.col("event_id") % 50 == 0, F.substring(whole, 1, 12)).otherwise(whole)).repartition(3).write.option("compression", "gzip").option("maxRecordsPerFile", 200_000).text(path)
    good, bad = sources.load_ndjson(spark, path, "event_id bigint, user_id bigint, event_type string")
    report = sources.load_report(good, bad).agg(F.sum("loaded").alias("loaded"), F.sum("rejected").alias("rejected"))
    lines = good.select(F.col("src_file").alias("f"), F.col("src_line").alias("l")).unionByName(bad.select(F.col("file").alias("f"), F.col("line").alias("l")))
    checks = lines.agg(F.min("l").alias("first_line"), (F.count(F.lit(1)) == F.countDistinct("f", "l")).alias("lines_are_distinct"))
    return report.crossJoin(F.broadcast(checks))


@query("load_by_name", "SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS DOUBLE) AS area FROM nation")
def load_by_name(spark, sf_dir):
    """Columns by name in any case; one that the file lacks is null."""
    (nation,) = tables(spark, sf_dir, "nation")
    path = scratch(spark, "named")
    nation.select(F.col("n_name").alias("NAME"), F.col("n_nationkey").alias("Id"), F.lit("x").alias("extra")).write.parquet(path)
    return sources.by_name(spark.read.parquet(path), "id int, name string, area double")


@query("schema_inference", "SELECT * FROM (VALUES ('r_regionkey', 'int', 0), ('r_name', 'string', 0)) v(\"column\", type, template_rows)")
def schema_inference(spark, sf_dir):
    """A table made from what the files' footers tell."""
    path = f"{sf_dir}/region.parquet"
    template = sources.empty_like(spark, path)
    return sources.infer(spark, path).select("column", "type").crossJoin(F.broadcast(template.agg(F.count(F.lit(1)).cast("int").alias("template_rows"))))


@query("query_by_position", "SELECT CAST(r_regionkey AS VARCHAR) AS c1, r_name AS c2 FROM region")
def query_by_position(spark, sf_dir):
    """Files in place, by the columns' positions."""
    (region,) = tables(spark, sf_dir, "region")
    path = scratch(spark, "position")
    region.select(F.col("r_regionkey").cast("string"), "r_name").write.csv(path)
    return sources.by_position(spark, path)


@query("shared_dataset", "SELECT r_name, CAST(count(*) AS BIGINT) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def shared_dataset(spark, sf_dir):
    """Another owner's files as a view, joined in place."""
    region = sources.shared_view(spark, f"{sf_dir}/region.parquet", "shared_region")
    (nation,) = tables(spark, sf_dir, "nation")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("local_frame", "SELECT n_name AS store, n_regionkey + 0.5::DOUBLE AS lat, n_nationkey % 2 = 0 AS active FROM nation")
def local_frame(spark, sf_dir):
    """A small local frame, made of a small table, as a table again, its types from the frame, written anew each time."""
    (nation,) = tables(spark, sf_dir, "nation")
    local, t = nation.toPandas(), sources.Table(spark, scratch(spark, "frame"))
    for shift in (0.0, 0.5):
        frame = local.assign(store=local["n_name"], lat=local["n_regionkey"] + shift, active=local["n_nationkey"] % 2 == 0)
        t.replace(spark.createDataFrame(frame[["store", "lat", "active"]]))
    return t.read()


@query("typed_seed", """
SELECT n_name AS reason_code, 'a "quoted", ' || n_name AS description, r_name AS owning_team, n_nationkey % 2 = 0 AS is_sla_related FROM nation JOIN region ON r_regionkey = n_regionkey""")
def typed_seed(spark, sf_dir):
    """A versioned CSV under declared types; commas and quotes are inside quotes, doubled."""
    nation, region = tables(spark, sf_dir, "nation", "region")
    path = scratch(spark, "seed")
    text = F.concat(F.lit('a "quoted", '), "n_name")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("reason_code"), text.alias("description"), F.col("r_name").alias("owning_team"), (F.col("n_nationkey") % 2 == 0).alias("is_sla_related"))
    rows.coalesce(1).write.options(header=True, quote='"', escape='"').csv(path)
    return sources.read_seed(spark, path, "complaint_reason_code")


@query("empty_as_null", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS n_name FROM nation")
def empty_as_null(spark, sf_dir):
    """A bulk load of CSV in which an empty field is null."""
    (nation,) = tables(spark, sf_dir, "nation")
    path = scratch(spark, "bulk")
    sources.unload(nation.select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("n_name")), path, "csv", single=True)
    return sources.read_csv(spark, path, "n_nationkey int, n_name string")


@query("settlement_by_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS status, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS paise FROM events GROUP BY 1, 2")
def settlement_by_day(spark, sf_dir):
    """Daily CSV files queried in place, the day from the file's name, by day and status."""
    (events,) = tables(spark, sf_dir, "events")
    base = scratch(spark, "settlement")
    e = events.select("event_id", F.col("event_type").alias("status"), fn.cents("value").alias("paise"), F.date_format("ts", "yyyyMMdd").alias("day"))
    e.repartition("day").write.partitionBy("day").option("header", True).csv(base)
    found = sources.read_dated_csv(spark, f"{base}/*", "event_id long, status string, paise long", column="path", pattern=r"day=(\d{8})/")
    return found.groupBy(F.date_format("file_day", "yyyy-MM-dd").alias("day"), "status").agg(F.count(F.lit(1)).alias("n"), F.sum("paise").alias("paise"))


@query("documents_by_address", "SELECT n_name AS body, TRUE AS is_new FROM nation WHERE n_nationkey % 5 <> 0")
def documents_by_address(spark, sf_dir):
    """Document files by content address: those that the ledger has are passed over."""
    (nation,) = tables(spark, sf_dir, "nation")
    path = scratch(spark, "docs")
    text = F.concat(F.lit("BT ("), "n_name", F.lit(") Tj ET"))
    nation.select(text.alias("value"), "n_nationkey").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = sources.listing(spark, f"{path}/*/*.txt")
    ledger = found.where(F.regexp_extract("path", r"n_nationkey=(\d+)/", 1).cast("int") % 5 == 0)
    fresh = sources.new_files(found, ledger).select("path")
    return sources.read_documents(spark, f"{path}/*/*.txt").join(F.broadcast(fresh), "path").select("body", F.lit(True).alias("is_new"))


_LANDED = "SELECT user_id, event_type FROM (SELECT user_id, event_type, CASE WHEN event_id % 17 = 0 THEN 'd' ELSE 'u' END AS op FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) = 1) WHERE op <> 'd'"


def _log(events):
    row = F.struct("user_id", "event_type")
    gone = F.col("event_id") % 17 == 0
    return events.select(F.to_json(F.struct(F.when(gone, row).alias("before"), F.when(~gone, row).alias("after"), F.when(gone, "d").otherwise("u").alias("op"), fn.millis("ts").alias("ts_ms"), F.col("event_id").alias("offset"))).alias("value"), "event_id")


@query("cdc_stream", _LANDED)
def cdc_stream(spark, sf_dir):
    """A change log landed from a file stream as it is, in two runs, then its current state."""
    (events,) = tables(spark, sf_dir, "events")
    base = scratch(spark, "cdc")
    t = sources.Table(spark, f"{base}/landed")
    log = _log(events)
    for half in (0, 1):
        log.where(F.col("event_id") % 2 == half).select("value").write.mode("append").text(f"{base}/in")
        streaming.land_changes(spark, f"{base}/in", t, f"{base}/state", "events")
    return streaming.latest_state(t.read(), "user_id long, event_type string", "user_id").select("user_id", "event_type")


@query("channel_resume", "SELECT event_id AS \"offset\", event_type FROM events")
def channel_resume(spark, sf_dir):
    """A channel that is sent the first half, then all, then all again: each row lands once."""
    (events,) = tables(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("offset"), "event_type")
    channel = streaming.Channel(sources.Table(spark, scratch(spark, "channel")))
    middle = rows.agg(F.max("offset")).first()[0] // 2
    for batch in (rows.where(F.col("offset") <= middle), rows, rows):
        channel.send(batch)
    return channel.table.read()


@query("view_stream", "SELECT n_name, 'INSERT' AS action, n_nationkey % 2 = 0 AS is_update, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS weight FROM nation UNION ALL SELECT n_name, 'DELETE', TRUE, 1 FROM nation WHERE n_nationkey % 2 = 0")
def view_stream(spark, sf_dir):
    """A stream on a joined view: reading it twice changes nothing, consuming it moves on."""
    nation, region = tables(spark, sf_dir, "nation", "region")
    base = scratch(spark, "view")
    n, r = sources.Table(spark, f"{base}/n"), sources.Table(spark, f"{base}/r")
    n.replace(nation.where("n_nationkey % 2 = 0").select("n_name", "n_regionkey", F.lit(1).alias("weight")))
    r.replace(region)
    view = lambda n, r: n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "weight")
    stream = streaming.ChangeStream(sources.Table(spark, f"{base}/offset"), {"n": n, "r": r}, "n_name", ["weight"], view)
    n.replace(nation.select("n_name", "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, 2).otherwise(1).alias("weight")))
    stream.pending().count()
    out = sources.Table(spark, f"{base}/out")
    stream.consume(out.append)
    stream.consume(out.append)
    return out.read()


@query("ingest_lag", """
WITH l AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'row' ELSE 'file' END AS mechanism, ts, ts + to_seconds(CASE WHEN event_id % 3 = 0 THEN 5 + event_id % 6 ELSE 60 + event_id % 40 END) AS landed FROM events), s AS (SELECT mechanism, epoch_us(landed) / 1e6 - epoch_us(ts) / 1e6 AS lag FROM l)
SELECT mechanism, CAST(count(*) AS BIGINT) AS n, round(min(lag), 3) AS least, round(median(lag), 3) AS p50, round(quantile_cont(lag, 0.95), 3) AS p95, round(max(lag), 3) AS most FROM s GROUP BY 1""")
def ingest_lag(spark, sf_dir):
    """Seconds from event to landing, by mechanism."""
    (events,) = tables(spark, sf_dir, "events")
    row = F.col("event_id") % 3 == 0
    wait = F.when(row, 5 + F.col("event_id") % 6).otherwise(60 + F.col("event_id") % 40)
    l = events.select(F.when(row, "row").otherwise("file").alias("mechanism"), "ts", F.timestamp_add("SECOND", wait.cast("int"), "ts").alias("landed"))  # noqa: E741
    r = streaming.lag_report(l, "mechanism", "ts", "landed")
    return r.select("mechanism", "n", *[F.round(c, 3).alias(c) for c in ("least", "p50", "p95", "most")])


@query("route_counts", "SELECT 'parquet' AS route, CAST(count(*) AS BIGINT) AS n FROM region UNION ALL SELECT 'csv', count(*) FROM region UNION ALL SELECT 'ndjson', count(*) FROM region")
def route_counts(spark, sf_dir):
    """The same rows by three routes, counted side by side."""
    (region,) = tables(spark, sf_dir, "region")
    base = scratch(spark, "routes")
    region.write.parquet(f"{base}/parquet")
    region.write.csv(f"{base}/csv")
    region.write.json(f"{base}/ndjson")
    n = lambda route, df: df.agg(F.lit(route).alias("route"), F.count(F.lit(1)).alias("n"))
    return n("parquet", spark.read.parquet(f"{base}/parquet")).unionByName(n("csv", sources.by_position(spark, f"{base}/csv"))).unionByName(n("ndjson", sources.read_ndjson(spark, f"{base}/ndjson", "r_regionkey int, r_name string")))


@query("file_ingest", "SELECT event_id, event_type, TRUE AS has_file FROM events")
def file_ingest(spark, sf_dir):
    """New files of a folder, once each, over three runs; files of another name are passed over."""
    (events,) = tables(spark, sf_dir, "events")
    base = scratch(spark, "ingest")
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).select("event_id", "event_type").write.mode("append").json(f"{base}/in")
        streaming.ingest(spark, f"{base}/in", "event_id long, event_type string", f"{base}/out", f"{base}/state", pattern="*.json")
    streaming.ingest(spark, f"{base}/in", "event_id long, event_type string", f"{base}/out", f"{base}/state", pattern="*.json")
    return spark.read.parquet(f"{base}/out").select("event_id", "event_type", F.col("src_file").isNotNull().alias("has_file"))


@query("probe_report", "SELECT * FROM (VALUES ('good', 'ok', CAST(NULL AS VARCHAR), 25), ('missing column', 'failed', 'AnalysisException', CAST(NULL AS INTEGER)), ('bad cast', 'failed', 'NumberFormatException', NULL)) v(attempt, outcome, error, n)")
def probe_report(spark, sf_dir):
    """Attempts one by one, each with its outcome or kind of error, as a table."""
    (nation,) = tables(spark, sf_dir, "nation")
    attempts = {"good": lambda: nation.count(), "missing column": lambda: nation.select("nothing").count(), "bad cast": lambda: len(nation.select(F.col("n_name").cast("int")).collect())}
    return sources.probe(spark, attempts)
