"""Scalar functions: dates, keys, JSON, text, masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.registry import query
from tidewell.session import tables
from tidewell.sources import spine_of


@query("date_dimension", """
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, strftime(d, '%Y-%m-%d') AS day, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
  CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day_of_month, CAST(week(d) AS INTEGER) AS week, CAST(dayofweek(d) AS INTEGER) AS day_of_week,
  dayofweek(d) IN (0, 6) AS is_weekend
FROM (SELECT unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(o_orderdate)::DATE FROM orders), INTERVAL 1 DAY))::DATE AS d)""")  # fmt: skip
def date_dimension(spark, sf_dir):
    """The days from the first order to the last."""
    (orders,) = tables(spark, sf_dir, "orders")
    d = spine_of(orders, "o_orderdate").withColumnRenamed("day", "d")
    return d.select(
        fn.date_key("d").alias("date_key"), F.date_format("d", "yyyy-MM-dd").alias("day"), F.year("d").alias("year"), F.quarter("d").alias("quarter"), F.month("d").alias("month"),
        F.dayofmonth("d").alias("day_of_month"), F.weekofyear("d").alias("week"), fn.day_of_week("d").alias("day_of_week"), fn.day_of_week("d").isin(0, 6).alias("is_weekend"),
    )


@query("date_boundary_diff", """
SELECT event_id, date_diff('second', p, ts) AS seconds, date_diff('minute', p, ts) AS minutes, date_diff('millisecond', p, ts) AS ms
FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)""")  # fmt: skip
def date_boundary_diff(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    e = events.select("event_id", "ts", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("p"))
    return e.select("event_id", fn.seconds_between("p", "ts").alias("seconds"), fn.minutes_between("p", "ts").alias("minutes"), (fn.millis("ts") - fn.millis("p")).alias("ms"))


@query("surrogate_keys", """
SELECT n_nationkey, md5(n_nationkey || '-' || n_name) AS nation_key,
  md5(coalesce(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END, '_dbt_utils_surrogate_key_null_') || '-' || n_regionkey) AS nullable_key FROM nation""")
def surrogate_keys(spark, sf_dir):
    (nation,) = tables(spark, sf_dir, "nation")
    return nation.select("n_nationkey", fn.surrogate_key("n_nationkey", "n_name").alias("nation_key"), fn.surrogate_key(F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")), "n_regionkey").alias("nullable_key"))


@query("row_hash", r"SELECT p_partkey, md5(coalesce(p_name, '\N') || '|' || coalesce(p_brand, '\N') || '|' || coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END, '\N')) AS row_hash FROM part")
def row_hash(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    return part.select("p_partkey", fn.row_hash("p_name", "p_brand", F.when(F.col("p_size") % 5 != 0, F.col("p_type"))).alias("row_hash"))


@query("json_variant", """
SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CAST(props->>'$.missing' AS BIGINT) AS missing, json_type(props, '$.k') = 'NULL' AS is_json_null FROM events""")
def json_variant(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    v = events.select("event_id", F.parse_json("props").alias("v"))
    return v.select(
        "event_id", F.variant_get("v", "$.k", "bigint").alias("k"), F.try_variant_get("v", "$.missing", "bigint").alias("missing"),
        F.is_variant_null(F.variant_get("v", "$.k", "variant")).alias("is_json_null"),
    )


@query("json_flatten", """
SELECT event_id, CAST(i AS BIGINT) AS idx, CAST(k AS BIGINT) + i AS item FROM (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, unnest(range(0, 3)) AS i FROM events)""")
def json_flatten(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    doc = F.to_json(F.struct(F.array(k, k + 1, k + 2).alias("items")))
    items = F.from_json(doc, "items array<bigint>")["items"]
    return events.select("event_id", F.posexplode(items).alias("idx", "item")).select("event_id", F.col("idx").cast("long").alias("idx"), "item")


@query("text_parse_regex", r"""
SELECT page_id, nullif(regexp_extract(url, '^(https?)://', 1), '') AS scheme, nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS host,
  nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page, split_part(regexp_extract(url, '^https?://([^/?#]+)', 1), '.', -1) AS tld, length(url) AS n FROM pages""")
def text_parse_regex(spark, sf_dir):
    (pages,) = tables(spark, sf_dir, "pages")
    host = fn.extract("url", "^https?://([^/?#]+)")
    return pages.select(
        "page_id", fn.extract("url", "^(https?)://").alias("scheme"), host.alias("host"), fn.extract("url", "[?&]page=([0-9]+)").alias("page"),
        F.split_part(host, F.lit("."), F.lit(-1)).alias("tld"), F.length("url").cast("long").alias("n"),
    )


@query("try_casts", """
SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 2 = 0 THEN source ELSE CAST(n_chars AS VARCHAR) END AS BIGINT) AS number, strftime(TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN lang ELSE '2024-02-29 10:00:00' END AS TIMESTAMP), '%Y-%m-%d %H') AS at FROM documents""")
def try_casts(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    mixed = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.col("n_chars").cast("string"))
    at = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.lit("2024-02-29 10:00:00"))
    return docs.select("doc_id", mixed.try_cast("long").alias("number"), F.date_format(F.try_to_timestamp(at), "yyyy-MM-dd HH").alias("at"))


@query("null_safe_extremes", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE least(o_custkey, o_orderkey) END AS least_strict, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE greatest(o_custkey, o_orderkey) END AS greatest_strict,
  nullif(o_orderstatus, 'P') AS status, nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F' AS changed, nullif(o_orderstatus, 'P') IN ('F', 'O') AS known, o_orderkey BETWEEN 100 AND 2000 AS early FROM orders""")
def null_safe_extremes(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    status = F.nullif("o_orderstatus", F.lit("P"))
    k = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    return orders.select(
        "o_orderkey", fn.least_strict(k, "o_orderkey").alias("least_strict"), fn.greatest_strict(k, "o_orderkey").alias("greatest_strict"), status.alias("status"),
        (~status.eqNullSafe(F.lit("F"))).alias("changed"), status.isin("F", "O").alias("known"), F.col("o_orderkey").between(100, 2000).alias("early"),
    )


@query("like_patterns", r"""
SELECT p_partkey, p_type LIKE '%BRASS%' AS brass, p_type ILIKE '%brass%' AS ibrass, p_name LIKE '%' || lower(left(p_brand, 1)) || '%' AS by_column, p_name LIKE 'part\_%' ESCAPE '\' AS escaped FROM part""")
def like_patterns(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    return part.select(
        "p_partkey", F.col("p_type").like("%BRASS%").alias("brass"), F.col("p_type").ilike("%brass%").alias("ibrass"),
        F.expr("p_name LIKE concat('%', lower(left(p_brand, 1)), '%')").alias("by_column"), F.expr(r"p_name LIKE r'part\_%'").alias("escaped"),
    )


@query("string_functions", """
SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, ltrim(c_name, 'C') AS cut, left(c_name, 4) AS l4, right(c_name, 4) AS r4, repeat('X', 3) || chr(45) || replace(c_name, '#', '') AS built,
  CAST(abs(round(c_acctbal)) AS BIGINT) AS size, CAST(sign(c_acctbal) AS INTEGER) AS sgn, CAST(ceil(c_acctbal) AS BIGINT) AS up_to FROM customer""")
def string_functions(spark, sf_dir):
    (customer,) = tables(spark, sf_dir, "customer")
    return customer.select(
        "c_custkey", F.upper("c_mktsegment").alias("up"), F.lower("c_name").alias("low"), F.ltrim("c_name", F.lit("C")).alias("cut"), F.left("c_name", F.lit(4)).alias("l4"), F.right("c_name", F.lit(4)).alias("r4"),
        F.concat(F.repeat(F.lit("X"), 3), F.char(F.lit(45)), F.replace("c_name", F.lit("#"), F.lit(""))).alias("built"),
        F.abs(F.round("c_acctbal")).cast("long").alias("size"), F.signum("c_acctbal").cast("int").alias("sgn"), F.ceil("c_acctbal").alias("up_to"),
    )


@query("haversine_distance", """
SELECT s_suppkey, round(2 * 6371.0 * asin(sqrt(pow(sin((lat - 0.2268928) / 2), 2) + cos(0.2268928) * cos(lat) * pow(sin((lon - 1.3536035) / 2), 2))), 3) AS km
FROM (SELECT s_suppkey, radians(12.9 + (s_suppkey % 50) / 100.0::DOUBLE) AS lat, radians(77.5 + (s_suppkey % 70) / 100.0::DOUBLE) AS lon FROM supplier)""".replace("0.2268928", "radians(13.0::DOUBLE)").replace("1.3536035", "radians(77.6::DOUBLE)"))
def haversine_distance(spark, sf_dir):
    (supplier,) = tables(spark, sf_dir, "supplier")
    at = supplier.select("s_suppkey", (F.lit(12.9) + (F.col("s_suppkey") % 50) / 100.0).alias("lat"), (F.lit(77.5) + (F.col("s_suppkey") % 70) / 100.0).alias("lon"))
    return at.select("s_suppkey", F.round(fn.haversine_km(F.lit(13.0), F.lit(77.6), "lat", "lon"), 3).alias("km"))


@query("hash_vector_tokens", """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS tok FROM documents),
s AS (SELECT doc_id, ('0x' || substr(md5(tok), 15, 2))::INTEGER AS slot, CASE WHEN ('0x' || substr(md5(tok), 8, 1))::INTEGER % 2 = 1 THEN 1 ELSE -1 END AS sign FROM t)
SELECT doc_id, slot, CAST(sum(sign) AS BIGINT) AS weight FROM s GROUP BY doc_id, slot HAVING sum(sign) <> 0""")
def hash_vector_tokens(spark, sf_dir):
    """Signed hashing of single words to 256 slots (sparse)."""
    (docs,) = tables(spark, sf_dir, "documents")
    t = docs.select("doc_id", fn.tokens("text").alias("toks")).select("doc_id", F.explode_outer("toks").alias("tok")).where("tok is not null")
    t = t.select("doc_id", fn.hash_slot("tok").alias("h")).select("doc_id", "h.*")
    return t.groupBy("doc_id", "slot").agg(F.sum("sign").alias("weight")).where("weight <> 0")


@query("hash_vector_text", """
WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[a-z]{2,}'), []) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS gram FROM t),
s AS (SELECT doc_id, ('0x' || substr(md5(gram), 15, 2))::INTEGER AS slot, sum(CASE WHEN ('0x' || substr(md5(gram), 8, 1))::INTEGER % 2 = 1 THEN 1 ELSE -1 END) AS n FROM g GROUP BY ALL),
m AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM s GROUP BY ALL),
d AS (SELECT doc_id, unnest(range(0, 256)) AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, round(coalesce(n / nullif(norm, 0), 0), 9) + 0.0 AS weight FROM d LEFT JOIN s USING (doc_id, slot) LEFT JOIN m USING (doc_id)""")
def hash_vector_text(spark, sf_dir):
    """The 256 components of every document's hash vector."""
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(fn.hash_vector("text")).alias("slot", "weight")).select("doc_id", "slot", (F.round("weight", 9) + F.lit(0.0)).alias("weight"))


@query("masking_by_role", """
SELECT c_custkey, role, CASE role WHEN 'owner' THEN c_name || '@mail.example' WHEN 'analyst' THEN sha256(lower(c_name || '@mail.example')) ELSE '***REDACTED***' END AS email,
  CASE role WHEN 'owner' THEN '98450' || lpad(c_custkey::VARCHAR, 5, '0') ELSE repeat('X', 6) || right('98450' || lpad(c_custkey::VARCHAR, 5, '0'), 4) END AS phone,
  CASE role WHEN 'owner' THEN c_name ELSE left(c_name, 1) || repeat('*', length(c_name)::INTEGER - 1) END AS name,
  CASE role WHEN 'owner' THEN c_acctbal / 7 ELSE round(c_acctbal / 7, 2) END AS lat
FROM customer, (VALUES ('owner'), ('analyst'), ('viewer')) r(role) WHERE role <> 'owner'""")
def masking_by_role(spark, sf_dir):
    (customer,) = tables(spark, sf_dir, "customer")
    base = customer.select("c_custkey", "c_name", F.concat("c_name", F.lit("@mail.example")).alias("m"), F.concat(F.lit("98450"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("p"), (F.col("c_acctbal") / 7).alias("x"))
    each = [
        base.select("c_custkey", F.lit(r).alias("role"), fn.mask_email("m", r).alias("email"), fn.mask_phone("p", r).alias("phone"), fn.mask_name("c_name", r).alias("name"), fn.mask_coordinate("x", r).alias("lat"))
        for r in ("analyst", "viewer")
    ]
    return each[0].unionByName(each[1])
