"""From conformed tables to marts, features and served views.

Each function takes DataFrames of the conformed schema (stores, customers, riders, products with
their versions, order headers and items, status events, stock snapshots) and returns one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell import operators as op
from tidewell.operators import timed

PEAK_HOURS = (12, 13, 19, 20, 21)
OPEN_END = "9999-12-31 00:00:00"
#: Fitting columns: what is known when an order is placed. Nothing that happens later may be among them.
FEATURES = ("f_dist_5", "f_peak", "f_load_15", "f_items_5", "f_weekend", "f_cod")
AFTERWARDS = frozenset({"packed_ts", "picked_up_ts", "delivered_ts", "breach_sec", "pack_sec", "pick_sec", "ride_sec", "total_sec", "is_breached"})


#: The conformed tables: their key, and their columns as the change log carries them, with what each becomes. Dates come as days
#: since 1970, times as text with a Z.
CONFORMED = {
    "order_status_event": ("event_id", "event_id string, order_id long, store_id int, rider_id int, from_status string, to_status string, event_ts time, source string"),
    "store": ("store_id", "store_id int, store_code string, city string, pincode string, lat double, lon double, opened_on day, is_active boolean"),
    "customer": ("customer_id", "customer_id int, full_name string, email string, phone string, segment string, home_pincode string, home_lat double, home_lon double, created_at time"),
    "product": ("product_id", "product_id int, sku string, name string, category_l1 string, category_l2 string, category_l3 string, price_paise long, is_active boolean, updated_at time"),
    "rider": ("rider_id", "rider_id int, full_name string, phone string, vehicle_type string, store_id int, shift string, is_active boolean, joined_on day"),
    "order_header": ("order_id", "order_id long, customer_id int, store_id int, rider_id int, placed_ts time, promised_ts time, packed_ts time, picked_up_ts time, delivered_ts time, status string, payment_method string, coupon_code string, item_count int, gross_paise long, discount_paise long, delivery_fee_paise long, order_total_paise long"),
    "order_item": ("order_item_id", "order_item_id long, order_id long, product_id int, qty int, unit_price_paise long, line_total_paise long"),
    "inventory_daily": ("snapshot_date,store_id,product_id", "snapshot_date day, store_id int, product_id int, on_hand_qty int, reorder_level int"),
}


def conformed(landed: DataFrame, table: str, parts: int | None = None) -> DataFrame:
    """The current rows of one of CONFORMED from its landed change log (``payload``, ``offset``): the latest
    record of each key, none whose latest is a delete, dates and times as such. ``parts``: how many tasks the keys are
    dealt to, for a log with few records a key; records are then sorted once, behind the shuffle alone."""
    key, columns = CONFORMED[table]
    fields = [c.split(" ") for c in columns.split(", ")]
    raw = ", ".join(f"{n}: {({'day': 'int', 'time': 'string'}).get(t, t)}" for n, t in fields)
    log = landed.select(F.from_json("payload", f"before struct<{raw}>, after struct<{raw}>, op string, ts_ms long").alias("p"), "offset").select("p.*", "offset")
    keys = [F.coalesce(F.col(f"after.{k}"), F.col(f"before.{k}")).alias(f"__{k}") for k in key.split(",")]
    keyed = log.select("*", *keys)
    if parts:
        keyed = keyed.repartition(parts, *[f"__{k}" for k in key.split(",")])
    latest = op.dedupe_latest(keyed, [f"__{k}" for k in key.split(",")], [F.desc("ts_ms"), F.desc("offset")]).where("after is not null and op <> 'd'")
    typed = {"day": lambda c: F.date_from_unix_date(c), "time": lambda c: F.to_timestamp_ntz(c)}
    return latest.select(*[typed.get(t, lambda c: c)(F.col(f"after.{n}")).alias(n) for n, t in fields], F.timestamp_millis("ts_ms").alias("cdc_ts"))


def dimension(rows: DataFrame, name: str, key: str) -> DataFrame:
    """A type-1 dimension: its surrogate key before all columns."""
    return rows.select(fn.surrogate_key(key).alias(f"{name}_sk"), "*")


def dim_date(spine: DataFrame, day: str = "day") -> DataFrame:
    d = F.col(day)
    return spine.select(
        fn.date_key(d).alias("date_sk"), d.alias("calendar_date"), F.year(d).alias("calendar_year"), F.quarter(d).alias("calendar_quarter"), F.month(d).alias("calendar_month"),
        F.monthname(d).alias("month_name"), F.dayofmonth(d).alias("day_of_month"), fn.day_of_week(d).alias("day_of_week"), F.dayname(d).alias("day_name"),
        F.weekofyear(d).alias("week_of_year"), fn.day_of_week(d).isin(0, 6).alias("is_weekend"),
    )


def dim_product(versions: DataFrame) -> DataFrame:
    """Product versions with a key each; an open version ends far away."""
    start = F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss")
    return versions.select(fn.surrogate_key("product_id", start).alias("product_sk"), "*").withColumn("valid_to", F.coalesce("valid_to", F.lit(OPEN_END).cast("timestamp_ntz")))


def order_funnel(events: DataFrame) -> DataFrame:
    """Orders whose events are placed, packed, picked up, delivered, one after another, with the seconds of each leg."""
    m = op.match_strict(events, ["order_id"], ["event_ts", "event_id"], "to_status", ["PLACED", "PACKED", "PICKED_UP", "DELIVERED"])
    at = lambda k: F.col("steps")[k]["event_ts"]
    legs = {"pack_sec": (0, 1), "pick_sec": (1, 2), "ride_sec": (2, 3), "total_sec": (0, 3)}
    return m.select("order_id", *[fn.seconds_between(at(a), at(b)).alias(n) for n, (a, b) in legs.items()])


def order_cancelled(events: DataFrame) -> DataFrame:
    """Orders placed, perhaps packed, then cancelled."""
    m = op.match_pattern(events, ["order_id"], ["event_ts", "event_id"], "to_status", {"PLACED": "P", "PACKED": "K", "CANCELLED": "C"}, "PK?C")
    return m.select("order_id", (F.col("n_rows") == 3).alias("was_packed"))


def order_anomaly(events: DataFrame, funnel: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Orders with events that are neither: what is missing, or else that the order of events is wrong."""
    rest = events.join(funnel.select("order_id").unionByName(cancelled.select("order_id")), "order_id", "left_anti")
    has = lambda s: F.bool_or(F.col("to_status") == s)
    found = rest.groupBy("order_id").agg(op.ordered_list("to_status", "event_ts", "event_id").alias("path"), has("PACKED").alias("k"), has("PICKED_UP").alias("u"), has("DELIVERED").alias("d"))
    kind = F.when(~F.col("k"), "MISSING_PACKED").when(~F.col("u"), "MISSING_PICKED_UP").when(~F.col("d"), "MISSING_DELIVERED").otherwise("OUT_OF_ORDER")
    return found.select("order_id", kind.alias("anomaly_type"), F.array_join("path", ">").alias("path"))


def placed_orders(headers: DataFrame) -> DataFrame:
    """What the order fact has from the headers alone: keys, times, breach of the promise, money."""
    late = F.col("delivered_ts").isNotNull() & (F.col("delivered_ts") > F.col("promised_ts"))
    return headers.select(
        fn.surrogate_key("order_id").alias("order_sk"), "order_id", fn.date_key("placed_ts").alias("placed_date_sk"), fn.surrogate_key("customer_id").alias("customer_sk"),
        fn.surrogate_key("store_id").alias("store_sk"), fn.surrogate_key("rider_id").alias("rider_sk"), "placed_ts", "promised_ts", "delivered_ts", "status", late.alias("is_breached"),
        F.when(F.col("delivered_ts").isNotNull(), fn.seconds_between("promised_ts", "delivered_ts")).alias("breach_sec"),
        "payment_method", "item_count", "gross_paise", "discount_paise", "delivery_fee_paise", "order_total_paise",
    )


def fct_order(headers: DataFrame, funnel: DataFrame, cancelled: DataFrame, anomaly: DataFrame) -> DataFrame:
    """The accumulating order fact: legs, outcome of the lifecycle, breach of the promise."""
    outcome = funnel.select("order_id", F.lit("CLEAN").alias("o")).unionByName(cancelled.select("order_id", F.lit("CANCELLED").alias("o"))).unionByName(anomaly.select("order_id", F.col("anomaly_type").alias("o")))
    return placed_orders(headers).join(funnel, "order_id", "left").join(outcome, "order_id", "left").select(
        "order_sk", "order_id", "placed_date_sk", "customer_sk", "store_sk", "rider_sk", "placed_ts", "promised_ts", "delivered_ts", "pack_sec", "pick_sec", "ride_sec", "total_sec",
        "status", F.coalesce("o", F.lit("NO_EVENTS")).alias("lifecycle_outcome"), "is_breached", "breach_sec",
        "payment_method", "item_count", "gross_paise", "discount_paise", "delivery_fee_paise", "order_total_paise",
    )


def fct_order_item(items: DataFrame, headers: DataFrame, products: DataFrame, item_id: Column | str = "order_item_id") -> DataFrame:
    """Order lines at the price that the catalogue had when the order was placed. ``item_id`` may be made of the
    items' other columns: it is made after the joins, so that they shuffle no long text."""
    lines = items.join(headers.select("order_id", "placed_ts"), "order_id")
    out = op.validity_join(lines, products.select("product_id", "product_sk", "price_paise", "valid_from", "valid_to"), "product_id", "placed_ts")
    return out.select(
        fn.surrogate_key(item_id).alias("order_item_sk"), fn.col(item_id).alias("order_item_id"), "order_id", fn.surrogate_key("order_id").alias("order_sk"), "product_sk", "product_id",
        fn.date_key("placed_ts").alias("placed_date_sk"), "qty", "unit_price_paise", "line_total_paise", F.col("price_paise").alias("catalogue_price_paise"),
        (F.col("unit_price_paise") - F.col("price_paise")).alias("price_variance_paise"),
    )


def fct_order_status_event(events: DataFrame) -> DataFrame:
    key = lambda c: fn.surrogate_key(c)
    return events.select(
        key("event_id").alias("event_sk"), "event_id", "order_id", key("order_id").alias("order_sk"), key("store_id").alias("store_sk"), key("rider_id").alias("rider_sk"),
        fn.date_key("event_ts").alias("event_date_sk"), "from_status", "to_status", "event_ts",
    )


def fct_inventory_daily(stock: DataFrame) -> DataFrame:
    day = F.date_format("snapshot_date", "yyyy-MM-dd")
    return stock.select(
        fn.surrogate_key(day, "store_id", "product_id").alias("inventory_sk"), fn.date_key("snapshot_date").alias("snapshot_date_sk"), "snapshot_date", fn.surrogate_key("store_id").alias("store_sk"),
        "store_id", "product_id", "on_hand_qty", "reorder_level", (F.col("on_hand_qty") <= F.col("reorder_level")).alias("is_below_reorder"),
        F.greatest(F.col("reorder_level") - F.col("on_hand_qty"), F.lit(0)).alias("units_short"),
    )


def order_features(fact: DataFrame, stores: DataFrame, customers: DataFrame, split_days: int = 45) -> DataFrame:
    """Delivered orders (of :func:`placed_orders` or the whole fact) with what was known when they were placed, the label, and a split by time:
    TRAIN before the first day plus ``split_days``, else TEST. The store's load counts the orders of
    the hour before, not those of the same millisecond."""
    cutoff = fact.agg(F.date_add(F.min("placed_ts").cast("date"), split_days).alias("split_day"))
    placed = fact.where("status = 'DELIVERED'").select("order_id", "store_sk", "customer_sk", "placed_ts", "payment_method", "item_count", "gross_paise", "is_breached")
    base = placed.join(stores.select("store_sk", "city", "lat", "lon"), "store_sk").join(customers.select("customer_sk", "segment", "home_lat", "home_lon"), "customer_sk")
    base = base.withColumns({
        "dist_km": fn.haversine_km("lat", "lon", "home_lat", "home_lon"), "ist_hour": fn.ist_hour("placed_ts"),
        "is_weekend": fn.day_of_week("placed_ts").isin(0, 6).cast("int"), "is_cod": (F.col("payment_method") == "COD").cast("int"),
    })
    base = timed.trailing_counts(base, ["store_sk"], "placed_ts", 3_600_000, "store_load_60m")
    base = base.withColumn("is_peak_hour", F.col("ist_hour").isin(*PEAK_HOURS).cast("int"))
    scaled = {
        "f_dist_5": F.col("dist_km") / 5.0, "f_peak": F.col("is_peak_hour").cast("double"), "f_load_15": F.least(F.col("store_load_60m"), F.lit(15)) / 15.0,
        "f_items_5": F.col("item_count") / 5.0, "f_weekend": F.col("is_weekend").cast("double"), "f_cod": F.col("is_cod").cast("double"),
    }
    split = F.when(F.col("placed_ts") < F.col("split_day").cast("timestamp_ntz"), "TRAIN").otherwise("TEST")
    return base.crossJoin(F.broadcast(cutoff)).select(
        "order_id", "placed_ts", "city", "segment", "payment_method", "dist_km", "ist_hour", "item_count", "gross_paise", "store_load_60m", "is_peak_hour", "is_weekend", "is_cod",
        *[c.alias(n) for n, c in scaled.items()], F.col("is_breached").cast("double").alias("label"), split.alias("split"),
    )


def assert_no_leakage(features: tuple[str, ...] | list[str]) -> None:
    """Raises if a fitting column is only known after the order was placed."""
    late = AFTERWARDS & set(features)
    if late:
        raise ValueError(f"known only afterwards: {', '.join(sorted(late))}")


def sla_store_hour(fact: DataFrame, stores: DataFrame) -> DataFrame:
    """Counts and sums by store, day and local hour: what can be kept up by adding."""
    seconds = lambda c: F.sum(fn.seconds_between("placed_ts", c))
    rows = fact.where("status = 'DELIVERED'").join(stores.select("store_sk", "store_code", "city"), "store_sk")
    return rows.groupBy("store_code", "city", F.date_format("placed_ts", "yyyy-MM-dd").alias("placed_date"), fn.ist_hour("placed_ts").alias("ist_hour")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if("is_breached").alias("breached"), seconds("promised_ts").alias("promised_sec"), seconds("delivered_ts").alias("delivered_sec"),
        F.count("delivered_ts").alias("delivered_n"), F.sum("order_total_paise").alias("gross_paise"),
    )


def sla_rates(state: DataFrame) -> DataFrame:
    """The ratios over :func:`sla_store_hour`."""
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b), F.lit(0)))
    return state.select(
        "store_code", "city", "placed_date", "ist_hour", "orders", "breached", F.round(100 * part("breached", "orders"), 2).alias("breach_pct"),
        F.round(part("promised_sec", "orders") / 60, 1).alias("avg_promised_min"), F.round(part("delivered_sec", "delivered_n") / 60, 1).alias("avg_actual_min"), "gross_paise",
    )


def parse_complaint(docs: DataFrame, labels: DataFrame, order_offset: int = 899_999, body: str = "body", on: tuple[str, ...] = ("ticket_id",)) -> DataFrame:
    """Complaint documents as columns, with their hand label where there is one; what can't be parsed is null.
    ``on``: the parsed columns by which ``labels`` are found, more than the ticket where tickets repeat."""
    raw = F.expr(f"try_cast(nullif(regexp_extract({body}, 'Order ([0-9]+)', 1), '') as bigint)")
    text = F.trim(F.regexp_replace(F.regexp_extract(body, r"(?s)City: [A-Za-z]+\s*(.*)$", 1), r"\s+", " "))
    parsed = docs.select(
        "ticket_id", (raw + order_offset).alias("order_id"), raw.alias("source_order_id"), fn.extract(body, "Store (DS[0-9]+)").alias("store_code"),
        F.try_to_timestamp(fn.extract(body, "Raised ([0-9-]+T[0-9:]+)Z")).alias("raised_ts"), fn.extract(body, "Channel: ([a-z_]+)").alias("channel"), fn.extract(body, "City: ([A-Za-z]+)").alias("city"),
        text.alias("complaint_text"), F.length(text).alias("text_chars"), F.size(F.split(text, " ")).alias("word_count"),
    )
    return parsed.join(labels.select(*on, "reason_code"), list(on), "left").select(*parsed.columns, "reason_code").withColumn("is_labelled", F.col("reason_code").isNotNull())


def triage(predictions: DataFrame, reasons: DataFrame, threshold: float = 0.235) -> DataFrame:
    """Predicted complaints routed: at or above ``threshold`` AUTO, below it REVIEW."""
    routed = predictions.withColumn("routing", F.when(F.col("confidence") >= threshold, "AUTO").otherwise("REVIEW"))
    return routed.join(reasons, routed["predicted"] == reasons["reason_code"], "left")


def data_health(results: DataFrame) -> DataFrame:
    """The latest result of each check."""
    return op.dedupe_latest(results, ["check_name", "target"], [F.desc("check_ts")])


def scoreboard(metrics: DataFrame, names: tuple[str, ...] = ("n", "accuracy", "roc_auc", "macro_f1", "brier")) -> DataFrame:
    """Long model metrics, one row a model, version and split."""
    return op.pivot_metrics(metrics, ["model_name", "model_version", "split"], "metric", "value", list(names))
