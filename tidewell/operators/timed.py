"""Joins and windows over time and order that split a key's rows among tasks: no hot key is one task's.

Times are compared in microseconds. Slices and bins are keyed by (group, slice), so a group of any size is as
many keys as it covers slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_MS = 6 * 3_600_000


def _micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def as_of_sliced(left: DataFrame, right: DataFrame, ts: str, right_ts: str, by: list[str], values: list[str], how: str = "left", slice_ms: int = SLICE_MS) -> DataFrame:
    """Each left row with the values of the latest right row at or before it in its group.

    Both sides are stacked and the last right row is carried forward inside each slice of time. A slice begins with the
    last right row of the slices before it, which is found over one row a slice. Rows without a time or a group match nothing.
    """
    rest = [c for c in left.columns if c not in by]
    at = lambda c: F.floor(_micros(c) / F.lit(slice_ms * 1000)).alias("__slice")
    a = left.select(*by, at(ts), F.col(ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*rest).alias("__l"), F.lit(None).alias("__r"))
    b = right.dropna(subset=[right_ts, *by]).select(*by, at(right_ts), F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.lit(None).alias("__l"), F.struct(*values).alias("__r"))
    both = a.unionByName(b)
    last = both.groupBy(*by, "__slice").agg(F.max_by("__r", F.when(F.col("__side") == 0, F.col("__ts"))).alias("__end"))
    earlier = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__slice").alias("__at"), F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    same = [F.col(c) == F.col(f"__by{k}") for k, c in enumerate(by)]
    w = Window.partitionBy(*by, "__slice").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1").join(carried, [*same, F.col("__slice") == F.col("__at")], "left")
    r = F.when(F.col("__ts").isNotNull(), F.coalesce("__r", "__before"))
    out = out.withColumn("__r", r).select(*by, "__l.*", *[F.col(f"__r.{v}").alias(v) for v in values], F.col("__r").isNotNull().alias("__hit"))
    return (out.where("__hit") if how == "inner" else out).drop("__hit")


def trailing_counts(df: DataFrame, by: list[str], ts: str, millis_back: int, name: str, slice_ms: int = SLICE_MS) -> DataFrame:
    """``df`` with the number of its group's rows in the ``millis_back`` before each row, itself and its equals in time left out.

    A slice sees the rows of the one before that are near enough, its halo, and keeps its own. Times are taken in whole milliseconds.
    """
    slice_ms = max(slice_ms, millis_back)
    ms = F.floor(_micros(ts) / 1000)
    own = F.floor(F.col("__ms") / F.lit(slice_ms))
    near = F.col("__ms") >= (own + 1) * slice_ms - millis_back
    seen = df.withColumn("__ms", ms).withColumn("__slice", F.explode(F.when(near, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*by, "__slice").orderBy("__ms").rangeBetween(-millis_back, -1)
    return seen.withColumn(name, F.count("__ms").over(w)).where(own.eqNullSafe(F.col("__slice"))).drop("__ms", "__slice")


def interval_join(left: DataFrame, right: DataFrame, by: list[tuple[str, str]], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows of a group whose half-open intervals overlap, each once; the columns of ``right`` must have other names.

    An interval's level is the power of two (of a second at least) that its length does not exceed; at any level from its
    own up it touches two bins at most. Two intervals meet at the higher of their levels, in the bin in which the later of
    them begins, and nowhere else. So rows grow by the number of levels, not by their length, and a
    long interval meets the short ones near it alone. Empty and null intervals match nothing.
    """
    second = 1_000_000
    level = lambda a, b: F.ceil(F.log2(F.greatest((b - a) / F.lit(float(second)), F.lit(1.0)))).cast("int")

    def placed(df: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        a, b = _micros(span[0]), _micros(span[1])
        return df.withColumns({f"__a{side}": a, f"__b{side}": b}).where(F.col(f"__a{side}") < F.col(f"__b{side}")).withColumn(f"__lv{side}", level(F.col(f"__a{side}"), F.col(f"__b{side}")))

    l, r = placed(left, left_span, "l"), placed(right, right_span, "r")  # noqa: E741
    known = sorted({x[0] for x in l.select("__lvl").distinct().union(r.select("__lvr").distinct()).collect()})  # 60 at most
    levels = F.array(*[F.lit(k) for k in known]) if known else F.array().cast("array<int>")
    size = lambda k: F.pow(F.lit(2.0), k).cast("long") * second
    bin_of = lambda t, k: F.floor(t / size(k))

    def binned(df: DataFrame, side: str) -> DataFrame:
        a, b, own = F.col(f"__a{side}"), F.col(f"__b{side}"), F.col(f"__lv{side}")
        up = df.withColumn(f"__at{side}", F.explode(F.filter(levels, lambda k: k >= own)))
        k = F.col(f"__at{side}")
        return up.withColumn(f"__bin{side}", F.explode(F.sequence(bin_of(a, k), bin_of(b - 1, k))))

    same = [F.col(x) == F.col(y) for x, y in by]
    met = binned(l, "l").join(binned(r, "r"), [*same, F.col("__atl") == F.col("__atr"), F.col("__binl") == F.col("__binr")])
    met = met.where((F.col("__al") < F.col("__br")) & (F.col("__ar") < F.col("__bl")) & (F.col("__atl") == F.greatest("__lvl", "__lvr")))
    met = met.where(F.col("__binl") == bin_of(F.greatest("__al", "__ar"), F.col("__atl")))
    return met.select(*left.columns, *right.columns)


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], also: dict[str, Column] | None = None, buckets: int = 64) -> DataFrame:
    """Exact quantiles by group, interpolated as percentile_cont does, without holding a group's values anywhere.

    Equal values are counted first. Values then fall into ``buckets`` ranges (their bounds are drawn from all values and
    only steer the work), whose counts tell which ranges hold the ranks that are asked for; just those are ranked. ``also`` are
    aggregates over the distinct values with their number ``n``. Null values do not count; groups of nulls alone are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("n"))
    cuts = counts.agg(F.percentile_approx("__v", F.array(*[F.lit((k + 1) / buckets) for k in range(buckets - 1)]), F.lit(1000))).first()[0] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    counts = counts.withColumn("__bucket", F.size(F.filter(bounds, lambda x: x < F.col("__v"))))
    # one row a group and range: how many are before it, and how many there are
    sums = counts.groupBy(*by, "__bucket").agg(F.sum("n").alias("__n"))
    over, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"__total": F.sum("__n").over(over), "__before": F.coalesce(F.sum("__n").over(upto), F.lit(0))})
    rank = lambda q: F.lit(q) * (F.col("__total") - 1)
    low, high = (lambda q: F.floor(rank(q))), (lambda q: F.ceil(rank(q)))
    holds = lambda k: (F.col("__before") <= k) & (k < F.col("__before") + F.col("__n"))
    wanted = F.lit(False)
    for q in quantiles.values():
        wanted = wanted | holds(low(q)) | holds(high(q))
    key = [F.col(c).alias(f"__by{k}") for k, c in enumerate(by)]
    need = sums.where(wanted).select(*key, F.col("__bucket").alias("__b"), "__total", "__before")
    same = [F.col(c).eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by)]
    inside = counts.join(need, [*same, F.col("__bucket") == F.col("__b")])
    first = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("__from", F.col("__before") + first)
    at = lambda k: F.max(F.when((F.col("__from") <= k) & (k < F.col("__from") + F.col("n")), F.col("__v")))
    found = inside.groupBy(*by).agg(F.max("__total").alias("__total"), *[x for name, q in quantiles.items() for x in (at(low(q)).alias(f"{name}__lo"), at(high(q)).alias(f"{name}__hi"))])
    part = lambda q: rank(q) - low(q)
    out = found.select(*by, *[(F.col(f"{name}__lo") + part(q) * (F.col(f"{name}__hi") - F.col(f"{name}__lo"))).alias(name) for name, q in quantiles.items()])
    if not also:
        return out
    rest = counts.withColumnRenamed("__v", value).groupBy(*key).agg(*[c.alias(n) for n, c in also.items()])
    return out.join(rest, same).drop(*[f"__by{k}" for k in range(len(by))])
