"""Data-quality checks as rows: check_name, target, passed, observed, expected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(name: str, target: str, n: Column) -> list[Column]:
    return [F.lit(name).alias("check_name"), F.lit(target).alias("target"), (n == 0).alias("passed"), n.cast("string").alias("observed"), F.lit("0").alias("expected")]


def check(df: DataFrame, target: str, rule: Column, name: str) -> DataFrame:
    """Rows for which the rule doesn't hold (null counts as such)."""
    return df.agg(*_row(name, target, F.count_if(~F.coalesce(rule, F.lit(False)))))


def not_null(df: DataFrame, target: str, column: str, name: str) -> DataFrame:
    return check(df, target, F.col(column).isNotNull(), name)


def unique(df: DataFrame, target: str, column: str, name: str) -> DataFrame:
    """Values that are there more than once; nulls are passed over (pair it with not_null)."""
    return df.agg(*_row(name, target, F.count(column) - F.countDistinct(column)))


def accepted(df: DataFrame, target: str, column: str, values: list, name: str) -> DataFrame:
    return df.agg(*_row(name, target, F.count_if(~F.col(column).isin(values))))


def relationship(df: DataFrame, target: str, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Values without a parent; nulls are passed over (pair it with not_null)."""
    lost = df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__k")), F.col(column) == F.col("__k"), "left_anti")
    return lost.agg(*_row(name, target, F.count(F.lit(1))))


def not_empty(df: DataFrame, target: str, name: str) -> DataFrame:
    return df.agg(F.lit(name).alias("check_name"), F.lit(target).alias("target"), (F.count(F.lit(1)) > 0).alias("passed"), F.count(F.lit(1)).cast("string").alias("observed"), F.lit("> 0").alias("expected"))


def column_metrics(df: DataFrame, column: str) -> DataFrame:
    """Rows, nulls and repeated values of a column, as (metric, value)."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("row_count"), F.count_if(F.col(column).isNull()).alias("null_count"), (F.count(column) - F.countDistinct(column)).alias("duplicate_count"))
    return one.unpivot([], ["row_count", "null_count", "duplicate_count"], "metric", "value")


def suite(df: DataFrame, target: str, rules: dict[str, Column], unique_keys: dict[str, str] | None = None) -> DataFrame:
    """All the checks of one table in one pass: ``rules`` by name (as :func:`check`), keys that must be unique."""
    counts = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{k}") for k, rule in enumerate(rules.values())]
    keys = [(F.count(F.lit(1)) - F.countDistinct(c)).alias(f"u{k}") for k, c in enumerate((unique_keys or {}).values())]
    names = [*((n, f"r{k}") for k, n in enumerate(rules)), *((n, f"u{k}") for k, n in enumerate(unique_keys or {}))]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(c).alias("n")) for n, c in names]))
    return df.agg(*counts, *keys).select(rows.alias("x")).select("x.*").select("check_name", F.lit(target).alias("target"), (F.col("n") == 0).alias("passed"), F.col("n").cast("string").alias("observed"), F.lit("0").alias("expected"))


def results(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def gate(dq: DataFrame) -> None:
    """Raises if any check failed, naming the failures."""
    failed = [r["check_name"] for r in dq.where("not passed").select("check_name").limit(100).collect()]
    if failed:
        raise ValueError(f"failed checks: {', '.join(failed)}")


def alert(dq: DataFrame, order: str) -> DataFrame:
    """The latest row of each check, where it failed."""
    from tidewell.operators import dedupe_latest

    return dedupe_latest(dq, ["check_name"], [F.desc(order)]).where("not passed")
