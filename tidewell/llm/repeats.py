"""Later occurrences of repeated keys, with hot keys spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys can hold more than 1/HOT_KEYS of all repeated rows: the bound of the broadcast.
HOT_KEYS = 10_000
#: The parts a hot key's rows are dealt to.
SALTS = 64


def hot_above(total: int) -> int:
    """The rows of a key from which it is hot."""
    return max(1000, total // HOT_KEYS)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, by: list[str]) -> DataFrame:
    """``left`` joined to ``right``, the keys of ``hot`` (at most HOT_KEYS rows) dealt to SALTS parts by
    the columns ``by`` of the left; each side is read once."""
    known = F.broadcast(hot.select(*keys, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0)
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(known, keys, "left").withColumn("__salt", salt.cast("int")).drop("__hot")
    b = right.join(known, keys, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return a.join(b, [*keys, "__salt"]).drop("__salt")


def later_occurrences(units: DataFrame, keys: list[str], rank: list[str]) -> DataFrame:
    """The rows of ``units`` whose ``rank`` is not the least of their key, with it as ``first``.

    Counts and least ranks are combined before the shuffle; in the join a key above 1/HOT_KEYS of all
    repeated rows goes to SALTS parts.
    """
    place = F.struct(*rank)
    first = units.groupBy(*keys).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").checkpoint()
    limit = hot_above(first.agg(F.sum("__n")).first()[0] or 0)
    both = spread_join(units, first.drop("__n"), keys, first.where(F.col("__n") > limit), rank)
    return both.where(~place.eqNullSafe(F.col("first")))
