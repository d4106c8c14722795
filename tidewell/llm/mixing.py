"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

The tree is domain, language, source. A token budget enters at the root. At each node it is shared
among the children by weight, none above what its leaves can give in ``max_epochs`` epochs; what a
child can't take goes to its siblings, by weight again, and only what no sibling can take stays
with the ancestors, who share it likewise. A leaf's budget is met by whole epochs and the
token-prefix of one more, in that epoch's seeded order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, prepare

LEVELS = ("domain", "lang", "source")
#: Leaf tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_LEAVES = 50_000


def default_domain() -> Column:
    """d0 to d3 by the number that ends the source's name, or ``other``."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (number.cast("int") % 4).cast("string")))


def _weight(level: str, weights: dict) -> Column:
    """A level's weights: a table of whole numbers (1 for others), or "supply" for the node's own tokens."""
    given = weights.get(level, {})
    if given == "supply":
        return F.col("supply")
    out = F.lit(1)
    for value, w in given.items():
        out = F.when(F.col(level) == value, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def water_fill(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Adds ``alloc`` to nodes with ``budget`` (the parent's), ``cap`` and ``weight``: the parent's
    budget by weight, none above its cap; whole tokens, rounded down."""
    whole = "decimal(38,0)"
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    order = by.orderBy(F.col("ratio"), F.col(key))
    nodes = nodes.withColumn("ratio", F.col("cap").cast("double") / F.nullif("weight", F.lit(0)).cast("double")).where("weight > 0")
    nodes = (
        nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w", F.sum(F.col("weight").cast(whole)).over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap").cast(whole) * F.col("w") <= F.col("left").cast(whole) * F.col("weight").cast(whole))
        .withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0)))
        .withColumn("rest_w", F.sum(F.when(~F.col("full"), F.col("weight").cast("decimal(28,0)"))).over(by))
    )
    share = F.expr("cast(rest as decimal(19,0)) * cast(weight as decimal(19,0)) div rest_w")
    return nodes.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(share).cast("long")).drop("ratio", "left", "w", "full", "rest", "rest_w")


def mix(
    docs: DataFrame, weights: dict, budget_share: float = 1.0, max_epochs: int = 2, seed: int = 17,
    text_col: str = "text", id_col: str = "doc_id", domain: Column | None = None,
) -> DataFrame:
    """``docs`` mixed to the weights: each row once for each epoch it is chosen in, as ``record``
    (a struct of all columns) with domain, lang, source, n_tokens and ``epoch`` (from 1).

    ``weights`` has a table, or "supply", by level; a node that weighs 0 takes nothing, and what it
    would have taken goes to its siblings, or up where none can take it. The budget is
    ``budget_share`` of all tokens (words), or all that the leaves can give in their epochs. Null lang or source counts as "". A null or empty text
    has no tokens and goes where its place in the epoch puts it; a leaf without tokens gives
    nothing. Rows of one id in a leaf stand together in the order. A prefix ends before the row
    that would pass the budget. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    leaf = list(LEVELS)
    src = docs.withColumn("__domain", domain if domain is not None else default_domain())
    rows = src.select(
        F.col("__domain").alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
    )
    supply = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("rows")).checkpoint()
    total, most = supply.agg(F.sum("supply"), F.max("rows")).first()
    total = int(total or 0)
    # from the leaves up, what each node can take: nothing where it or all below it weighs 0
    tree = [supply.select(*leaf, "supply", (F.col("supply") * max_epochs).alias("cap"))]
    for depth in range(len(leaf), 0, -1):
        here = tree[0].withColumn("weight", _weight(leaf[depth - 1], weights))
        here = here.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
        tree[0] = here
        tree.insert(0, here.groupBy(*leaf[: depth - 1]).agg(F.sum("supply").alias("supply"), F.sum("cap").alias("cap")))
    can_take = int(tree[0].first()["cap"] or 0)
    # from the root down, what each gets; no budget is above its node's cap, so none is lost on the way
    above = None
    for depth, nodes in enumerate(tree[1:]):
        path = leaf[: depth + 1]
        nodes = nodes.withColumn("budget", F.lit(min(int(total * budget_share), can_take)).cast("long")) if above is None else nodes.join(above, path[:-1])
        plan = water_fill(nodes, path[:-1], leaf[depth])
        above = plan.select(*path, F.col("alloc").alias("budget"))
    plan = plan.select(*leaf, F.expr("coalesce(alloc div nullif(supply, 0), 0)").alias("whole"), F.expr("coalesce(alloc % nullif(supply, 0), 0)").alias("rest")).checkpoint()
    small = plan.count() <= BROADCAST_LEAVES

    def with_leaf(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
        return df.join(F.broadcast(table) if small else table, on)

    def keyed(df: DataFrame) -> DataFrame:
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), "id"))
        return df.withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits))

    # the bucket in which the prefix ends, by sums over buckets; then the row, in that bucket alone. A leaf has as many
    # buckets as a bucket has rows, so that the largest leaf, whatever its share, gives a task the root of its rows
    digits = max(2, math.ceil(math.log(max(1, most or 0), 16) / 2))
    slim = keyed(with_leaf(rows.select(*leaf, "id", "n_tokens"), plan, leaf))
    run = Window.partitionBy(*leaf).orderBy("bucket")
    ends = (
        slim.groupBy(*leaf, "bucket", "rest").agg(F.sum("n_tokens").alias("t")).withColumn("before", F.sum("t").over(run) - F.col("t"))
        .where("before <= rest and rest < before + t").select(*leaf, F.col("bucket").alias("end"), "before")
    )
    inside = with_leaf(slim, ends, leaf).where(F.col("bucket") == F.col("end"))
    run = Window.partitionBy(*leaf).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(run)).groupBy(*leaf, "end").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))).alias("last"))
    cut = cut.select(*leaf, F.coalesce("last", "end").alias("last"))
    chosen = keyed(with_leaf(rows, plan.join(cut, leaf, "left"), leaf))
    copies = F.col("whole") + F.when(F.col("key") <= F.col("last"), 1).otherwise(0)
    return chosen.withColumn("copies", copies).where("copies > 0").select("record", *leaf, "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("epoch"))
