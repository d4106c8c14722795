"""Exact nearest neighbours by cosine that skip pairs of blocks which can hold none.

Unit vectors go to the nearest of some pivots; a block is a ring of distances around one. For two blocks the triangle
inequality over their pivots bounds the distance of any two of their vectors from below, and so their cosine from above. Each block
first meets itself, which gives every vector k neighbours to begin with; it then meets only blocks whose bound
reaches the least of its vectors' k-th cosines. What is skipped holds no neighbour, ties included.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import nearest as all_pairs
from tidewell.session import scratch

#: Cosines are told to five places: a bound must lie under the k-th one by more than that.
_PLACES, _SLACK = 5, 1.5e-5
_NEAR = pa.schema([("vec_id", pa.int64()), ("label", pa.float64()), ("neighbour", pa.int64()), ("neighbour_label", pa.float64()), ("sim", pa.float64()), ("block", pa.int32())])
_NEAR_DDL = "vec_id long, label double, neighbour long, neighbour_label double, sim double, block int"


def _best(a: dict, b: dict, k: int) -> pa.RecordBatch:
    """The k best of block ``b`` for each row of block ``a``."""
    read = lambda r: (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], float), np.frombuffer(r["m"], float).reshape(-1, r["dims"]))
    (i, la, x), (j, lb, y) = read(a), read(b)
    q, o, s = [], [], []
    for at in range(0, len(i), 256):
        sim = np.round(np.clip(x[at : at + 256] @ y.T, -1, 1), _PLACES)
        for row in range(len(sim)):
            other = np.flatnonzero(j != i[at + row])
            if len(other) > 4 * k:  # all that reach the k-th, then in order
                kth = np.partition(sim[row, other], len(other) - k)[len(other) - k]
                other = other[sim[row, other] >= kth]
            order = other[np.lexsort((j[other], -sim[row, other]))[:k]]
            q.append(np.full(len(order), at + row))
            o.append(order)
            s.append(sim[row, order])
    q, o, s = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (q, o, s))
    return pa.RecordBatch.from_arrays([pa.array(i[q]), pa.array(la[q], from_pandas=True), pa.array(j[o]), pa.array(lb[o], from_pandas=True), pa.array(s.astype(float)), pa.array(np.full(len(q), a["block"], np.int32))], schema=_NEAR)


def _kept(found: list[pa.RecordBatch], k: int) -> list[pa.RecordBatch]:
    """The k best of each vector of one block among what was found in several others."""
    if len(found) < 2:
        return found
    t = pa.Table.from_batches(found).combine_chunks()
    ids, other, sim = (t[c].to_numpy() for c in ("vec_id", "neighbour", "sim"))
    order = np.lexsort((other, -sim, ids))
    first = np.r_[True, ids[order][1:] != ids[order][:-1]] if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return t.take(pa.array(order[rank < k])).combine_chunks().to_batches()


def _best_of_many(batches, k: int, most: int = 16):
    """The k best of each left block in all right blocks that follow one another beside it: one result, not one a pair."""
    held, block = [], None
    for batch in batches:
        for at in range(len(batch)):
            (r,) = batch.slice(at, 1).to_pylist()
            if r["ri"]["block"] != block or len(held) >= most:
                held = _kept(held, k)
                if r["ri"]["block"] != block:
                    yield from held
                    held, block = [], r["ri"]["block"]
            held.append(_best(r["ri"], r["rj"], k))
    yield from _kept(held, k)


class Blocks:
    """The blocks of (vec_id, label, embedding), written once, with what is known of each."""

    def __init__(self, vectors: DataFrame, rows_per_block: int = 2048, pivots: int = 128, rings: int = 40):
        spark = vectors.sparkSession
        x = F.col("embedding").cast("array<double>")
        rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("double").alias("label"), x.alias("x"))
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e))
        dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
        fit = F.coalesce((F.size("x") == dims) & norm.between(1e-300, 1e300) & ~F.exists("x", lambda e: e.isNull()), F.lit(False))
        self.odd, usable = rows.where(~fit).select("vec_id", "label"), rows.where(fit)
        seeds = usable.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(pivots).select("x").toArrow()["x"].to_pylist()
        centres = np.unique(np.array([np.array(s) / np.linalg.norm(s) for s in seeds]).reshape(-1, max(dims, 1)), axis=0)

        def assign(batches):
            for batch in batches:
                m = np.array(batch.column(2).to_pylist(), float).reshape(-1, dims)
                m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
                far = np.sqrt(np.maximum(2 - 2 * np.clip(m @ centres.T, -1, 1), 0)) if len(m) else np.zeros((0, 1))
                near = far.argmin(axis=1) if len(m) else np.zeros(0, int)
                # told again from the difference itself: exact enough for the bounds where the two are close
                dist = np.sqrt(((m - centres[near]) ** 2).sum(axis=1)) if len(m) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in m], pa.binary()), pa.array(near.astype(np.int32)), pa.array(dist)], names=["vec_id", "label", "u", "pivot", "dist"])

        placed = usable.mapInArrow(assign, "vec_id long, label double, u binary, pivot int, dist double").withColumn("ring", F.floor(F.col("dist") * (rings / 2.0)).cast("int"))
        # neighbouring rings of a pivot make a block until it is full; one with more rows is split
        sizes = placed.groupBy("pivot", "ring").count().orderBy("pivot", "ring").collect()  # pivots times rings at most
        plan, block, held, last = [], 0, 0, None
        for r in sizes:
            if last is not None and (r["pivot"] != last or held + r["count"] > rows_per_block):
                block, held = block + 1, 0
            split = -(-r["count"] // rows_per_block)
            plan.append((r["pivot"], r["ring"], block, split))
            block, held, last = block + split - 1, held + r["count"], r["pivot"]
        known = spark.createDataFrame(plan, "p int, g int, base int, split int")
        to = placed.join(F.broadcast(known), (F.col("pivot") == F.col("p")) & (F.col("ring") == F.col("g"))).withColumn("block", (F.col("base") + F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.col("split"))).cast("int"))

        def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{"block": key[0], "pivot": pdf["pivot"].iloc[0], "low": pdf["dist"].min(), "high": pdf["dist"].max(), "dims": dims, "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "labels": pdf["label"].to_numpy(float).tobytes(), "m": b"".join(pdf["u"])}])

        packed = to.groupBy("block").applyInPandas(pack, "block int, pivot int, low double, high double, dims int, ids binary, labels binary, m binary")
        path = scratch(spark, "blocks")
        packed.write.parquet(path)
        self.packed, self.centres, self.spark = spark.read.parquet(path), centres, spark

    def itself(self, k: int) -> DataFrame:
        return self.packed.mapInArrow(lambda it: (_best(r, r, k) for b in it for r in b.to_pylist()), _NEAR_DDL)

    def pairs(self, first: DataFrame, k: int) -> DataFrame:
        """(i, j): blocks, one of them not the other, whose bound reaches the least k-th cosine of the first's vectors."""
        least = first.groupBy("block", "vec_id").agg(F.when(F.count(F.lit(1)) < k, -2.0).otherwise(F.min("sim")).alias("kth")).groupBy("block").agg(F.min("kth").alias("kth"))
        meta = self.packed.select(F.col("block").alias("i"), F.col("pivot").alias("p"), F.col("low").alias("li"), F.col("high").alias("hi"))
        # a block of one vector has no neighbour yet
        meta = meta.join(least, F.col("i") == F.col("block"), "left").select("i", "p", "li", "hi", F.coalesce("kth", F.lit(-2.0)).alias("kth"))
        other = self.packed.select(F.col("block").alias("j"), F.col("pivot").alias("q"), F.col("low").alias("lj"), F.col("high").alias("hj"))
        c = self.centres
        far = np.sqrt(((c[:, None, :] - c[None]) ** 2).sum(axis=2)) if len(c) else np.zeros((0, 0))
        between = self.spark.createDataFrame(pd.DataFrame({"a": np.repeat(np.arange(len(c)), len(c)), "b": np.tile(np.arange(len(c)), len(c)), "d": far.ravel()}), "a int, b int, d double")
        d, below = F.col("d"), F.greatest(F.lit(0.0), F.col("d") - F.col("hi") - F.col("hj"), F.col("lj") - F.col("d") - F.col("hi"), F.col("li") - F.col("d") - F.col("hj"))
        met = meta.join(F.broadcast(between), F.col("p") == F.col("a")).join(other, (F.col("q") == F.col("b")) & (F.col("i") != F.col("j")))
        return met.where(d.isNotNull() & (1 - below * below / 2 >= F.col("kth") - _SLACK)).select("i", "j")


def nearest(vectors: DataFrame, k: int, rows_per_block: int = 2048, pivots: int = 128) -> DataFrame:
    """The ``k`` rows nearest by cosine (to five places, ties to the smaller id) to each row of (vec_id, label, embedding),
    itself left out: vec_id, label, neighbour, neighbour_label, sim.

    Vectors that are null, hold a null, are all zero, or shorter than the longest have a null similarity, which comes
    last. Null ids take no part. What fits into one block is compared there.
    """
    if vectors.limit(rows_per_block + 1).count() <= rows_per_block:
        return all_pairs(vectors, k, rows_per_block)
    blocks = Blocks(vectors, rows_per_block, pivots)

    def once(df: DataFrame, name: str) -> DataFrame:
        path = scratch(blocks.spark, name)
        df.write.parquet(path)
        return blocks.spark.read.schema(df.schema).parquet(path)

    first = once(blocks.itself(k), "first")
    side = lambda df, s, *more: df.select(F.col("block").alias(s), F.struct("block", "ids", "labels", "m", "dims").alias(f"r{s}"), *more)
    # each block goes, once, beside the list of those that it meets; a task of the product then reads its files of both sides
    lists = blocks.pairs(first, k).groupBy("i").agg(F.collect_list("j").alias("js"))
    left = once(side(blocks.packed, "i").join(lists, "i").select("i", "ri", "js"), "meets")
    met = left.hint("shuffle_replicate_nl").join(side(blocks.packed, "j"), F.array_contains("js", F.col("j"))).select("ri", "rj")
    near = once(first.unionByName(met.mapInArrow(lambda it: _best_of_many(it, k), _NEAR_DDL)).drop("block"), "near")
    every = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("double").alias("label"))
    # a null similarity is met where there are not k others: then the smallest ids come last
    small = every.orderBy("vec_id").limit(2 * k + 2).select(F.col("vec_id").alias("neighbour"), F.col("label").alias("neighbour_label"))
    odd = blocks.odd.join(F.broadcast(small), F.col("vec_id") != F.col("neighbour")).select("vec_id", "label", "neighbour", "neighbour_label", F.lit(None).cast("double").alias("sim"))
    few = blocks.odd.orderBy("vec_id").limit(k).select(F.col("vec_id").alias("neighbour"), F.col("label").alias("neighbour_label"))
    lacking = near.select("vec_id", "label").groupBy("vec_id", "label").count().where(F.col("count") < k).join(F.broadcast(few), F.lit(True)).select("vec_id", "label", "neighbour", "neighbour_label", F.lit(None).cast("double").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc_nulls_last("sim"), "neighbour"))
    return near.unionByName(odd).unionByName(lacking).withColumn("__rn", rank).where(F.col("__rn") <= k).drop("__rn")


def pruned(vectors: DataFrame, k: int, rows_per_block: int = 2048, pivots: int = 128) -> DataFrame:
    """How much work :func:`nearest` skips: blocks, pairs (of unlike blocks), met, skipped_pct."""
    blocks = Blocks(vectors, rows_per_block, pivots)
    n, met = blocks.packed.agg(F.count(F.lit(1)).alias("blocks")), blocks.pairs(blocks.itself(k), k).agg(F.count(F.lit(1)).alias("met"))
    every = F.col("blocks") * (F.col("blocks") - 1)
    return n.crossJoin(met).select("blocks", every.alias("pairs"), "met", F.when(every > 0, F.round(100 * (1 - F.col("met") / every), 2)).alias("skipped_pct"))
