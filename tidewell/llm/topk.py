"""Exact top-k inner products by a bit-sliced index.

The index holds blocks of rows. In a block every attribute (vector component, shifted to start at
zero) is cut into bit slices: bitmap (d, b) has bit b of component d of all rows. A query adds the
slices it needs, |q_d| times component d, by carry-save bitmap arithmetic over the most
significant slices of every attribute (``coarse_bits``); components with a negative weight enter
by their complement. The bit-sliced sums are searched from the most significant slice downward
for the k-th largest coarse score. All rows whose upper bound reaches that score's lower bound
are the boundary, and get their exact score. The bounds are proven, so nothing is lost.
"""

from __future__ import annotations

import heapq
import math
import pickle
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def finite(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, x, size): the vectors that take part, and their largest |scale * component|."""
    x = F.col(vec_col).cast("array<double>")
    ok = F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(ok, x).alias("x"))
        .where("vec_id is not null and x is not null")
        .withColumn("size", F.coalesce(F.array_max(F.transform("x", lambda e: F.abs(e) * F.lit(float(scale)))), F.lit(0.0)))
    )


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component."""
    return vectors.select("vec_id", F.transform("x", lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))


def _whole(x: list[float], scale: int) -> tuple[int, ...]:
    return tuple(math.floor(e * scale) if math.isfinite(e * scale) else math.floor(Fraction(e) * scale) for e in x)


def _exact_block(scale: int):
    """The rows of a block, once each and with whole components of any size, as a pickled list."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {}
        for i, x in zip(pdf["vec_id"], pdf["x"], strict=True):
            v = _whole([float(e) for e in x], scale)
            rows[int(i)] = min(rows.get(int(i), v), v)
        return pd.DataFrame([{"b": key[0], "rows": pickle.dumps(sorted(rows.items()))}])

    return run


def _exact(k: int):
    """The best ``k`` of each block pair by whole numbers. Scores under 64 bits are null; one over them is an error."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows, out = pickle.loads(r["rows"]), []
                for q, w in pickle.loads(r["q"]):
                    best = heapq.nsmallest(k, ((-sum(a * b for a, b in zip(w, v, strict=False)), i) for i, v in rows if i != q))
                    if best and -best[0][0] >= 1 << 63:
                        raise OverflowError(f"the score of query {q} and vector {best[0][1]} does not fit 64 bits: {-best[0][0]}")
                    out += [(q, i, -s if -s >= -(1 << 63) else None) for s, i in best]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], names=["query_id", "vec_id", "score"])

    return run


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, once each (of several vectors of an id the least), and the padded vectors."""
    rows = sorted({(int(i), tuple(int(e) for e in v)) for i, v in zip(pdf["vec_id"], pdf["v"], strict=True)})
    rows = [r for k, r in enumerate(rows) if k == 0 or rows[k - 1][0] != r[0]]
    out = np.zeros((len(rows), max((len(v) for _, v in rows), default=0)), np.int64)
    for k, (_, v) in enumerate(rows):
        out[k, : len(v)] = v
    return np.array([i for i, _ in rows], np.int64), out


def _index_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    ids, x = _matrix(pdf)
    low = int(x.min()) if x.size else 0
    bits = max(1, int(x.max() - low).bit_length()) if x.size else 1
    n, dims = x.shape
    words = -(-n // 64)
    slices = np.zeros((dims, bits, words * 8), np.uint8)
    for d in range(dims):
        u = x[:, d] - low
        for b in range(bits):
            packed = np.packbits((u >> b & 1).astype(np.uint8), bitorder="little")
            slices[d, b, : len(packed)] = packed
    return pd.DataFrame([{"b": key[0], "qb": -1, "ids": ids.tobytes(), "dims": dims, "bits": bits, "low": low, "body": slices.tobytes()}])


def _query_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    ids, x = _matrix(pdf)
    return pd.DataFrame([{"qb": key[0], "ids": ids.tobytes(), "dims": x.shape[1], "bits": 0, "low": 0, "body": x.tobytes()}])


def _add(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of bitmaps by weight, as slices: carry-save adders, three bitmaps into two."""
    out, k = [], 0
    while k < len(columns):
        if k + 1 == len(columns):
            columns.append([])
        parts = columns[k]
        a = np.concatenate(parts) if len(parts) > 1 else (parts[0] if parts else None)
        if a is None or not len(a):
            if k + 1 == len(columns) - 1 and not columns[k + 1]:
                break
            out.append(None)
            k += 1
            continue
        while len(a) > 1:
            t = len(a) // 3
            if t:
                x, y, z = a[:t], a[t : 2 * t], a[2 * t : 3 * t]
                xy = x ^ y
                columns[k + 1].append((x & y) | (z & xy))
                a = np.concatenate((xy ^ z, a[3 * t :])) if len(a) > 3 * t else xy ^ z
            else:
                columns[k + 1].append(a[:1] & a[1:2])
                a = a[:1] ^ a[1:2]
        out.append(a[0])
        k += 1
    return out


class _Block:
    """An index block's bitmaps, the coarse ones with their complements, and its rows."""

    def __init__(self, block: dict, coarse_bits: int):
        self.ids = np.frombuffer(block["ids"], np.int64)
        self.dims, bits, n = block["dims"], block["bits"], len(self.ids)
        words = -(-n // 64)
        slices = np.frombuffer(block["body"], np.uint64).reshape(self.dims, bits, words)
        self.x = np.full((n, self.dims), block["low"], np.int64)
        for b in range(bits):
            self.x += np.unpackbits(slices[:, b].copy().view(np.uint8).reshape(self.dims, words * 8), axis=1, bitorder="little")[:, :n].T.astype(np.int64) << b
        self.shift = max(0, bits - coarse_bits)
        plain = np.ascontiguousarray(slices[:, self.shift :, :])
        self.planes, self.top = np.stack((plain, ~plain)), bits - self.shift
        exist = np.zeros(words * 8, np.uint8)
        packed = np.packbits(np.ones(n, np.uint8), bitorder="little")
        exist[: len(packed)] = packed
        self.exist = exist.view(np.uint64)


def _best(block: _Block, queries: np.ndarray, qids: np.ndarray, k: int) -> tuple[list, list, list]:
    ids, x, dims, planes, shift, top, exist = block.ids, block.x, block.dims, block.planes, block.shift, block.top, block.exist
    n = len(ids)
    q = np.zeros((len(qids), dims), np.int64)
    common = min(dims, queries.shape[1])
    q[:, :common] = queries[:, :common]
    out_q, out_v, out_s = [], [], []
    for qi, w in zip(qids, q, strict=True):
        e = exist.copy()
        own = int(np.searchsorted(ids, qi))
        if own < n and ids[own] == qi:
            e[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        size = np.abs(w)
        ge = e
        if int(np.bitwise_count(e).sum()) > k and size.any():
            neg = (w < 0).astype(np.int64)
            columns: list[list[np.ndarray]] = [[] for _ in range(int(size.max()).bit_length() + top)]
            for j in range(int(size.max()).bit_length()):
                d = np.flatnonzero(size >> j & 1)
                if len(d):
                    for b in range(top):
                        columns[j + b].append(planes[neg[d], d, b])
            sums = _add(columns)
            # k-th largest coarse score, from the most significant slice down
            kth, cand, need = 0, e, k
            for level in range(len(sums) - 1, -1, -1):
                s = sums[level]
                if s is None:
                    continue
                hit = cand & s
                c = int(np.bitwise_count(hit).sum())
                if c >= need:
                    kth |= 1 << level
                    cand = hit
                else:
                    need -= c
                    cand = cand & ~s
            least = max(0, kth - (int(size.sum()) * ((1 << shift) - 1) >> shift))
            gt, eq = np.zeros_like(e), e
            for level in range(len(sums) - 1, -1, -1):
                s = sums[level]
                if least >> level & 1:
                    eq = eq & s if s is not None else np.zeros_like(e)
                elif s is not None:
                    gt = gt | (eq & s)
                    eq = eq & ~s
            ge = gt | eq
        rows = np.flatnonzero(np.unpackbits(ge.view(np.uint8), bitorder="little")[:n])
        score = x[rows] @ w
        order = np.lexsort((ids[rows], -score))[:k]
        out_q += [int(qi)] * len(order)
        out_v += ids[rows[order]].tolist()
        out_s += score[order].tolist()
    return out_q, out_v, out_s


def top_k(
    df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    scale: int = 256, rows_per_block: int = 16384, queries_per_block: int = 128, coarse_bits: int = 4,
) -> DataFrame:
    """The ``k`` rows of ``df`` with the highest integer inner product with each row of ``queries``.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Rows that are
    null, hold a null or non-finite component, or have a null id take no part. Rows so large that a
    score could leave 64 bits are scored apart, in whole numbers of any size; a score to be returned
    that does not fit is an error. Vectors of unlike length are compared over the shorter one; an empty
    vector scores 0. A row does not answer a query of its own id. Of repeated rows one counts; of
    several vectors under one id the least in order counts. Other columns are not looked at. An
    empty table gives an empty result.
    """
    spark = df.sparkSession
    prepare(spark)
    index, asked = finite(df, id_col, vec_col, scale), finite(queries, id_col, vec_col, scale)
    extent = lambda v: v.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max("size"), F.lit(0.0))).first()
    (n, dims, most), (n_asked, q_dims, q_most) = extent(index), extent(asked)
    blocks = max(1, math.ceil(n / rows_per_block))
    q_blocks = max(1, math.ceil(n_asked / queries_per_block))
    width = max(1, min(dims, q_dims))
    apart = None
    # the shifted index and the scores stay under 64 bits if all components stay under these
    if (max(most, q_most) + 1) > 2.0**61 or width * (most + 1) * (q_most + 1) > 2.0**62:
        limit = math.sqrt(2.0**62 / width) - 1
        # all vectors of an id go one way, as the least of them counts
        large = lambda v: v.where(F.col("size") > limit).select("vec_id").distinct()
        parts = [(v.join(large(v), "vec_id", "left_anti"), v.join(large(v), "vec_id", "left_semi")) for v in (index, asked)]
        (few, big), (q_few, q_big) = parts
        e_blocks, e_asked = max(1, math.ceil(n / 2048)), max(1, math.ceil(n_asked / 128))
        sized = lambda v, c, m: v.withColumn("b", F.pmod(F.xxhash64(F.lit(13), "vec_id"), F.lit(m)).cast("int")).groupBy("b").applyInPandas(_exact_block(scale), "b int, rows binary").select(F.col("b").alias(f"b_{c}"), F.col("rows").alias(c))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        meet = lambda v, q: sized(v, "rows", e_blocks).withColumn("b_q", every(e_asked)).join(sized(q, "q", e_asked).withColumn("b_rows", every(e_blocks)), ["b_rows", "b_q"]).mapInArrow(_exact(k), "query_id long, vec_id long, score long")
        apart = meet(index, q_big).unionByName(meet(big, q_few))
        index, asked = few, q_few
    index, asked = quantised(index, scale), quantised(asked, scale)
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    # one copy of the index, block k in partition k; the queries, which are few, come to every block, which sees them one block at a time
    parts = "qb int, ids binary, dims int, bits int, low long, body binary"
    built = index.withColumn("b", dealt(blocks, 11)).groupBy("b").applyInPandas(_index_block, f"b int, {parts}")
    asked = asked.withColumn("qb", dealt(q_blocks, 12)).groupBy("qb").applyInPandas(_query_block, parts).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        at, block = None, None
        for batch in batches:
            for k_row in range(len(batch)):
                r = batch.slice(k_row, 1).to_pylist()[0]
                if r["qb"] < 0:
                    at, block = r["b"], _Block(r, coarse_bits)
                elif r["b"] == at:
                    qids = np.frombuffer(r["ids"], np.int64)
                    found = _best(block, np.frombuffer(r["body"], np.int64).reshape(len(qids), r["dims"]), qids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], schema=schema)

    met = built.unionByName(asked).repartitionById(blocks, F.col("b")).sortWithinPartitions("b", "qb")
    near = met.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if apart is not None:
        near = near.unionByName(apart)
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.col("score") if apart is None else F.coalesce("score", F.raise_error(F.lit("a score does not fit 64 bits")).cast("long"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
