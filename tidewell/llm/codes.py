"""Product codes of vectors, fitted in whole numbers, with annular norm pruning.

Vectors are cut into equal consecutive parts; each part position has a small codebook. A round assigns
every part to its nearest entry and moves the entries to the means of their parts. The entries of a codebook are
sorted by norm. By the triangle inequality an entry within distance d of a vector v has a norm in
[|v| - d, |v| + d]: the entry next to v in norm gives the first d, a binary search gives the interval that d
allows, and only the entries in that annulus are evaluated, from the inside out, while d shrinks. The bounds are
inclusive and rounded outwards, so ties are evaluated too and the result is that of a full search.

A round is one pass over the vectors: sums and counts by entry are made in each partition and added up by
Spark, so what reaches the driver is a codebook's size whatever the table's.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, tidy

#: Integer roots may be one too small on either side of a comparison; so much wider is every annulus.
_SLACK = 4


def _root(x: np.ndarray) -> np.ndarray:
    """Square roots of whole numbers, rounded down (64-bit ones to within one)."""
    if x.dtype == object:
        return np.array([math.isqrt(int(v)) for v in x], object)
    return np.sqrt(x.astype(np.float64)).astype(np.int64)


class Codebook:
    """One part position's entries, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norms = _root((entries * entries).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each row's nearest entry, ties to the lower index; how many distances that took."""
        n, k = len(x), len(self.order)
        own = _root((x * x).sum(axis=1))
        at = np.minimum(np.searchsorted(self.norms, own), k - 1)
        best = self.order[at]
        dist = ((x - self.entries[best]) ** 2).sum(axis=1)
        evaluated = n
        for step in range(1, k):
            radius = _root(dist) + _SLACK
            low, high = np.searchsorted(self.norms, own - radius), np.searchsorted(self.norms, own + radius, side="right")
            going = False
            for where, inside in ((at - step, at - step >= low), (at + step, at + step < high)):
                rows = np.flatnonzero(inside)
                if len(rows):
                    going = True
                    entry = self.order[where[rows]]
                    d = ((x[rows] - self.entries[entry]) ** 2).sum(axis=1)
                    better = (d < dist[rows]) | ((d == dist[rows]) & (entry < best[rows]))
                    rows = rows[better]
                    best[rows], dist[rows] = entry[better], d[better]
                    evaluated += len(better)
            if not going:
                break
        return best, dist, evaluated


def _matrix(column: pa.Array, dims: int, scale: int, wide: bool) -> np.ndarray:
    """Vectors as rows of whole numbers, shorter ones padded with zeros."""
    if wide:
        out = np.zeros((len(column), dims), object)
        for k, x in enumerate(column.to_pylist()):
            out[k, : len(x)] = [math.floor(Fraction(e) * scale) for e in x]
        return out
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = flat
    return out


def _sums(books: list[np.ndarray], dims: int, scale: int, wide: bool):
    """Of a partition: part, entry, position, the sum of that component as a decimal string or a number, and the count."""
    width, searched = dims // len(books), [Codebook(b) for b in books]

    def run(batches):
        total = [np.zeros(b.shape, object if wide else np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            x = _matrix(batch.column(0), dims, scale, wide)
            for p, book in enumerate(searched):
                part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                entry, _, _ = book.nearest(part)
                order = np.argsort(entry, kind="stable")
                used, first = np.unique(entry[order], return_index=True)
                if len(used):
                    total[p][used] += np.add.reduceat(part[order], first, axis=0)
                count[p] += np.bincount(entry, minlength=len(count[p]))
        rows = [(p, e, j, total[p][e, j], int(count[p][e])) for p in range(len(books)) for e in range(len(count[p])) if count[p][e] for j in range(width)]
        keys = [pa.array([r[i] for r in rows], pa.int32()) for i in range(3)]
        value = pa.array([str(r[3]) for r in rows], pa.string()) if wide else pa.array([int(r[3]) for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([*keys, value, pa.array([r[4] for r in rows], pa.int64())], names=["part", "entry", "place", "s", "n"])

    return run


def _encode(books: list[np.ndarray], dims: int, scale: int, wide: bool):
    width, searched = dims // len(books), [Codebook(b) for b in books]
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(0), dims, scale, wide)
            code, error = np.full(len(x), "", dtype=f"<U{2 * len(books)}"), np.zeros(len(x), object if wide else np.int64)
            for p, book in enumerate(searched):
                entry, dist, _ = book.nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width]))
                code, error = np.char.add(code, digits[entry]), error + dist
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(code.tolist(), pa.string()), pa.array([int(e) for e in error], pa.int64())], names=["id", "label", "code", "error"])

    return run


def fit_codebooks(stored: DataFrame, dims: int, parts: int, entries: int, rounds: int, scale: int, wide: bool) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds; ``stored`` has v, id."""
    ids = [r[0] for r in stored.select("id").distinct().orderBy(F.asc_nulls_last("id")).limit(entries).collect()]
    first = stored.where(F.col("id").isin([i for i in ids if i is not None]) | (F.col("id").isNull() if None in ids else F.lit(False)))
    seeds = dict(first.groupBy("id").agg(F.min("v")).collect())
    column = pa.array([seeds[i] for i in ids], pa.list_(pa.float64() if wide else pa.int64()))
    x, width = _matrix(column, dims, scale, wide), dims // parts
    books = [x[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        sums = stored.select("v").mapInArrow(tidy(_sums(books, dims, scale, wide)), f"part int, entry int, place int, s {'string' if wide else 'long'}, n long")
        by = sums.groupBy("part", "entry", "place")
        # wide sums are whole numbers of any size: one string from each partition
        found = by.agg((F.collect_list("s") if wide else F.sum("s")).alias("s"), F.sum("n").alias("n")).collect()
        for r in found:
            books[r["part"]][r["entry"], r["place"]] = (sum(map(int, r["s"])) if wide else r["s"]) // r["n"]
    return books


def vector_codes(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> DataFrame:
    """Each vector's code: id, code (two hex digits a part), error, label_error, codebooks_sha256.

    A component is floor(scale * x). The codebooks begin with the vectors of the ``entries`` smallest distinct ids, a null
    id after all others; of several vectors under one id the least in order counts there. All rows are coded
    and counted, repeated ones each. Vectors that are null or hold a null or non-finite component are
    dropped. Vectors shorter than the longest, and lengths that ``parts`` does not divide, are
    padded with zeros. ``error`` is the sum of the parts' squared distances, ``label_error`` its sum over
    rows of an equal label, nulls together; one that does not fit 64 bits is an error. Fewer ids than
    ``entries`` give smaller codebooks, an empty table an empty result. Other columns are not looked at.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    if scale < 1 or scale & (scale - 1):
        raise ValueError("the scale must be a power of two, as products are then exact")
    prepare(df.sparkSession)
    x = F.col(vec_col).cast("array<double>")
    ok = F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    kept = df.select(F.when(ok, x).alias("x"), F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).where("x is not null")
    most = F.coalesce(F.array_max(F.transform("x", lambda e: F.abs(e))), F.lit(0.0)) * float(scale)
    n, longest, most = kept.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max(most), F.lit(0.0))).first()
    dims = max(1, -(-longest // parts)) * parts
    wide = dims * (2.0 * (most + 1)) * (2.0 * (most + 1)) > 2.0**62 or n * (most + 1) > 2.0**62
    v = F.col("x") if wide else F.transform("x", lambda e: F.floor(e * F.lit(float(scale))))
    stored = cut(kept.select(v.alias("v"), "id", "label"))
    books = fit_codebooks(stored, dims, parts, entries, rounds, scale, wide) if n else [np.zeros((1, dims // parts), np.int64)] * parts
    sha = hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()
    label = df.schema[label_col].dataType.simpleString()
    coded = stored.mapInArrow(tidy(_encode(books, dims, scale, wide)), f"id long, label {label}, code string, error long")
    if wide:
        coded = cut(coded)
    by = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by, F.col("label").eqNullSafe(F.col("__label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
