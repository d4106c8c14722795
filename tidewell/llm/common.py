"""What the corpus operators share: job set-up, Arrow text access, vectorised words and hashes.

Texts are handled as the UTF-8 bytes of an Arrow column. A batch is walked in slices of whole
rows of about ``SLICE_BYTES``; a longer text is a slice of its own, so memory follows the longest
text and not the batch.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import random
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

_U = np.uint64
_P, _P_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: The word pattern in SQL's and Java's notation.
WORD = "[^\\x20\\x09-\\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and see that checkpoint() has a folder.

    The cluster names the shared folder in ``spark.checkpoint.dir``; only where it is unset and all
    runs on one machine, as in tests, a temporary folder is taken. Batches for Python end at BATCH_BYTES unless
    the session has a size of its own.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = sc.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths) if x)
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidewell-"))
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: idle workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def clean(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that no table in use needs.

    It does so when the driver's garbage is collected, which an iterative job can't leave to chance:
    until then the files of all its rounds stay on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``work`` on Arrow batches, which gives memory back at the end of its partition."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def some_files(docs: DataFrame, most: int = 64, seed: int = 1) -> DataFrame:
    """The rows of at most ``most`` of the files that ``docs`` is read from, chosen at random, for samples
    that only steer costs; ``docs`` itself where it isn't read straight from more files than that."""
    files = sorted(docs.inputFiles())
    if len(files) <= most:
        return docs
    try:
        names = [unquote(f.rsplit("/", 1)[-1]) for f in random.Random(seed).sample(files, most)]
        few = docs.where(F.col("_metadata.file_name").isin(names))
        return docs if few.isEmpty() else few
    except AnalysisException:
        return docs


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows that hold about ``limit`` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _P), ("down", _P_INV)):
            with np.errstate(over="ignore"):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class SpanHash:
    """64-bit hashes of arbitrary byte spans of one slice, by prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * _U(0x9FB21C651E98DF25))


class Words:
    """The words of a slice: start and end bytes, and the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        space = IS_SPACE[data]
        if n:
            before = np.empty(n, bool)
            before[0] = True
            before[1:] = space[:-1]
            first = offsets[:-1]
            before[first[first < n]] = True
            after = np.empty(n, bool)
            after[-1] = True
            after[:-1] = space[1:]
            last = offsets[1:]
            after[last[last > 0] - 1] = True
            self.start = np.flatnonzero(before & ~space)
            self.end = np.flatnonzero(after & ~space) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.space = space
        self.row = np.searchsorted(offsets[1:], self.start, side="right")
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)


_STEP = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` word hashes from each position on; windows may run over rows."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += words[k : k + n] * _STEP[k]
    return mix(out)


def row_sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read again; gone when the session ends."""
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
