"""Exact substring dedup: threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is removed. The
windows of ``length`` bytes are dealt out by their minimizer, the least-hashed k-mer in them:
equal windows have the same one, at the same place, so they meet. Consecutive windows with one
minimizer travel as one run, and runs whose minimizer occurs once are left at home. Runs with equal
contents need one copy; where a minimizer has different contents, their texts are gathered, and a
task builds the Burrows-Wheeler transform of a batch of whole minimizer groups. There the
intervals of suffixes are extended backward breadth first: level l sets the common-prefix
boundaries of value l, and the search stops at ``length``. Suffixes that no boundary parts then
share ``length`` bytes. A minimizer with very many occurrences is dealt out anew by longer k-mers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, SpanHash, buffers, cut, mix, prepare, slices, tidy
from .repeats import hot_above, spread_join

_U = np.uint64
#: Longest stretch of one text looked at in one go, the bytes of one transform, and the occurrences
#: from which a minimizer is dealt out by longer k-mers.
STRETCH, CHUNK, HOT = 4 << 20, 1 << 20, 20_000
_AT = _U((1 << 24) - 1)
#: A run's start and, in its low bits, its windows.
PLACE = 20
WINS = (1 << PLACE) - 1


def runs(data: np.ndarray, offsets: np.ndarray, length: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: row, start, windows, hash of the minimizer, hash of the bytes."""
    n = len(data)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    first, count = offsets[:-1], np.maximum(0, np.diff(offsets) - length + 1)
    if n < length or not count.any():
        return empty
    hashed = SpanHash(data)
    at = np.arange(n - kmer + 1)
    h = mix(hashed.raw(at, at + kmer))
    low = (h & ~_AT) | at.astype(np.uint64)
    size, width = 1, length - kmer + 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    rows = np.flatnonzero(count)
    c = count[rows]
    before = np.concatenate(([0], np.cumsum(c)))
    start = np.repeat(first[rows] - before[:-1], c) + np.arange(before[-1])
    row = np.repeat(rows, c)
    m = low[start]
    head = np.concatenate(([0], np.flatnonzero((m[1:] != m[:-1]) | (row[1:] != row[:-1])) + 1))
    wins = np.diff(np.append(head, len(m)))
    s = start[head]
    return row[head], s, wins, h[(m[head] & _AT).astype(np.int64)], hashed(s, s + wins + length - 1)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Slices as (first row, bytes, offsets, bytes of the text before): long texts in stretches that
    overlap by ``length`` - 1 bytes, so that each window lies in exactly one."""
    for i, j in slices(offsets, SLICE_BYTES):
        a, b = int(offsets[i]), int(offsets[j])
        if j - i > 1 or b - a <= STRETCH:
            yield i, data[a:b], offsets[i : j + 1] - a, 0
            continue
        for s in range(0, b - a - length + 1, STRETCH):
            e = min(b - a, s + STRETCH + length - 1)
            yield i, data[a + s : a + e], np.array([0, e - s]), s


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes sorted by their first ``depth`` bytes at least (prefix doubling from 8 bytes)."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(key)
    new = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = head, -1
    k = 8
    while k < depth:
        alone = new & np.append(new[1:], True)
        todo = np.flatnonzero(~alone)  # places in the order that aren't settled
        if not len(todo):
            break
        suffix = order[todo]
        nxt = rank[np.minimum(suffix + k, n)]
        by = rank[suffix] * (n + 1) + nxt + 1
        move = np.argsort(by)
        suffix, by = suffix[move], by[move]
        order[todo] = suffix
        new[todo] = np.concatenate(([True], by[1:] != by[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[suffix] = head[todo]
        k *= 2
    return order


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """For each position, whether the ``length`` bytes from there also start elsewhere in ``text``.

    Breadth-first backward extension over the transform. ``edge[i]`` tells that suffixes i - 1 and i
    of the order have been parted. An interval [lb, rb) of the suffixes that begin with w, extended
    by a character c before it, is the interval of cw; if its right edge is not yet set, the common
    prefix there is |w|, and the interval goes on to the next level.
    """
    n = len(text) + 1  # with the empty suffix, which comes first
    order = np.concatenate(([n - 1], suffix_order(text, length + 1)))
    last = text[order - 1].astype(np.int16)  # the transform
    last[order == 0] = -1
    by_char = np.argsort(last, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_char] = np.arange(n)
    same = last[by_char[1:]] == last[by_char[:-1]]
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    after[by_char[:-1][same]] = by_char[1:][same]
    before[by_char[1:][same]] = by_char[:-1][same]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    lb, rb = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(lb):
            break
        size = rb - lb
        upto = np.cumsum(size)
        pos = np.repeat(lb - upto + size, size) + np.arange(upto[-1])
        firsts = pos[before[pos] < np.repeat(lb, size)]
        lasts = pos[after[pos] >= np.repeat(rb, size)]
        lb, rb = np.sort(lf[firsts]), np.sort(lf[lasts]) + 1
        fresh = ~edge[rb]
        lb, rb = lb[fresh], rb[fresh]
        edge[rb] = True
    out = np.empty(n, bool)
    out[order] = ~(edge[:-1] & edge[1:])
    return out[:-1]


def _search(length: int):
    """Whole minimizer groups, in order, gathered to transforms of about CHUNK bytes."""

    def solve(held: list) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(x[4] + b"\xff" for x in held), np.uint8)
        again = repeated(text, length)
        out, at = [[], [], [], []], 0
        for mh, ch, off, many, raw in held:
            n = len(raw) - length + 1
            mask = np.ones(n, bool) if many else again[at : at + n]
            if mask.any():
                for column, value in zip(out, (mh, ch, off, np.packbits(mask).tobytes()), strict=True):
                    column.append(value)
            at += len(raw) + 1
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], names=["mh", "ch", "off", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        group: list = []
        size, key = 0, None
        for batch in batches:
            for k, mh, ch, off, many, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if len(group) > 1 or group and group[0][3]:
                        held += group
                        size += sum(len(x[4]) for x in group)
                        if size >= CHUNK:
                            yield solve(held)
                            held, size = [], 0
                    group, key = [], k
                group.append((mh, ch, off, many, raw))
        held += group
        if held:
            yield solve(held)

    return run


def substring_dedup(docs: DataFrame, length: int = 200, text_col: str = "text", id_col: str = "doc_id", kmer: int = 32, keep_text: bool = False) -> DataFrame:
    """Each row's id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the
    bytes that stay, joined); with ``keep_text`` also the removed ``spans`` as [start, end) bytes.

    Texts are UTF-8 bytes, null counting as empty; a text shorter than ``length`` keeps all. Strings
    are judged on the input, across all rows and within one; repeated rows lose all that is long
    enough. ``length`` is under a million. Other columns are not looked at. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    if not kmer < length < WINS:
        raise ValueError(f"length must be above {kmer} and under {WINS}")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit("")), F.octet_length(F.coalesce(text_col, F.lit("")))).alias("tk"), F.coalesce(text_col, F.lit("")).alias("t"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(2))
            for i, piece, off, skipped in stretches(data, offs, length):
                row, start, wins, mh, ch = runs(piece, off, length, kmer)
                if len(row):
                    rows = pa.array(row + i)
                    place = (start - off[row] + skipped) << PLACE | wins
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place), pa.array(mh.view(np.int64)), pa.array(ch.view(np.int64))],
                        names=["doc_id", "tk", "place", "mh", "ch"],
                    )

    # the runs are found once and written; both passes over them read the file
    found = cut(src.mapInArrow(tidy(mark), "doc_id long, tk long, place long, mh long, ch long"))
    known = found.groupBy("mh").agg(F.count(F.lit(1)).alias("n"), F.min("ch").alias("x"), F.max("ch").alias("y")).where("n > 1")
    known = known.select("mh", "n", (F.col("x") != F.col("y")).alias("several"), (F.col("n") > HOT).alias("hot")).checkpoint()
    limit = hot_above(known.agg(F.sum("n")).first()[0] or 0)
    run = ["doc_id", "tk", "place"]
    twice = cut(spread_join(found, known.drop("n"), ["mh"], known.where(F.col("n") > limit), run))

    # one copy of each content of the minimizers that have several, by document, to fetch its bytes
    one = twice.where("several").groupBy("mh", "ch").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("doc_id", "tk", "place", "hot"))).checkpoint()
    asked = one.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("place", "mh", "ch", (F.col("n") > 1).alias("many"), "hot")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longer = (length + kmer) // 2
        for batch in batches:
            data, offs = buffers(batch.column(0))
            for lo in range(0, len(batch), 256):  # so that what is sent on stays small
                out: list[list] = [[], [], [], [], [], []]
                for r, asks in enumerate(batch.column(1).slice(lo, 256).to_pylist(), lo):
                    for x in asks:
                        s, wins = int(offs[r]) + (x["place"] >> PLACE), x["place"] & WINS
                        raw = data[s : s + wins + length - 1]
                        if x["hot"]:
                            _, at, w, mh, _ = runs(raw, np.array([0, len(raw)]), length, longer)
                            parts = [(int(k.view(np.int64)), int(a), raw[a : a + b + length - 1]) for k, a, b in zip(mix(mh + _U(x["mh"] & 0xFFFFFFFFFFFFFFFF)), at, w, strict=True)]
                        else:
                            parts = [(x["mh"], 0, raw)]
                        for key, off, part in parts:
                            for column, value in zip(out, (key, x["mh"], x["ch"], off, x["many"], part.tobytes()), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.bool_()), pa.array(out[5], pa.binary())], names=["key", "mh", "ch", "off", "many", "raw"])

    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tk"] == b["tk"])
    texts = src.join(asked, same(src, asked)).select("t", "asked").mapInArrow(fetch, "key long, mh long, ch long, off long, many boolean, raw binary")
    masks = texts.repartition("key").sortWithinPartitions("key").mapInArrow(_search(length), "mh long, ch long, off long, mask binary")
    whole = twice.where("not several").select("doc_id", "tk", "place", F.lit(0).cast("long").alias("off"), F.lit(None).cast("binary").alias("mask"))
    partly = spread_join(twice.where("several"), masks, ["mh", "ch"], one.where(F.col("n") > limit), run).select("doc_id", "tk", "place", "off", "mask")
    hits = whole.union(partly).groupBy("doc_id", "tk").agg(F.collect_list(F.struct("place", "off", "mask")).alias("hits"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(1))
            out: list[list] = [[], [], [], [], []]
            for r in range(len(batch)):
                text = data[offs[r] : offs[r + 1]]
                got = batch.column(2)[r].as_py()
                gone = np.zeros(len(text), bool)
                if got:
                    edge = np.zeros(len(text) + 1, np.int64)
                    for x in got:
                        s, wins = (x["place"] >> PLACE) + x["off"], x["place"] & WINS
                        if x["mask"] is None:
                            edge[s] += 1
                            edge[s + wins + length - 1] -= 1
                        else:
                            w = s + np.flatnonzero(np.unpackbits(np.frombuffer(x["mask"], np.uint8)))
                            np.add.at(edge, w, 1)
                            np.add.at(edge, w + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                jump = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
                for column, value in zip(out, (len(text), int(gone.sum()), len(jump) // 2, hashlib.sha256(text[~gone].tobytes()).hexdigest(), jump.reshape(-1, 2).tolist() if keep_text else []), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.list_(pa.int64())))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    done = src.join(hits, same(src, hits), "left").select(src["doc_id"], "t", "hits").mapInArrow(remove, schema)
    return done if keep_text else done.drop("spans")
