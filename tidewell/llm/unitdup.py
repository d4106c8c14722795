"""Substring dedup by digests of lines, paragraphs and passages, with the original offsets retained.

Repeated passages mostly begin and end inside lines, so whole lines alone miss them. A text's words
are therefore also cut into passages at content-defined points: of every ``pick`` consecutive words
the one with the least key begins a passage of ``span`` words. The key depends on the word alone, so
two texts that share ``span + pick - 1`` consecutive words share a whole passage, at any offset.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, SLICE_BYTES, SpanHash, Words, buffers, mix, prepare, slices, tidy
from .repeats import later_occurrences

_U = np.uint64
_GAP = re.compile(rb"\n[\x20\x09-\x0d]*\n")
#: A word's key: sum of (byte + 1) * KEY_BASE ** place, modulo 2 ** 31.
KEY_BASE = 2654435761
_KEY_INVERSE = pow(KEY_BASE, -1, 1 << 64)
_TURN = (0xD1342543DE82EF95, 0xAEF17502108EF2D9)
KINDS = ("line", "paragraph", "passage")


@functools.cache
def _steps(base: int) -> np.ndarray:
    return _geometric(base, SLICE_BYTES, None)


def _geometric(base: int, n: int, known=_steps) -> np.ndarray:
    """The powers 0 to ``n`` of ``base``, modulo 2 ** 64."""
    if known and n <= SLICE_BYTES:
        return known(base)[: n + 1]
    steps = np.full(n + 1, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Lowered:
    """The words of a slice, their place in the original, and hashes of their lower-cased letters."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, low: np.ndarray, low_offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.words = Words(data, offsets)
        same = len(data) == len(low) and np.array_equal(IS_SPACE[data], IS_SPACE[low])
        at = self.words if same else Words(low, low_offsets)  # the same words in the same order, whatever the lengths
        self.low, self.start, self.end = low, at.start, at.end
        self.hash = SpanHash(low)(at.start, at.end)
        self.chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))

    def keys(self) -> np.ndarray:
        n = len(self.low)
        up, down = _geometric(KEY_BASE, n), _geometric(_KEY_INVERSE, n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.low.astype(np.uint64) + _U(1)) * up[:n])))
        return ((sums[self.end] - sums[self.start]) * down[self.start]) & _U((1 << 31) - 1)

    def digests(self, first: np.ndarray, last: np.ndarray, salt: int) -> list[np.ndarray]:
        """128 bits of the word sequences [first, last), as two signed numbers."""
        out, n = [], len(self.hash)
        for k, base in enumerate(_TURN):
            up, down = _geometric(base, n), _geometric(pow(base, -1, 1 << 64), n)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.hash + _U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * up[:n])))
            out.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) + _U(salt << 40)).view(np.int64))
        return out


def _lines(x: Lowered, kind: str) -> tuple[np.ndarray, ...]:
    """First and last byte, row and number of each line or paragraph."""
    offs, rows = x.offsets, len(x.offsets) - 1
    if kind == "line":
        cut = np.flatnonzero(x.data == 0x0A)
        ends, nexts = cut, cut + 1
    else:
        found = [(offs[r] + m.start(), offs[r] + m.end()) for r in range(rows) for m in _GAP.finditer(x.data[offs[r] : offs[r + 1]].tobytes())]
        ends, nexts = np.array(found, np.int64).reshape(-1, 2).T
    row = np.searchsorted(offs[1:], ends, side="right")
    start = np.concatenate((offs[:-1], nexts))
    of = np.concatenate((np.arange(rows), row))
    order = np.lexsort((start, np.concatenate((np.zeros(rows), np.ones(len(row)))), of))
    start, of = start[order], of[order]
    end = np.concatenate((ends, offs[1:]))[np.lexsort((np.concatenate((ends, offs[1:])), np.concatenate((np.zeros(len(row)), np.ones(rows))), np.concatenate((row, np.arange(rows)))))]
    number = np.arange(len(of)) - np.searchsorted(of, of)
    return start, end, of, number


def passages(keys: np.ndarray, bounds: np.ndarray, span: int, pick: int) -> np.ndarray:
    """The words that begin passages: the last of the least keys of each ``pick`` places that have
    ``span`` words ahead in their text (of all such places, where there are fewer)."""
    places = np.maximum(0, np.diff(bounds) - span + 1)
    if not places.any():
        return np.zeros(0, np.int64)
    n = len(keys)
    ranked = keys << _U(32) | (_U(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    low, size = ranked, 1
    while 2 * size <= pick and len(low) > size:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if size < pick and len(low) > pick - size:
        low = np.minimum(low[: len(low) - (pick - size)], low[pick - size :])
    rows, few = np.flatnonzero(places >= pick), np.flatnonzero((places > 0) & (places < pick))
    c = places[rows] - pick + 1
    before = np.concatenate(([0], np.cumsum(c)))
    s = np.repeat(bounds[:-1][rows] - before[:-1], c) + np.arange(before[-1])
    least = [low[s]] if len(s) else []
    least += [ranked[bounds[r] : bounds[r] + places[r]].min(keepdims=True) for r in few]
    return np.unique((_U(0xFFFFFFFF) - (np.concatenate(least) & _U(0xFFFFFFFF))).astype(np.int64))


def _units(kinds: tuple[str, ...], min_words: int, span: int, pick: int):
    names = ["id", "h", "kind", "unit", "start", "length", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(2))
            low, low_offs = buffers(pc.utf8_lower(batch.column(2)))
            for i, j in slices(offs):
                x = Lowered(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], low[low_offs[i] : low_offs[j]], low_offs[i : j + 1] - low_offs[i])
                w = x.words
                for kind in kinds:
                    if kind == "passage":
                        first = passages(x.keys(), w.bounds, span, pick)
                        last, row = first + span, w.row[first]
                        number = first - w.bounds[row]
                        start, end = w.start[first], w.end[last - 1]
                    else:
                        start, end, row, number = _lines(x, kind)
                        first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
                        keep = last - first >= max(1, min_words)
                        start, end, row, number, first, last = (v[keep] for v in (start, end, row, number, first, last))
                    a, b = x.digests(first, last, 1 + (kind == "passage"))
                    at, rows = x.chars[start], pa.array(row + i)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(row), KINDS.index(kind), np.int32)), *(pa.array(v.astype(np.int64)) for v in (number, at - x.chars[x.offsets[row]], x.chars[end] - at, a, b))],
                        names=names,
                    )

    return run


def repeated_units(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rank_col: str | None = None, unit: str | tuple[str, ...] = "line", min_words: int = 1, span: int = 25, pick: int = 20,
) -> DataFrame:
    """One row for each unit to remove: id, kind, unit number, start and length in code points, and
    the id and unit of the occurrence that stays.

    Units are lines, paragraphs (cut at blank lines), or passages of ``span`` words (numbered by their
    first word); several kinds may be asked for at once, and are compared each among its own. They
    are compared by 128-bit digests of their lower-cased words, so white space between words doesn't
    count. Of equal units the one least in (``rank_col``, id, unit) stays; ``rank_col`` defaults to
    the id (both whole numbers), nulls first. A passage that overlaps its own first occurrence is no
    repeat. Lines and paragraphs of fewer than ``min_words`` words,
    empty ones and null texts are left alone. Rows that share id and text are one document. Other
    columns are not looked at. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    kinds = (unit,) if isinstance(unit, str) else tuple(unit)
    rank = F.col(rank_col or id_col).cast("long")
    src = docs.select(F.struct(rank.alias("r"), F.col(id_col).cast("long").alias("i")).alias("k"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    if rank_col:
        keys = src.select(F.col("k.i").alias("id"), "h", F.col("k.r").alias("rank")).groupBy("id", "h").agg(F.min("rank").alias("rank"))
    units = src.select("k.i", "h", "t").mapInArrow(tidy(_units(kinds, min_words, span, pick)), "id long, h long, kind int, unit long, start long, length long, a long, b long")
    units = units.join(keys, ["id", "h"]) if rank_col else units.withColumn("rank", F.col("id"))
    later = later_occurrences(units, ["a", "b"], ["rank", "id", "h", "unit"])
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")) & (F.col("unit") - F.col("first.unit") < span)
    later = later.where(~(own & (F.col("kind") == KINDS.index("passage"))))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return later.select(
        F.col("id").alias(id_col), F.col("h").alias("text_key"), name.alias("kind"), "unit", "start", "length", F.col("first.id").alias(f"kept_{id_col}"), F.col("first.unit").alias("kept_unit")
    )


def remove_units(docs: DataFrame, units: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the text of ``units`` (of :func:`repeated_units`) cut out, and their original
    (start, length) pairs as ``removed_spans``, merged where they overlap or touch; white space and
    line ends around a cut stay as they are. A row without units keeps its text; a null id and null
    text are rows like others; a column named ``removed_spans`` is replaced."""
    spans = units.groupBy(id_col, "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("__s"))
    merged = F.expr(
        "aggregate(__s, cast(array() as array<struct<start:bigint,length:bigint>>), (m, x) -> if(size(m) > 0 and m[size(m) - 1].start + m[size(m) - 1].length >= x.start, "
        "concat(slice(m, 1, size(m) - 1), array(named_struct('start', m[size(m) - 1].start, 'length', greatest(m[size(m) - 1].start + m[size(m) - 1].length, x.start + x.length) - m[size(m) - 1].start))), "
        "concat(m, array(named_struct('start', x.start, 'length', x.length)))))"
    )
    spans = spans.select(F.col(id_col).alias("__i"), F.col("text_key").alias("__t"), merged.alias("__s"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__r"), F.col(id_col).cast("long").alias("__k"), F.xxhash64(text_col).alias("__h"))
    both = rows.join(spans, F.col("__k").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__t")), "left")
    text = f"__r.{text_col}"
    kept = F.expr(
        f"array_join(transform(sequence(0, size(__s)), k -> substring({text}, cast(if(k = 0, 0, __s[k - 1].start + __s[k - 1].length) + 1 as int), "
        f"cast(if(k = size(__s), length({text}), __s[k].start) - if(k = 0, 0, __s[k - 1].start + __s[k - 1].length) as int))), '')"
    )
    new = F.when(F.col("__s").isNull(), F.col(text)).otherwise(kept)
    columns = [new.alias(c) if c == text_col else F.col(f"__r.`{c}`") for c in docs.columns if c != "removed_spans"]
    return both.select(*columns, F.coalesce("__s", F.array().cast("array<struct<start:bigint,length:bigint>>")).alias("removed_spans"))
