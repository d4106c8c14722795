"""Quality rules as a short-circuit cascade.

On a bounded sample every rule's cost (seconds a row) and selectivity (share it rejects) are
measured on the executors; the rules then run by rejection per cost, highest first, and a row that
one rule rejects is not shown to the next. The sample decides the order alone: the rows kept are
the same in any order, as a row is kept if and only if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, Words, buffers, mix, prepare, row_sums, slices, some_files, tidy, window_hash

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_U = np.uint64


class Texts:
    """A slice of texts whose measures are computed when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self._have = data, offsets, {}
        self.n = len(offsets) - 1

    def only(self, keep: np.ndarray) -> Texts:
        """The texts at ``keep``, with the measures at hand."""
        if len(keep) == self.n:
            return self
        size = np.diff(self.offsets)[keep]
        offsets = np.concatenate(([0], np.cumsum(size)))
        where = np.repeat(self.offsets[keep] - offsets[:-1], size) + np.arange(offsets[-1])
        out = Texts(self.data[where], offsets)
        out._have = {k: v[keep] for k, v in self._have.items() if isinstance(v, np.ndarray) and k.startswith("n_")}
        return out

    def get(self, name: str):
        if name not in self._have:
            self._have[name] = getattr(self, "_" + name)()
        return self._have[name]

    def _words(self) -> Words:
        return Words(self.data, self.offsets)

    def _hash(self) -> SpanHash:
        return SpanHash(self.data)

    def _n_words(self) -> np.ndarray:
        return self.get("words").counts

    def _n_word_chars(self) -> np.ndarray:
        return row_sums(((self.data & 0xC0) != 0x80) & ~self.get("words").space, self.offsets)

    def _n_symbols(self) -> np.ndarray:
        return row_sums(_SYMBOL[self.data], self.offsets)

    def _n_upper(self) -> np.ndarray:
        return row_sums((self.data >= 0x41) & (self.data <= 0x5A), self.offsets)

    def _n_lower(self) -> np.ndarray:
        return row_sums((self.data >= 0x61) & (self.data <= 0x7A), self.offsets)

    def _n_marks(self) -> np.ndarray:
        return row_sums(self.data == 0x21, self.offsets)

    def _n_lines(self) -> np.ndarray:
        """Lines with a word; also leaves how many of them equal an earlier one."""
        data, offs, w = self.data, self.offsets, self.get("words")
        cut = np.flatnonzero(data == 0x0A)
        start = np.union1d(offs[:-1], cut + 1)
        start = start[start < len(data)]
        end = np.append(start[1:], len(data))
        end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 0x0A))
        has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        start, end = start[has], end[has]
        row = np.searchsorted(offs[1:], start, side="right")
        key = mix(self.get("hash")(start, end) + row.astype(_U) * _U(0xA24BAED4963EE407))
        lines = np.bincount(row, minlength=self.n)
        _, first = np.unique(key, return_index=True)
        self._have["n_dup_lines"] = lines - np.bincount(row[first], minlength=self.n)
        return lines

    def _n_dup_lines(self) -> np.ndarray:
        self.get("n_lines")
        return self._have["n_dup_lines"]

    def _n_stutter(self) -> np.ndarray:
        """Words that equal the word before."""
        w = self.get("words")
        if len(w.start) < 2:
            return np.zeros(self.n, np.int64)
        h = self.get("hash")(w.start, w.end)
        return np.bincount(w.row[1:], weights=(h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1]), minlength=self.n).astype(np.int64)

    def _n_repeat_words(self) -> np.ndarray:
        size, w = 8, self.get("words")
        n = len(w.start)
        out = np.zeros(self.n, np.int64)
        if n < size:
            return out
        win = window_hash(self.get("hash")(w.start, w.end), size)
        row = w.row[: len(win)]
        at = np.flatnonzero(w.row[size - 1 :] == row)
        key = mix(win[at] + row[at].astype(_U) * _U(0xA24BAED4963EE407))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + size, -1)
        return np.bincount(w.row, weights=np.cumsum(edge)[:n] > 0, minlength=self.n).astype(np.int64)


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps a slice of texts to a mask of those to reject."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


BASE = (
    Rule("few_words", lambda t: t.get("n_words") < 20),
    Rule("repeated_words", lambda t: 100 * t.get("n_repeat_words") > 30 * t.get("n_words")),
)
#: Beyond the base: marks such as # or | on over a tenth of the words, text mostly in capitals,
#: an exclamation mark on over a fifth of the words, lines of which over half repeat earlier ones, over a fifth
#: of the words the same as the word before, words too short or long on average to be prose.
MORE = (
    Rule("symbols", lambda t: 10 * t.get("n_symbols") > t.get("n_words")),
    Rule("capitals", lambda t: t.get("n_upper") > t.get("n_lower")),
    Rule("exclaims", lambda t: 5 * t.get("n_marks") > t.get("n_words")),
    Rule("repeated_lines", lambda t: 2 * t.get("n_dup_lines") > t.get("n_lines")),
    Rule("stutter", lambda t: 5 * t.get("n_stutter") > t.get("n_words")),
    Rule("word_length", lambda t: (t.get("n_word_chars") < 2 * t.get("n_words")) | (t.get("n_word_chars") > 40 * t.get("n_words"))),
)
RULES = BASE + MORE


def survivors(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """The texts that no rule rejects, each rule seeing only what those before it left."""
    alive, left = np.arange(texts.n), texts
    for rule in rules:
        if not len(alive):
            break
        keep = np.flatnonzero(~rule.rejects(left))
        alive, left = alive[keep], left.only(keep)
    return alive


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = 2000, seed: int = 5) -> tuple[Rule, ...]:
    """The rules by rejection per cost on a sample of about ``sample_rows`` texts (the bound), from at most 64 files."""
    few = some_files(docs)
    total = few.count()
    if not total:
        return rules
    sample = few.select(F.col(text_col).alias("t")).sample(fraction=min(1.0, sample_rows / total), seed=seed)

    def measure(batches):
        cost, hit, rows = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            data, offs = buffers(batch.column(0))
            for i, j in slices(offs):
                rows += j - i
                for k, rule in enumerate(rules):
                    texts = Texts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    began = time.perf_counter()
                    hit[k] += int(rule.rejects(texts).sum())
                    cost[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(cost), pa.array(hit), pa.array([rows] * len(rules), pa.int64())], names=["k", "cost", "hit", "n"])

    told = sample.mapInArrow(measure, "k int, cost double, hit long, n long").groupBy("k").agg(F.sum("cost").alias("cost"), F.sum("hit").alias("hit")).collect()
    worth = {r["k"]: (-(r["hit"] / max(r["cost"], 1e-9)), r["cost"]) for r in told}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (worth.get(k, (0.0, 0.0)), k)))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", **sampling) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    A null text counts as empty. Rows are judged one by one, so repeated rows fare alike; columns of any
    name are kept. A text longer than a slice is a slice of its own, so memory follows the longest text.
    An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    ordered = order_rules(docs, rules, text_col, **sampling)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, offs = buffers(batch.column(at))
            kept = [i + survivors(Texts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), ordered) for i, j in slices(offs)]
            if kept:
                yield batch.take(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(tidy(run), docs.schema)


MEASURES = ("n_words", "n_word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, more: tuple[Rule, ...] = MORE, text_col: str = "text", id_col: str = "doc_id", **sampling) -> DataFrame:
    """Each row's base measures, whether it fails the base, and whether the cascade keeps it.

    The base measures are wanted of every row and come first; the cascade then sees the rows that
    pass the base. A null text has no words and fails. One row for each row of ``docs``.
    """
    prepare(docs.sparkSession)
    ordered = order_rules(docs, more, text_col, **sampling)

    def run(batches):
        for batch in batches:
            data, offs = buffers(batch.column(1))
            for i, j in slices(offs):
                texts = Texts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                got = [texts.get(m) for m in MEASURES]
                failed = BASE[0].rejects(texts) | BASE[1].rejects(texts)
                passed = np.flatnonzero(~failed)
                kept = np.zeros(j - i, bool)
                kept[passed[survivors(texts.only(passed), ordered)]] = True
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(x.astype(np.int64)) for x in got), pa.array(failed), pa.array(kept)],
                    names=["doc_id", "n_words", "word_chars", *MEASURES[2:], "base_failed", "kept"],
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidy(run), schema)
