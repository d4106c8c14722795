"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenisations of the same bytes are read side by side. The state is the side that leads and
the bytes of it that the other side has not matched; the next token is always the lagging side's. A token eats
into the residual, or matches it and dangles beyond, and then leads. Transitions are memoised by residual and
token. On an empty residual both sides end at the same byte, and the group of tokens since the last such place is
closed. The residual is always part of one token, so there are few states.

Both tokenizers cut a text before a single space between two characters that are no white space, whatever stands
around it; ``Tokenizers`` proves that from its vocabularies and takes whole texts where it does not
hold. The stretches between such places are tokenised and aligned once each and memoised.

Documents are put together in blocks. A block holds the dictionary of its linked id pairs, and each document's pairs as
places in it. So corpus-wide counts need one row a block and distinct pair, and a block gets back one row for each:
no table of all pairs is sent to every task, and no row for each document's pairs is shuffled.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, tidy

_CUT = re.compile(r"(?<=\S) (?=\S)")
_METRICS = ("n_a", "n_b", "n_groups", "n_links")
#: Work is done in runs of texts of so many characters, or one longer text.
_RUN = 1 << 20


class Transducer:
    """Groups of tokens with equal bytes; states and transitions are found once and kept."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes], limit: int = 1 << 20):
        self.tokens, self.limit = (a_bytes, b_bytes), limit
        self._clear()

    def _clear(self) -> None:
        self.known, self.states = 0, {(0, b""): 0}
        self.residual: list[tuple[int, bytes]] = [(0, b"")]
        #: The lagging side of each state (with nothing dangling the first side goes on), and the state after each token of it.
        self.lagging: list[int] = [0]
        self.next: list[dict[int, int]] = [{}]

    def _step(self, state: int, token: int) -> int:
        """The state after the lagging side's next token, or -1 if its bytes differ from the residual's."""
        lead, rest = self.residual[state]
        side = self.lagging[state]
        own = self.tokens[side][token]
        short = min(len(own), len(rest))
        if own[:short] != rest[:short]:
            to = -1
        else:
            key = (lead, rest[short:]) if len(rest) > short else (side, own[short:])
            key = key if key[1] else (0, b"")
            if key not in self.states:
                self.states[key] = len(self.residual)
                self.residual.append(key)
                self.lagging.append(1 - key[0])
                self.next.append({})
            to = self.states[key]
        self.next[state][token] = to
        self.known += 1
        return to

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """Where the groups end in ``a`` and in ``b``; None if their bytes differ."""
        if self.known > self.limit:
            self._clear()
        ends_a, ends_b, lagging, known, state = [], [], self.lagging, self.next, 0
        left, right, n, i, j = [*a, -1], [*b, -1], len(a), 0, 0  # a side that is used up yields -1
        put_a, put_b = ends_a.append, ends_b.append
        while i < n or state:
            if lagging[state]:
                token = right[j]
                j += 1
            else:
                token = left[i]
                i += 1
            if token < 0:
                return None
            to = known[state].get(token)
            state = self._step(state, token) if to is None else to
            if not state:
                put_a(i)
                put_b(j)
            elif state < 0:
                return None
        return (ends_a, ends_b) if j == len(b) else None


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """The byte-level tokenizer of a JSON file, and the pieces of a sentence-piece model."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back, size = _byte_of(), self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in (self.a.id_to_token(k) or "" for k in range(size))]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        spec = self.a.pre_tokenizer.__getstate__() if self.a.pre_tokenizer else b""
        #: No piece goes on over a space, and the byte-level pattern starts a token at a space before anything else.
        self.cuts = b'"ByteLevel"' in spec and b'"use_regex":true' in spec and self.a.normalizer is None and not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of each text by both, where the joined bytes are those of a space and the text; else two empty lists."""
        out = []
        for text, x, b in zip(texts, self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1), strict=True):
            a, raw = x.ids, b" " + text.encode()
            same = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
            out.append((a, b) if same else ([], []))
        return out


def _plain(stretch: str) -> bool:
    """Whether the stretch can stand between others: it neither begins nor ends with white space."""
    return bool(stretch) and not stretch[0].isspace() and not stretch[-1].isspace()


class Aligner:
    """Aligned stretches of text, kept until they hold ``limit`` characters."""

    def __init__(self, names: Tokenizers, limit: int = 24 << 20):
        self.names, self.limit, self.width = names, limit, len(names.b_bytes)
        self.transducer = Transducer(names.a_bytes, names.b_bytes)
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (names.a_bytes, names.b_bytes))
        n = len(names.a_bytes)
        #: A token with what follows it: an id of the first side, the last one in a group, an id of the second, the last one.
        self.shown = [f"{k}{mark}" for size, marks in ((n, ",|"), (self.width, ",;")) for mark in marks for k in range(size)]
        self.shift = np.array([0, n, 2 * n, 2 * n + self.width])
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.chars, self.text = 0, []
        self.table = np.zeros((0, 5), np.int64)  # the metrics, and whether the bytes are the stretch's
        self.first, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _linked(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, pair, times) of the groups' links, by owner and pair. Of a large group unlike pairs are made alone."""
        begin_a, begin_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
        n, m = ends_a - begin_a, ends_b - begin_b
        large = np.flatnonzero(n * m > 4096)
        small = np.where(n * m > 4096, 0, n * m)
        g = np.repeat(np.arange(len(n)), small)
        at = np.arange(len(g)) - np.repeat(np.cumsum(small) - small, small)
        who = [owner[g]]
        pair = [a[begin_a[g] + at // m[g]].astype(np.uint64) * np.uint64(self.width) + b[begin_b[g] + at % m[g]].astype(np.uint64)]
        times = [np.ones(len(g), np.int64)]
        for k in large:
            (x, xn), (y, yn) = (np.unique(s[i:j], return_counts=True) for s, i, j in ((a, begin_a[k], ends_a[k]), (b, begin_b[k], ends_b[k])))
            pair.append((x.astype(np.uint64)[:, None] * np.uint64(self.width) + y.astype(np.uint64)).ravel())
            times.append((xn[:, None] * yn).ravel())
            who.append(np.full(len(pair[-1]), owner[k]))
        who, pair, times = np.concatenate(who), np.concatenate(pair), np.concatenate(times)
        order = np.lexsort((pair, who))
        who, pair, times = who[order], pair[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (pair[1:] != pair[:-1])))) if len(who) else np.zeros(0, np.int64)
        return who[first], pair[first], np.add.reduceat(times, first) if len(first) else times

    def align(self, encoded: list[tuple[list[int], list[int]]], sizes: np.ndarray):
        """Metrics, shown groups, and (owner, pair, times) of stretches of so many bytes, given the token streams that cover them in turn."""
        a, b = [t for x, _ in encoded for t in x], [t for _, y in encoded for t in y]
        found = self.transducer.groups(a, b)
        assert found is not None, "streams of equal bytes"
        a, b, ends_a, ends_b = (np.array(x, np.int64) for x in (a, b, *found))
        # all stretches end where groups end
        upto_a, upto_b = np.searchsorted(np.cumsum(self.a_size[a]), np.cumsum(sizes)) + 1, np.searchsorted(np.cumsum(self.b_size[b]), np.cumsum(sizes)) + 1
        upto = np.searchsorted(ends_a, upto_a) + 1
        n_groups = np.diff(upto, prepend=0)
        owner = np.repeat(np.arange(len(sizes)), n_groups)
        links = np.diff(ends_a, prepend=0) * np.diff(ends_b, prepend=0)
        rows = np.stack((np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0), n_groups, np.bincount(owner, weights=links, minlength=len(sizes)).astype(np.int64), np.ones(len(sizes), np.int64)), axis=1)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[ends_a - 1], last_b[ends_b - 1] = 1, 1
        codes = np.empty(len(a) + len(b), np.int64)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        codes[np.arange(len(a)) + np.concatenate(([0], ends_b))[group_a]] = a + self.shift[last_a]
        codes[np.arange(len(b)) + ends_a[group_b]] = b + self.shift[2 + last_b]
        tokens, bounds = [self.shown[c] for c in codes.tolist()], np.concatenate(([0], upto_a + upto_b)).tolist()
        return rows, ["".join(tokens[i:j])[:-1] for i, j in zip(bounds[:-1], bounds[1:], strict=True)], self._linked(a, b, ends_a, ends_b, owner)

    def learn(self, stretches: list[str]) -> None:
        """Stretches that can stand between others are tokenised together, as one text of them all."""
        runs, size = [[]], 0
        for s in stretches:
            if not _plain(s) or not self.names.cuts:
                runs.insert(0, [s])
                continue
            runs[-1].append(s)
            size += len(s)
            if size > 8192:
                runs.append([])
                size = 0
        runs = [r for r in runs if r]
        encoded = self.names.encode([" ".join(r) for r in runs])
        for k, (run, ids) in enumerate(zip(runs, encoded, strict=True)):
            if len(run) > 1 and not ids[0]:  # one of them does not come back as it was: each by itself
                runs[k], encoded[k] = [], ([], [])
                runs += [[s] for s in run]
                encoded += self.names.encode(run)
        good = [k for k, ids in enumerate(encoded) if ids[0]]
        for s in (s for k, run in enumerate(runs) if run and not encoded[k][0] for s in run):
            self._keep([s], np.zeros((1, 5), np.int64), [""], (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        if good:
            known = [s for k in good for s in runs[k]]
            sizes = np.array([1 + (len(s) if s.isascii() else len(s.encode())) for s in known], np.int64)
            self._keep(known, *self.align([encoded[k] for k in good], sizes))

    def _keep(self, stretches: list[str], rows: np.ndarray, shown: list[str], linked: tuple) -> None:
        self.place.update(zip(stretches, range(len(self.text), len(self.text) + len(stretches)), strict=True))
        self.text += shown
        self.chars += sum(map(len, stretches)) + sum(map(len, shown))
        owner, pairs, times = linked
        self.table = np.concatenate((self.table, rows))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(np.bincount(owner, minlength=len(stretches)))))
        self.pairs, self.times = np.concatenate((self.pairs, pairs)), np.concatenate((self.times, times))

    def _whole(self, text: str) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        """A text some stretch of which does not come back as it was: its joined streams decide."""
        ids = self.names.encode([text])[0]
        if not ids[0]:
            return np.zeros(4, np.int64), "", np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rows, shown, (_, pairs, times) = self.align([ids], np.array([1 + len(text.encode())]))
        return rows[0, :4], shown[0], pairs, times

    def texts(self, texts: list[str]):
        """(metrics, hash of the groups, distinct pairs, their links) of each text."""
        split = [_CUT.split(t) if self.names.cuts else [t] for t in texts]
        if self.chars > self.limit:
            self._clear()
        fresh = list({s: 0 for t in split for s in t if s and s not in self.place})
        for k in range(0, len(fresh), 50000):
            self.learn(fresh[k : k + 50000])
        for text, stretches in zip(texts, split, strict=True):
            at = np.fromiter(map(self.place.__getitem__, stretches), np.int64, len(stretches)) if text else np.zeros(0, np.int64)
            if len(at) and not self.table[at, 4].all():
                row, shown, pairs, times = self._whole(text)
            else:
                row, shown = self.table[at, :4].sum(axis=0), ";".join(map(self.text.__getitem__, at.tolist()))
                used, often = np.unique(at, return_counts=True)
                sizes = self.first[used + 1] - self.first[used]
                where = np.repeat(self.first[used] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                pairs, inverse = np.unique(self.pairs[where], return_inverse=True)
                times = np.zeros(len(pairs), np.int64)
                np.add.at(times, inverse, self.times[where] * np.repeat(often, sizes))
            yield row, hashlib.sha256(shown.encode()).hexdigest() if shown else "", pairs, times


_BLOCK = "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, pairs array<long>, n_docs array<long>, sizes array<long>, n_places long, places binary, times binary"


def _squeeze(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _spread(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _packed(block: int, docs: list) -> pa.RecordBatch:
    """One row for a block. A document's places in the block's dictionary are written as steps, which are small."""
    ids, rows, hashes, pairs, times = zip(*docs, strict=True)
    sizes = np.array([len(p) for p in pairs], np.int64)
    known, places, n_docs = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
    steps = np.diff(places.astype(np.uint32), prepend=np.uint32(0))  # wraps around where a document begins
    one = [block, list(ids), *[[int(r[k]) for r in rows] for k in range(4)], list(hashes), known.astype(np.int64), n_docs.astype(np.int64), sizes, len(places), _squeeze(steps), _squeeze(np.concatenate(times))]
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.binary(), pa.binary()]
    names = [c.split(" ")[0] for c in _BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds, strict=True)], names=names)


def _blocks(a_path: str, b_path: str, chars: int):
    def run(batches):
        aligner, held, size, n = Aligner(Tokenizers(a_path, b_path)), [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            while at < len(ids):
                upto = at + max(1, int(np.searchsorted(np.cumsum(length[at:]), _RUN, side="right")))
                part = [t or "" for t in texts.slice(at, upto - at).to_pylist()]
                for i, found in zip(ids[at:upto], aligner.texts(part), strict=True):
                    held.append((i, *found))
                size += sum(map(len, part))
                at = upto
                if size >= chars:
                    yield _packed(n, held)
                    held, size, n = [], 0, n + 1
        if held:
            yield _packed(n, held)

    return run


def _scores(key: tuple, blocks: pa.Table, found: pa.Table) -> pa.Table:
    """Links whose pair is best for its first id, and the sum of counts, of each document of a block."""
    r = blocks.to_pylist()[0]
    n = r["n_places"]
    sizes = np.array(r["sizes"], np.int64)
    order = np.argsort(found["pair"].to_numpy())
    count, best = found["n"].to_numpy()[order], found["best"].to_numpy(zero_copy_only=False)[order]
    places = np.cumsum(_spread(r["places"], "<u4", n), dtype=np.uint32).astype(np.int64)
    times = _spread(r["times"], "<i8", n)
    ends = np.cumsum(sizes)
    total = lambda x: (s := np.concatenate(([0], np.cumsum(x))))[ends] - s[ends - sizes]
    by = [r["ids"], *[r[c] for c in _METRICS], total(times * best[places]), total(times * count[places]), r["sha"]]
    kinds = [pa.int64()] * 7 + [pa.string()]
    return pa.table([pa.array(x, k) for x, k in zip(by, kinds, strict=True)], names=["doc_id", *_METRICS, "n_best", "count_sum", "groups_sha256"])


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 16 << 20) -> DataFrame:
    """The token groups of each text under two tokenizers, and how usual its linked id pairs are in all of ``df``.

    Returns id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as any pair of its first
    id), count_sum (documents that hold the pair, over links), groups_sha256. A text that is null or empty, or
    whose tokens don't give back a space and the text, has no tokens: zeros and ''. Every row counts as a document,
    repeated rows and null ids too. Texts of any length are taken whole; one over ``block_chars`` is
    a block of its own. An empty table gives an empty result; other columns are not looked at.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = cut(rows.mapInArrow(tidy(_blocks(a_path, b_path, block_chars)), _BLOCK))
    width = len(Tokenizers(a_path, b_path).b_bytes)
    held = blocks.select(F.col("block").alias("of"), F.explode(F.arrays_zip("pairs", "n_docs")).alias("x")).select("of", F.col("x.pairs").alias("pair"), F.col("x.n_docs").alias("n"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("first", F.floor(F.col("pair") / F.lit(width)).cast("int"))
    most = counts.groupBy(F.col("first").alias("f")).agg(F.max("n").alias("most"))
    judged = counts.join(most, F.col("first") == F.col("f")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = held.select("of", "pair").join(judged, "pair").select("of", "pair", "n", "best")
    slim = blocks.drop("pairs", "n_docs")
    out = slim.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_scores, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)
