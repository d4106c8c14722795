"""Byte-level BPE over whole batches of texts at once.

The words of a slice are cut into pieces as the pre-tokenizer would, by character classes; equal
pieces are found once, and the pieces that differ are merged side by side: in each round every
piece merges the pair of least rank that it has. That is the tokenizer's own order, as a merge
always ranks after those that make its two parts (checked when the merges are read).
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

from .common import LOWER, SpanHash, Words

#: The pre-tokenizer whose pieces are known here: contractions, runs of letters, single digits, runs of other marks.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of more bytes go through the tokenizer; so do so many of the others at most, by table, before it is begun anew.
LONGEST, TABLE = 200, 100_000
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_NONE = np.int32(1 << 30)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 18


def _parts(component, key: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer."""
    state = json.loads(component.__getstate__()) if component else {"type": "none"}
    return state[key] if state["type"] == "Sequence" else [state]


def known_shape(tokenizer) -> bool:
    """Whether characters are normalised one by one (but for composition), white space is dropped and
    pieces are those of SPLIT, so that text is never joined across white space."""
    normal, pre = _parts(tokenizer.normalizer, "normalizers"), _parts(tokenizer.pre_tokenizer, "pretokenizers")
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in normal)
    if not plain or [n["type"] for n in normal].count("Lowercase") != 1 or [p["type"] for p in pre] != ["Split", "ByteLevel"] or tokenizer.post_processor is not None:
        return False
    return pre[0]["pattern"] == {"Regex": SPLIT} and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]


class BatchEncoder:
    """The token ids of texts, by a tokenizer file of the ``tokenizers`` library.

    A tokenizer of another shape, or with merges out of order, encodes whole texts one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table: dict[bytes, bytes] = {}
        self.fast = known_shape(self.tokenizer) and self._read(path)

    def _read(self, path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("byte_fallback"):
            return False
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        if any(char[b] not in vocab or char[b] + suffix not in vocab for b in range(256)):
            return False
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[char[b] + suffix] for b in range(256)], np.int32)
        a, b, made = (np.array(x, np.int64) for x in zip(*((vocab[x], vocab[y], vocab[x + y]) for x, y in merges), strict=True))
        born = np.full(max(vocab.values()) + 1, -1)
        born[made[::-1]] = np.arange(len(made))[::-1]  # the first merge that makes a token
        if len(np.unique(a << 32 | b)) < len(a) or (np.maximum(born[a], born[b]) >= np.arange(len(a))).any():
            return False
        self.made = made.astype(np.int32)
        self.keys, self.ranks = np.full(1 << _SLOTS, -1, np.int64), np.full(1 << _SLOTS, _NONE, np.int32)
        todo, slot = np.arange(len(a)), self._slot(a << 32 | b)
        while len(todo):  # each free slot takes the first that wants it; the others go to the next
            slot &= (1 << _SLOTS) - 1
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = first & (self.keys[slot] < 0)
            self.keys[slot[put]], self.ranks[slot[put]] = (a << 32 | b)[todo[put]], todo[put]
            todo, slot = todo[~put], slot[~put] + 1
        specials = [re.escape(t["content"].encode()) for t in told.get("added_tokens", [])]
        self.special = re.compile(b"|".join(specials)) if specials else None
        # classes of the ASCII bytes and of two-byte letters, and the lower case of these, as the tokenizer has them
        self.kind = np.full(0x250, _OTHER, np.uint8)
        self.low = np.arange(0x250, dtype=np.uint16)
        for c in range(0x21, 0x250):
            x = chr(c)
            low, cuts = self.tokenizer.normalizer.normalize_str(f"b{x}b"), [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"b{x.lower()}b")]
            if c < 0x7F:
                self.kind[c] = _LETTER if x.isalpha() else _DIGIT if x.isdigit() else _MARK
            elif x.isalpha() and low == f"b{x.lower()}b" and len(low) == 3 and len(low.encode()) == 4 and len(cuts) == 1:
                self.kind[c], self.low[c] = _LETTER, ord(low[1])
        return True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        have = self.keys[slot]
        out = np.where(have == key, self.ranks[slot], _NONE)
        on = np.flatnonzero((have != key) & (have >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << _SLOTS) - 1)
            have = self.keys[slot[on]]
            hit = have == key[on]
            out[on[hit]] = self.ranks[slot[on[hit]]]
            on = on[~hit & (have >= 0)]
        return out

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces [start, end) of ``data``, one after another, and the number of each."""
        size = end - start
        upto = np.cumsum(size)
        sym = self.inner[data[np.arange(upto[-1] if len(size) else 0) + np.repeat(start - upto + size, size)]]
        sym[upto - 1] = self.last[data[end - 1]]
        piece = np.repeat(np.arange(len(size)), size)
        done_sym, done_piece = [], []
        while len(sym):
            inside = piece[1:] == piece[:-1]
            rank = np.full(len(sym), _NONE, np.int32)
            at = np.flatnonzero(inside)
            rank[at] = self._rank(sym[at], sym[at + 1])
            head = np.concatenate(([0], np.flatnonzero(~inside) + 1))
            width = np.diff(np.append(head, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, head), width)
            ready = least == _NONE
            if ready.any():
                done_sym.append(sym[ready])
                done_piece.append(piece[ready])
                sym, piece, rank, least = sym[~ready], piece[~ready], rank[~ready], least[~ready]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            if len(hit) > 1 and (np.diff(hit) == 1).any():  # overlapping pairs of one symbol: every other one, from the left
                begin = np.concatenate(([True], np.diff(hit) != 1))
                run = hit[np.maximum.accumulate(np.where(begin, np.arange(len(hit)), 0))]
                hit = hit[(hit - run) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, piece = sym[keep], piece[keep]
        if not done_sym:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        sym, piece = np.concatenate(done_sym), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(piece, minlength=len(size))

    def one(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes, by the tokenizer itself."""
        if text not in self.table:
            if len(self.table) >= TABLE:
                self.table.clear()
            ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
            self.table[text] = struct.pack(f"<{len(ids)}I", *ids)
        return self.table[text]

    def _pieces(self, data: np.ndarray, w: Words) -> tuple[np.ndarray, ...]:
        """The bytes to look at, and start, end, word and whether it is a plain piece, of each piece."""
        n = len(data)
        kind = np.full(n, _OTHER, np.uint8)
        ascii_ = data < 0x80
        kind[ascii_] = self.kind[data[ascii_]]
        low = LOWER[data]
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
        code = (data[lead] & 0x1F).astype(np.int64) << 6 | (data[np.minimum(lead + 1, n - 1)] & 0x3F)
        known = code < 0x250
        lead, code = lead[known], code[known]
        letter = self.kind[code] == _LETTER
        lead, code = lead[letter], self.low[code[letter]]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead], low[lead + 1] = 0xC0 | code >> 6, 0x80 | code & 0x3F
        kind[w.space] = _SPACE
        odd = (kind == _OTHER) | (data == 0x27)
        for m in self.special.finditer(data.tobytes()) if self.special else ():
            odd[m.start() : m.end()] = True
        odd = np.concatenate(([0], np.cumsum(odd)))
        apart = (odd[w.end] > odd[w.start]) | (w.end - w.start > LONGEST)
        edge = np.ones(n, bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        edge &= ~w.space
        for a, b in zip(w.start[apart].tolist(), w.end[apart].tolist(), strict=True):
            edge[a:b] = False
            low[a:b] = data[a:b]
        edge[w.start] = True
        start = np.flatnonzero(edge)
        word = np.searchsorted(w.start, start, side="right") - 1
        end = np.minimum(w.end[word], np.append(start[1:], n))
        return low, start, end, word, ~apart[word]

    def texts(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, each with ``end_id`` after it, and the texts' bounds in them."""
        rows, found = len(offsets) - 1, None
        if self.fast:
            w = Words(data, offsets)
            low, start, end, word, plain = self._pieces(data, w)
            found = _equal(low, start, end)
        if found is None:  # nothing known of the tokenizer's parts, or hashes that mislead
            raw, last = data.tobytes(), struct.pack("<I", end_id)
            each = [self.one(raw[a:b]) + last for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.frombuffer(b"".join(each), "<u4"), np.concatenate(([0], np.cumsum([len(x) // 4 for x in each], dtype=np.int64)))
        u, heads = found
        fast = plain[heads]
        ids, n = self.merge(low, start[heads[fast]], end[heads[fast]])
        slow = [self.one(low[a:b].tobytes()) for a, b in zip(start[heads[~fast]].tolist(), end[heads[~fast]].tolist(), strict=True)]
        pool = np.concatenate((ids, np.frombuffer(b"".join(slow), "<u4"), np.array([end_id], np.uint32)))
        size = np.empty(len(heads) + 1, np.int64)
        size[:-1][fast], size[:-1][~fast], size[-1] = n, [len(x) // 4 for x in slow], 1
        first = np.empty(len(heads) + 1, np.int64)
        first[:-1][fast] = np.cumsum(n) - n
        first[:-1][~fast] = len(ids) + np.cumsum(size[:-1][~fast]) - size[:-1][~fast]
        first[-1] = len(pool) - 1
        row = w.row[word]
        upon = np.searchsorted(row, np.arange(rows), side="right") + np.arange(rows)  # the end marks' places
        order = np.full(len(u) + rows, len(heads))
        order[np.arange(len(u)) + row] = u
        n = size[order]
        upto = np.cumsum(n)
        return pool[np.repeat(first[order] - upto + n, n) + np.arange(upto[-1] if rows else 0)], np.concatenate(([0], upto[upon]))


def _equal(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """For each span the number of its group of equal ones, and a span of each group; None where hashes mislead."""
    h = SpanHash(data)(start, end)
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    u = np.empty(len(h), np.int64)
    u[order] = np.cumsum(new) - 1
    heads = order[new]
    size, head = end - start, start[heads[u]]
    if not np.array_equal(size, (end - start)[heads[u]]):
        return None
    step = 100_000
    for k in range(0, len(h), step):
        n = size[k : k + step]
        upto = np.cumsum(n)
        at = np.arange(upto[-1]) + np.repeat(start[k : k + step] - upto + n, n)
        if not np.array_equal(data[at], data[at + np.repeat(head[k : k + step] - start[k : k + step], n)]):
            return None
    return u, heads
