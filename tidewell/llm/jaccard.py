"""Near duplicates by an exact Jaccard join of word shingles: universe partition and pigeonhole.

Sets are banded by size so that sets that can link lie in one band or in neighbours. A band's
scheme hashes the universe of shingles into m segments, m a little over the largest symmetric
difference H that linked sets of the band can have. If two sets differ by at most H, and one of
them has more than H segments that aren't empty, they agree on one of those: so it is enough to
index a hash of each segment's subset. Where a set falls short of that it is allocated more, the
cheapest that suffices: the one-deletion neighbourhoods of its larger segments as well (a segment
of two shingles or more then counts twice), or, failing that, its single shingles. Where it has more
than it needs, it does without the dearest it can spare: what a signature costs is how many sets
share it, as far as a sample tells, and the order is the same for all sets (then by hash). The
cheapest segment that two linked sets agree on has at most H others before it in either set, so
both keep it, whatever the sample said. Sets that meet under a signature are candidates, and are
verified on their whole texts. Of rows with equal sets only one is signed.

A group of sets that meet is first linked to its least member. Only where such a pair fails are
the group's other pairs looked at, nearest first, and of those only the ones between components
that are still apart and that sizes and parity sketches (their Hamming distance is never above the
symmetric difference) can't rule out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SpanHash, Words, buffers, clean, give_back, mix, prepare, slices, tidy, window_hash
from .graph import components

_U = np.uint64
SKETCH_BITS = 1024
#: Signatures a map task gathers before it writes them out by bucket, and that a bucket holds.
FLUSH, PER_BUCKET = 1_500_000, 3_000_000
#: Up to so many (id, hash) pairs, 12 MB, of the texts to verify are broadcast.
BROADCAST_ROWS = 500_000
#: Signatures' costs are taken from this share of the sets, and so many of the dearest signatures are told to the tasks.
COST_SHARE, DEAREST = 1 / 8, 20_000
#: Members of one group that travel in one row.
CHUNK = 4096
PAIR = ("a", "b", "da", "ta", "db", "tb")


def sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, in order, and the row bounds."""
    data = LOWER[data]
    w = Words(data, offsets)
    h = SpanHash(data)(w.start, w.end)
    win = window_hash(h, size)
    out, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for r in np.flatnonzero(w.counts).tolist():
        a, b = w.bounds[r], w.bounds[r + 1]
        if b - a >= size:
            s = np.unique(win[a : b - size + 1])
        else:
            s = window_hash(h[a:b], b - a) + _U(b - a)
        counts[r] = len(s)
        out.append(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(counts)))


def set_keys(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ _U(0x5851F42D4C957F2D)))))
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the set's hashes over a power of two of bits, at least as many as it has shingles."""
    bits = max(SKETCH_BITS, 1 << max(0, (len(tokens) - 1).bit_length()))
    bit = (mix(tokens + _U(0x2545F4914F6CDD1D)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A sketch as words, folded to ``size`` bytes (halves by exclusive or: the same set's shorter sketch)."""
    out = np.frombuffer(raw, np.uint64)
    while 8 * len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


class Bands:
    """Size bands: a set of size y and one of size x <= y with x >= y * similarity lie in one band
    or in neighbours. ``percent`` is the similarity."""

    def __init__(self, percent: int):
        self.percent = percent
        self.high = np.array([1])

    def _reach(self, more) -> None:
        high = self.high.tolist()
        while more(high):
            high.append(max(high[-1] + 1, high[-1] * 100 // self.percent))
        self.high = np.array(high)

    def of(self, size: int) -> int:
        if self.high[-1] < size:
            self._reach(lambda high: high[-1] < size)
        return int(np.searchsorted(self.high, size))

    def top(self, band: int) -> int:
        """The largest size in the band."""
        if len(self.high) <= band:
            self._reach(lambda high: len(high) <= band)
        return int(self.high[band])

    def difference(self, both: int) -> int:
        """The largest symmetric difference of linked sets whose sizes sum to ``both``."""
        return both * (100 - self.percent) // (100 + self.percent)


def signatures(tokens: np.ndarray, bands: Bands, slack: float = 1.25, dear: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """All signatures of one set (sorted distinct hashes), under its band's scheme and the next's.

    ``dear`` has dear signatures, sorted, and their costs; all others cost nothing.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    out, own = [], bands.of(n)
    inner = mix(tokens + _U(0x9E6C63D0876A9A47))
    for band in (own, own + 1):
        top = bands.top(band)
        m = bands.difference(2 * top) + 1
        m = m if m == 1 else math.ceil(slack * m)
        seg = ((tokens >> _U(32)) * _U(m)) >> _U(32)  # in order, as the tokens are
        first = np.concatenate(([0], np.flatnonzero(seg[1:] != seg[:-1]) + 1))
        sums, place = np.add.reduceat(inner, first), mix(seg[first] + _U((band + 1) << 40))
        plain = mix(sums ^ place)
        need = bands.difference(n + min(top, n * 100 // bands.percent)) + 1
        spare = len(first) - need
        if spare > 0 and dear is not None and len(dear[0]):
            at = np.minimum(np.searchsorted(dear[0], plain), len(dear[0]) - 1)
            cost = np.where(dear[0][at] == plain, dear[1][at], 0)
            over = np.flatnonzero(cost)
            plain = np.delete(plain, over[np.lexsort((plain[over], cost[over]))[::-1][:spare]])
        out.append(plain)
        if len(first) < need:
            size = np.diff(np.append(first, n))
            many = np.repeat(size > 1, size)
            out.append(mix((np.repeat(sums, size) - inner)[many] ^ np.repeat(place, size)[many]))
            if int(np.minimum(size, 2).sum()) < need:
                out.append(mix(inner + _U((band + 1) << 20)))
    return np.unique(np.concatenate(out))


def dear_signatures(texts: DataFrame, shingle: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The DEAREST signatures (the bound) that most of a COST_SHARE of the texts share, sorted, and by how many."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            data, offs = buffers(batch.column(0))
            for i, j in slices(offs):
                tokens, bounds = sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
                found = [signatures(tokens[a:b], bands) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["s"])

    sample = texts.sample(fraction=COST_SHARE, seed=9).mapInArrow(tidy(tell), "s long")
    top = sample.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "s").limit(DEAREST).collect()
    known = sorted((r["s"] & 0xFFFFFFFFFFFFFFFF, r["n"]) for r in top)
    return np.array([x for x, _ in known], np.uint64), np.array([x for _, x in known], np.int64)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Each row's id, its number of shingles and its component: id, n_shingles, component_id.

    Words are lower-cased (A-Z) runs of other than white space; a text's set are its distinct
    ``shingle``-word shingles, the whole if it has fewer words. Sets link when 100 * |both| >=
    ``percent`` * |either|. component_id is the least id that links reach. Null texts and texts
    without words have no shingles and stay alone. Rows with equal sets are one node; repeated
    rows fare alike. A null id has no say in the least id, and is null alone. Other columns are
    not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("t"))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(2))
            for i, j in slices(offs):
                tokens, bounds = sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
                sk = [sketch(tokens[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(set_keys(tokens, bounds).view(np.int64)), pa.array(sk, pa.binary())],
                    names=["doc_id", "tk", "n", "key", "sk"],
                )

    rows = src.mapInArrow(tidy(profile), "doc_id long, tk long, n long, key long, sk binary").checkpoint()
    total = int(rows.agg(F.sum("n")).first()[0] or 0)
    buckets = max(1, math.ceil(0.65 * total / PER_BUCKET))

    # one row of the table for each set: the least (id, text), and how to find it
    # signatures carry a key's low 48 bits alone: sets that share those are told apart from here on
    short = lambda c: F.col(c).bitwiseAND(F.lit((1 << 48) - 1))
    nodes = rows.where("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tk")).alias("at"), F.min("sk").alias("sk"))
    nodes = nodes.select(F.col("key").alias("node"), short("key").alias("short"), "n", "least", F.col("at.doc_id").alias("doc_id"), F.col("at.tk").alias("tk"), "sk").checkpoint()

    # rows whose set another row stands for: few are told by a broadcast; beyond the bound, texts and rows meet in a shuffle
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tk"] == b["tk"])
    n_sets, stand = nodes.count(), nodes.select("doc_id", "tk")
    texts = src.where("t is not null")
    if rows.where("n > 0").count() - n_sets <= BROADCAST_ROWS:
        copies = rows.where("n > 0").select("doc_id", "tk")
        copies = copies.join(stand, same(copies, stand), "left_anti").distinct()
        texts = texts.join(F.broadcast(copies), same(texts, copies), "left_anti").select("t")
    else:
        texts = texts.join(stand, same(texts, stand), "left_semi").dropDuplicates(["doc_id", "tk"]).select("t")
    dear = dear_signatures(texts, shingle, percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, sigs, keys, held = Bands(percent), [], [], 0

        def flush() -> pa.RecordBatch:
            s, k = np.concatenate(sigs), np.concatenate(keys)
            b = ((s >> _U(32)) * _U(buckets)) >> _U(32)
            order = np.argsort(b, kind="stable")
            s, k, b = s[order], k[order], b[order].astype(np.int64)
            cut = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]))
            # a signature's low 5 bytes (its bucket tells more), and a set key's low 6
            low = lambda x, n: x.view(np.uint8).reshape(-1, 8)[:, :n]
            blobs = [np.hstack((low(s[p:q], 5), low(k[p:q], 6))).tobytes() for p, q in zip(cut[:-1], cut[1:], strict=True)]
            sigs.clear(), keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(b[cut[:-1]], pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            data, offs = buffers(batch.column(0))
            for i, j in slices(offs):
                tokens, bounds = sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
                for key, a, b in zip(set_keys(tokens, bounds), bounds[:-1], bounds[1:], strict=True):
                    if b > a:
                        s = signatures(tokens[a:b], bands, dear=dear)
                        sigs.append(s)
                        keys.append(np.full(len(s), key, np.uint64))
                        held += len(s)
                if held >= FLUSH:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        raw = np.frombuffer(b"".join(pdf["blob"]), np.uint8).reshape(-1, 11)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw[:, :5]
        s = wide.view(np.uint64).ravel().copy()
        wide[:, :6] = raw[:, 5:]
        k = wide.view(np.int64).ravel()
        order = np.argsort(s, kind="stable")
        s, k = s[order], k[order]
        same = np.concatenate(([False], s[1:] == s[:-1]))
        inside = np.flatnonzero(same | np.append(same[1:], False))
        groups: dict[bytes, np.ndarray] = {}
        if len(inside):
            s, k = s[inside], k[inside]
            order = np.lexsort((k, s))
            s, k = s[order], k[order]
            fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])))
            s, k = s[fresh], k[fresh]
            cut = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]))
            for p, q in zip(cut[:-1], cut[1:], strict=True):
                if q - p > 1:
                    groups[k[p:q].tobytes()] = k[p:q]
        out: dict[str, list] = {c: [] for c in ("g", "h", "a", "size", "part", "members")}
        for raw_keys, g in groups.items():
            name = hashlib.md5(raw_keys, usedforsecurity=False).digest()
            for part in range(0, len(g), CHUNK):
                for c, v in zip(out, (int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True), int(g[0]), len(g), part, g[part : part + CHUNK].tolist()), strict=True):
                    out[c].append(v)
        return pd.DataFrame(out).astype({"g": "int64", "h": "int64", "a": "int64", "size": "int64", "part": "int64", "members": "object"})

    # groups in rows of bounded size; a group comes up under many signatures, and is kept once
    met = texts.mapInArrow(tidy(sign), "bucket long, blob binary").groupBy("bucket").applyInPandas(meet, "g long, h long, a long, size long, part long, members array<long>")
    met = met.dropDuplicates(["g", "h", "part"]).checkpoint()
    clean(spark)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def one(node: int, text: str) -> np.ndarray:
            if node not in known:
                if len(known) > 64:
                    known.clear()
                raw = np.frombuffer(text.encode(), np.uint8)
                known[node] = sets(raw, np.array([0, len(raw)]), shingle)[0]
            return known[node]

        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            ok = [_linked(one(x, tx), one(y, ty), percent) for x, y, tx, ty in zip(a, b, ta, tb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], names=["a", "b", "ok"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, sa, sb = (batch.column(k).to_pylist() for k in range(6, 10))
            keep = [False] * len(batch)
            for r, (m, n, x, y) in enumerate(zip(na, nb, sa, sb, strict=True)):
                size = min(len(x), len(y))
                keep[r] = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= (m + n) * (100 - percent) // (100 + percent)
            yield batch.filter(pa.array(keep, pa.bool_())).select(list(PAIR))

    def checked(pairs: DataFrame, by: str = "node") -> DataFrame:
        """(a, b, ok) for distinct pairs of nodes, given by ``by``; those that sizes or sketches rule out don't come."""
        end = lambda x: nodes.select(F.col(by).alias(f"by{x}"), F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("doc_id").alias(f"d{x}"), F.col("tk").alias(f"t{x}"), F.col("sk").alias(f"s{x}"))
        both = pairs.select(F.col("a").alias("bya"), F.col("b").alias("byb")).join(end("a"), "bya").join(end("b"), "byb")
        both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select(*PAIR, "na", "nb", "sa", "sb")
        both = both.mapInArrow(tidy(near), ", ".join(f"{c} long" for c in PAIR)).checkpoint()
        wanted = both.select(F.col("da").alias("d"), F.col("ta").alias("k")).union(both.select("db", "tb")).distinct().checkpoint()
        # few wanted texts are picked where they lie; more than the bound meet the table in a shuffle
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        texts = src.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("k"))).dropDuplicates(["d", "k"]).select("d", "k", "t")
        left = texts.select(F.col("d").alias("da"), F.col("k").alias("ta"), F.col("t").alias("xa"))
        right = texts.select(F.col("d").alias("db"), F.col("k").alias("tb"), F.col("t").alias("xb"))
        with_a = both.join(left, both["da"].eqNullSafe(left["da"]) & (both["ta"] == left["ta"])).select("a", "b", "db", "tb", "xa")
        full = with_a.join(right, with_a["db"].eqNullSafe(right["db"]) & (with_a["tb"] == right["tb"])).select("a", "b", "xa", "xb")
        return full.mapInArrow(tidy(verify), "a long, b long, ok boolean")

    stars = met.select("a", F.explode("members").alias("b")).where("a <> b").distinct().checkpoint()
    ends = F.least(short("a"), short("b")).alias("a"), F.greatest(short("a"), short("b")).alias("b")
    links = checked(stars, "short").where("ok").select("a", "b").checkpoint()
    clean(spark)
    roots = components(links).checkpoint()
    failed = stars.join(links.select(*ends), ["a", "b"], "left_anti").select("a").distinct()

    def apart(node: np.ndarray, root: np.ndarray, n: np.ndarray, sk: list[bytes], first: int, last: int) -> np.ndarray:
        """Pairs of unlike roots, of each node the ``first`` to ``last`` nearest; (-1, -1) if there are more."""
        order = np.argsort(n, kind="stable")
        node, root, n, sk = node[order], root[order], n[order], [sk[k] for k in order]
        size = min(map(len, sk))
        bits = np.stack([folded(x, size) for x in sk])
        least, most = np.searchsorted(n, -(-n * percent // 100)), np.searchsorted(n, n * 100 // percent, side="right")
        found, more = [np.zeros((0, 2), np.int64)], False
        for i in range(len(node)):
            j = np.arange(least[i], most[i])
            dist = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)
            near = (dist <= (n[j] + n[i]) * (100 - percent) // (100 + percent)) & (j != i)
            j, dist = j[near], dist[near]
            if len(j) > first:
                j = j[np.lexsort((node[j], dist))]
                more = more or bool((root[j[last:]] != root[i]).any())
                j = j[first:last]
                j = j[root[j] != root[i]]
                found.append(np.stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])), axis=1))
        return np.concatenate((*found, np.full((int(more), 2), -1)))

    def cross(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def solve(end: bool) -> pa.RecordBatch | None:
                table = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                g, node, root, n = (table.column(k).to_numpy() for k in range(4))
                sk = table.column(4).to_pylist()
                cut = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))
                stop = len(cut) - 1 if end else len(cut) - 2
                out = [apart(node[p:q], root[p:q], n[p:q], sk[p:q], first, last) for p, q in zip(cut[:stop], cut[1 : stop + 1], strict=True)]
                if not end:
                    held.extend(table.slice(cut[stop]).to_batches())
                if out and len(pairs := np.unique(np.concatenate(out), axis=0)):
                    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
                return None

            for batch in batches:
                if not len(batch):
                    continue
                held.append(batch)
                if batch.column(0)[len(batch) - 1] != held[0].column(0)[0] and (got := solve(False)) is not None:
                    yield got
            if held and (got := solve(True)) is not None:
                yield got

        return run

    # groups with a failed pair whose members are still apart: each set's nearest eight by sketch, then
    # all others, as far as they lie in another component by then. The ranks are fixed, so each pair
    # comes up in one of the two rounds, and most have been joined before the second.
    members = met.where("size > 2").join(failed, "a", "left_semi").select("g", F.explode("members").alias("short"))
    members = members.join(nodes.select("short", "node", "n", "sk"), "short").drop("short")
    first, step = 0, 8
    while True:
        placed = members.join(roots, "node", "left").select("g", "node", F.coalesce("root", "node").alias("root"), "n", "sk")
        apart_groups = placed.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("g")
        found = placed.join(apart_groups, "g").repartition("g").sortWithinPartitions("g").mapInArrow(tidy(cross(first, first + step)), "a long, b long").distinct().checkpoint()
        more = found.where("a <> b").select("a", "b", *(c.alias(f"s{k}") for k, c in enumerate(ends)))
        more = more.join(stars.toDF("s0", "s1"), ["s0", "s1"], "left_anti").select("a", "b").checkpoint()
        clean(spark)
        if not more.isEmpty():
            fresh = checked(more).where("ok").select("a", "b").checkpoint()
            if not fresh.isEmpty():
                links = links.union(fresh)
                roots = components(links).checkpoint()
        clean(spark)
        if found.where("a = b").isEmpty():
            break
        first, step = first + step, 1 << 40

    placed = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = placed.join(least, "root").select("node", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("node")).join(of_node, "node", "left")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
