"""Language identification by error-correcting output codes over character n-grams.

Every language gets a codeword; every bit of it is a binary classifier, which tells the languages with a 1 from those with
a 0 by the log odds of a text's letter 1-, 2- and 3-grams. A text's evidence for a bit is the mean log odds times the
square root of its n-grams' number, scaled to the logit that fits best. Decoding weighs losses: a
codeword's distance is the logistic loss of each bit against the evidence, weighted by how often that bit was right
for that language on rows its classifier had not seen; the nearest codeword wins. A text for which another
codeword is about as near is flagged as ambiguous.

The classifiers are fitted on a bounded, seeded sample of labelled rows; n-grams are counted on the executors and
summed there, and the driver sees one table of ``2 ** bits`` counts a language. A row of any length is walked in pieces.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, tidy

_PIECE = 1 << 19
_ORDERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_BEFORE, _BEFORE2 = np.uint32(668265263), np.uint32(374761393)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(k).isalpha() for k in range(0x110000)], bool)


def grams(texts: list[str | None], bits: int):
    """Over runs of pieces of the texts: (row of each piece, its number of n-gram places, buckets by order).

    A place is a letter, in lower case, or the end of a word; its n-grams reach back over the two characters before it,
    which count as one and the same where they are no letters.
    """
    pieces: list[tuple[int, str, int]] = []
    size = 0

    def done():
        chars = np.frombuffer("".join(p for _, p, _ in pieces).encode("utf-32-le"), np.uint32)
        c = np.where(_letters()[chars], chars, np.uint32(0))
        begin = np.cumsum([0, *(len(p) for _, p, _ in pieces)])
        one, two = np.zeros_like(c), np.zeros_like(c)
        one[1:], two[2:] = c[:-1], c[:-2]
        first = begin[:-1]
        one[first], two[first] = 0, 0
        second = first[first + 1 < begin[1:]] + 1
        two[second] = 0
        valid = (c != 0) | (one != 0)
        for k, (_, _, skip) in enumerate(pieces):
            valid[first[k] : first[k] + skip] = False
        at = np.flatnonzero(valid)
        n = np.diff(np.searchsorted(at, begin))
        c, pair = c[at], c[at] + one[at] * _BEFORE
        return np.array([r for r, _, _ in pieces]), n, [(x * m) >> np.uint32(32 - bits) for x, m in zip((c, pair, pair + two[at] * _BEFORE2), _ORDERS, strict=True)]

    for row, text in enumerate(texts):
        t = (text or "").lower()
        for k in range(0, len(t), _PIECE):
            back = min(2, k)
            pieces.append((row, t[k - back : k + _PIECE], back))
            size += len(pieces[-1][1])
            if size >= _PIECE:
                yield done()
                pieces, size = [], 0
    if pieces:
        yield done()


def evidence(texts: list[str | None], weights: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed log odds of each text for each classifier, and the number of n-gram places."""
    total, count = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), np.int64)
    for row, n, buckets in grams(texts, bits):
        np.add.at(count, row, n)
        has = n > 0
        if has.any() and weights.shape[1]:
            x = weights[buckets[0]]
            x += weights[buckets[1]]
            x += weights[buckets[2]]
            np.add.at(total, row[has], np.add.reduceat(x, (np.cumsum(n) - n)[has], axis=0, dtype=np.float64))
    return total, count


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of 0 and 1 for each language: every split of up to five languages, else seeded splits far apart."""
    if n < 2:
        return np.zeros((n, 0), np.int64)
    if n <= 5:
        splits = [c for k in range(1, n) for c in combinations(range(n), k) if n - 1 not in c]
        out = np.zeros((n, len(splits)), np.int64)
        for b, c in enumerate(splits):
            out[list(c), b] = 1
        return out
    rng, width, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    for _ in range(200):
        code = np.stack([rng.permutation(np.arange(n) % 2) for _ in range(width)], axis=1)
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + width * np.eye(n, dtype=np.int64)
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


def log_odds(counts: np.ndarray, code: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """(bucket, bit) weights from (language, bucket) counts; languages weigh the same however many n-grams they have."""
    share = counts + smooth
    share = share / share.sum(axis=1, keepdims=True)
    out = [np.log(share[code[:, b] == 1].mean(axis=0)) - np.log(share[code[:, b] == 0].mean(axis=0)) for b in range(code.shape[1])]
    return np.stack(out, axis=1).astype(np.float32) if out else np.zeros((counts.shape[1], 0), np.float32)


def _logit_scale(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The scale a of least logistic loss of y (1 and -1) against a * x, by bisection of its slope."""
    low, high = 0.0, 64.0
    for _ in range(60):
        a = (low + high) / 2
        slope = -(weight * y * x / (1 + np.exp(np.clip(a * y * x, -50, 50)))).sum()
        low, high = (a, high) if slope < 0 else (low, a)
    return max(low, 1e-3)


class Model:
    """Languages, codewords, classifiers, their scales, and the weight of each bit for each language."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, scale: np.ndarray, trust: np.ndarray, bits: int, margin: float):
        self.languages, self.code, self.weights, self.scale, self.trust, self.bits, self.margin = languages, code, weights, scale, trust, bits, margin

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        total, n = evidence(texts, self.weights, self.bits)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        z = self.scale * total / np.sqrt(np.maximum(n, 1))[:, None]
        sign = 2 * self.code - 1
        far = np.stack([(self.trust[k] * np.logaddexp(0, -sign[k] * z)).sum(axis=1) for k in range(len(self.languages))], axis=1)
        near = np.exp(-(far - far.min(axis=1, keepdims=True)))
        near /= near.sum(axis=1, keepdims=True)
        best = far.argmin(axis=1)
        top = np.sort(near, axis=1)
        score = top[:, -1]
        close = (score - top[:, -2] < self.margin) if top.shape[1] > 1 else np.zeros(len(texts), bool)
        found = [self.languages[k] if m else "und" for k, m in zip(best, n, strict=True)]
        return found, np.where(n > 0, score, 0.0), close & (n > 0)


def _counts(bits: int):
    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            lang, fold = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, n, buckets in grams(batch.column(2).to_pylist(), bits):
                for r, i, j in zip(row, np.cumsum(n) - n, np.cumsum(n), strict=True):
                    total = held.setdefault((lang[r], fold[r]), np.zeros(1 << bits, np.int64))
                    for b in buckets:
                        np.add.at(total, b[i:j], 1)
        for (lang, fold), total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, np.int32)), pa.array(np.full(len(at), fold, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "fold", "bucket", "n"])

    return run


def _judged(weights: list[np.ndarray], bits: int):
    """Language, evidence and n-grams of sampled rows, by the classifiers that did not see their fold."""

    def run(batches):
        for batch in batches:
            fold = np.array(batch.column(1).to_pylist())
            texts = batch.column(2).to_pylist()
            for f in (0, 1):
                rows = np.flatnonzero(fold == f)
                total, n = evidence([texts[k] for k in rows], weights[1 - f], bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(n), pa.array(list(total), pa.list_(pa.float64()))], names=["lang", "n", "x"])

    return run


def fit(labelled: DataFrame, sample_rows: int = 20000, max_languages: int = 64, bits: int = 15, margin: float = 0.2, seed: int = 3) -> Model:
    """A model from (text, lang) rows: at most ``sample_rows`` different texts, shared evenly by the ``max_languages`` languages with most rows."""
    empty = Model([], np.zeros((0, 0)), np.zeros((1 << bits, 0), np.float32), np.zeros(0), np.zeros((0, 0)), bits, margin)
    most = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not most:
        return empty
    # twice the share, as copies go; then exactly so many
    share, languages = max(1, sample_rows // len(most)), sorted(r["lang"] for r in most)
    key = F.xxhash64(F.lit(seed), "id", "text")
    chance = F.create_map(*[F.lit(x) for r in most for x in (r["lang"], min(1.0, 2.0 * share / r["n"]))])
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
    some = labelled.withColumn("key", key).where(F.pmod("key", F.lit(1 << 30)) < chance[F.col("lang")] * float(1 << 30))
    some = some.select(number[F.col("lang")].alias("lang"), "text", F.xxhash64(F.lit(seed + 1), "text").alias("key")).dropDuplicates(["lang", "key"])
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("at") <= share)
    some = cut(some.select("lang", F.pmod("at", F.lit(2)).cast("int").alias("fold"), "text"))
    counts = np.zeros((2, len(languages), 1 << bits))
    summed = some.mapInArrow(tidy(_counts(bits)), "lang int, fold int, bucket int, n long").groupBy("lang", "fold", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[summed["fold"].to_numpy(), summed["lang"].to_numpy(), summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    has = np.flatnonzero(counts.sum(axis=(0, 2)))
    if not len(has):
        return empty
    code = codewords(len(has), seed)
    counts = counts[:, has]
    judged = some.mapInArrow(tidy(_judged([log_odds(c, code) for c in counts], bits)), "lang int, n long, x array<double>").where("n > 0").toArrow()
    lang = np.searchsorted(has, judged["lang"].to_numpy())
    x = np.array(judged["x"].to_pylist()).reshape(len(lang), code.shape[1]) / np.sqrt(judged["n"].to_numpy())[:, None]
    weight = 1.0 / np.bincount(lang, minlength=len(has))[lang]
    sign = 2 * code - 1
    right = sign[lang] * x > 0
    trust = np.stack([right[lang == k].mean(axis=0) if (lang == k).any() else np.full(code.shape[1], 0.5) for k in range(len(has))]) + 1e-3 if code.shape[1] else np.zeros(code.shape)
    scale = np.array([_logit_scale(x[:, b], sign[lang, b], weight) for b in range(code.shape[1])])
    trust = trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9) * code.shape[1]
    return Model([languages[k] for k in has], code, log_odds(counts.sum(axis=0), code), scale, trust, bits, margin)


def held_out(id_col: str, parts: int = 3, part: int = 1) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, by ``parts``; a null id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The language of each text: id, held_out, lang_pred, score (0 to 1), ambiguous.

    Learns from the text and language of rows with a language that are not ``held_out``; ``options`` are :func:`fit`'s.
    A text that is null or has no letters is ``und`` with score 0, and so is every text where nothing can be learned,
    as in a table without labels. Where one language alone is learned, all others get it with score 1.
    Texts of any length are read whole; repeated rows fare alike; an empty table gives an empty
    result; other columns are not looked at.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(fit(rows.where("not held_out and lang is not null and text is not null"), **options))

    def predict(batches):
        known = model.value
        for batch in batches:
            found, score, close = known.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(score), pa.array(close)], names=["id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = df.schema[id_col].dataType.simpleString()
    out = rows.select("id", "held_out", "text").mapInArrow(tidy(predict), f"id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)
