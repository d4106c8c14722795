"""Column functions: keys, dates, masks, geometry, vectors, lexicon scores."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_KEY = "_dbt_utils_surrogate_key_null_"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(c: Column | str) -> Column:
    """Money as whole hundredths, so that sums are exact."""
    return F.round(col(c) * 100).cast("long")


def surrogate_key(*cols: Column | str) -> Column:
    """MD5 over the columns' strings joined by ``-``, nulls replaced: never null."""
    return F.md5(F.concat_ws("-", *[F.coalesce(col(c).cast("string"), F.lit(NULL_KEY)) for c in cols]))


def row_hash(*cols: Column | str) -> Column:
    """MD5 of the columns' strings joined by ``|``; nulls stay visible (concat_ws alone would skip them)."""
    return F.md5(F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("\\N")) for c in cols]))


def millis(ts: Column | str) -> Column:
    return F.unix_millis(col(ts).cast("timestamp"))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    """Second boundaries crossed from a to b (not whole elapsed seconds)."""
    return F.unix_seconds(col(b).cast("timestamp")) - F.unix_seconds(col(a).cast("timestamp"))


def minutes_between(a: Column | str, b: Column | str) -> Column:
    at = lambda c: F.floor(F.unix_seconds(col(c).cast("timestamp")) / 60)
    return at(b) - at(a)


def day_of_week(d: Column | str) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(col(d)) - 1


def day_text(d: Column | str) -> Column:
    """A day as year-month-day; years past 9999 without the plus sign that a ``yyyy`` pattern puts before them."""
    return F.when(F.year(col(d)) > 9999, F.concat(F.year(col(d)), F.date_format(col(d), "-MM-dd"))).otherwise(F.date_format(col(d), "yyyy-MM-dd"))


def date_key(d: Column | str) -> Column:
    return F.date_format(col(d), "yyyyMMdd").cast("int")


def ist_hour(ts: Column | str) -> Column:
    """The hour in India (330 minutes ahead) of a UTC time."""
    return F.hour(col(ts) + F.expr("interval 330 minutes"))


def least_strict(*cols: Column | str) -> Column:
    """LEAST that is null if any argument is."""
    cs = [col(c) for c in cols]
    none = cs[0].isNull()
    for c in cs[1:]:
        none = none | c.isNull()
    return F.when(~none, F.least(*cs))


def greatest_strict(*cols: Column | str) -> Column:
    cs = [col(c) for c in cols]
    none = cs[0].isNull()
    for c in cs[1:]:
        none = none | c.isNull()
    return F.when(~none, F.greatest(*cs))


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group's text, null where the pattern doesn't match."""
    return F.when(col(c).rlike(pattern), F.regexp_extract(col(c), pattern, group))


def full_match(c: Column | str, pattern: str) -> Column:
    """Whether the pattern matches the whole string (``rlike`` searches)."""
    return col(c).rlike(f"^(?:{pattern})$")


def haversine_km(lat1, lon1, lat2, lon2, radius: float = 6371.0) -> Column:
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(h))


def distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Metres on the sphere between two points."""
    return haversine_km(lat1, lon1, lat2, lon2) * 1000


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a).cast("array<double>"), col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def tokens(c: Column | str, pattern: str = "[a-z]{2,}") -> Column:
    """A text's words in small letters; of the dotted capital I a plain i (``lower`` leaves a mark behind it, at which a word would end)."""
    return F.regexp_extract_all(F.lower(F.replace(col(c), F.lit("\u0130"), F.lit("i"))), F.lit(pattern), F.lit(0))


def hash_slot(token: Column | str) -> Column:
    """Slot 0..255 and sign of a token, from its MD5: struct<slot int, sign int>."""
    h = F.md5(col(token))
    slot = F.conv(F.substring(h, 15, 2), 16, 10).cast("int")
    odd = F.conv(F.substring(h, 8, 1), 16, 10).cast("int") % 2
    return F.struct(slot.alias("slot"), F.when(odd == 1, 1).otherwise(-1).alias("sign"))


def hash_slices(rows: int = 256):
    """Arrays of texts to arrays of their hash vectors, ``rows`` at a time: a batch's vectors are never held together."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = re.compile("[a-z]{2,}")

        def digest(gram: str) -> bytes:
            return hashlib.md5(gram.encode(), usedforsecurity=False).digest()

        known = lru_cache(1 << 16)(digest)  # words come again, most pairs don't
        for batch in batches:
            for at in range(0, len(batch), rows):
                texts = batch.slice(at, rows).to_pylist()
                out = np.zeros((len(texts), 256))
                for v, text in zip(out, texts, strict=True):
                    words = token.findall((text or "").replace("\u0130", "i").lower())  # as in tokens
                    if words:
                        h = np.frombuffer(b"".join([*map(known, words), *[digest(f"{a}_{b}") for a, b in zip(words, words[1:], strict=False)]]), np.uint8).reshape(-1, 16)
                        v += np.bincount(h[:, 7], np.where(h[:, 3] & 1, 1.0, -1.0), 256)
                        v /= math.sqrt(v @ v) or 1.0
                yield pa.ListArray.from_arrays(pa.array(range(0, out.size + 1, 256), pa.int32()), out.ravel())

    return run


def hash_vector(c: Column | str) -> Column:
    """Text to 256 doubles: words and word pairs hashed with a sign (as :func:`hash_slot`), L2-normalised; all zero without words."""
    return F.arrow_udf(hash_slices(), "array<double>")(col(c))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def hits(words: Column, lexicon: list[str]) -> Column:
    """How many of the words the lexicon has."""
    return F.array_size(F.filter(words, lambda w: w.isin(lexicon)))


def tone(c: Column | str, strong, escalation, blank: Column | None = None) -> Column:
    """How strong a text's words are: struct of intensity, escalation, words, score and band. A blank
    text has no score and the band UNKNOWN: an empty or null one, unless ``blank`` tells which are. Then
    an empty text has the score 0, a null one no counts at all, and neither is above LOW."""
    a, b = list(strong), list(escalation)
    text = col(c)
    if blank is None:
        text = F.coalesce(text, F.lit(""))
        blank = text == ""
    words = let(tokens(text), lambda w: F.struct(F.array_size(w).alias("n"), F.filter(w, lambda x: x.isin([*a, *b])).alias("told")))
    counts = let(words, lambda w: F.struct(hits(w["told"], a).alias("a"), hits(w["told"], b).alias("b"), w["n"].alias("n")))

    def scored(x: Column) -> Column:
        score = x["a"] + 2 * x["b"]
        band = F.when(blank, "UNKNOWN").when(score >= 6, "HIGH").when(score >= 3, "MEDIUM").otherwise("LOW")
        return F.struct(x["a"].alias("intensity"), x["b"].alias("escalation"), x["n"].alias("words"), F.when(~blank, score).alias("score"), band.alias("band"))

    return let(counts, scored)


def mask_email(c: Column | str, role: str) -> Column:
    """Clear for full readers, a stable pseudonym for analysts, else redacted."""
    if role in ("owner", "steward"):
        return col(c)
    return F.sha2(F.lower(col(c)), 256) if role == "analyst" else F.when(col(c).isNotNull(), F.lit("***REDACTED***"))


def mask_phone(c: Column | str, role: str) -> Column:
    """All but the last four characters as X."""
    x = col(c)
    return x if role in ("owner", "steward") else F.concat(F.repeat(F.lit("X"), F.greatest(F.length(x) - 4, F.lit(0))), F.right(x, F.lit(4)))


def mask_name(c: Column | str, role: str) -> Column:
    x = col(c)
    return x if role in ("owner", "steward") else F.concat(F.left(x, F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.length(x) - 1, F.lit(0))))


def mask_coordinate(c: Column | str, role: str) -> Column:
    return col(c) if role in ("owner", "steward") else F.round(col(c), 2)
