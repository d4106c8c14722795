"""Packing token runs into fixed-length sequences: first-fit decreasing in randomised groups.

Each text is tokenised where it lies; a run longer than a sequence is cut into whole sequences and
a remainder. Only the pieces' sizes travel: they meet in randomised groups of bounded size, and in
each group go, longest first, into the first sequence with room, found by a tournament tree of
the sequences' free capacities.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BatchEncoder
from .common import buffers, prepare, slices, tidy

#: Texts are encoded in slices of about so many bytes, in which equal words are looked up once.
ENCODE_BYTES = 4 << 20
_ENCODERS: dict = {}


def encoder(path: str) -> BatchEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and offset of each size (1 to ``capacity``), given in the order of placing.

    ``tree`` is a tournament over the bins: node k holds the larger free capacity of 2k and 2k + 1,
    so the first bin with room is found from the root in log time.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, size in enumerate(sizes.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[k], offsets[k] = at - leaves, capacity - tree[at]
        tree[at] -= size
        at //= 2
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left >= right else right
            at //= 2
    return bins, offsets


def pack(
    docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, docs_per_group: int = 8192, seed: int = 3,
    text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """One row for each piece: doc_id, start and length in the document's ids (with the end id),
    their CRC-32, the document's number of ids, the sequence and the offset there.

    ``tokenizer`` is a file of the ``tokenizers`` library; those of a known shape are faster (see
    :mod:`.bpe`). A null or empty text is the end id alone. Each row is packed, repeated
    ones too. Sequences hold rows of one random group, so groups are packed on their own and again
    alike if an executor is lost. Other columns are not looked at.
    """
    prepare(docs.sparkSession)
    groups = max(1, math.ceil(docs.count() / docs_per_group))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            data, offs = buffers(batch.column(1))
            docs, groups = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = [[], [], [], [], [], []]
            for i, j in slices(offs, ENCODE_BYTES):
                ids, bounds = encode.texts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], end_id)
                view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                for r, a, b in zip(range(i, j), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for start in range(a, b, length):
                        n = min(length, b - start)
                        for column, value in zip(out, (docs[r], groups[r], start - a, n, zlib.crc32(view[4 * start : 4 * (start + n)]), b - a), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "g", "start", "length", "ids_crc32", "doc_tokens"])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf.drop(columns="g").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    group = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.length(text_col)), F.lit(groups))
    pieces = docs.select(F.col(id_col).cast("long"), text_col, group.alias("g")).mapInArrow(tidy(cut), "doc_id long, g long, start long, length long, ids_crc32 long, doc_tokens long")
    return pieces.groupBy("g").applyInPandas(fit, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
