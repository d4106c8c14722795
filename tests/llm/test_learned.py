"""Language ID, cross-tokenizer alignment and vector codes: held-out accuracy, brute force, odd rows, empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewell.llm import align as al
from tidewell.llm import codes, language
from tidewell.llm import queries as corpus

PATHS = (corpus.tokenizer_path("byte_bpe_50k.json"), corpus.tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}).getOrCreate()


# --- language ---------------------------------------------------------------------------------


def test_languages_of_held_out_texts(spark):
    got = corpus.QUERIES["op11_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count() == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    tried = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(tried) > 300 and sum(tried) >= 0.99 * len(tried)


def _words(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def test_language_odd_rows(spark):
    r = random.Random(1)
    alphabets = {"aa": "abcdeé", "bb": "fghijß", "cc": "klmnoñ"}
    rows = [(k, _words(r, alphabets[lang], r.randint(3, 40)), lang, "s", 0.5) for k in range(240) for lang in [list(alphabets)[k % 3]]]
    rows += [(1000, None, "aa", None, None), (1001, "", "bb", None, None), (1002, " 12 ?! \n", "cc", None, None), (1003, "abcde " * 200_000, None, "s", 1.0), (None, "fghij ß", "bb", None, None), (None, "fghij ß", "bb", None, None)]
    rows += [(1004, "ABCDE É", None, "s", None), (1005, "x" * 3_000_000, None, None, None), (1006, "abcde klmno", None, None, None), (1007, "🙂🙂", "aa", None, None), rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(3)
    got = defaultdict(list)
    for x in language.identify(df).collect():
        got[x.doc_id].append((x.lang_pred, round(x.score, 9), x.held_out))
    assert sum(map(len, got.values())) == len(rows) and len(got[5]) == 2 and len(set(got[5])) == 1 and len(got[None]) == 2
    assert all(got[k][0][:2] == ("und", 0.0) for k in (1000, 1001, 1002, 1007))
    assert got[1003][0][0] == got[1004][0][0] == "aa" and {x[0] for x in got[None]} == {"bb"} and not any(x[2] for x in got[None])
    right = [got[k][0][0] == lang for k, _, lang, *_ in rows[:240]]
    assert sum(right) >= 236
    shifted = {x.doc_id: x.lang_pred for x in language.identify(df.withColumn("lang", F.when(language.held_out("doc_id"), "zz").otherwise(F.col("lang")))).collect()}
    assert all(shifted[k] == got[k][0][0] for k in shifted if k is not None)  # nothing is learned from what is held out


def test_languages_without_labels_or_rows(spark):
    schema = "doc_id long, text string, lang string"
    none = language.identify(spark.createDataFrame([(1, "abc", None), (2, "x", None)], schema)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language.identify(spark.createDataFrame([], schema)).count() == 0
    one = language.identify(spark.createDataFrame([(k, "abc", "aa") for k in range(6)] + [(9, "xyz", None), (10, "1", None)], schema)).collect()
    assert {(r.lang_pred, r.score) for r in one if r.doc_id != 10} == {("aa", 1.0)}


def test_codewords_are_apart():
    for n in (2, 3, 5, 6, 12, 40):
        code = language.codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (1 if n == 2 else 2 ** (n - 2) if n <= 5 else 0.28 * code.shape[1])
        assert all(0 < column.sum() < n for column in code.T)
    assert language.codewords(1).shape == (1, 0)


def test_evidence_does_not_depend_on_pieces(monkeypatch):
    r = random.Random(4)
    texts = ["", "é", None, _words(r, "abcdé ß12\n", 900), "a", " b ", _words(r, "xyz", 5)]
    w = np.random.default_rng(1).normal(0, 1, (1 << 10, 3)).astype(np.float32)
    whole = language.evidence(texts, w, 10)
    for size in (1, 2, 3, 50):
        monkeypatch.setattr(language, "_PIECE", size)
        total, n = language.evidence(texts, w, 10)
        assert (n == whole[1]).all() and np.allclose(total, whole[0], atol=1e-4)


def test_an_ambiguous_text_is_flagged(spark):
    r = random.Random(7)
    rows = [(k, _words(r, "abcdefgh" if k % 2 else "efghijkl", 30), "aa" if k % 2 else "bb") for k in range(200)] + [(900, "efgh " * 3, None), (901, "abcd " * 30, None)]
    got = {x.doc_id: x.ambiguous for x in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[900] and not got[901]


# --- alignment --------------------------------------------------------------------------------


def _texts():
    r = random.Random(1)
    out = [None, "", " ", "  ", "a", "  foo  bar ", "a\nb  c", "▁x y", "a ▁ b", "x" * 3000, "é" * 700 + " ß", "日本語 テキスト 🙂🙂 ok", "<|endoftext|> <unk> </s>", "a\x00b c", "it's 'tis we'll  'x", "tab\t x", "nb sp em", "\u001c x \u001c", "aaaa" * 2000 + " bbbb" * 5, "one two", "one two", "one two"]
    odd = "ab cd\n é▁'s1 日🙂\t"
    out += ["".join(r.choice(odd) for _ in range(r.randint(1, 60))) for _ in range(120)]
    return out + ["".join(r.choice(["the ", "of", " in", " ", "\n", "▁", "'", "ing", "x9", " 12", "ü"]) for _ in range(r.randint(1, 40))) for _ in range(120)]


def _aligned(texts):
    """By byte offsets and sets, from the tokenizers' own outputs over whole texts."""
    names, docs = al.Tokenizers(*PATHS), []
    for t in texts:
        docs.append(None)
        if t:
            a, b = names.a.encode(" " + t, add_special_tokens=False).ids, names.b.encode(t)
            x, y = ([tokens[k] for k in ids] for tokens, ids in ((names.a_bytes, a), (names.b_bytes, b)))
            if b"".join(x) == b"".join(y) == (" " + t).encode():
                ends = [list(np.cumsum([len(k) for k in s])) for s in (x, y)]
                i = j = 0
                docs[-1] = []
                for e in sorted(set(ends[0]) & set(ends[1])):
                    p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
                    docs[-1].append((a[i:p], b[j:q]))
                    i, j = p, q
    count = Counter(pair for d in docs if d for pair in {(s, t) for x, y in d for s in x for t in y})
    best = defaultdict(int)
    for (s, _), n in count.items():
        best[s] = max(best[s], n)
    out = []
    for d in docs:
        links = [(s, t) for x, y in d or () for s in x for t in y]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d or ())
        sizes = [sum(len(g[k]) for g in d or ()) for k in (0, 1)]
        out.append((*sizes, len(d or ()), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(shown.encode()).hexdigest() if d else ""))
    return out


def test_alignment_against_brute_force(spark):
    texts = _texts()
    rows = [(k if k % 50 else None, t, "x", 1, 2) for k, t in enumerate(texts)]
    want = sorted(((k if k % 50 else -1), *w) for k, w in enumerate(_aligned(texts)))
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string, n int, block int").repartition(3)
    assert any(w[1] == 0 and texts[w[0]] for w in want if w[0] >= 0)  # texts that do not come back
    for chars in (16 << 20, 300):
        got = sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in al.align(df, *PATHS, block_chars=chars).collect())
        assert got == want
    assert al.align(df.limit(0), *PATHS).count() == 0


def test_alignment_memory_can_be_cleared():
    texts, names = [t or "" for t in _texts()], al.Tokenizers(*PATHS)
    assert names.cuts
    whole = [(tuple(r), s, p.tolist(), n.tolist()) for r, s, p, n in al.Aligner(names).texts(texts)]
    few = al.Aligner(names, limit=50)
    few.transducer.limit = 20
    assert [(tuple(r), s, p.tolist(), n.tolist()) for k in range(0, len(texts), 7) for r, s, p, n in few.texts(texts[k : k + 7])] == whole
    names.cuts = False  # as with tokenizers that don't cut at spaces: whole texts
    assert [(tuple(r), s, p.tolist(), n.tolist()) for r, s, p, n in al.Aligner(names).texts(texts)] == whole


def test_long_texts_and_groups_are_aligned_whole():
    names = al.Tokenizers(*PATHS)
    long = "".join(random.Random(3).choice("abé ") for _ in range(600_000)) + "q" * 50_000
    (row, _, pairs, times), = al.Aligner(names).texts([long])
    assert row[0] == len(names.a.encode(" " + long, add_special_tokens=False).ids) and row[3] == times.sum() and (np.diff(pairs.astype(np.int64)) > 0).all()
    made = al.Aligner(names)  # a group of 300 by 200 tokens, few of them unlike
    a, b = np.array([1, 2] * 150), np.array([7, 7, 8, 9] * 50)
    who, pair, n = made._linked(a, b, np.array([300]), np.array([200]), np.array([0]))
    assert who.tolist() == [0] * 6 and dict(zip(pair.tolist(), n.tolist(), strict=True)) == {s * made.width + t: 150 * (100 if t == 7 else 50) for s in (1, 2) for t in (7, 8, 9)}


def test_transducer():
    t = al.Transducer([b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"abcd", b"x"])
    assert t.groups([0, 1], [0, 1]) == ([2], [2]) and t.groups([2, 3], [2]) == ([2], [1]) and t.groups([], []) == ([], [])
    assert t.groups([0, 1], [0, 3]) is None and t.groups([0], [0]) is None and t.groups([0, 1], [0, 1, 0]) is None
    assert t.groups([2, 2], [0, 1, 0, 1]) == ([1, 2], [2, 4]) and set(t.states) <= {(s, b) for s in (0, 1) for b in (b"", b"ab", b"b", b"abc", b"bc", b"d", b"abcd", b"cd", b"c")}


# --- vector codes -----------------------------------------------------------------------------


def _coded(rows, parts, entries, rounds, scale):
    """By full searches in whole numbers of any size."""
    kept = [(i, lab, [math.floor(Fraction(x) * scale) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, _, v in kept) // parts))
    cut = lambda v: [tuple((v + [0] * (width * parts))[p * width : (p + 1) * width]) for p in range(parts)]
    least = {}
    for i, _, v in kept:
        key = (i is None, i or 0)
        least[key] = min(least.get(key, v), v)
    seeds = [cut(least[k]) for k in sorted(least)[:entries]]
    books, vectors = [[s[p] for s in seeds] for p in range(parts)], [cut(v) for *_, v in kept]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        got = [[min(range(len(books[p])), key=lambda e: (dist(v[p], books[p][e]), e)) for p in range(parts)] for v in vectors]  # noqa: B023
        if step < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [v[p] for v, g in zip(vectors, got, strict=True) if g[p] == e]
                    if mine:
                        books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(dist(v[p], books[p][g[p]]) for p in range(parts)) for v, g in zip(vectors, got, strict=True)]
    by = defaultdict(int)
    for (_, lab, _), e in zip(kept, errors, strict=True):
        by[lab] += e
    return sorted((-1 if i is None else i, "".join(f"{x:02x}" for x in g), e, by[lab], sha) for (i, lab, _), g, e in zip(kept, got, errors, strict=True))


@pytest.mark.parametrize("size", [1.0, 1e5])
def test_codes_against_brute_force(spark, size):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in v * size], int(k % 3) if k % 7 else None) for k, v in enumerate(r.normal(0, 0.3, (70, 13)).round(2))]
    rows += [(100 + k, rows[4][1], 1) for k in range(25)] + [rows[9], rows[9], (3, rows[8][1], 0), (None, rows[2][1], None), (200, None, 1), (201, [0.1, None], 1), (202, [float("nan")] * 13, 1), (203, [float("inf")] * 13, 1), (204, [], 2), (205, [0.5], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit("x"), "code": F.lit(0), "v": F.lit(1)}).repartition(3)
    for parts, entries, rounds, scale in ((8, 16, 6, 4096), (3, 4, 2, 128)):
        got = codes.vector_codes(df, parts=parts, entries=entries, rounds=rounds, scale=scale)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted((-1 if x.vec_id is None else x.vec_id, *tuple(x)[1:]) for x in got.collect()) == _coded(rows, parts, entries, rounds, scale)


def test_codes_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codes.vector_codes(spark.createDataFrame([], schema)).count() == 0 and codes.vector_codes(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    one = codes.vector_codes(spark.createDataFrame([(1, [0.5] * 16, None), (2, [0.25] * 16, None)], schema)).collect()
    assert sorted((x.vec_id, x.code, x.error, x.label_error) for x in one) == [(1, "00" * 8, 0, 0), (2, "01" * 8, 0, 0)]


def test_components_beyond_64_bits(spark):
    rows = [(1, [1e17, 0.0], 0), (2, [1e17, 2.0], 0), (3, [-1e17, 5.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(x) for x in codes.vector_codes(df, parts=2, entries=3, rounds=2).collect())
    assert got == _coded(rows, 2, 3, 2, 4096)
    with pytest.raises(Exception, match="(?i)overflow|too large|out of"):
        codes.vector_codes(df, parts=2, entries=1, rounds=1).collect()


def test_an_annulus_holds_the_nearest_entry_and_skips_others():
    r = np.random.default_rng(2)
    book = codes.Codebook((r.normal(0, 1, (64, 6)) * r.uniform(10, 4000, (64, 1))).astype(np.int64))
    x = (r.normal(0, 1, (3000, 6)) * r.uniform(10, 4000, (3000, 1))).astype(np.int64)
    entry, dist, evaluated = book.nearest(x)
    full = ((x[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
    assert (entry == full.argmin(axis=1)).all() and (dist == full.min(axis=1)).all() and evaluated < 0.6 * full.size
    same = codes.Codebook(np.array([[3, 4], [5, 0], [3, 4], [-5, 0], [0, 5]]))
    assert same.nearest(np.array([[3, 4], [0, 0], [4, 2]]))[0].tolist() == [0, 0, 0]
