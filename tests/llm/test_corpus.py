"""Corpus operators against brute force on small fixtures with nulls, ties, repeats and hot groups."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

from tidewell.llm import htmltext, jaccard, repeats, suffix
from tidewell.llm.jaccard import near_duplicates
from tidewell.llm.linedup import line_dedup
from tidewell.llm.mixing import mix
from tidewell.llm.packing import first_fit_decreasing, pack
from tidewell.llm.quality import quality_filter, quality_report
from tidewell.llm.queries import tokenizer_path
from tidewell.llm.sharding import shuffled
from tidewell.llm.suffix import substring_dedup
from tidewell.llm.topk import top_k
from tidewell.llm.unitdup import remove_units, repeated_units

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, n int"


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}).getOrCreate()


def texts() -> list:
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() + ("\n" if r.random() < 0.08 else "") for _ in range(n))
    out = [prose(r.randint(1, 150)) for _ in range(30)]
    base, shared = prose(120), prose(60)
    out += [base] * 6
    for _ in range(8):
        w = base.split(" ")
        w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [prose(20) + "\n" + shared + "\n" + prose(20) for _ in range(5)]
    out += [None, "", " \n\n ", "one", "one two three", "same words here ok", "same words here ok", "a\n" * 40, "###&& ***$ " * 30, "ab " * 2000, "x" * 5000, "é" * 300 + "y" * 3, "\n".join(["l1", "l2", "l3", "l4"] * 3)]
    return out


@pytest.fixture(scope="session")
def rows():
    out = [(i, t, r[0], r[1], len(t or ""), "x", 1, 2) for i, t in enumerate(texts()) for r in [[("en", "src1"), ("fr", "src0"), (None, "src2"), ("en", None)][i % 4]]]
    return [*out, out[31], (None, "text without an id " * 12, "en", "src1", 1, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(none, spark):
    assert quality_report(none).count() == quality_filter(none).count() == line_dedup(none).count() == repeated_units(none).count() == 0
    assert near_duplicates(none).count() == substring_dedup(none).count() == shuffled(none).count() == mix(none, {}).count() == pack(none, tokenizer_path()).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(vectors, vectors).count() == 0
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(3)
    data = [(i, [float(x) for x in v], "x", i % 3) for i, v in enumerate(r.normal(0, 0.2, (90, 7)))]
    data += [(90 + i, data[5][1], None, None) for i in range(30)] + [(200, None, "", 0), (201, [0.1, None] + [0.0] * 5, "", 0), (202, [float("nan")] * 7, "", 0), (250, [float("inf")] * 7, "", 0), (None, data[0][1], "", 0), (260, [], "", 0), data[3]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, b string, score int")
    ok = {i: [int(np.floor(256 * x)) for x in v] for i, v, *_ in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in ok if i % 50 == 0 or i == 260):
        s = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=False)), i) for i, v in ok.items() if i != q)[:5]
        want |= {(q, k + 1, i, -x) for k, (x, i) in enumerate(s)}
    got = top_k(df, df.where("vec_id % 50 = 0 or vec_id = 260"), rows_per_block=40, queries_per_block=2, coarse_bits=3)
    assert {tuple(r) for r in got.collect()} == want


def test_quality(docs, rows):
    report = {(r.doc_id, r.n_words, r.word_chars): r for r in quality_report(docs).collect()}
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        r = report[(i, len(w), sum(map(len, w)))]
        win = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + d for k in range(len(w) - 7) if win[tuple(w[k : k + 8])] > 1 for d in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    kept = quality_filter(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in report.values() if r.kept for _ in range(2 if r.doc_id == 31 else 1))


def _words(n, w):
    return " ".join(f"{w}{k}word" for k in range(n))


A, B, C, D = _words(60, "a"), _words(50, "b"), _words(40, "c"), _words(90, "d")
PAGES = {
    "marked up": ("<title>t</title><nav><a href=x>m</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one  <b>two<br><p>three &eacute;</article><footer>f</footer>", ["A & B", "one two", "three é"]),
    "plain divs": (f"<div><a href=a>Home</a><a href=b>News</a></div><div><h1>Title</h1><p>{A}</p><p>{B}</p><p>Short.</p></div><div>Copyright 2020</div>", ["Title", A, B, "Short."]),
    "misleading class": (f"<div class='menu-of-the-day'><h1>T</h1><p>{A}</p><p>{B}</p></div><div>foot</div>", ["T", A, B]),
    "misleading id": (f"<div id='privacy-notice-explained'><p>{A}</p><p>{B}</p></div><div class='footer'>f</div>", [A, B]),
    "class of the article": (f"<nav>n</nav><div class='article-related'><p>{A}</p><p>{C}</p></div>", [A, C]),
    "references": (f"<article><p>{A}</p><ul><li><a href=x>Ref one</a><li><a href=y>Ref two</a></ul></article><nav><a href=q>n</a></nav>", [A, "Ref one", "Ref two"]),
    "references in divs": (f"<div><a href=1>x</a><a href=2>y</a></div><div><p>{A}</p><ul><li><a href=x>Ref one</a><li><a href=y>Ref two</a></ul><p>{B}</p></div>", [A, "Ref one", "Ref two", B]),
    "two articles": (f"<article><p>{A}</p></article><article><p>{D}</p></article><footer>f</footer>", [A, D]),
    "comments": (f"<div><p>{C}</p><p>{B}</p></div><div id=comments><p>{D}</p><p>{D}</p></div>", [C, B]),
    "form around all": (f"<form id=aspnet><div><a href=1>x</a><a href=2>y</a></div><div><p>{A}</p><p>{B}</p></div></form>", [A, B]),
    "flat": (f"<ul><li><a href=1>x</a><li><a href=2>y</a></ul><h1>Head</h1><p>{A}</p><p>ok</p><p>{B}</p><div>Copyright 2020</div>", ["Head", A, "ok", B]),
    "title outside": (f"<h1>The title</h1><div>by me</div><div><p>{A}</p><p>{B}</p></div><div>foot</div>", ["The title", A, B]),
    "short article, long footer": (f"<article><h1>Hm</h1><p>one</p></article><footer>{A}</footer>", ["Hm", "one"]),
    "a < b, quotes": (f"<p title='x > y'>1 < 2 {A}</p><p>{B}</p><a \"x", [f"1 < 2 {A}", B]),
}


_S = lambda n, w: " ".join(f"{w}{k} sentence number {k} of the text." for k in range(n))
E, G, H = _S(9, "a"), _S(8, "b"), _S(7, "c")
#: Names that mislead in pages with an article or main element: the text overrules them.
PAGES |= {
    "no-sidebar in main": (f"<nav><a href=1>n</a></nav><main><h1>T</h1><div class='content no-sidebar'><p>{E}</p><p>{G}</p></div></main><footer>f</footer>", ["T", E, G]),
    "post social": (f"<article><div class='post social'><p>{E}</p><p>{G}</p></div></article><footer>x</footer>", [E, G]),
    "social-share": (f"<article><header><h1>T</h1></header><div class='body-with-social-share'><p>{E}</p><p>{G}</p></div></article>", ["T", E, G]),
    "form in main": (f"<main><form id='aspnetForm'><p>{E}</p><p>{G}</p></form></main>", [E, G]),
    "ad-free in main": (f"<main><section class='ad-free'><p>{E}</p><p>{G}</p></section></main>", [E, G]),
    "related-work": (f"<article><h1>T</h1><p>{E}</p><section class='related-work'><h2>Related</h2><p>{G}</p><p>{H}</p></section></article>", ["T", E, "Related", G, H]),
    "parts of an article that are none of it": (
        f"<article><h1>T</h1><p>{E}</p><div class='ad'>Buy this now, it is cheap</div><p>{G}</p><div class='related'><ul><li><a href=1>{_S(2, 'r')}</a><li><a href=2>{_S(2, 'q')}</a></ul></div><div class='comments'><p>{H}</p><p>{H}</p></div></article>",
        ["T", E, G],
    ),
    "sidebar in the page's name": (f"<div class='page with-sidebar'><article><p>{E}</p><p>{G}</p></article><div class='sidebar'><p>{_S(1, 'x')}</p></div></div>", [E, G]),
    "sidebar longer than the article": (f"<article><h1>T</h1><p>short one here.</p></article><div class='sidebar'><p>{E}</p><p>{G}</p></div>", ["T", "short one here."]),
}


@pytest.mark.parametrize("name", PAGES)
def test_html(name):
    page, want = PAGES[name]
    assert htmltext.main_text(page).split("\n") == want


def test_html_edges(spark):
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<script>x</script>") == ""
    assert htmltext.main_text("<p>" * 3000 + "deep") == "deep"  # no recursion
    rows = [(1, "u", PAGES["flat"][0], "x", 5), (2, None, None, None, None), (1, "u", PAGES["flat"][0], "x", 5), (None, "v", "", "y", 1)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    flat = "\n".join(PAGES["flat"][1])
    assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(page_id=i, url=u, text=t, n_chars=len(t)) for i, u, t in [(1, "u", flat), (2, None, ""), (1, "u", flat), (None, "v", "")]]))


def test_density_decides():
    """The same page, but for the words' places: what is dense is kept, with no names to go by."""
    thin = "".join(f"<div><a href=x>{w}</a></div>" for w in A.split()[:20])
    for first, second in ((f"<div><p>{A}</p><p>{B}</p></div>", f"<div>{thin}</div>"), (f"<div>{thin}</div>", f"<div><p>{A}</p><p>{B}</p></div>")):
        assert htmltext.main_text(first + second) == f"{A}\n{B}"


def test_hostile_pages_take_linear_time():
    import time

    for page in ('<a "x ' * 80_000, '<a b="x ' * 60_000, "<!-- " * 90_000, "<" * 400_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 30_000, "<a " + "=" * 400_000, "<title>" * 70_000):
        began = time.perf_counter()
        htmltext.main_text(page)
        assert time.perf_counter() - began < 10, page[:20]


def test_mixing_meets_budgets(docs):
    weights = {"domain": {"d0": 3, "d1": 1}, "lang": {}, "source": {}}
    out = mix(docs, weights, budget_share=0.5, max_epochs=2).select("record.doc_id", "domain", "lang", "source", "n_tokens", "epoch").collect()
    total = sum(len(WORD.findall(r.text or "")) for r in docs.collect())
    assert 0 < sum(r.n_tokens for r in out) <= total // 2 and max(r.epoch for r in out) <= 2
    again = mix(docs, weights, budget_share=0.5, max_epochs=2).select("record.doc_id", "domain", "lang", "source", "n_tokens", "epoch").collect()
    assert Counter(out) == Counter(again)
    whole = mix(docs, {"domain": "supply", "lang": "supply", "source": "supply"}, budget_share=1.0, max_epochs=1)
    assert whole.where("n_tokens > 0").count() == sum(1 for r in docs.collect() if WORD.search(r.text or ""))


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path()).encode
    got = pack(docs, tokenizer_path(), length=64, docs_per_group=20).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*encode(t or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 64):
            want[(i, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert first_fit_decreasing(np.array([5, 4, 3, 2, 1]), 6)[0].tolist() == [0, 1, 2, 1, 0]


def test_interval_expansion():
    r = np.random.default_rng(1)
    for k in range(12):
        t = r.integers(97, 99 + k % 4, 200 + 20 * k).astype(np.uint8)
        t, n = np.concatenate((t, t[20:90], np.zeros(3, np.uint8))), (3, 5, 12)[k % 3]
        b, got = t.tobytes(), suffix.repeated(t, n)
        c = Counter(b[i : i + n] for i in range(len(b) - n + 1))
        assert all(got[i] == (c[b[i : i + n]] > 1) for i in range(len(b) - n + 1))


@pytest.mark.parametrize(("hot", "n"), [(20_000, 60), (2, 60), (2, 400)])
def test_substring_dedup(docs, rows, hot, n, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "hot_above", lambda total: hot)  # keys above it are spread
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[k : k + n] for _, b in raw for k in range(len(b) - n + 1))
    want = Counter()
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    assert Counter(tuple(r) for r in substring_dedup(docs, length=n, kmer=16).collect()) == want


def test_line_dedup(docs, rows):
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        lines = (t or "").split("\n") if t is not None else []
        for k in range(len(lines) - 2):
            first.setdefault(tuple(lines[k : k + 3]), (i, k))
    got = {(r.doc_id, r.n_chars): r for r in line_dedup(docs).collect()}
    for i, t, *rest in rows:
        if i is None or t is None:
            continue
        lines = t.split("\n")
        gone = {k + d for k in range(len(lines) - 2) if "".join(lines[k : k + 3]).strip(" ") and first[tuple(lines[k : k + 3])] != (i, k) for d in range(3)}
        r = got[(i, rest[2])]
        assert (r.text, r.n_removed_lines, r.n_lines) == ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone), len(lines))


def test_unit_dedup(docs, rows):
    got = repeated_units(docs, min_words=5)
    first = {}
    norm = lambda x: re.sub("[\x20\x09-\x0d]+", " ", x).strip(" ").lower()
    want, text = set(), {i: t for i, t, *_ in rows}
    for i, t in sorted(((i, t) for i, t, *_ in set(rows) if t), key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, x in enumerate(t.split("\n")):
            if len(norm(x).split(" ")) >= 5 and norm(x):
                if first.setdefault(norm(x), (i, k)) != (i, k):
                    want.add((i, k, len("\n".join(t.split("\n")[:k])) + (k > 0), len(x), *first[norm(x)]))
    assert {(r.doc_id, r.unit, r.start, r.length, r.kept_doc_id, r.kept_unit) for r in got.collect()} == want
    for r in remove_units(docs, got).where("size(removed_spans) > 0").collect():
        t, at, out = text[r.doc_id], 0, ""
        for s in r.removed_spans:
            out, at = out + t[at : s.start], s.start + s.length
        assert r.text == out + t[at:]


def test_sharding(docs, rows):
    got = shuffled(docs, shards=8, bucket_bytes=4096, columns=["doc_id"]).collect()
    assert len(got) == len(rows) and Counter((r.record.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for k in range(8):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 8) < 1


def brute_components(rows):
    """Shingle sets and roots by all pairs."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return sets, root


@pytest.mark.parametrize("bounds", [(500_000, 20_000, 4096), (0, 20_000, 3), (0, 0, 2)])
def test_near_duplicates(docs, rows, bounds, monkeypatch):
    for name, value in zip(("BROADCAST_ROWS", "DEAREST", "CHUNK"), bounds, strict=True):
        monkeypatch.setattr(jaccard, name, value)
    sets, root = brute_components(rows)
    want = Counter((i, len(s), min([rows[k][0] for k in range(len(rows)) if root[k] == root[r] and rows[k][0] is not None], default=None)) for r, ((i, *_), s) in enumerate(zip(rows, sets, strict=True)))
    assert Counter(tuple(r) for r in near_duplicates(docs).collect()) == want


def test_pipeline(spark, docs, tmp_path):
    """Each stage against brute force on what the stage before it kept."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars", "id")
    more = [(2000 + k, f"shared opening line {k % 3}\nand its second line\nand a third one\n" + " ".join(f"w{k}x{j}" for j in range(25)), "en", f"src{k % 5}", 1, None) for k in range(20)]
    plain = plain.unionByName(spark.createDataFrame(more, plain.schema))
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = left.collect()
        out = stage(spark, left, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        got = left.collect()
        if name != "packing":
            assert left.columns == plain.columns
        if name == "quality_rules":
            assert Counter(got) == Counter(r for r in before if verdict(r.text or "")[1]) and len(got) > 20
        elif name == "line_dedup":
            first, want = {}, Counter()
            lines = {(r.doc_id, r.text): r.text.split("\n") for r in before}
            for (i, t), x in sorted(lines.items(), key=lambda kv: (kv[0][0] is not None, kv[0][0] or 0)):
                for k in range(len(x) - 2):
                    first.setdefault(tuple(x[k : k + 3]), (i, t, k))
            for r in before:
                x = lines[r.doc_id, r.text]
                gone = {k + d for k in range(len(x) - 2) if "".join(x[k : k + 3]).strip(" \t\r\x0b\x0c") and first[tuple(x[k : k + 3])] != (r.doc_id, r.text, k) for d in range(3)}
                t = "\n".join(v for k, v in enumerate(x) if k not in gone)
                if not gone or t:
                    want[(r.doc_id, t, r.lang, r.source, len(t), r.id)] += 1
            assert Counter(map(tuple, got)) == want and any(len(t) != len(u) for (_, t, *_), (_, u, *_) in zip(sorted(want, key=str), sorted(map(tuple, before), key=str)))
        elif name == "near_duplicates":
            _, root = brute_components(before)
            least = {r: min((before[k].doc_id for k in range(len(before)) if root[k] == r and before[k].doc_id is not None), default=None) for r in set(root)}
            assert Counter((r.doc_id, r.text) for r in got) == Counter({(r.doc_id, r.text): 1 for k, r in enumerate(before) if r.doc_id == least[root[k]]})
        elif name == "mixing":
            n = lambda rows: sum(len(WORD.findall(r.text)) for r in rows)
            copies = Counter(got)
            assert set(copies) <= set(before) and max(copies.values()) <= 2 and 0 < n(got) <= 0.9 * n(before)
        else:
            encode, want = Tokenizer.from_file(tokenizer_path()).encode, Counter()
            for r in before:
                ids = [*encode(r.text or "", add_special_tokens=False).ids, 2]
                want[(r.doc_id, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids))] += 1
            assert Counter((r.doc_id, r.ids_crc32, r.doc_tokens) for r in got) == want  # texts here fit one piece
            assert sum(r.length for r in got) > 0 and all(r.offset + r.length <= 4096 for r in got)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == left.count() > 0


def test_token_ids(monkeypatch, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from tidewell.llm import bpe
    from tidewell.llm.common import buffers

    monkeypatch.setattr(bpe, "TABLE", 5)
    plain = Tokenizer.from_file(tokenizer_path())
    r = random.Random(6)
    odd = "\u0130\u0958\u095f\u09dc\ufb1d\ufb2a\u212aÉßǅµ\u0301'0٣日\u00a0\u1680"
    cases = [f"{a}{c}{m}" for c in odd for a in ("", "a", "Été") for m in ("", ",", ".a", "!'s")]
    cases += ["aaaaaaaaa", "x" * 300, "zz" * 90, "we'll've 'S", "<|endoftext|>a <| b", "12ab34", "$$$--..", None, "", " \t\n", "To$$$ \x1f\x0b\x85e"]
    cases += ["".join(r.choice("abcdé ABC.,'1$\n" + odd) for _ in range(r.randint(1, 80))) for _ in range(400)]
    data, offs = buffers(pa.array(cases))
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in cases]
    ids, b = bpe.BatchEncoder(tokenizer_path()).texts(data, offs, 2)
    assert [ids[x:y].tolist() for x, y in zip(b[:-1], b[1:])] == want
    encode = bpe.BatchEncoder(tokenizer_path())
    assert encode.fast
    encode.fast = False  # as for tokenizers of another shape
    ids, b = encode.texts(data, offs, 2)
    assert [ids[x:y].tolist() for x, y in zip(b[:-1], b[1:])] == want
    other = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, "ab": 2}, merges=[("a", "b")]))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    other.save(f"{tmp_path}/other.json")
    assert not bpe.BatchEncoder(f"{tmp_path}/other.json").fast


def test_paragraphs(docs, rows):
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    first, want = {}, set()
    for i, t in sorted(((i, t) for i, t, *_ in set(rows) if t), key=lambda r: (r[0] is not None, r[0] or 0)):
        at = 0
        for k, m in enumerate([*re.finditer("\n[\x20\x09-\x0d]*\n", t), None]):
            x = t[at : m.start() if m else len(t)]
            if norm(x) and first.setdefault(norm(x), (i, k)) != (i, k):
                want.add((i, k, at, len(x), *first[norm(x)]))
            at = m.end() if m else 0
    got = repeated_units(docs, unit="paragraph")
    assert {(r.doc_id, r.unit, r.start, r.length, r.kept_doc_id, r.kept_unit) for r in got.collect()} == want


def test_passages_are_caught_at_any_offset(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(44) for _ in range(40)]  # span + pick - 1 words
    data = [(2 * k + side, prose(r.randrange(60)) + " " + s.replace(" ", "\n" if side else " ", 3 * side).upper() + "  " + prose(r.randrange(60)), "x") for k, s in enumerate(shared) for side in (0, 1)]
    data += [(900, None, ""), (901, "", None), (902, "| " * 200, "y"), (903, prose(400), "z"), (902, "| " * 200, "y"), (904, prose(30), "z")]
    got = repeated_units(spark.createDataFrame(data, "doc_id long, text string, unit string"), unit="passage").collect()
    assert {x.doc_id for x in got} == {2 * k + 1 for k in range(40)} | {902} and all(x.kept_doc_id == x.doc_id - 1 for x in got if x.doc_id < 900)
    text = {i: t for i, t, _ in data}
    norm = lambda t: " ".join(WORD.findall(t)).lower()
    for x in got:
        part = norm(text[x.doc_id][x.start : x.start + x.length])
        assert len(part.split(" ")) == 25 and part == " ".join(norm(text[x.kept_doc_id]).split(" ")[x.kept_unit : x.kept_unit + 25])
    df = spark.createDataFrame(data, "doc_id long, text string, unit string")
    cut = {x.doc_id: x for x in remove_units(df, repeated_units(df, unit="passage")).collect()}
    assert cut[902].text.split() == ["|"] * 44 and cut[903].text == text[903] and cut[900].text is None


def test_line_windows_of_white_space_do_not_count(spark):
    data = [(1, "a\n\t\n\r\n \x0b\x0c\nb", 0), (2, "c\n\t\n\r\n \x0b\x0c\nd", 0), (3, "x\ny\nz\t\n", 0), (4, "x\ny\nz\t\nw", 0)]
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in line_dedup(spark.createDataFrame(data, "doc_id long, text string, n_lines int")).collect()}
    assert got == {1: (data[0][1], 0), 2: (data[1][1], 0), 3: (data[2][1], 0), 4: ("w", 3)}


def test_mixing_passes_on_what_weighs_nothing(spark):
    data = [(i, "w " * 10, "en", "src0") for i in range(200)] + [(1000 + i, "w " * 10, "fr", "src1") for i in range(200)] + [(None, None, None, None), (5000, "", "en", "src0")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    tokens = lambda w, **kw: sum(r.n_tokens for r in mix(df, w, **kw).collect())
    # fr is all that d1 has, and weighs nothing: its share goes to d0, which has 2000 tokens an epoch
    assert tokens({"domain": {"d0": 1, "d1": 1}, "lang": {"fr": 0}, "source": {}}, budget_share=0.25, max_epochs=2) == 1000
    assert tokens({"domain": {"d0": 1, "d1": 1}, "lang": {"fr": 0}, "source": {}}, budget_share=5.0, max_epochs=2) == 4000
    assert tokens({"domain": {"d0": 1, "d1": 1}, "lang": {}, "source": {"src0": 0}}, budget_share=1.0, max_epochs=1) == 2000
    assert tokens({"domain": {"d0": 0, "d1": 0, "other": 0}, "lang": {}, "source": {}}) == 0
    assert tokens({"domain": {"d0": 3, "d1": 1}, "lang": {}, "source": {}}, budget_share=0.5, max_epochs=1) == 2000  # 1500 and 500


def test_sharding_places_alike_under_any_partitions(spark, docs):
    def placed(n, df):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return Counter((r.record.doc_id, r.text_crc32, r.shard, r.slot) for r in shuffled(df, shards=8, seed=3, bucket_bytes=2048).collect())

    try:
        first = placed("4", docs)
        assert first == placed("7", docs.repartition(11)) == placed("4", docs.coalesce(1))
        assert first != Counter((r.record.doc_id, r.text_crc32, r.shard, r.slot) for r in shuffled(docs, shards=8, seed=4, bucket_bytes=2048).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def verdict(t):
    w = WORD.findall(t)
    win = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + d for k in range(len(w) - 7) if win[tuple(w[k : k + 8])] > 1 for d in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    chars = sum(map(len, w))
    base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    more = [
        10 * sum(c in "#*$%&|<>" for c in t) > len(w), sum("A" <= c <= "Z" for c in t) > sum("a" <= c <= "z" for c in t), 5 * t.count("!") > len(w),
        2 * (len(lines) - len(set(lines))) > len(lines), 5 * sum(a == b for a, b in zip(w, w[1:])) > len(w), chars < 2 * len(w) or chars > 40 * len(w),
    ]
    return base, not base and not any(more)


def test_quality_cascade_keeps_what_no_rule_rejects(spark, docs, rows):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 9)))
    extra = [" ".join(r.choice([word(), word().upper(), "!", "#", "dup", "x" * 60]) if r.random() < p else word() for _ in range(r.randint(15, 80))) for p in (0.02, 0.1, 0.3, 0.6) for _ in range(40)]
    extra += ["\n".join([word() + " " + word()] * 3 + [word() + str(k) for k in range(k)]) + " " + " ".join(word() for _ in range(30)) for k in range(12)] + ["Å" * 50 + " ab" * 30, "very " * 3 + " ".join(word() for _ in range(40))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    text = {10_000 + k: t for k, t in enumerate(extra)} | {i: t or "" for i, t, *_ in rows}
    report = quality_report(df).collect()
    assert all((x.base_failed, x.kept) == verdict(text[x.doc_id]) for x in report) and {x.kept for x in report if not x.base_failed} == {True, False}
    assert Counter(x.doc_id for x in quality_filter(df).collect()) == Counter(x.doc_id for x in report if x.kept)


def test_hot_lines_are_spread(docs, rows, monkeypatch):
    plain = {tuple(r) for r in repeated_units(docs).collect()}
    monkeypatch.setattr(repeats, "hot_above", lambda total: 2)
    assert {tuple(r) for r in repeated_units(docs).collect()} == plain and plain


def test_dear_signatures_lose_no_link():
    """Sets kept to as few signatures as they need still meet, whatever costs are told."""
    r, bands = np.random.default_rng(5), jaccard.Bands(80)
    met = 0
    for k in range(300):
        n = int(r.integers(5, 400))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        drop = int(r.integers(0, max(1, len(a) // 9) + 1))
        b = np.unique(np.concatenate((a[r.permutation(len(a))[drop:]], r.integers(0, 1 << 63, drop, dtype=np.uint64))))
        linked = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        every = jaccard.signatures(a, bands)
        some = np.sort(r.permutation(every)[: max(1, len(every) // 2)])
        dear = (some, r.integers(1, 50, len(some)))
        if linked:
            met += 1
            assert len(np.intersect1d(jaccard.signatures(a, bands, dear=dear), jaccard.signatures(b, bands, dear=dear))), (k, n, drop)
    assert met > 150


def test_samples_come_from_a_few_files(spark, docs, tmp_path):
    from tidewell.llm.common import some_files

    docs.repartition(9).write.parquet(f"{tmp_path}/many files")
    many = spark.read.parquet(f"{tmp_path}/many files")
    few = some_files(many, most=3)
    assert 0 < few.count() < many.count() and len(few.select("_metadata.file_path").distinct().collect()) <= 3 and few.columns == many.columns
    assert some_files(many, most=9) is many and some_files(docs, most=0) is docs
    assert some_files(many.groupBy("doc_id").count(), most=3).count() == many.select("doc_id").distinct().count()
