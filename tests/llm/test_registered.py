"""The corpus operators' registered queries: their SQL, and what they must not leave out."""

import math
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewell.llm import graph, sharding
from tidewell.llm import queries as corpus
from tidewell.llm.common import prepare
from tidewell.llm.topk import top_k

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}).getOrCreate()


@pytest.mark.parametrize("name", sorted(corpus.ORACLES))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(DATA):
        duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = corpus.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({corpus.ORACLES[name]})").fetchall()
    assert got == sorted(tuple(str(v) for v in r) for r in want)


def test_short_lines_are_deduplicated(spark, tmp_path):
    lines = ["Same two", "words of their own here 1", "same  TWO", "x", "", "words of their own here 2", "x"]
    docs = [(1, "\n".join(lines[:4])), (2, "\n".join(lines[3:])), (3, None), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in corpus.QUERIES["unit_dedup_lines"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(1, "line", 2, 35, 9, 1, 0), (2, "line", 0, 0, 1, 1, 3), (2, "line", 3, 29, 1, 1, 3)]
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got) == sorted(duckdb.sql(corpus.ORACLES["unit_dedup_lines"]).fetchall())


def test_sharding_reports_what_was_written(spark, tmp_path, monkeypatch):
    docs = [(i, f"text {i} é" * (i % 4) if i % 9 else None, "s") for i in range(100)] + [(None, "no id", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda: [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in corpus.QUERIES["op9_sharding"](spark, str(tmp_path)).collect()]
    want = lambda lost: sorted(((i or -1), len((t or "").replace(lost, "").encode()) + 1, zlib.crc32((t or "").replace(lost, "").encode())) for i, t, _ in docs)
    key = lambda rows: sorted((r[0] or -1, *r[1:3]) for r in rows)
    got = run()
    assert key(got) == want("\0") and all(sorted(r[4] for r in got if r[3] == k) == list(range(sum(r[3] == k for r in got))) for k in range(8))
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda df, *a, **o: write(df.withColumn("text", F.replace("text", F.lit("é"), F.lit(""))), *a, **o))
    assert key(run()) == want("é")  # a text changed on the way shows


@pytest.mark.parametrize("top", [5e5, 4e7, 3e9])
def test_top_k_keeps_large_components(spark, top):
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (60, 5))
    x[10:20] *= top / 100 / np.abs(x[10:20]).max()
    x[20] = [top, 0, 0, 0, 0]
    x[21] = [-1, 0, 0, 0, top]
    data = [(i, [float(e) for e in v]) for i, v in enumerate(x)] + [(20, [top * 2, 0.0, 0.0, 0.0, 0.0]), (70, [float("inf")] * 5), (71, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    whole = {i: tuple(math.floor(256 * e) for e in v) for i, v in reversed(data[:61])}
    want = set()
    for q in (0, 5, 15, 20, 21):
        s = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:4]
        want |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s)}
    if max(abs(x) for *_, x in want) < 1 << 63:
        got = top_k(df, df.where("vec_id in (0, 5, 15, 20, 21)"), k=4, rows_per_block=16, queries_per_block=2)
        assert {tuple(r) for r in got.collect()} == want
    else:
        with pytest.raises(Exception, match="64 bits"):
            top_k(df, df.where("vec_id in (0, 5, 15, 20, 21)"), k=4).collect()


@pytest.mark.parametrize("blind", [False, True])
def test_components_settle_or_raise(spark, monkeypatch, blind):
    n = 120
    order = np.random.default_rng(4).permutation(n).tolist()
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501), (501, 502)], "a long, b long").coalesce(2)
    if blind:  # every round looks like the one before by count and sum of hashes
        monkeypatch.setattr(graph.F, "xxhash64", lambda *c: F.lit(0))
    prepare(spark)
    assert {tuple(r) for r in graph.components(edges).collect()} == {(i, 0) for i in range(n)} | {(500, 500), (501, 500), (502, 500)}
    with pytest.raises(RuntimeError, match="not settled"):
        graph.components(edges, rounds=1)
