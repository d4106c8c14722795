"""What the registered queries must not leave out: whole tables against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell import operators as op
from tidewell import plans, registry  # noqa: F401


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}).getOrCreate()


def test_nearest_sees_all_rows(spark):
    r = np.random.default_rng(8)
    x = r.normal(0, 1, (300, 6))
    x[250:] = x[:50]
    data = [(i, i % 3 if i % 7 else None, [float(e) for e in v]) for i, v in enumerate(x)] + [(900, 1, None), (901, 2, [0.0] * 6)]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    sim = np.round(unit @ unit.T, 5)
    want = set()
    for i in range(300):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-sim[i, j], j))[:3]
        want |= {(i, j, sim[i, j]) for j in order}
    got = op.nearest(df, 3, rows_per_block=64).select("vec_id", "neighbour", "sim").where("vec_id < 300").collect()
    assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want} and np.allclose(sorted(s for *_, s in got), sorted(s for *_, s in want))
    assert op.nearest(df, 3, rows_per_block=64).where("vec_id >= 900 and sim is null").count() == 6
    label = lambda i: data[i][1]
    pairs = {}
    for i in range(300):
        for j in range(i + 1, 300):
            k = None if label(i) is None or label(j) is None else label(i) == label(j)
            n, s = pairs.get(k, (0, 0))
            pairs[k] = (n + 1, s + round(sim[i, j] * 1e5))
    got = op.pair_units(df.where("vec_id < 900"), rows_per_block=64).groupBy("same_label").sum("n", "sim_units").collect()
    assert {k: (n, s) for k, n, s in got} == pairs


def test_hash_vector_of_words_and_pairs(spark):
    docs = [("Late order, LATE rider", "en"), ("commande en retard", None), ("a 1 !", "fr"), ("", "de"), (None, "en")]
    got = [r.v for r in spark.createDataFrame(docs, "text string, lang string").coalesce(1).select(fn.hash_vector("text").alias("v")).collect()]
    grams = [["late", "order", "late", "rider", "late_order", "order_late", "late_rider"], ["commande", "en", "retard", "commande_en", "en_retard"], [], [], []]
    for v, g in zip(got, grams, strict=True):
        want = [0.0] * 256
        for x in g:
            h = int(hashlib.md5(x.encode()).hexdigest()[:16], 16)
            want[h % 256] += 1 if (h >> 32) & 1 else -1
        norm = math.sqrt(sum(x * x for x in want)) or 1.0
        assert v == pytest.approx([x / norm for x in want])


def test_hash_vector_takes_every_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = registry.QUERIES["hash_vector_text"](spark, "/root/testdata/sf0.001")
    assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count() and got.count() == 256 * docs.count()


def test_containment_of_many_short_items(spark, tmp_path):
    items = [(i, f"w{i}") for i in range(10_500)] + [(20_000 + i, f"a{i} b c") for i in range(20)] + [(30_000, "b c d e"), (30_001, "in\tner  x y z"), (30_002, ""), (30_003, None), (30_004, "ner one"), (30_005, "ner one two thr")]
    docs = [(0, " ".join(f"w{i}" for i in range(0, 10_500, 2))), (1, " ".join(f"w{i}" for i in range(1, 10_500, 2))), (2, "za5 b c d ef in\tner  x y zz"), (3, None), (4, "inner one two three"), (5, "")]
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["containment_join"](spark, str(tmp_path)).collect())
    assert got == sorted((i, d) for i, n in items for d, t in docs if n is not None and t is not None and n in t) and len(got) > 10_500


def test_models_score_every_labelled_row(spark):
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/documents.parquet").join(spark.read.parquet(f"{data}/labels.parquet").where("quality is not null"), "doc_id")
    n, base = rows.agg(F.count(F.lit(1)), F.avg("quality")).first()
    risk, text = (registry.QUERIES[f"{m}_model_metrics"](spark, data).first() for m in ("risk", "text"))
    for r in (risk, text):
        assert r.n == n > 0 and r.base_rate == pytest.approx(base) and 0 <= r.brier < 1 and 0 < r.mean_score < 1
    assert risk.mean_score == pytest.approx(base, abs=1e-3)  # an unregularised fit meets the base rate
    assert text.brier < base * (1 - base)
