"""Policies through derivation, and the columns that queries read."""

import pytest
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.governance import Catalog, Policy, Principal

ANALYST, STEWARD, OWNER = Principal("analyst", user="ann"), Principal("steward"), Principal("owner")


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}).getOrCreate()


@pytest.fixture()
def catalog(spark):
    c = Catalog()
    people = spark.createDataFrame([(1, 10, "ann@x.example", "Ann", 3), (2, 20, "bob@x.example", "Bob", 4), (3, 10, "cy@x.example", "Cy", 5)], "k int, store int, mail string, person string, n int")
    rights = spark.createDataFrame([("analyst", 10), ("steward", 10), ("steward", 20)], "role string, store int")
    c.put("people", people, Policy(rows=("store", rights), masks={"mail": fn.mask_email, "person": fn.mask_name}))
    c.put("stores", spark.createDataFrame([(10, "a"), (20, "b")], "id int, label string"), Policy(rows=("id", rights.withColumnRenamed("store", "id"))))
    return c


def _derive(c, make, who, raw=False, parents=("people",)):
    """Both ways to build on a table: on the frame that was put, and on the marked one."""
    base = c._tables["people"][0] if raw else c.build("people")
    c.put("d", make(base), parents=parents)
    return sorted(tuple(r) for r in c.read("d", who).collect())


@pytest.mark.parametrize("raw", [False, True])
def test_a_renamed_column_keeps_its_mask(catalog, raw):
    make = lambda p: p.where("n > 1").select("store", F.col("mail").alias("e"), "n").withColumnRenamed("e", "address")
    assert all(len(a) == 64 for _, a, _ in _derive(catalog, make, ANALYST, raw)) and len(_derive(catalog, make, ANALYST, raw)) == 2
    assert _derive(catalog, make, STEWARD, raw)[0] == (10, "ann@x.example", 3)
    rows = catalog._tables["people"][1].rows
    catalog.put("own", make(catalog._tables["people"][0] if raw else catalog.build("people")), Policy(rows=rows), parents=("people",))
    assert all("@" not in r.address for r in catalog.read("own", ANALYST).collect())  # a row policy of its own lifts no mask


@pytest.mark.parametrize("raw", [False, True])
def test_combined_and_aggregated_columns(catalog, raw):
    make = lambda p: p.select("store", F.concat("mail", F.lit(" "), "person").alias("both"), F.upper("person").alias("up"), (F.col("n") + 1).alias("m"), F.lit("x").alias("one"))
    assert _derive(catalog, make, ANALYST, raw) == [(10, None, None, 4, "x"), (10, None, None, 6, "x")]
    assert (10, "ann@x.example Ann", "ANN", 4, "x") in _derive(catalog, make, STEWARD, raw)
    make = lambda p: p.groupBy("store").agg(F.max("person").alias("last"), F.countDistinct("mail").alias("mails"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    assert _derive(catalog, make, ANALYST, raw) == [(10, "C*", None, 2, 8)]
    w = Window.partitionBy("store").orderBy("n")
    make = lambda p: p.select("store", F.lag("mail").over(w).alias("before"), F.row_number().over(w).alias("at"))
    assert _derive(catalog, make, ANALYST, raw) == [(10, None, 1), (10, None, 2)]


def test_joined_unioned_and_exploded_columns(catalog):
    joined = lambda p: p.join(catalog.build("stores"), F.col("store") == F.col("id")).select("id", "label", F.col("mail").alias("m"))
    got = _derive(catalog, joined, ANALYST, parents=("people", "stores"))  # the key of people went, that of stores does not stand for it
    assert got == []
    joined = lambda p: p.join(catalog.build("stores"), F.col("store") == F.col("id")).select("id", "store", "label", F.col("mail").alias("m"))
    assert [(a, b, c, len(m)) for a, b, c, m in _derive(catalog, joined, ANALYST, parents=("people", "stores"))] == [(10, 10, "a", 64)] * 2
    itself = lambda p: p.alias("a").join(p.alias("b"), F.col("a.store") == F.col("b.store")).select(F.col("a.store").alias("s"), F.col("b.mail").alias("other"))
    assert {len(m) for _, m in _derive(catalog, itself, ANALYST)} == {64}
    union = lambda p: p.select("store", F.lit("none").alias("x")).unionByName(p.select("store", F.col("mail").alias("x")))
    assert {x for _, x in _derive(catalog, union, ANALYST)} == {None}
    exploded = lambda p: p.select("store", F.explode(F.split("mail", "@")).alias("part"))
    assert {x for _, x in _derive(catalog, exploded, ANALYST)} == {None}
    scalar = lambda p: p.select("store", F.lit(1).alias("i")).where(F.lit(True))
    assert _derive(catalog, scalar, ANALYST) == [(10, 1), (10, 1)]


def test_what_cannot_be_told_is_shut(catalog, spark):
    python = lambda p: p.mapInPandas(lambda it: (x[["store", "mail"]].rename(columns={"mail": "z"}) for x in it), "store int, z string")
    assert _derive(catalog, python, ANALYST) == []  # the row key's origin is lost too
    rights = catalog._tables["people"][1].rows
    catalog.put("p", python(catalog.build("people")), Policy(rows=rights), parents=("people",))
    assert {tuple(r) for r in catalog.read("p", ANALYST).collect()} == {(None, None)} or catalog.read("p", ANALYST).columns == ["store", "z"]
    assert {r.z for r in catalog.read("p", ANALYST).collect()} == {None} and {r.z for r in catalog.read("p", STEWARD).collect()} != {None}
    strange = spark.createDataFrame([(10, "leak")], "store int, note string")
    catalog.put("s", strange, Policy(rows=rights), parents=("people",))
    assert [r.note for r in catalog.read("s", ANALYST).collect()] == [None]
    spark.conf.set("spark.sql.crossJoin.enabled", "true")
    catalog.build("people").createOrReplaceTempView("people_v")
    sub = spark.sql("select store, (select max(mail) from people_v) as top from people_v")
    catalog.put("q", sub, parents=("people",))
    assert {r.top for r in catalog.read("q", ANALYST).collect()} == {None}


def test_policies_go_through_two_derivations(catalog):
    catalog.put("first", catalog.build("people").select(F.col("store").alias("shop"), F.col("mail").alias("a")), parents=("people",))
    catalog.put("second", catalog.build("first").select(F.col("a").alias("b"), F.col("shop").alias("where")), parents=("first",))
    assert {(len(r.b), r["where"]) for r in catalog.read("second", ANALYST).collect()} == {(64, 10)} and catalog.read("second", Principal("guest")).count() == 0
    catalog.clone("second", "copy")
    assert {len(r.b) for r in catalog.read("copy", ANALYST).collect()} == {64}


def test_reads_are_those_of_the_queries_that_ran(catalog, spark, tmp_path):
    with catalog.watch(spark):
        people = catalog.read("people", OWNER)
        people.select("k")  # not run
        people.where("n > 3").select("k").collect()
        catalog.read("people", ANALYST).groupBy("person").agg(F.count(F.lit(1)).alias("c")).orderBy("c").select("c").count()
        people.join(catalog.read("stores", OWNER), F.col("store") == F.col("id")).select("label").write.parquet(f"{tmp_path}/out")
        people.withColumn("r", F.row_number().over(Window.partitionBy("store").orderBy("k"))).select("n").collect()
    got = {(r.reader, r.table_name, r.column_name): r.reads for r in catalog.column_reads(spark).collect()}
    assert got[("owner", "people", "k")] == 1 and got[("owner", "people", "n")] == 2
    assert got[("ann", "people", "person")] == 1 and got[("ann", "people", "store")] == 1  # the row policy reads its key
    assert got[("owner", "stores", "id")] == got[("owner", "stores", "label")] == got[("owner", "people", "store")] == 1
    assert not any(c == "mail" for _, _, c in got)
