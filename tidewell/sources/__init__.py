"""Sources and sinks: permissive CSV with rejects, evolving schemas, incremental files, listings."""

from __future__ import annotations

import json
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_with_rejects(spark: SparkSession, path: str, schema: str, **options) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the others as (file, record)."""
    full = T.StructType.fromDDL(schema).add("__bad", T.StringType())
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("record"))
    raw = lines.withColumn("row", F.from_csv("record", full.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", **options}))
    return raw.where("row.__bad is null").select("row.*").drop("__bad"), raw.where("row.__bad is not null").select("file", "record")


def read_evolving(parts: list[DataFrame]) -> DataFrame:
    """Loads by column name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, null: str = "") -> DataFrame:
    return spark.read.options(header=header, nullValue=null, quote='"', escape='"').schema(schema).csv(path)


def read_dated_csv(spark: SparkSession, path: str, schema: str, pattern: str = r"_(\d{8})\.csv", column: str = "name") -> DataFrame:
    """Files queried in place, the day taken from the file's ``name`` or ``path``."""
    df = spark.read.options(header=True).schema(schema).csv(path)
    return df.withColumn("file_day", F.to_date(F.regexp_extract(F.col(f"_metadata.file_{column}"), pattern, 1), "yyyyMMdd"))


def read_ndjson(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """Newline-delimited JSON (gzip too) with its file and modification time; broken lines give null rows."""
    return spark.read.schema(schema).json(paths).withColumns({"src_file": F.col("_metadata.file_name"), "src_modified": F.col("_metadata.file_modification_time")})


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Path, size, time and MD5 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime", F.md5("content").alias("md5"))


def new_files(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose (path, md5) the ledger doesn't have."""
    return found.join(ledger.select("path", "md5").distinct(), ["path", "md5"], "left_anti")


def document_text(content) -> str:
    """Text of a one-page document with uncompressed text operators; an error comes back as text."""
    import re

    try:
        parts = re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*Tj", bytes(content))
        return "\n".join(re.sub(rb"\\([()\\])", rb"\1", p).decode("latin-1") for p in parts)
    except Exception as e:
        return f"__EXTRACT_FAILED__ {type(e).__name__}"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document files with their text (Arrow batches)."""
    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(document_text)

    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"), text("content").alias("body"))


def date_spine(spark: SparkSession, first: str, end: str) -> DataFrame:
    """Days from ``first`` up to, not including, ``end``."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))).alias("day"))


def spine_of(df: DataFrame, column: str) -> DataFrame:
    """The days from a column's first to its last; none of an empty table."""
    ends = df.agg(F.min(column).cast("date").alias("a"), F.max(column).cast("date").alias("b"))
    return ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))


def unload(df: DataFrame, path: str, fmt: str = "parquet", single: bool = False, header: bool = True) -> None:
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").options(header=header).format(fmt).save(path)


def rows(spark: SparkSession, n: int, parts: int | None = None) -> DataFrame:
    """``n`` rows with their number ``seq``, from 0."""
    return spark.range(0, n, 1, parts).select(F.col("id").alias("seq")) if parts else spark.range(n).select(F.col("id").alias("seq"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of text files (gzip too) with their file, its time, and the line's number in it, from 1.

    Lines of a file meet in one task, in the order of its blocks, so files should be of bounded size.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"), F.col("value").alias("record")
    )
    return raw.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("__b", "__i"))).drop("__b", "__i")


def load_csv(spark: SparkSession, path: str | list[str], schema: str, **options) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema with their file and line, and a report of the others: file, line, record, error.

    Nothing is written, so counting the report is a dry run.
    """
    fields = T.StructType.fromDDL(schema)
    full = T.StructType([*fields.fields, T.StructField("__bad", T.StringType())])
    raw = numbered_lines(spark, path).withColumn("row", F.from_csv("record", full.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", **options}))
    text = F.from_csv("record", ", ".join(f"c{k} string" for k in range(len(fields) + 1)), options)
    error = F.when(F.col("__t")[f"c{len(fields)}"].isNotNull(), "too many columns").when(F.col("__t")[f"c{len(fields) - 1}"].isNull(), "too few columns")
    for k, f in enumerate(fields):
        if not isinstance(f.dataType, T.StringType):
            error = error.when(F.col("__t")[f"c{k}"].isNotNull() & F.col("__t")[f"c{k}"].try_cast(f.dataType).isNull(), f"{f.name} is not {f.dataType.simpleString()}")
    bad = raw.where("row.__bad is not null").withColumn("__t", text).select("file", "line", "record", error.otherwise("malformed").alias("error"))
    return raw.where("row.__bad is null").select("row.*", F.col("file").alias("src_file"), F.col("line").alias("src_line")).drop("__bad"), bad


def load_ndjson(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`load_csv`, of JSON lines; a broken line does not stop the load."""
    fields = T.StructType.fromDDL(schema)
    full = T.StructType([*fields.fields, T.StructField("__bad", T.StringType())])
    raw = numbered_lines(spark, path).withColumn("row", F.from_json("record", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    broken = F.col("row.__bad").isNotNull()
    return raw.where(~broken).select("row.*", F.col("file").alias("src_file"), F.col("line").alias("src_line"), F.col("modified").alias("src_modified")).drop("__bad"), raw.where(broken).select("file", "line", "record", F.lit("not of the schema").alias("error"))


def load_report(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows loaded and rejected by file."""
    n = lambda df, c, name: df.groupBy(F.col(c).alias("file")).agg(F.count(F.lit(1)).alias(name))
    return n(good, "src_file", "loaded").join(n(bad, "file", "rejected"), "file", "full_outer").na.fill(0, ["loaded", "rejected"])


def by_name(df: DataFrame, schema: str) -> DataFrame:
    """``df`` as ``schema``, its columns found by name in any case; those it lacks are null, others go."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])


def by_position(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Files in place, their columns c1, c2 and so on."""
    df = spark.read.format(fmt).load(path)
    return df.toDF(*[f"c{k + 1}" for k in range(len(df.columns))])


def infer(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The columns that files tell of: column, type, nullable."""
    found = spark.read.format(fmt).load(path).schema
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in found], "column string, type string, nullable boolean")


def empty_like(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """No rows, with the columns that files tell of: a table's template."""
    return spark.createDataFrame([], spark.read.format(fmt).load(path).schema)


def shared_view(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Another owner's dataset as a view, read in place."""
    spark.read.parquet(path).createOrReplaceTempView(name)
    return spark.table(name)


#: Seeds have declared types.
SEEDS = {
    "category_hierarchy": "category_l1 string, category_l2 string, category_l3 string, shelf_life_days int, needs_cold_chain boolean, pick_priority int",
    "sla_threshold": "store_code string, city string, store_tier string, daypart string, hour_from int, hour_to int, promise_minutes int, breach_tolerance_pct double, effective_from date",
    "complaint_reason_code": "reason_code string, description string, owning_team string, is_sla_related boolean",
    "complaint_label": "ticket_id string, reason_code string, labelled_by string, labelled_on date",
}


def read_seed(spark: SparkSession, path: str, name: str) -> DataFrame:
    return read_csv(spark, path, SEEDS[name])


class Table:
    """A table as a folder of Parquet parts and numbered versions.

    A version is a small file that names its parts and may carry a token. It is created whole and never changed,
    so readers see the last complete version, a writer that dies leaves the table as it was, and two
    writers can't make the same version. ``read(version)`` goes back in time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path, self._fs = jvm.Path, jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/_versions")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def state(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None and self.versions() else version
        if not version:
            return {"version": 0, "parts": [], "schema": None, "token": None, "action": None}
        stream = self._fs.open(self._path(f"{self.path}/_versions/{version:010d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _commit(self, before: dict, parts: list[str], schema: T.StructType, action: str, token=None) -> int:
        state = {"version": before["version"] + 1, "parts": parts, "schema": schema.json(), "token": token if token is not None else before["token"], "action": action}
        body, name = json.dumps(state).encode(), f"{self.path}/_versions/{state['version']:010d}.json"
        made = self._path(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(bytearray(body))
        out.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(made, self._path(name)):
            self._fs.delete(made, False)
            raise RuntimeError(f"version {state['version']} of {self.path} was made by another writer")
        return state["version"]

    def _put(self, df: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        return part

    def read(self, version: int | None = None) -> DataFrame:
        state = self.state(version)
        if state["schema"] is None:
            raise ValueError(f"{self.path} has no version")
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in state["parts"]]) if state["parts"] else self.spark.createDataFrame([], schema)

    def replace(self, df: DataFrame, action: str = "replace", token=None) -> int:
        """All rows anew; ``df`` may be built on what the table holds."""
        before = self.state()
        return self._commit(before, [self._put(df)], df.schema, action, token)

    def append(self, df: DataFrame, token=None) -> int:
        before = self.state()
        schema = T.StructType.fromJson(json.loads(before["schema"])) if before["schema"] else df.schema
        part = self._put(df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema]))
        return self._commit(before, [*before["parts"], part], schema, "append", token)

    def delete(self, where: Column) -> int:
        """Without the rows for which ``where`` holds (null doesn't)."""
        return self.replace(self.read().where(~F.coalesce(where, F.lit(False))), "delete")

    def update(self, values: dict[str, Column], where: Column) -> int:
        now = self.read()
        return self.replace(now.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(now.schema[c].dataType) for c, v in values.items()}), "update")

    def insert_once(self, df: DataFrame) -> bool:
        """Appends only to a table without rows."""
        if self.state()["parts"] and not self.read().isEmpty():
            return False
        self.append(df)
        return True

    def insert_if_changed(self, df: DataFrame, latest: DataFrame) -> bool:
        """Appends only what differs, either way, from the snapshot ``latest``."""
        if self.state()["parts"] and df.subtract(latest).isEmpty() and latest.subtract(df).isEmpty():
            return False
        self.append(df)
        return True

    def history(self) -> DataFrame:
        """The versions with what made them."""
        made = [self.state(v) for v in self.versions()]
        return self.spark.createDataFrame([(s["version"], s["action"], len(s["parts"])) for s in made], "version int, action string, parts int")


def log_action(table: Table, at: str, **values) -> None:
    """One row of a write-back log; the values are bound, never pasted into the statement, and ``context`` is JSON."""
    sql = "SELECT cast(:at as timestamp) AS logged_at, :acted_by AS acted_by, :subject_type AS subject_type, :subject_id AS subject_id, :action AS action, :note AS note, :context AS context"
    table.append(table.spark.sql(sql, {"at": at, "acted_by": "", "subject_type": "", "subject_id": "", "action": "", "note": "", "context": "{}", **values}))


def probe(spark: SparkSession, attempts: dict) -> DataFrame:
    """What becomes of each attempt (a function that returns a count): attempt, outcome, error, n."""
    found = []
    for name, attempt in attempts.items():
        try:
            found.append((name, "ok", None, int(attempt())))
        except Exception as e:
            found.append((name, "failed", type(e).__name__, None))
    return spark.createDataFrame(found, "attempt string, outcome string, error string, n int")
