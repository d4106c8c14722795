"""Structured Streaming: exactly-once dedupe, maintained aggregates, file ingest, change streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import change_feed, conform_cdc
from tidewell.sources import Table

#: Partial sums of so many micro-batches are folded into one.
COMPACT_AFTER = 20


def _run(writer, state: str, every: str | None) -> None:
    """Over what is there; with ``every`` (such as 60 seconds) on and on until stopped."""
    writer = writer.option("checkpointLocation", state)
    (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start().awaitTermination()


def dedupe_stream(spark: SparkSession, source: str, schema, key: str, ts: str, late: str, out: str, state: str) -> DataFrame:
    """At-least-once files to exactly-once rows; runs over what is there, resumes from ``state``."""
    stream = spark.readStream.schema(schema).parquet(source).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    _run(stream.writeStream.format("parquet").option("path", out), state, None)
    return spark.read.schema(schema).parquet(out)


def maintain(spark: SparkSession, source: str, schema, keys: list[str], measures: dict[str, Column], out: str, state: str, files_per_batch: int = 100) -> DataFrame:
    """An additive aggregate kept up by micro-batches: each appends its partial sums with its batch id
    as the table's token, so a batch that runs again adds nothing; after COMPACT_AFTER of them they
    are folded into one. The state is their sum."""
    table = Table(spark, out)
    folded = lambda df: df.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in measures])

    def add(batch: DataFrame, batch_id: int) -> None:
        held = table.state()
        if held["token"] is not None and batch_id <= held["token"]:
            return
        part = batch.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])
        if len(held["parts"]) >= COMPACT_AFTER:
            table.replace(folded(table.read().unionByName(part)), "compact", batch_id)
        else:
            table.append(part, batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    _run(stream.writeStream.foreachBatch(add), state, None)
    return folded(table.read())


class NotIncremental(ValueError):
    """Why a view can't be kept by increments."""


def refresh(table: Table, incremental: Callable[[], DataFrame], full: Callable[[], DataFrame]) -> str:
    """The maintained table brought up to date; in full where the increment says, by NotIncremental, why it can't be had.
    The reason is kept with the version. Any other error is one, and is raised."""
    try:
        table.replace(incremental(), "incremental")
    except NotIncremental as e:
        table.replace(full(), f"full: {e}")
    return table.state()["action"]


def ingest(spark: SparkSession, source: str, schema, out: str, state: str, fmt: str = "json", pattern: str = "*") -> None:
    """New files once each, with the file's name and time."""
    found = spark.readStream.schema(schema).option("pathGlobFilter", pattern).format(fmt).load(source)
    found = found.withColumns({"src_file": F.col("_metadata.file_name"), "src_modified": F.col("_metadata.file_modification_time")})
    _run(found.writeStream.format("parquet").option("path", out), state, None)


def land_changes(spark: SparkSession, source: str, table: Table, state: str, topic: str, every: str | None = None) -> None:
    """A change log's files (lines of {before, after, op, ts_ms}) as they are: the payload unread, with
    topic, file and offset. ``every`` sets the micro-batch mode's flush; without it, what is there."""

    def add(batch: DataFrame, batch_id: int) -> None:
        held = table.state()
        if held["token"] is None or batch_id > held["token"]:
            table.append(batch, batch_id)

    lines = spark.readStream.text(source).select(
        F.col("value").alias("payload"), F.lit(topic).alias("topic"), F.col("_metadata.file_name").alias("file"), F.get_json_object("value", "$.offset").cast("long").alias("offset")
    )
    _run(lines.writeStream.foreachBatch(add), state, every)


def latest_state(landed: DataFrame, row: str, key: str) -> DataFrame:
    """The current rows of a landed change log; ``row`` is the schema of before and after."""
    log = landed.select(F.from_json("payload", f"before struct<{row}>, after struct<{row}>, op string, ts_ms long").alias("p"), "offset")
    return conform_cdc(log.select("p.*", "offset"), key)


class Channel:
    """A stream's writing end with a committed offset token: rows at or under it are not written again,
    and rows and token become visible together."""

    def __init__(self, table: Table, offset: str = "offset"):
        self.table, self.offset = table, offset

    def committed(self) -> int:
        token = self.table.state()["token"]
        return -1 if token is None else token

    def send(self, batch: DataFrame) -> int:
        """Writes the rows after the token; how many those were."""
        fresh = batch.where(F.col(self.offset) > self.committed())
        n, last = fresh.agg(F.count(F.lit(1)), F.max(self.offset)).first()
        if n:
            self.table.append(fresh, last)
        return n


class ChangeStream:
    """What changed in a table, or in a view over tables, since the stream was last consumed.

    Reading :meth:`pending` consumes nothing; :meth:`consume` moves on only once its writer is done.
    The offset is kept as a token of its own, so that a new stream begins where the tables are now.
    """

    def __init__(self, offsets: Table, tables: dict[str, Table], key: str, columns: list[str], view: Callable[..., DataFrame] | None = None):
        self.offsets, self.tables, self.key, self.columns = offsets, tables, key, columns
        self.view = view or (lambda **t: next(iter(t.values())))
        if offsets.state()["token"] is None:
            self._mark(self._now())

    def _now(self) -> dict[str, int]:
        return {n: t.state()["version"] for n, t in self.tables.items()}

    def _mark(self, at: dict[str, int]) -> None:
        self.offsets.replace(self.offsets.spark.createDataFrame(list(at.items()), "name string, version int"), "mark", at)

    def _at(self, versions: dict[str, int]) -> DataFrame:
        return self.view(**{n: t.read(versions[n]) for n, t in self.tables.items()})

    def pending(self, upto: dict[str, int] | None = None) -> DataFrame:
        return change_feed(self._at(self.offsets.state()["token"]), self._at(upto or self._now()), self.key, self.columns)

    def consume(self, write: Callable[[DataFrame], None]) -> None:
        upto = self._now()
        write(self.pending(upto))
        self._mark(upto)


def lag_report(landed: DataFrame, mechanism: str, event_ts: str, load_ts: str) -> DataFrame:
    """Seconds from an event to its landing, by mechanism."""
    lag = F.unix_micros(F.col(load_ts).cast("timestamp")) / 1e6 - F.unix_micros(F.col(event_ts).cast("timestamp")) / 1e6
    return landed.withColumn("__lag", lag).groupBy(mechanism).agg(F.count(F.lit(1)).alias("n"), F.min("__lag").alias("least"), F.median("__lag").alias("p50"), F.expr("percentile_cont(0.95) within group (order by __lag)").alias("p95"), F.max("__lag").alias("most"))
