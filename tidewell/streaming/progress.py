"""What streams tell of their own runs: rows, batches and latency of each, kept in a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "route string, run_id string, batch long, at timestamp, n_rows long, batch_ms long, add_ms long, plan_ms long, rows_per_second double, source string, sink string"


class ProgressLog(StreamingQueryListener):
    """Notes the progress of named queries between :meth:`watch` and :meth:`done`; ``done`` appends it to Parquet at ``out``."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out, self._rows = spark, out, []

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        self.spark.streams.removeListener(self)
        rows, self._rows = self._rows, []
        if rows:
            found = self.spark.createDataFrame([(json.dumps(x),) for x in rows], "x string")
            got = lambda path: F.get_json_object("x", f"$.{path}")
            ms = lambda k: got(f"durationMs.{k}").cast("long")
            found.select(
                got("name").alias("route"), got("runId").alias("run_id"), got("batchId").cast("long").alias("batch"), got("timestamp").cast("timestamp").alias("at"), got("numInputRows").cast("long").alias("n_rows"),
                ms("triggerExecution").alias("batch_ms"), ms("addBatch").alias("add_ms"), F.coalesce(ms("latestOffset"), F.lit(0)).alias("plan_ms"), got("processedRowsPerSecond").cast("double").alias("rows_per_second"),
                got("sources[0].description").alias("source"), got("sink.description").alias("sink"),
            ).coalesce(1).write.mode("append").parquet(self.out)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._rows.append(json.loads(event.progress.json))

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.out)


def by_route(progress: DataFrame) -> DataFrame:
    """Rows, batches with rows, and a batch's latency (least, median, most, in seconds) by route."""
    full = progress.where("n_rows > 0")
    s = lambda c: F.round(c / 1000, 3)
    return full.groupBy("route").agg(
        F.sum("n_rows").alias("n_rows"), F.countDistinct("run_id", "batch").alias("batches"), s(F.min("batch_ms")).alias("least_s"), s(F.percentile_approx("batch_ms", 0.5)).alias("median_s"),
        s(F.max("batch_ms")).alias("most_s"), F.round(F.sum("n_rows") * 1000 / F.sum("batch_ms"), 1).alias("rows_per_second"),
    )
