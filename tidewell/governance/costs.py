"""What queries cost, from the runs themselves: executor time, shuffle and spill of the jobs under a tag.

A tag is a part and a name, such as ``serve:sla``. It goes with every job that is started inside :meth:`CostLog.run`
(broadcasts and adaptive stages too); the stages' own metrics are read from the session's status store when the run is over.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "tag string, run long, jobs long, stages long, failed_stages long, wall_ms long, executor_ms long, cpu_ms long, gc_ms long, read_bytes long, shuffle_bytes long, spilled_bytes long, cores long"
_PREFIX = "cost="


class CostLog:
    """Costs of tagged runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self._rows = spark, []

    def run(self, tag: str, work: Callable):
        """``work()`` under the tag; its costs are noted, also when it fails."""
        sc, mine = self.spark.sparkContext, f"{_PREFIX}{len(self._rows)}"
        sc.addJobTag(mine)
        began = time.perf_counter()
        try:
            return work()
        finally:
            wall = time.perf_counter() - began
            sc.removeJobTag(mine)
            self._rows.append((tag, len(self._rows), *self._measured(mine, round(wall * 1000)), sc.defaultParallelism))

    def _measured(self, mine: str, wall: int) -> tuple:
        sc = self.spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(60_000)
        store, seq = sc.statusStore(), lambda x: [x.apply(k) for k in range(x.size())]
        jobs = [j for j in seq(store.jobsList(None)) if mine in seq(j.jobTags().toSeq())]
        ids = {s for j in jobs for s in seq(j.stageIds().toSeq())}
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.double, 0)
        total, stages, failed = [0] * 6, 0, 0
        for s in ids:
            # every attempt costs; a stage whose output was there already has none
            for x in seq(store.stageData(s, False, None, False, none)):
                if x.status().toString() == "SKIPPED":
                    continue
                stages += 1
                failed += x.status().toString() == "FAILED"
                for k, v in enumerate((x.executorRunTime(), x.executorCpuTime() // 1_000_000, x.jvmGcTime(), x.inputBytes(), x.shuffleWriteBytes(), x.diskBytesSpilled())):
                    total[k] += v
        return len(jobs), stages, failed, wall, *total

    def read(self) -> DataFrame:
        return self.spark.createDataFrame(self._rows, SCHEMA)


def shares(log: DataFrame, units: str = "executor_ms") -> DataFrame:
    """Runs and ``units`` by what stands before a tag's first colon, and the share of all in per cent.

    Shares are rounded to two places so that they sum to 100: what rounding down leaves goes to the largest remainders.
    """
    by = log.groupBy(F.split_part("tag", F.lit(":"), F.lit(1)).alias("part")).agg(F.count(F.lit(1)).alias("queries"), F.sum("jobs").alias("jobs"), F.sum(units).alias("units"))
    every = Window.partitionBy(F.lit(1))  # one row a part
    exact = F.when(F.col("__all") > 0, F.col("units") * 10_000 / F.col("__all")).otherwise(F.lit(10_000.0) / F.col("__n"))
    down = by.withColumns({"__all": F.sum("units").over(every), "__n": F.count(F.lit(1)).over(every)}).withColumn("__x", exact).withColumn("__down", F.floor("__x"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("__x") - F.col("__down")), "part")
    more = (F.row_number().over(order) <= F.lit(10_000) - F.sum("__down").over(every)).cast("int")
    return down.withColumn("pct", (F.col("__down") + more) / F.lit(100.0)).select("part", "queries", "jobs", "units", "pct")


def idle(log: DataFrame) -> DataFrame:
    """Of the time that the cores were there for the runs: executor_ms, idle_ms and the idle share in per cent."""
    there = log.agg(F.sum("executor_ms").alias("executor_ms"), F.sum(F.col("wall_ms") * F.col("cores")).alias("__there"))
    return there.select("executor_ms", F.greatest(F.col("__there") - F.col("executor_ms"), F.lit(0)).alias("idle_ms"), F.round(F.greatest(1 - F.col("executor_ms") / F.col("__there"), F.lit(0.0)) * 100, 2).alias("idle_pct"))
