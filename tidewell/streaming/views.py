"""Aggregates over a join, maintained from both sides' change logs.

A change is a row's ``before`` and ``after`` image; signed, it is the old row with weight -1 and the new one with
weight 1. With L and R the rows known so far, dL and dR those of a micro-batch, the join changes by

    dL x R  +  (L + dL) x dR

with weights multiplied, so updates, deletes and changed dimension rows take back what they had added. Sums and
counts are kept by group with the group's net number of rows; a group whose number falls to 0 is gone.

State is Parquet partitioned by micro-batch: a batch overwrites its own partition, so one that runs again adds
nothing. Every ``NET_EVERY`` batches all earlier ones are netted into one snapshot, in which rows that
came and went take no space.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.streaming import NotIncremental, _run

NET_EVERY = 20


@dataclass(frozen=True)
class Side:
    """An input: the folder its change files (Parquet of before, after) land in, and the columns of a row that the view uses.

    ``entitled`` filters the side by other tables, as a row policy does; such a filter can change without a change in
    the log, so that a view over it is computed in full.
    """

    path: str
    row: str
    entitled: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Measure:
    """An aggregate over joined rows; ``additive`` ones can be kept by signed sums."""

    kind: str
    value: Column

    @property
    def additive(self) -> bool:
        return self.kind in ("count", "sum")


def count(value: Column | None = None) -> Measure:
    """Rows, or those with a value."""
    return Measure("count", F.lit(1) if value is None else value)


def total(value: Column) -> Measure:
    """The sum of whole numbers or decimals; null for a group without any. Sums of doubles drift when rows are taken back."""
    return Measure("sum", value)


def other(aggregate: Column) -> Measure:
    """Any other aggregate, such as a maximum: nothing can be taken back from it."""
    return Measure("other", aggregate)


class _State:
    """Signed rows by micro-batch, and snapshots of all before every NET_EVERY-th of them."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], weights: list[str]):
        self.spark, self.path, self.keys, self.weights = spark, path, keys, weights
        self.schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        for part in ("log", "net"):
            spark.createDataFrame([], self.schema).write.mode("ignore").partitionBy("batch").parquet(f"{path}/{part}")

    def _put(self, part: str, batch: int, df: DataFrame) -> None:
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields[:-1]], F.lit(batch).cast("long").alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{part}")

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{part}")

    def add(self, batch: int, df: DataFrame) -> None:
        if batch and batch % NET_EVERY == 0:
            net = self.before(batch, batch - NET_EVERY)
            self._put("net", batch, net.groupBy(*self.keys).agg(*[F.sum(w).alias(w) for w in self.weights]).where(F.col(self.weights[0]) != 0))
        self._put("log", batch, df)

    def before(self, batch: int, base: int | None = None) -> DataFrame:
        """Signed rows of the batches before this one."""
        base = batch // NET_EVERY * NET_EVERY if base is None else base
        return self._read("net").where(F.col("batch") == base).unionByName(self._read("log").where((F.col("batch") >= base) & (F.col("batch") < batch))).drop("batch")

    def upto(self, batch: int) -> DataFrame:
        """Signed rows of the batches up to this one, which has been added."""
        return self.before(batch + 1, max(batch, 0) // NET_EVERY * NET_EVERY)

    def of(self, batch: int) -> DataFrame:
        return self._read("log").where(F.col("batch") == batch).drop("batch")


class MaintainedJoin:
    """``keys`` and ``measures`` over the rows of ``left`` joined to ``right`` on ``on``, of those where ``where`` holds.

    :meth:`run` takes in what has landed (or goes on, ``every`` so often) and :meth:`current` has the groups as of the last
    batch. ``mode`` is ``incremental``, or ``full`` for the reason in ``reason``; any other error of a batch
    stops the run and is raised.
    """

    def __init__(
        self, spark: SparkSession, out: str, left: Side, right: Side, on: list[tuple[str, str]], keys: dict[str, Column], measures: dict[str, Measure], where: Column | None = None
    ):
        self.spark, self.out, self.sides, self.on, self.keys, self.measures, self.where = spark, out, {"l": left, "r": right}, on, keys, measures, where
        self.state = {}
        for name, side in self.sides.items():
            row = T.StructType.fromDDL(side.row)
            self.state[name] = _State(spark, f"{out}/{name}", T.StructType([*row.fields, T.StructField("__w", T.LongType())]), row.names, ["__w"])
        try:
            self._check()
            self.mode, self.reason = "incremental", None
        except NotIncremental as e:
            self.mode, self.reason = "full", str(e)
        shape = self._grouped(self._joined(*[s.of(-1) for s in self.state.values()])).schema
        if self.mode == "incremental":
            self.groups = _State(spark, f"{out}/groups", shape, list(keys), [c for c in shape.names if c not in keys])
        self.shape = shape

    def _check(self) -> None:
        for name, m in self.measures.items():
            if not m.additive:
                raise NotIncremental(f"measure {name} is not additive")
        for name, side in self.sides.items():
            if side.entitled:
                raise NotIncremental(f"the {'left' if name == 'l' else 'right'} side is filtered by another table")

    def _joined(self, left: DataFrame, right: DataFrame) -> DataFrame:
        l, r = left.withColumnRenamed("__w", "__wl"), right.withColumnRenamed("__w", "__wr")  # noqa: E741
        r = r.withColumnsRenamed({b: f"__on{k}" for k, (_, b) in enumerate(self.on)})
        same = [F.col(a) == F.col(f"__on{k}") for k, (a, _) in enumerate(self.on)]
        out = l.join(r, same).withColumn("__w", F.col("__wl") * F.col("__wr"))
        return out if self.where is None else out.where(self.where)

    def _grouped(self, joined: DataFrame) -> DataFrame:
        """Net rows, and each measure's net number of values and sum."""
        w, rows = F.col("__w"), []
        for name, m in self.measures.items():
            if m.additive:
                rows.append(F.coalesce(F.sum(F.when(m.value.isNotNull(), w)), F.lit(0)).cast("long").alias(f"{name}__n"))
            if m.kind == "sum":
                rows.append(F.coalesce(F.sum(m.value * w), F.lit(0)).alias(f"{name}__sum"))
        return joined.groupBy(*[c.alias(k) for k, c in self.keys.items()]).agg(F.sum(w).alias("__rows"), *rows)

    def _signed(self, batch: DataFrame, name: str) -> DataFrame:
        images = F.array(F.struct(F.col(f"{name}.before").alias("x"), F.lit(-1).cast("long").alias("__w")), F.struct(F.col(f"{name}.after").alias("x"), F.lit(1).cast("long").alias("__w")))
        return batch.select(F.inline(images)).where("x is not null").select("x.*", "__w")

    def _add(self, batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            for name, state in self.state.items():
                state.add(n, self._signed(batch, name))
        finally:
            batch.unpersist()
        l, r = self.state["l"], self.state["r"]  # noqa: E741
        if self.mode == "incremental":
            changed = self._joined(l.of(n), r.before(n))
            if not r.of(n).isEmpty():
                changed = changed.unionByName(self._joined(l.before(n).unionByName(l.of(n)), r.of(n)))
            self.groups.add(n, self._grouped(changed))
        # in full, the groups are made when they are read

    def run(self, every: str | None = None) -> None:
        side = lambda name: self.spark.readStream.schema(f"before struct<{self._row(name)}>, after struct<{self._row(name)}>").parquet(self.sides[name].path)
        both = side("l").select(F.struct("before", "after").alias("l")).unionByName(side("r").select(F.struct("before", "after").alias("r")), allowMissingColumns=True)
        _run(both.writeStream.foreachBatch(self._add), f"{self.out}/checkpoint", every)

    def _row(self, name: str) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromDDL(self.sides[name].row))

    def _last(self) -> int:
        """The last batch whose groups (in full: whose rows) are there, as written in the query's checkpoint."""
        fs, path = self.spark._jvm.org.apache.hadoop.fs, None
        path = fs.Path(f"{self.out}/checkpoint/commits")
        at = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in at.listStatus(path)] if at.exists(path) else []
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def current(self) -> DataFrame:
        """The groups as of the last batch."""
        last = self._last()
        if self.mode == "full":
            return self._in_full(last)
        sums = [c for c in self.shape.names if c not in self.keys]
        net = self.groups.upto(last).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in sums]).where("__rows > 0")
        of = lambda n, m: F.col(f"{n}__n") if m.kind == "count" else F.when(F.col(f"{n}__n") > 0, F.col(f"{n}__sum"))
        return net.select(*self.keys, *[of(n, m).alias(n) for n, m in self.measures.items()])

    def rows(self, name: str, upto: int | None = None) -> DataFrame:
        """A side's rows (``l`` or ``r``) as of a batch, repeated ones as often as they are there."""
        state = self.state[name]
        net = state.upto(self._last() if upto is None else upto).groupBy(*state.keys).agg(F.sum("__w").alias("__w")).where("__w > 0")
        out = net.select(*state.keys, F.explode(F.array_repeat(F.lit(1), F.col("__w").cast("int"))).alias("__one")).drop("__one")
        entitled = self.sides[name].entitled
        return entitled(out) if entitled else out

    def _in_full(self, upto: int) -> DataFrame:
        l, r = (self.rows(n, upto).withColumn("__w", F.lit(1).cast("long")) for n in ("l", "r"))  # noqa: E741
        value = {"count": lambda m: F.count(m.value), "sum": lambda m: F.sum(m.value), "other": lambda m: m.value}
        return self._joined(l, r).groupBy(*[c.alias(k) for k, c in self.keys.items()]).agg(*[value[m.kind](m).alias(n) for n, m in self.measures.items()])

    def inconsistent(self) -> DataFrame:
        """Rows that were taken back without having come: side, row as JSON, net number. None in a sound log."""
        found = [self.state[n].upto(self._last()).groupBy(*self.state[n].keys).agg(F.sum("__w").alias("n")).where("n < 0").select(F.lit(n).alias("side"), F.to_json(F.struct(*self.state[n].keys)).alias("row"), "n") for n in ("l", "r")]
        return found[0].unionByName(found[1])


def in_full(view: MaintainedJoin) -> MaintainedJoin:
    """The same view over the same state, computed in full when it is read: to compare, or after a log was found inconsistent."""
    twin = object.__new__(MaintainedJoin)
    twin.__dict__ = dict(view.__dict__, mode="full", reason="asked for", sides={n: replace(s) for n, s in view.sides.items()})
    return twin
