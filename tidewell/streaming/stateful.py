"""Streams with a state a key: the latest row of a change log, and lifecycles whose events come out of order.

State lives in Spark's state store, by key and partition, and is read back from there with :func:`state_of`, so
nothing that landed before is read again. Rows of a key may come in any order, over any number of batches, and more
than once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.streaming import _run

_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: A run over what is there would not end, as a timer can always come due in one more batch.
_ONCE = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def run_stateful(out: DataFrame, sink: Callable[[DataFrame, int], None], state: str, every: str | None = None) -> None:
    """What is there (or, ``every`` so often, what comes) through ``out`` into ``sink``, in update mode.

    Timers come due in any batch; in a run over what is there, those are the batches with data.
    """
    conf, mine = out.sparkSession.conf, _STORE | ({} if every else _ONCE)
    before = {k: conf.get(k, None) for k in mine}
    for k, v in mine.items():
        conf.set(k, v)
    try:
        _run(out.writeStream.outputMode("update").foreachBatch(sink), state, every)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def state_of(spark: SparkSession, state: str, name: str) -> DataFrame:
    """The keys and values of a state variable as of the last batch. Where keys share buckets, the value is arrays of
    them, which are laid out; those whose names begin with ``__`` are the operator's own."""
    held = spark.read.format("statestore").option("stateVarName", name).load(state)
    if held.schema["key"].dataType.names != ["__bucket"]:
        return held.select("key.*", "value.*")
    columns = [c for c in held.schema["value"].dataType.names if not c.startswith("__")]
    return held.select("value.*").select(F.inline(F.arrays_zip(*columns)))


def latest_rows(log: DataFrame, key: str, tombstone_ms: int) -> DataFrame:
    """Changes of each key's latest row: key, ts_ms, offset, op, payload.

    ``log`` has key, ts_ms, offset, op, payload. The latest is the greatest (ts_ms, offset); a delete (op ``d``) leaves a
    tombstone, so that an older row that comes later does not bring the key back. Tombstones go after ``tombstone_ms``,
    the longest that a row may be late; live rows stay. Rows of no key are passed over.
    """
    kind = log.schema[key].dataType.simpleString()
    row = "ts_ms long, offset long, op string, payload string"
    made = Row(key, "ts_ms", "offset", "op", "payload")

    class Latest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.live = handle.getValueState("live", row)
            self.gone = handle.getValueState("gone", "ts_ms long, offset long", ttlDurationMs=tombstone_ms)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            held = self.live.get() if self.live.exists() else None
            at = tuple(held)[:2] if held else tuple(self.gone.get()) if self.gone.exists() else None
            best = None
            for r in rows:
                if at is None or (r.ts_ms, r.offset) > at:
                    at, best = (r.ts_ms, r.offset), r
            if best is None:
                return
            if best.op == "d":
                self.live.clear()
                self.gone.update(at)
            else:
                self.gone.clear()
                self.live.update((*at, best.op, best.payload))
            yield made(key[0], *at, best.op, best.payload)

        def close(self) -> None:
            pass

    keyed = log.where(F.col(key).isNotNull()).select(key, F.col("ts_ms").cast("long"), F.col("offset").cast("long"), "op", "payload")
    return keyed.groupBy(key).transformWithState(Latest(), f"`{key}` {kind}, {row}", "Update", "ProcessingTime")


def lifecycles(events: DataFrame, key: str, steps: list[str], stop: str, wait_ms: int, buckets: int = 4096) -> DataFrame:
    """Each key's outcome whenever it changes: key, outcome, n_events, expected (the first step not seen), overdue.

    ``events`` has key, event_id, event_ts (timestamp), status. An outcome is ``CLEAN`` (all ``steps`` in their order of
    time), ``CANCELLED`` (the first steps, one at least and short of the last two, then ``stop``), ``MISSING_<step>`` (the first step after the first one that isn't
    there) or ``OUT_OF_ORDER``. Events of a key are told apart by id, so one delivered twice counts once. A key with
    a step missing may yet get it: only when ``wait_ms`` have gone by without one is it reported as overdue, once,
    by a timer; an event that comes after all the same changes the outcome again. A key's state is its few events.

    Every call to the state store is a message between Python and the JVM, so keys share their calls by ``buckets``: a bucket's
    state is arrays of its keys and of their events one key after another, its timer the earliest of its keys'. A stream
    keeps the number of buckets that it began with.
    """
    made = Row(key, "outcome", "n_events", "expected", "overdue")
    kind, size = events.schema[key].dataType.simpleString(), len(steps)
    value = f"`{key}` array<{kind}>, outcome array<string>, n_events array<int>, expected array<string>, overdue array<boolean>, __due array<long>, __ids array<string>, __times array<long>, __statuses array<string>, __timer boolean"

    class Lifecycle(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.state = handle, handle.getValueState("order", value)
            self.judged: dict[tuple, tuple] = {}

        def _judge(self, path: tuple) -> tuple[str, str | None]:
            absent = next((s for s in steps if s not in path), None)
            if list(path) == steps:
                return "CLEAN", absent
            if path[-1] == stop and list(path[:-1]) == steps[: len(path) - 1] and 2 <= len(path) <= size - 1:
                return "CANCELLED", absent
            later = next((s for s in steps[1:] if s not in path), None)
            return (f"MISSING_{later}" if later else "OUT_OF_ORDER"), absent

        def _told(self, seen: dict) -> tuple[str, str | None]:
            path = tuple(s for _, _, s in sorted((t, i, s) for i, (t, s) in seen.items()))
            if len(self.judged) > 10_000:
                self.judged.clear()
            return self.judged.get(path) or self.judged.setdefault(path, self._judge(path))

        def _get(self) -> tuple[dict, bool]:
            """The bucket's keys with [outcome, expected, overdue, due, events], and whether it has a timer."""
            held = self.state.get()
            if held is None:
                return {}, False
            of, at = {}, 0
            for k, outcome, n, expected, overdue, due in zip(*list(held)[:6], strict=True):
                of[k] = [outcome, expected, overdue, due, dict(zip(held[6][at : at + n], zip(held[7][at : at + n], held[8][at : at + n], strict=True), strict=True))]
                at += n
            return of, held[9]

        def _put(self, of: dict, timer: bool) -> None:
            all_of = [(i, t, s) for v in of.values() for i, (t, s) in v[4].items()]
            ids, times, statuses = (list(x) for x in zip(*all_of, strict=True))
            outcome, expected, overdue, due, seen = (list(x) for x in zip(*of.values(), strict=True))
            self.state.update((list(of), outcome, [len(x) for x in seen], expected, overdue, due, ids, times, statuses, timer))

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            of, timer = self._get()
            fresh = set()
            for _, k, i, t, s in rows:
                if k not in of:
                    of[k] = [None, None, False, None, {}]
                seen = of[k][4]
                if i not in seen:
                    seen[i] = (t, s)
                    fresh.add(k)
            if not fresh:
                return
            due = timerValues.getCurrentProcessingTimeInMs() + wait_ms
            for k in fresh:
                held = of[k]
                outcome, absent = self._told(held[4])
                if held[0] != outcome or held[2]:
                    yield made(k, outcome, len(held[4]), absent, False)
                held[:4] = outcome, absent, False, due if outcome.startswith("MISSING_") else None
            # later keys come due later, so a timer that is there is early enough
            if not timer and any(of[k][3] is not None for k in fresh):
                self.handle.registerTimer(due)
                timer = True
            self._put(of, timer)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            now, (of, _) = timerValues.getCurrentProcessingTimeInMs(), self._get()
            for k, held in of.items():
                if held[3] is not None and held[3] <= now:
                    held[2:4] = True, None
                    yield made(k, held[0], len(held[4]), held[1], True)
            left = min((held[3] for held in of.values() if held[3] is not None), default=None)
            if left is not None:
                self.handle.registerTimer(left)
            self._put(of, left is not None)

        def close(self) -> None:
            pass

    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("__bucket")
    rows = events.where(F.col(key).isNotNull()).select(bucket, key, F.col("event_id").cast("string").alias("id"), F.unix_micros(F.col("event_ts").cast("timestamp")).alias("at"), "status")
    return rows.groupBy("__bucket").transformWithState(Lifecycle(), f"`{key}` {kind}, outcome string, n_events int, expected string, overdue boolean", "Update", "ProcessingTime")
