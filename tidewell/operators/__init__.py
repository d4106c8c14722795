"""Relational operators that Spark has no single call for."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import millis
from tidewell.session import scratch

FOREVER = "9999-12-31"


def dedupe_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order`` (give it a unique tie-break)."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def conform_cdc(log: DataFrame, key: str) -> DataFrame:
    """Current rows of a change log of (before, after, op, ts_ms, offset): the latest record of each
    key by (ts_ms, offset), without those whose latest is a delete. The key of a delete comes from
    ``before``."""
    keyed = log.withColumn("__k", F.coalesce(F.col(f"after.{key}"), F.col(f"before.{key}")))
    return dedupe_latest(keyed, ["__k"], [F.desc("ts_ms"), F.desc("offset")]).where("after is not null and op <> 'd'").select("after.*", "ts_ms", "op")


def as_of_join(left: DataFrame, right: DataFrame, ts: str, right_ts: str, by: list[str], values: list[str], how: str = "left") -> DataFrame:
    """Each left row with the values of the latest right row at or before it, in its group.

    One shuffle: both sides are stacked and the last right row is carried forward. With no group
    (``by`` empty) the stack is range partitioned by time, so that no task gets all rows, and each
    part begins with the last right row of those before it. Groups that may be large: ``timed.as_of_sliced``.
    """
    if not by:
        return _as_of_keyless(left, right, ts, right_ts, values, how)
    rest = [c for c in left.columns if c not in by]
    a = left.select(*by, F.col(ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*rest).alias("__l"), F.lit(None).alias("__r"))
    b = right.select(*by, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.lit(None).alias("__l"), F.struct(*values).alias("__r"))
    w = Window.partitionBy(*by).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.unionByName(b).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    out = out.select(*by, "__l.*", *[F.col(f"__r.{v}").alias(v) for v in values])
    return out.where(F.col(values[0]).isNotNull()) if how == "inner" else out


def _as_of_keyless(left: DataFrame, right: DataFrame, ts: str, right_ts: str, values: list[str], how: str) -> DataFrame:
    a = left.select(F.col(ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).alias("__r"))
    b = right.select(F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.lit(None).alias("__l"), F.struct(*values).alias("__r"))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the bounds of the parts are drawn once: both uses below read one exchange
    ranged = a.unionByName(b).repartitionByRange(parts, "__ts", "__side").withColumn("__p", F.spark_partition_id()).persist()
    ends = ranged.where("__side = 0").groupBy("__p").agg(F.max_by("__r", "__ts").alias("__end"))  # one row a part
    known = ends.sparkSession.range(parts).select(F.col("id").cast("int").alias("__p")).join(ends, "__p", "left")
    carried = known.select("__p", F.last("__end", ignorenulls=True).over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    w = Window.partitionBy("__p").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(carried), "__p").withColumn("__r", F.coalesce(F.last("__r", ignorenulls=True).over(w), "__before")).where("__side = 1")
    out = out.select("__l.*", *[F.col(f"__r.{v}").alias(v) for v in values])
    return out.where(F.col(values[0]).isNotNull()) if how == "inner" else out


def validity_join(facts: DataFrame, dim: DataFrame, key: str, ts: str, valid_from: str = "valid_from", valid_to: str = "valid_to", how: str = "left") -> DataFrame:
    """Each fact with the dimension version valid at its time: from <= ts < to."""
    d = dim.withColumnRenamed(key, "__key")
    return facts.join(d, (facts[key] == d["__key"]) & (facts[ts] >= d[valid_from]) & (facts[ts] < d[valid_to]), how).drop("__key")


def merge_upsert(target: DataFrame, source: DataFrame, key: str, columns: list[str], delete: Column | None = None) -> DataFrame:
    """The target after MERGE: matched rows updated where a column is distinct, matched rows that
    ``delete`` (over source columns) selects removed, others inserted; adds ``merge_action``."""
    t = target.select(F.col(key).alias("__k"), F.struct(*columns).alias("t"))
    s = source.withColumn("__d", delete if delete is not None else F.lit(False)).select(F.col(key).alias("__k"), F.struct(*columns).alias("s"), "__d")
    both = t.join(s, "__k", "full_outer").where("not coalesce(__d, false)")
    action = F.when(F.col("t").isNull(), "insert").when(F.col("s").isNull() | F.col("s").eqNullSafe(F.col("t")), "keep").otherwise("update")
    new = F.coalesce("s", "t")
    return both.select(F.col("__k").alias(key), *[new[c].alias(c) for c in columns], action.alias("merge_action"))


def scd2_open(rows: DataFrame, since: Column) -> DataFrame:
    """First versions: valid from ``since``, open."""
    return rows.select("*", since.cast("date").alias("valid_from"), F.lit(FOREVER).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))


def scd2_apply(dim: DataFrame, current: DataFrame, key: str, tracked: list[str], at: Column, gone: bool = True) -> DataFrame:
    """A type-2 dimension after a new state: changed keys' open versions close at ``at`` and new ones
    open, new keys open at ``at``, and with ``gone`` versions of keys no longer there close."""
    at = at.cast("date")
    now = current.select(F.col(key).alias("__k"), F.struct(*tracked).alias("__new"))
    both = dim.where("is_current").join(now, F.col(key) == F.col("__k"), "full_outer")
    old = F.struct(*tracked)
    same = F.col(key).isNotNull() & F.col("__k").isNotNull() & old.eqNullSafe(F.col("__new"))
    kept = same | (F.lit(not gone) & F.col("__k").isNull())
    cols = [key, *tracked]
    still = both.where(kept).select(*cols, "valid_from", "valid_to", "is_current")
    closed = both.where(~kept & F.col(key).isNotNull()).select(*cols, "valid_from", at.alias("valid_to"), F.lit(False).alias("is_current"))
    opened = both.where(~same & F.col("__k").isNotNull()).select(F.col("__k").alias(key), *[F.col(f"__new.{c}").alias(c) for c in tracked], at.alias("valid_from"), F.lit(FOREVER).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
    return dim.where("not is_current").select(*cols, "valid_from", "valid_to", "is_current").unionByName(still).unionByName(closed).unionByName(opened)


def overlapping_versions(dim: DataFrame, key: str) -> DataFrame:
    """Pairs of versions of a key whose validity intervals overlap."""
    a, b = dim.alias("a"), dim.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.valid_from") < F.col("b.valid_from")) & (F.col("a.valid_to") > F.col("b.valid_from"))
    return a.join(b, on).select(F.col(f"a.{key}").alias(key), F.col("a.valid_from").alias("first_from"), F.col("b.valid_from").alias("second_from"))


def change_feed(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What changed between two snapshots, as a change stream tells it: INSERT and DELETE rows, an
    update as one of each with ``is_update``."""
    b = before.select(F.col(key).alias("__k"), F.struct(*columns).alias("b"))
    a = after.select(F.col(key).alias("__k"), F.struct(*columns).alias("a"))
    both = a.join(b, "__k", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    update = F.col("a").isNotNull() & F.col("b").isNotNull()
    row = lambda action, x: F.when(F.col(x).isNotNull(), F.struct(F.lit(action).alias("action"), update.alias("is_update"), *[F.col(f"{x}.{c}").alias(c) for c in columns]))
    return both.select(F.col("__k").alias(key), F.explode(F.filter(F.array(row("DELETE", "b"), row("INSERT", "a")), lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side alone, with the ``side`` they are on."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def trailing_count(df: DataFrame, by: list[str], ts: str, millis_back: int) -> Column:
    """Rows of the group in the ``millis_back`` before this row, itself and its equals left out."""
    return F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy(millis(ts)).rangeBetween(-millis_back, -1))


def match_strict(df: DataFrame, by: list[str], order: list[str], symbol: str, pattern: list[str]) -> DataFrame:
    """Rows that start a run of consecutive rows with these symbols, with ``steps`` (structs of all
    rows' order columns). Matches don't overlap: the next one begins past the last row of the one before.

    Only a pattern that begins as it ends can overlap itself; its matches are then chosen in turn within each stretch of
    them that overlap, which is gathered.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.struct(*order, symbol)
    df = df.withColumn("__steps", F.array(step, *[F.lead(step, k).over(w) for k in range(1, len(pattern))]))
    ok = F.lit(True)
    for k, s in enumerate(pattern):
        ok = ok & F.coalesce(F.col("__steps")[k][symbol] == s, F.lit(False))
    size = len(pattern)
    if not any(pattern[:k] == pattern[size - k :] for k in range(1, size)):
        return df.where(ok).withColumnRenamed("__steps", "steps")
    names = [c for c in df.columns if c != "__steps"]
    found = df.withColumn("__at", F.row_number().over(w)).where(ok)
    found = found.withColumn("__new", (F.col("__at") - F.lag("__at", 1, -size).over(w.orderBy("__at")) >= size).cast("int"))
    found = found.withColumn("__stretch", F.sum("__new").over(w.orderBy("__at")))
    rows = found.groupBy(*by, "__stretch").agg(F.array_sort(F.collect_list(F.struct("__at", *[c for c in names if c not in by], F.col("__steps").alias("steps")))).alias("__s"))
    empty = F.filter("__s", lambda r: F.lit(False))
    taken = F.aggregate("__s", empty, lambda kept, r: F.when((F.size(kept) == 0) | (r["__at"] - F.element_at(kept, -1)["__at"] >= size), F.concat(kept, F.array(r))).otherwise(kept))
    return rows.select(*by, F.inline(taken)).select(*names, "steps")


def match_pattern(df: DataFrame, by: list[str], order: list[str], symbol: str, letters: dict[str, str], pattern: str) -> DataFrame:
    """General row patterns over symbols: a regular expression over one letter a row.

    Each group's rows, in order, become a string; matches don't overlap (each search goes on past
    the last row). Returns the group, ``matched`` (letters) and ``n_rows`` for each match. Groups
    are gathered, so they should be of bounded length (an order, a session).
    """
    letter = F.lit("~")
    for value, x in letters.items():
        letter = F.when(F.col(symbol) == value, F.lit(x)).otherwise(letter)
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, letter.alias("__x")))).alias("s"))
    text = F.array_join(F.transform("s", lambda r: r["__x"]), "")
    return rows.select(*by, F.explode_outer(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("matched")).where("matched is not null").withColumn("n_rows", F.length("matched"))


def ordered_list(value: str, *order: str) -> Column:
    """The group's values as an array in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value])


def object_of(key: str, value: str) -> Column:
    """The group's keys and values as a map, by key."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int) -> DataFrame:
    """``n`` rows at random: those with the least seeded hash of their key, so alike on any cluster."""
    return df.withColumn("__h", F.xxhash64(F.lit(seed), *key)).orderBy("__h", *key).limit(n).drop("__h")


def flatten_series(df: DataFrame, doc: str, path: str, arrays: dict[str, str]) -> DataFrame:
    """Parallel arrays of a JSON text under ``path``, one row a position, beside the other columns."""
    schema = f"{path} struct<{', '.join(f'{n}: array<{t}>' for n, t in arrays.items())}>"
    inner = F.from_json(doc, schema)[path]
    return df.select(*[c for c in df.columns if c != doc], F.explode(F.arrays_zip(*[inner[n].alias(n) for n in arrays])).alias("__x")).select(*[c for c in df.columns if c != doc], *[F.col("__x")[n].alias(n) for n in arrays])


def pivot_metrics(df: DataFrame, by: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long metrics to one column each (the names are given, so no extra pass finds them)."""
    return df.groupBy(*by).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def _block_pairs(vectors: DataFrame, rows_per_block: int) -> DataFrame:
    """Every pair of blocks of (vec_id, label, embedding), each side as bytes; null ids take no part.

    Blocks are written once. A task of the Cartesian product reads its files of both sides, so no block is shuffled once a pair.
    """
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    blocks = max(1, math.ceil(rows.count() / rows_per_block))

    def build(key, pdf):
        dims = max((len(x) for x in pdf["x"] if x is not None), default=0)
        m = np.full((len(pdf), dims), np.nan)
        for k, x in enumerate(pdf["x"]):
            if x is not None and len(x) == dims:
                m[k] = np.asarray(x, float)
        with np.errstate(divide="ignore", invalid="ignore"):
            m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
        return pd.DataFrame([{"b": key[0], "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "labels": pdf["label"].to_numpy(float).tobytes(), "m": m.tobytes()}])

    built = rows.withColumn("b", F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(blocks)).cast("int")).groupBy("b").applyInPandas(build, "b int, ids binary, labels binary, m binary")
    path = scratch(vectors.sparkSession, "blocks")
    built.write.parquet(path)
    held = vectors.sparkSession.read.parquet(path)
    left, right = (held.select(F.col("b").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "labels", "m")]) for k, s in (("i", "a"), ("j", "b")))
    return left.hint("shuffle_replicate_nl").crossJoin(right)


def _on_similarities(work, schema):
    """``work`` on (ids, labels) of both sides and their cosines to five places, NaN where there is none, 256 rows of the left at a time."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, lab, m = ({s: np.frombuffer(r[f"{c}_{s}"], t) for s in "ab"} for c, t in (("ids", np.int64), ("labels", float), ("m", float)))
                a, b = (m[s].reshape(len(ids[s]), -1) for s in "ab")
                for k in range(0, len(a), 256):
                    sim = a[k : k + 256] @ b.T if a.shape[1] == b.shape[1] else np.full((len(a[k : k + 256]), len(b)), np.nan)
                    sim = np.sign(sim) * np.floor(np.abs(sim) * 1e5 + 0.5) / 1e5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(work(ids["a"][k : k + 256], lab["a"][k : k + 256], ids["b"], lab["b"], sim), schema.types, strict=True)], schema=schema)

    return run


def nearest(vectors: DataFrame, k: int, rows_per_block: int = 2048) -> DataFrame:
    """The ``k`` rows nearest by cosine (to five places, ties to the smaller id) to each row of
    (vec_id, label, embedding), itself left out: vec_id, label, neighbour, neighbour_label, sim.

    Every block of rows meets every block. Vectors that are null, hold a null, or are all zero have
    a null similarity, which comes last, and so have pairs of unlike length.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.float64()), ("neighbour", pa.int64()), ("neighbour_label", pa.float64()), ("sim", pa.float64())])

    def best(a, la, b, lb, sim):
        rows = []
        for q in range(len(a)):
            other = np.flatnonzero(b != a[q])
            order = other[np.lexsort((b[other], -sim[q, other]))[:k]]
            rows.append((np.full(len(order), q), order))
        q, o = (np.concatenate(x) for x in zip(*rows, strict=True))
        return a[q], la[q], b[o], lb[o], sim[q, o]

    near = _block_pairs(vectors, rows_per_block).mapInArrow(_on_similarities(best, schema), "vec_id long, label double, neighbour long, neighbour_label double, sim double")
    return dedupe_rank(near, ["vec_id"], [F.desc_nulls_last("sim"), F.asc("neighbour")], k)


def containing(texts: DataFrame, text_id: str, text: str, needles: DataFrame, needle_id: str, needle: str, block: int = 20_000) -> DataFrame:
    """(needle_id, text_id) for each text that contains a needle, by one automaton for every ``block``
    needles (the bound of what is sent to the tasks) and a pass over the texts for each."""
    dealt = needles.where(F.col(needle).isNotNull()).select(F.col(needle_id).cast("long").alias("i"), F.col(needle).alias("n")).persist()
    blocks = math.ceil(dealt.count() / block)
    schema = f"{needle_id} long, {text_id} long"
    out = texts.sparkSession.createDataFrame([], schema)
    for k in range(blocks):
        mine: dict[str, list[int]] = {}
        for r in dealt.where(F.pmod(F.xxhash64("i", "n"), F.lit(blocks)) == k).collect():
            mine.setdefault(r["n"], []).append(r["i"])

        def find(batches, mine=mine):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for n, ids in mine.items():
                if n:
                    automaton.add_word(n, ids)
            automaton.make_automaton()
            for batch in batches:
                found = []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    hits = set(mine.get("", ()))
                    for _, ids in automaton.iter(t) if len(automaton) else ():
                        hits.update(ids)
                    found += [(h, i) for h in hits]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=[needle_id, text_id])

        out = out.unionByName(texts.where(F.col(text).isNotNull()).select(F.col(text_id).cast("long"), text).mapInArrow(find, schema))
    return out


def dedupe_rank(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows a key in ``order``."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")


def pair_units(vectors: DataFrame, rows_per_block: int = 2048) -> DataFrame:
    """Partial sums over all pairs of rows a < b: same_label, n, sim_units (cosine in 1/100,000)."""
    schema = pa.schema([("same_label", pa.bool_()), ("n", pa.int64()), ("sim_units", pa.int64())])

    def sums(a, la, b, lb, sim):
        less = a[:, None] < b[None, :]
        known = ~np.isnan(la)[:, None] & ~np.isnan(lb)[None, :]
        same = la[:, None] == lb[None, :]
        units = np.where(np.isnan(sim), 0, np.rint(sim * 1e5)).astype(np.int64)
        groups = [(True, less & known & same), (False, less & known & ~same), (None, less & ~known)]
        found = [(v, int(m.sum()), int(units[m].sum()) if (m & ~np.isnan(sim)).any() else None) for v, m in groups if m.any()]
        return tuple(zip(*found, strict=True)) or ((), (), ())

    return _block_pairs(vectors, rows_per_block).mapInArrow(_on_similarities(sums, schema), "same_label boolean, n long, sim_units long")
