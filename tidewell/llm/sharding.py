"""Sharding by a two-pass external shuffle (DataFrame functions only).

Pass one scatters the records into memory-sized buckets by a seeded hash, bucket k into partition k.
Pass two takes each bucket as one array, puts it into a fixed order, shuffles it by Fisher-Yates and
deals it out: ``shuffle`` draws from its seed plus the partition's number, so from the seed and the
bucket alone. Positions run on over the buckets, so the shards' row counts differ by at most one
(law ``rows``).
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import prepare

#: Up to so many buckets' first positions (16 bytes each) are broadcast; more meet the buckets in a shuffle.
BROADCAST_BUCKETS = 500_000


def shuffled(docs: DataFrame, shards: int = 8, seed: int = 7, bucket_bytes: int = 64 << 20, text_col: str = "text", id_col: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """Every record once, as ``record`` (a struct of ``columns``, by default all), with its
    ``size`` (UTF-8 bytes of the text, null as none, plus 1), ``text_crc32``, ``shard`` and ``slot``
    (from 0, without gaps).

    Deterministic in the seed and the rows, whatever the number of shuffle partitions or the order of
    the input. Only rows alike in every column share a bucket for sure. Null ids and texts are records like others; an empty table gives no rows. Clashing column names are safe, as
    a record's columns stay inside the struct.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    record = F.struct(*[F.col(f"`{c}`") for c in (columns or docs.columns)])
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), record.alias("record"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    hashed = [F.col(f"record.`{f.name}`") for f in rows.schema["record"].dataType if "map" not in f.dataType.simpleString()]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "id", "size", "crc", *hashed), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("bucket").count()
    before = counts.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("before"))
    whole = rows.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("id", "crc", "size", "record"))).alias("a"))
    dealt = whole.select("bucket", F.shuffle("a", seed).alias("a")).join(F.broadcast(before) if buckets <= BROADCAST_BUCKETS else before, "bucket")
    at = F.col("before") + F.col("pos")
    return dealt.select("before", F.posexplode("a").alias("pos", "x")).select(
        "x.record", "x.size", F.col("x.crc").alias("text_crc32"), (at % shards).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 7, **options) -> None:
    """The shards as folders ``shard=k`` of Parquet files, each in slot order."""
    out = shuffled(docs, shards, seed, **options)
    out.select("shard", "slot", "record").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def written_shards(docs: DataFrame, shards: int = 8, seed: int = 7, text_col: str = "text", **options) -> DataFrame:
    """Every record as :func:`write_shards` left it in the shared folder, with the columns of
    :func:`shuffled`: shard and slot as stored, size and CRC of the text that was read back. The
    files go when the session ends."""
    spark = docs.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    write_shards(docs, path, shards, seed, text_col=text_col, **options)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    columns = options.get("columns") or docs.columns
    schema = StructType([StructField("slot", LongType()), StructField("record", docs.select(*[F.col(f"`{c}`") for c in columns]).schema), StructField("shard", IntegerType())])
    text = F.coalesce(F.col("record").getField(text_col), F.lit(""))
    return spark.read.schema(schema).parquet(path).select("record", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "shard", "slot")
