"""A stream of the lines of growing files, with an offset a file and a committed token.

Spark's own file source takes a file once, as it is when it is first seen. Logs that are written on and on need a place
in each file: the source ``lines`` has the bytes read of each file as its offset, and takes whole lines alone, so that one
that is being written waits. A batch's range is in the query's checkpoint before it runs, files
only grow, so a batch that runs again reads the same lines, and a query that was stopped goes on after its last batch. Large ranges
are split among tasks. The token, what a channel has taken in for good, is kept beside the files for who writes them.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewell.streaming import _run

SCHEMA = "file string, offset long, value string"


def _source() -> type:
    """The source's class; made here, so that it travels to the workers by value."""

    def at(path: str):
        import pyarrow.fs as fs

        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")

    class Range(InputPartition):
        def __init__(self, file: str, start: int, end: int):
            self.file, self.start, self.end = file, start, end

    class Lines(DataSource):
        @classmethod
        def name(cls) -> str:
            return "lines"

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader(self.options)

    class Reader(DataSourceStreamReader):
        def __init__(self, options):
            self.path, self.channel = options["path"].rstrip("/"), options.get("channel", "")
            self.split = int(options.get("splitBytes", 64 << 20))
            self.suffix = options.get("suffix", ".json")

        def initialOffset(self) -> dict:
            return {"files": {}}

        def _whole(self, store, info) -> int:
            """Bytes of the file up to its last line end."""
            with store.open_input_file(info.path) as f:
                end, step = info.size, 1 << 16
                while end > 0:
                    begin = max(0, end - step)
                    found = f.read_at(end - begin, begin).rfind(b"\n")
                    if found >= 0:
                        return begin + found + 1
                    end = begin
            return 0

        def latestOffset(self) -> dict:
            import pyarrow.fs as fs

            store, root = at(self.path)
            found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            return {"files": {x.base_name: self._whole(store, x) for x in sorted(found, key=lambda x: x.base_name) if x.is_file and x.base_name.endswith(self.suffix)}}

        def partitions(self, start: dict, end: dict) -> list:
            out = []
            for file, upto in end["files"].items():
                begin = start["files"].get(file, 0)
                while begin < upto:
                    out.append(Range(file, begin, min(upto, begin + self.split)))
                    begin += self.split
            return out

        def read(self, part):
            """The lines that begin in the range; the last may end after it."""
            import pyarrow as pa

            store, root = at(self.path)
            with store.open_input_file(f"{root}/{part.file}") as f:
                place = part.start
                if place and f.read_at(1, place - 1) != b"\n":  # in a line of the range before
                    while (more := f.read_at(1 << 16, place)) and (cut := more.find(b"\n")) < 0:
                        place += len(more)
                    place += (cut + 1) if more else 0
                kept, begins = [], []
                held, first = b"", place
                while first < part.end and (more := f.read_at(1 << 20, place)):
                    place += len(more)
                    *whole, held = (held + more).split(b"\n")
                    for line in whole:
                        if first >= part.end:
                            break
                        kept.append(line.decode("utf-8", "replace"))
                        begins.append(first)
                        first += len(line) + 1
                    if len(kept) >= 10_000 or first >= part.end:
                        yield pa.RecordBatch.from_pydict({"file": pa.array([part.file] * len(kept), pa.string()), "offset": pa.array(begins, pa.int64()), "value": pa.array(kept, pa.string())})
                        kept, begins = [], []
                if kept:
                    yield pa.RecordBatch.from_pydict({"file": pa.array([part.file] * len(kept), pa.string()), "offset": pa.array(begins, pa.int64()), "value": pa.array(kept, pa.string())})

        def commit(self, end: dict) -> None:
            if self.channel:
                store, root = at(self.path)
                store.create_dir(f"{root}/_tokens")
                with store.open_output_stream(f"{root}/_tokens/.{self.channel}") as f:
                    f.write(json.dumps(end["files"]).encode())
                store.move(f"{root}/_tokens/.{self.channel}", f"{root}/_tokens/{self.channel}")

        def stop(self) -> None:
            pass

    return Lines


def stream_lines(spark: SparkSession, path: str, channel: str = "", **options: str) -> DataFrame:
    """(file, offset, value): the lines of a folder's files, ``offset`` the byte that a line begins at."""
    spark.dataSource.register(_source())
    return spark.readStream.format("lines").options(path=path, channel=channel, **options).load()


def take_in(spark: SparkSession, path: str, channel: str, out: str, parse: Callable[[DataFrame], DataFrame] | None = None, every: str | None = None, **options: str) -> None:
    """A channel: new lines into Parquet at ``out``, partitioned by micro-batch, which a batch that runs again overwrites.

    Rows have the channel, file, offset and time they were taken in at, beside the line or what ``parse`` makes of it.
    """

    def add(batch: DataFrame, n: int) -> None:
        rows = (parse(batch) if parse else batch).withColumns({"channel": F.lit(channel), "load_ts": F.current_timestamp(), "batch": F.lit(n)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/rows")

    _run(stream_lines(spark, path, channel, **options).writeStream.queryName(channel).foreachBatch(add), f"{out}/checkpoint", every)


def status(spark: SparkSession, out: str, path: str) -> DataFrame:
    """What a channel has committed: file, bytes, and the rows that are there of it. The bytes are those of its last batch."""
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(f"{out}/checkpoint/commits")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(x.getPath().getName()) for x in store.listStatus(root) if x.getPath().getName().isdigit()] if store.exists(root) else []
    if not done:
        return spark.createDataFrame([], "file string, bytes long, n_rows long")
    text = spark.read.text(f"{out}/checkpoint/offsets/{max(done)}").collect()[-1][0]
    files = spark.createDataFrame([(k, int(v)) for k, v in json.loads(text)["files"].items()] or [("", 0)], "file string, bytes long").where("file <> ''")
    n = spark.read.parquet(f"{out}/rows").where(F.col("batch") <= max(done)).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))
    return files.join(n, "file", "left").na.fill(0, ["n_rows"])
