"""Topics kept as files: records in partitions by key, offsets by partition, written whole or not at all.

A topic is a folder. A write puts a file for each partition that got records, and then one entry into the
topic's log; records count from then on. A record's offset is its place among all records of its partition, in
the order of the log. A stream's offset is the number of records of each partition that it has read, so a query
that is killed resumes where its checkpoint stands; a batch that is written again under its number adds nothing.
Paths are URIs of any file system that Arrow knows. A topic has one writer at a time. A stream takes what the
log has when a batch starts, as sources in Python can't be told how much to take.

    topics.register(spark)
    topics.publish(rows, "file:///data/raw-events", key="user_id", order="seq")
    spark.readStream.format("topic").load("file:///data/raw-events")
"""

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

RECORD = "key string, value string, headers map<string,string>, partition int, offset long"
WRITTEN = pa.schema([("key", pa.string()), ("value", pa.string()), ("headers", pa.map_(pa.string(), pa.string()))])
PARTITIONS = 8
#: Records that a file holds in one piece.
ROWS = 10_000


def partition_of(key, partitions: int = PARTITIONS):
    """Column of the partition of a key; a null key's is the first."""
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(partitions)), F.lit(0)).cast("int")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a URI or a local path; Hadoop writes `file:/x` for `file:///x`, and has names of its own for S3."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri.removeprefix('file:')}"
    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest)


class Log:
    """The entries of a topic's log."""

    def __init__(self, path: str):
        self.files, self.base = file_system(path)

    def entries(self) -> list[dict]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.base}/_log", allow_not_found=True))
        out = []
        for name in sorted(i.path for i in found if i.path.endswith(".json")):
            with self.files.open_input_stream(name) as f:
                out.append(json.loads(f.read()))
        return out

    def ends(self) -> dict[str, int]:
        """Records of each partition."""
        out: dict[str, int] = {}
        for e in self.entries():
            for p, _, n in e["files"]:
                out[str(p)] = out.get(str(p), 0) + n
        return out

    def spans(self, start: dict[str, int], end: dict[str, int]) -> list["Span"]:
        """The pieces of files that hold the records from start to end, in order."""
        at: dict[str, int] = {}
        out = []
        for e in self.entries():
            for p, name, n in e["files"]:
                first = at.get(str(p), 0)
                a, b = max(first, start.get(str(p), 0)), min(first + n, end.get(str(p), 0))
                if a < b:
                    out.append(Span(p, name, first, a, b))
                at[str(p)] = first + n
        return out

    def add(self, files: list, writer: str, batch: int | None) -> None:
        known = self.entries()
        if batch is not None and any(e["writer"] == writer and e["batch"] == batch for e in known):
            return  # this batch has been written
        self.files.create_dir(f"{self.base}/_log", recursive=True)
        there = f"{self.base}/_log/{len(known):012d}.json"
        with self.files.open_output_stream(f"{there}.tmp") as f:
            f.write(json.dumps({"writer": writer, "batch": batch, "files": files}).encode())
        self.files.move(f"{there}.tmp", there)


class Span(InputPartition):
    def __init__(self, partition: int, name: str, first: int, start: int, end: int):
        self.partition, self.name, self.first, self.start, self.end = partition, name, first, start, end


def records(path: str, span: Span) -> Iterator[pa.RecordBatch]:
    files, base = file_system(path)
    with files.open_input_file(f"{base}/{span.name}") as f, pa.ipc.open_file(f) as reader:
        at = span.first
        for k in range(reader.num_record_batches):
            batch = reader.get_batch(k)
            a, b = max(span.start, at) - at, min(span.end, at + batch.num_rows) - at
            if a < b:
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([span.partition] * (b - a), pa.int32()), pa.array(range(at + a, at + b), pa.int64())], names=["key", "value", "headers", "partition", "offset"])
            at += batch.num_rows


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Span]:
        log = Log(self.path)
        return log.spans({}, log.ends())

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from records(self.path, partition) if partition else ()


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return Log(self.path).ends()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return Log(self.path).spans(start, end)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from records(self.path, partition)


class Files(WriterCommitMessage):
    def __init__(self, files: list):
        self.files = files


class Write:
    """Writes the records of a task, a file for each partition; the driver adds them to the log."""

    def __init__(self, path: str, writer: str):
        self.path, self.writer = path, writer

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        files, base = file_system(self.path)
        open_: dict[int, tuple] = {}
        for batch in iterator:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                numbers = part.column(part.schema.get_field_index("partition")).to_pylist()
                for p in sorted(set(numbers)):
                    own = part.filter(pa.array([n == p for n in numbers])).select(["key", "value", "headers"])
                    if p not in open_:
                        name = f"{p:05d}-{uuid.uuid4().hex}.arrow"
                        files.create_dir(base, recursive=True)
                        sink = files.open_output_stream(f"{base}/{name}")
                        open_[p] = [name, sink, pa.ipc.new_file(sink, WRITTEN), 0]
                    open_[p][2].write_batch(own.cast(WRITTEN))
                    open_[p][3] += own.num_rows
        for _, sink, ipc, _ in open_.values():
            ipc.close()
            sink.close()
        return Files([[p, name, n] for p, (name, _, _, n) in sorted(open_.items())])


class BatchWriter(Write, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        Log(self.path).add([f for m in messages if m for f in m.files], self.writer, None)

    def abort(self, messages) -> None:
        """Files that no entry names don't count."""


class StreamWriter(Write, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        Log(self.path).add([f for m in messages if m for f in m.files], self.writer, batchId)

    def abort(self, messages, batchId: int) -> None:
        """Files that no entry names don't count."""


class Topic(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("a topic can be added to only")
        return BatchWriter(self.options["path"], self.options.get("writer", ""))

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], self.options.get("writer", ""))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Topic)


def keyed(rows: DataFrame, key: str, value=None, headers=None, partitions: int = PARTITIONS) -> DataFrame:
    """rows as records: their key, their value (all columns as JSON, if none is given), headers and partition."""
    own = F.to_json(F.struct(*rows.columns)) if value is None else value
    none = F.lit(None).cast("map<string,string>")
    return rows.select(F.col(key).cast("string").alias("key"), own.alias("value"), (none if headers is None else headers).alias("headers"), partition_of(F.col(key), partitions).alias("partition"), F.lit(0).cast("long").alias("offset"), *([F.col(c).alias(f"__{c}") for c in rows.columns]))


def publish(rows: DataFrame, path: str, key: str, order: str, value=None, headers=None, partitions: int = PARTITIONS) -> None:
    """Adds rows to a topic: records of one key go to one partition, in the order given."""
    dealt = keyed(rows, key, value, headers, partitions).repartition(partitions, "partition").sortWithinPartitions("partition", f"__{order}")
    dealt.select("key", "value", "headers", "partition", "offset").write.format("topic").mode("append").option("path", path).save()


def dead_letters(failed: DataFrame, reason: str) -> DataFrame:
    """Records (with key, value, headers, partition, offset) as dead letters: headers tell why, and where the record stood."""
    told = F.create_map(F.lit("reason"), F.col(reason), F.lit("partition"), F.col("partition").cast("string"), F.lit("offset"), F.col("offset").cast("string"))
    return failed.select("key", "value", F.map_concat(F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")), told).alias("headers"), "partition", "offset")


def consume(records_: DataFrame, handle: Callable[[DataFrame], DataFrame], good: str, dead: str, checkpoint: str, tries: int = 3, pause: float = 0.5) -> StreamingQuery:
    """Handles each batch of a stream of records and writes the outcome: rows of `handle`'s result with a `reason` to the topic `dead`, the others to the topic `good`, keys in their order.

    handle takes and returns records, with a column reason (null where all is well). A batch whose handling fails
    is tried `tries` times, after pauses that double; then the query stops, and starts at that batch next time.
    A batch is written to each topic under its number, so one that runs again adds nothing twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        for n in range(tries):
            try:
                done = handle(batch).persist()
                done.count()
                break
            except Exception:
                if n == tries - 1:
                    raise
                time.sleep(pause * 2**n)
        order = done.repartition("partition").sortWithinPartitions("partition", "offset")
        for path, rows in ((good, order.where("reason IS NULL").select("key", "value", "headers", "partition", "offset")), (dead, dead_letters(order.where("reason IS NOT NULL"), "reason"))):
            written(rows, path, number)
        done.unpersist()

    return records_.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(rows: DataFrame, path: str, number: int) -> None:
    """Adds the records of a numbered batch to a topic, unless that batch is there."""
    log = Log(path)
    if not any(e["batch"] == number and e["writer"] == "consume" for e in log.entries()):
        write = Write(path, "consume")

        def task(batches):
            yield pa.RecordBatch.from_pydict({"files": [json.dumps(write.write(batches).files)]})

        files = [f for r in rows.mapInArrow(task, "files string").collect() for f in json.loads(r.files)]  # a row for each task
        log.add(sorted(files), "consume", number)
