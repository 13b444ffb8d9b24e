"""Token ids as length-delimited binary records with masked checksums, and an offset index beside each file.

A file holds records one after another::

    length of payload   8 bytes, little-endian
    masked crc          4 bytes, of the length's 8 bytes
    payload             doc_id present (1 byte), doc_id (8 bytes), bytes per id (1 byte), ids
    masked crc          4 bytes, of the payload

The checksum is CRC-32, rotated right by 15 bits plus a constant, so that checksums stored in data do not
disturb each other. Beside ``part-….rec`` lies ``part-….idx``: the 8-byte offset of each record and of the
end. Each task writes files under a name of its own; only files named in the manifest count, so a task that
is run again after an executor is lost leaves at most an orphan. Files go to the shared folder through the
file system that its URI names, by Arrow's libraries (see file_system). They are the operator's output: they
stay until the caller deletes the folder that the manifest names.
"""

import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.common import chunks, cut, lean, shared_dir, shuffle_partitions
from spendlake.llm.words import TEXT_BYTES, WordEncoder

HEAD = struct.Struct("<QI")
BODY = struct.Struct("<?qB")
MASK = 0xA282EAD8
#: Bytes that a reader takes from a file at once.
READ_BYTES = 8 << 20
#: Bytes that a writing worker's memory of words may take.
MEMORY_BYTES = 160 << 20

MANIFEST = T.StructType(
    [
        T.StructField("part", T.IntegerType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("n_records", T.LongType(), False),
        T.StructField("n_ids", T.LongType(), False),
        T.StructField("n_bytes", T.LongType(), False),
    ]
)
ROWS = "doc_id long, position long, ids binary"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = BODY.pack(doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int] | None:
    """doc_id, ids and the end of the record at an offset; None if the data ends within it. A wrong checksum raises ValueError."""
    if at + HEAD.size > len(data):
        return None
    length, crc = HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != crc:
        raise ValueError("a record's length is damaged")
    end = at + HEAD.size + length + 4
    if end > len(data):
        return None
    payload = data[at + HEAD.size : end - 4]
    if masked(payload) != struct.unpack_from("<I", data, end - 4)[0]:
        raise ValueError("a record is damaged")
    present, doc_id, width = BODY.unpack_from(payload)
    return doc_id if present else None, np.frombuffer(payload, f"<u{width}", offset=BODY.size), end


class LibraryEncoder:
    """The tokenizers library over a vocabulary file whose pre-tokenizer splits by `pattern`, with a memory of words.

    The library takes the string of an added token for that token, also where no special tokens are asked for; so
    texts are split at such strings before words are found. Files with added tokens that match in other ways
    (whole words only, with the space around them, or in normalized text) raise ValueError.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        tokens = self.library.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in tokens.values()):
            raise ValueError(f"{path} has added tokens that don't match as plain strings")
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in tokens.items()}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = WordEncoder(regex.compile(pattern), self.learn, MEMORY_BYTES)

    def learn(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for null and empty ones."""
        marked = [self.marked(t) for t in texts]
        if not any(marked):
            return self.words.encode(texts)
        out = self.words.encode([None if m else t for t, m in zip(texts, marked, strict=True)])
        return [self.around_marks(t) if m else ids for t, m, ids in zip(texts, marked, out, strict=True)]

    def marked(self, text: str | None) -> bool:
        return bool(text) and any(a in text for a in self.added)

    def around_marks(self, text: str) -> bytes:
        ids, at = [], 0
        for m in self.marks.finditer(text):
            ids += [*self.words.encode([text[at : m.start()]]), self.added[m.group()]]
            at = m.end()
        return b"".join([*ids, *self.words.encode([text[at:]])])


@lru_cache(maxsize=2)
def library_encoder(path: str, pattern: str) -> LibraryEncoder:
    return LibraryEncoder(path, pattern)


def file_system(uri: str) -> tuple[FileSystem, str]:
    """Arrow's file system and path of a URI: file, hdfs, viewfs, s3, gs and abfs, and the names that Hadoop has for some of them. Others raise ValueError, on the driver before any task starts."""
    scheme, colon, rest = uri.partition("://")
    try:
        return FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)
    except pa.ArrowInvalid as e:
        raise ValueError(f"token records can't be written to {scheme}://; give `folder` a URI of file, hdfs, viewfs, s3, gs or abfs") from e


def write(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, width: int = 2, folder: str | None = None) -> DataFrame:
    """Encodes each text, appends end_id, and writes records in ascending doc_id order; returns the manifest, a row for each file.

    docs are dealt by ranges of doc_id, so files follow each other in order: file `part` holds smaller ids
    than file `part` + 1. Null doc_ids come first; rows of one doc_id are ordered by text. Null and empty
    texts give end_id alone. Every row gives a record. width: bytes per id; 2 holds ids below 65,536 (a
    larger id raises OverflowError). Other columns of docs are left out.
    """
    spark = docs.sparkSession
    base = f"{folder or shared_dir(spark)}/records-{uuid.uuid4().hex}"
    file_system(base)
    most = 256**width

    def run(batches):
        files, base_path = file_system(base)
        part = TaskContext.get().partitionId()
        path = f"{base_path}/part-{part:06d}-{uuid.uuid4().hex[:12]}"
        encoder = library_encoder(tokenizer_path, pattern)
        offsets, at, n_ids, out = [0], 0, 0, None
        for batch in batches:
            for piece in chunks(batch, limit=2 * TEXT_BYTES):
                if out is None:
                    files.create_dir(base_path, recursive=True)
                    out = files.open_output_stream(f"{path}.rec")
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode(piece.column("text").to_pylist()), strict=True):
                    ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                    if ids.max() >= most:
                        raise OverflowError(f"an id does not fit in {width} bytes")
                    record = frame(doc_id, ids, width)
                    out.write(record)
                    at += len(record)
                    n_ids += len(ids)
                    offsets.append(at)
        if out is not None:
            out.close()
            with files.open_output_stream(f"{path}.idx") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            row = {"part": part, "path": f"{base}/{path.rpartition('/')[2]}", "n_records": len(offsets) - 1, "n_ids": n_ids, "n_bytes": at}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first())
    return cut(dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).mapInArrow(lean(run), MANIFEST))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, position (ids in all records before it, in file order) and ids (little-endian 32-bit) of every record, read file by file in bounded pieces."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))  # a row for each file
    return starts.repartition(shuffle_partitions(manifest.sparkSession), "path").mapInArrow(lean(read_files), ROWS)


def read_files(batches):
    for batch in batches:
        for row in batch.to_pylist():
            files, path = file_system(row["path"])
            position, rest = row["first"], b""
            with files.open_input_stream(f"{path}.rec") as f:
                while data := f.read(READ_BYTES):
                    rest, at, found = rest + data, 0, []
                    while (got := unframe(rest, at)) is not None:
                        found.append((got[0], position, got[1].astype("<u4").tobytes()))
                        position, at = position + len(got[1]), got[2]
                    rest = rest[at:]
                    yield rows_batch(found)
            if rest:
                raise ValueError(f"{row['path']} ends within a record")


def rows_batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([x[0] for x in found], pa.int64()),
            "position": pa.array([x[1] for x in found], pa.int64()),
            "ids": pa.array([x[2] for x in found], pa.binary()),
        }
    )


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """All records in an order drawn by seed: offsets of the index files are dealt at random, then each record is read at its offset.

    position is the record's number within its file here.
    """

    def offsets(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files, path = file_system(row["path"])
                with files.open_input_stream(f"{path}.idx") as f:
                    at = np.frombuffer(f.read(), "<u8").astype("i8")
                n = len(at) - 1
                yield pa.RecordBatch.from_pydict({"path": pa.array([row["path"]] * n), "number": pa.array(range(n), pa.int64()), "at": pa.array(at[:-1]), "size": pa.array(np.diff(at))})

    def fetch(batches):
        for batch in batches:
            found, handles = [], {}
            for row in batch.to_pylist():
                if row["path"] not in handles:
                    if len(handles) >= 64:
                        handles.popitem()[1].close()
                    files, path = file_system(row["path"])
                    handles[row["path"]] = files.open_input_file(f"{path}.rec")
                doc_id, ids, _ = unframe(handles[row["path"]].read_at(row["size"], row["at"]))
                found.append((doc_id, row["number"], ids.astype("<u4").tobytes()))
            yield rows_batch(found)

    n = shuffle_partitions(manifest.sparkSession)
    index = manifest.select("path").repartition(n, "path").mapInArrow(offsets, "path string, number long, at long, size long")
    order = F.xxhash64(F.lit(seed), "path", "number")
    return index.repartition(n, order).sortWithinPartitions(order).mapInArrow(fetch, ROWS)


def summary(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each record read back."""
    return read_back.select("doc_id", F.col("position").alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
