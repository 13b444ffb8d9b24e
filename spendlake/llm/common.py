"""Helpers that the operators of this subpackage share."""

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes and rows that a Python task works on at once; they bound its memory for batches of long texts and of many short ones.
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where it is unset, a local session gets a temporary one; on a cluster that is an error, as executors don't see each other's folders."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spendlake-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one, in whatever file system its URI names."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


class Steps:
    """Tables written between the steps of one operator. drop() deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/cut-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete(self.spark, self.paths.pop(id(table))[0])


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here and lost executors cost no recomputation. Columns of numbers take a fraction of what they take in a checkpoint."""
    return Steps(df.sparkSession).cut(df)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


#: Keys that look_up sends to every task.
HOT_KEYS = 1_024


def look_up(rows: DataFrame, found: DataFrame, keys: list[str], own, hot=None) -> DataFrame:
    """rows with the other columns of found, which has at most one row for each key and the key's rows as `n`; null where found has none.

    The HOT_KEYS keys of largest n (of those for which `hot` holds, if given) are looked up by broadcast, and their
    rows are dealt by `own`, a column that differs from row to row, so that no task gets all rows of a frequent key:
    any other key has at most 1 / HOT_KEYS of the rows. The rest is a merge join.
    """
    values = [c for c in found.columns if c not in keys and c != "n"]
    first = (found if hot is None else found.where(hot)).orderBy(F.desc("n"), *keys).limit(HOT_KEYS)
    sent = first.select(*(F.col(c).alias(f"__{c}") for c in keys), F.struct(*values).alias("__hot"))
    marked = rows.join(F.broadcast(sent), [F.col(c) == F.col(f"__{c}") for c in keys], "left").drop(*(f"__{c}" for c in keys))
    dealt = marked.withColumn("__deal", F.when(F.col("__hot").isNull(), F.xxhash64(*keys)).otherwise(F.xxhash64(own)))
    rest = found.select(F.xxhash64(*keys).alias("__deal"), *keys, F.struct(*values).alias("__cold"))
    both = dealt.join(rest.hint("merge"), ["__deal", *keys], "left").withColumn("__got", F.coalesce("__hot", "__cold"))
    return both.select(*map(quoted, rows.columns), *(F.col("__got")[c].alias(c) for c in values))


#: Shares that salted() cuts the rows of a key into.
SALTS = 256


def salted(rows: DataFrame, side: DataFrame, key: str, own) -> DataFrame:
    """The inner join of rows and side (one row for each key) where a key may have many rows and side's rows are large: rows of a key are cut into SALTS shares by `own`, and side's row goes to the shares that are there."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(own), F.lit(SALTS)))
    copies = dealt.select(key, "__salt").distinct().join(side.hint("merge"), key)
    return dealt.join(copies.hint("merge"), [key, "__salt"]).drop("__salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def digest128(*columns) -> list:
    """Two 64-bit hashes of the columns under different seeds, as one 128-bit key."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


class Hashes(dict):
    """64-bit hash of each word (bytes), remembered up to a bound."""

    BOUND = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def chunks(batch, column: str = "text", limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS):
    """Slices of an Arrow batch of at most `rows` rows whose texts together take about `limit` bytes each (a longer text has its own slice)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    bins = np.cumsum(sizes) // limit
    cuts = sorted({0, batch.num_rows, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), *range(rows, batch.num_rows, rows)})
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def trim_memory() -> None:
    """Hands memory that this process has freed back to the system; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(run):
    """run, a function from batches to batches, which trims memory at its end: reused Python workers live on beside the executor."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim_memory()

    return wrapped
