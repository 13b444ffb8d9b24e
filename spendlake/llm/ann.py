"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are rotated pseudo-randomly (three rounds of random signs and a fast Hadamard transform) and fall to
the nearest signed axis; several rotations give several tables. A query probes the nearest axes of each
table. Queries and vectors of a bucket meet in blocks of bounded size, where distances are exact; the best
of all blocks are ranked. Equal vectors are hashed once, with their smallest ids.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.llm.common import cut, lean

#: Tables. How many buckets of each are probed is measured for the data at hand: as many as find RECALL of the nearest of
#: TRIAL_QUERIES queries, drawn by a hash. Vectors that lie in clusters need one or two; in 64 random-like dimensions,
#: where nothing is much nearer than the rest, it takes about twenty.
TABLES = 5
RECALL = 0.97
TRIAL_QUERIES = 256
#: Vectors and queries of a block, and of a distance matrix within it.
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 2048
MATRIX_QUERIES = 256


def signs(width: int, table: int) -> np.ndarray:
    return np.random.default_rng([width, table]).choice([-1.0, 1.0], (3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def axes(vectors: np.ndarray, table: int) -> np.ndarray:
    """Closeness of each vector to each signed axis: all positive axes, then all negative ones."""
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    x = np.zeros((len(vectors), width))
    x[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for s in signs(width, table):
        x = hadamard(x * s)
    return np.concatenate([x, -x], 1)


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector (64-bit floats), its width and digest, of rows with an id and a finite vector that isn't zero."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, float) + 0.0  # no negative zeros
                if np.isfinite(x).all() and x.any() and np.isfinite(x @ x):
                    d = xxhash.xxh3_128_digest(x.tobytes())
                    rows.append((i, x.tobytes(), len(x), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()))], names=["vec_id", "vector", "width", "d1", "d2"])

    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return vectors.mapInArrow(lean(run), "vec_id long, vector binary, width int, d1 long, d2 long")


def hashed(vectors: DataFrame, probes: int, tables: int) -> DataFrame:
    """A row for each table and each of the `probes` nearest axes of each vector: width, table, bucket and vectors' columns."""

    def run(batches):
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                own = batch.take(pa.array(np.flatnonzero(widths == width)))
                x = np.frombuffer(b"".join(own.column("vector").to_pylist())).reshape(-1, width)
                for table in range(tables):
                    close = axes(x, table)
                    n = min(probes, close.shape[1])
                    near = np.argpartition(-close, n - 1, axis=1)[:, :n] if n < close.shape[1] else np.tile(np.arange(n), (len(x), 1))
                    for p in range(n):
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(x), table, "i4")), pa.array(near[:, p].astype("i4"))], names=names)

    names = [*vectors.columns, "table", "bucket"]
    return vectors.mapInArrow(lean(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", `table` int, bucket int")


def best_of_block(k: int):
    def run(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and vectors.num_rows:
            v = np.frombuffer(b"".join(vectors.column("vector").to_pylist())).reshape(vectors.num_rows, -1)
            q = np.frombuffer(b"".join(queries.column("vector").to_pylist())).reshape(queries.num_rows, -1)
            ids = vectors.column("ids").to_pylist()
            norms = (v * v).sum(1)
            n = min(k, len(v))
            for a in range(0, len(q), MATRIX_QUERIES):
                part = q[a : a + MATRIX_QUERIES]
                about = norms - 2 * part @ v.T
                edge = np.partition(about, n - 1, axis=1)[:, n - 1]
                slack = 1e-9 * (1 + norms.max() + (part * part).sum(1))
                for row, x in enumerate(part):
                    near = np.flatnonzero(about[row] <= edge[row] + slack[row])
                    exact = np.sqrt(((v[near] - x) ** 2).sum(1))
                    ranked = sorted((s, i) for s, j in zip(exact.tolist(), near.tolist(), strict=True) for i in ids[j])[:k]
                    found += [(a + row, i, s) for s, i in ranked]
        at = pa.array([f[0] for f in found], pa.int64())
        return pa.table({"d1": queries.column("d1").take(at), "d2": queries.column("d2").take(at), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    return run


def meet(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest ids (d1, d2 of the query, vec_id, score) within each block of queries and vectors of the same bucket."""
    bucket = ["width", "table", "bucket"]
    blocks = lambda df, size, name: df.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = cut(blocks(queries, BLOCK_QUERIES, "nq").join(blocks(vectors, BLOCK_VECTORS, "nv"), bucket))
    spot = lambda n: F.pmod(F.xxhash64("d1", "d2"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, bucket).withColumn("bq", spot("nq")).withColumn("bv", all_of("nv"))
    right = vectors.join(sizes, bucket).withColumn("bv", spot("nv")).withColumn("bq", all_of("nq"))
    unit = [*bucket, "bq", "bv"]
    right = right.select(*(F.col(c).alias(f"{c}_") for c in unit), "ids", F.col("vector").alias("vector"))
    both = left.select(*unit, "d1", "d2", "vector").groupBy(*unit).cogroup(right.groupBy(*(f"{c}_" for c in unit)))
    return both.applyInArrow(best_of_block(k), "d1 long, d2 long, vec_id long, score double")


def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def brute_force(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest of all vectors (d1, d2, vec_id, score) for each query, in blocks."""
    one = lambda df: df.withColumn("table", F.lit(-1)).withColumn("bucket", F.lit(0))
    return best(meet(one(queries), one(vectors), k), ["d1", "d2"], k).drop("rank")


def probes_needed(queries: DataFrame, vectors: DataFrame, k: int, tables: int, recall: float, trial: int = TRIAL_QUERIES) -> int:
    """Probes a table that find `recall` of the k nearest of at most `trial` queries, by comparison with all vectors.

    A neighbour is found by so many probes as the place of its bucket among the query's nearest axes, in the
    table where that is least. What reaches the driver is bounded by trial and k.
    """
    asked = cut(queries.orderBy("d1", "d2").limit(trial))
    true = brute_force(asked, vectors, k + 1).select("d1", "d2", "vec_id")
    sides = true.join(vectors.select(F.explode("ids").alias("vec_id"), "vector"), "vec_id").join(asked.select("d1", "d2", F.col("vector").alias("q")), ["d1", "d2"])
    pairs = sides.select("q", "vector").limit(trial * (k + 1)).toArrow()
    places = []
    for q, v in zip(pairs["q"].to_pylist(), pairs["vector"].to_pylist(), strict=True):
        both = np.stack([np.frombuffer(q), np.frombuffer(v)])
        places.append(min(int((of_q > of_q[of_v.argmax()]).sum()) for of_q, of_v in (axes(both, t) for t in range(tables))))
    return 1 + int(np.quantile(places, recall, method="higher")) if places else 1


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, tables: int = TABLES, probes: int | None = None, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest rows found for each row whose vec_id is divisible by `every`.

    probes: buckets probed of each table; by default as many as find `recall` of the nearest of a sample of the
    queries. A row is never its own neighbour; ties go to the smaller vec_id; repeated rows of one vec_id count as
    one, and of different vectors of one vec_id the one of least digest counts. Rows without id and vectors that are
    null, empty, zero, hold null or non-finite numbers, or are so long that their square overflows take no part;
    vectors of different widths never meet. Queries whose probes hold fewer than k other rows are compared
    with all rows, in blocks; where there are fewer candidates, all come back. No bucket is capped.
    """
    rows = valid_vectors(embeddings).groupBy("vec_id").agg(F.min(F.struct("d1", "d2", "width", "vector")).alias("least"))
    rows = cut(rows.select("vec_id", "least.*"))
    # of equal vectors, only the k + 1 smallest ids can be among anyone's k nearest; Spark ranks within tasks before copies meet
    few = Window.partitionBy("d1", "d2").orderBy("vec_id")
    firsts = rows.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    distinct = cut(firsts.groupBy("d1", "d2", "width").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector")))
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = cut(asked.dropDuplicates(["d1", "d2"]).select("d1", "d2", "width", "vector"))
    probes = probes or probes_needed(queries, distinct, k, tables, recall)
    found = meet(hashed(queries, probes, tables), hashed(distinct, 1, tables), k + 1)
    top = cut(best(found.distinct(), ["d1", "d2"], k + 1).drop("rank"))
    enough = top.groupBy("d1", "d2").count().where(F.col("count") > k)
    rest = cut(queries.join(enough, ["d1", "d2"], "left_anti"))
    if not rest.isEmpty():
        top = top.join(rest.select("d1", "d2"), ["d1", "d2"], "left_anti").union(brute_force(rest, distinct, k + 1))
    own = asked.select(F.col("vec_id").alias("query_id"), "d1", "d2").join(top, ["d1", "d2"]).where("query_id <> vec_id")
    return best(own, ["query_id"], k).select("query_id", "rank", "vec_id", "score")
