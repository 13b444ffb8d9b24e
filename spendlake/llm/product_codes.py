"""Compression of vectors to codes by parts, in whole numbers.

Components become integers; vectors are cut into equal parts, and each part has a codebook of entries. Embeddings
have few distinct integers in each dimension: a batch of rows has a dictionary of them, the squared difference of
each of its values to each entry is tabulated once, and a part's distance to an entry is the sum over its
dimensions of what the rows' dictionary codes gather. Rounds of assignment hand on sums by entry only.
"""

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.common import cut, lean, look_up

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Largest integer component; squares and their sums over a vector of up to 512 components stay whole 64-bit numbers.
LARGEST = 1 << 26
#: Components of rows that are coded at once.
COMPONENTS = 1 << 19


def integers(embeddings: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label and q (whole components) of the rows whose vector has finite components only.

    Components are floor(scale * x). A vector whose width isn't a multiple of `parts`, and a component of more
    than LARGEST, raise ValueError within tasks.
    """

    def run(batches):
        for batch in batches:
            vectors = batch.column("embedding")
            good = vectors.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.where(good, np.diff(vectors.offsets.to_numpy()), 0)
            x = vectors.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
            owner = np.repeat(np.arange(len(sizes)), sizes)
            good = good & (np.bincount(owner[~np.isfinite(x)], minlength=len(sizes)) == 0)
            q = np.floor(x[good[owner]] * np.float64(scale))
            if len(q) and np.abs(q).max() > LARGEST:
                raise ValueError(f"a component lies beyond {LARGEST / scale}")
            if (sizes[good] % parts).any():
                raise ValueError(f"a vector's width isn't a multiple of {parts}")
            offsets = np.concatenate([[0], np.cumsum(sizes[good])]).astype("<i4")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(q.astype("<i4")))
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(keep), batch.column("label").filter(keep), lists], names=["vec_id", "label", "q"])

    types = {c: embeddings.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(lean(run), f"vec_id {types['vec_id']}, label {types['label']}, q array<int>")


def nearest_entries(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry (the lower of equally near ones) and its squared distance, rows by parts; books: part, entry, place."""
    parts, entries, size = books.shape
    index, far = np.zeros((len(q), parts), np.int64), np.zeros((len(q), parts), np.int64)
    for p in range(parts):
        distances = np.zeros((len(q), entries), np.int64)
        for d in range(size):
            values, codes = np.unique(q[:, p * size + d], return_inverse=True)
            table = (values[:, None] - books[p, :, d]) ** 2
            distances += table[codes]
        index[:, p] = distances.argmin(axis=1)
        far[:, p] = distances[np.arange(len(q)), index[:, p]]
    return index, far


def matrices(batches, width: int):
    """Slices of batches of bounded size, with q as a matrix."""
    step = max(1, COMPONENTS // max(1, width))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            lists = part.column("q")
            if (np.diff(lists.offsets.to_numpy()) != width).any():
                raise ValueError("vectors have different widths")
            yield part, lists.flatten().to_numpy().astype(np.int64).reshape(part.num_rows, width)


def updated(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """books with each entry replaced by the componentwise floor of the mean of the parts assigned to it; one that no part is assigned to stays."""
    parts, entries, size = books.shape

    def run(batches):
        sums, counts = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for _, q in matrices(batches, parts * size):
            index, _ = nearest_entries(q, books)
            for p in range(parts):
                counts[p] += np.bincount(index[:, p], minlength=entries)
                for d in range(size):  # a slice's sums are below 2^53, so whole
                    sums[p, :, d] += np.bincount(index[:, p], q[:, p * size + d], entries).astype(np.int64)
        p, e = np.nonzero(counts)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sums[p, e].ravel()), size).cast(pa.list_(pa.int64())) if size else pa.array([[]] * len(p), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype("<i4")), pa.array(e.astype("<i4")), pa.array(counts[p, e]), lists], names=["part", "entry", "n", "sums"])

    partial = rows.select("q").mapInArrow(lean(run), "part int, entry int, n long, sums array<long>")
    # at most parts x entries rows reach the driver
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(size))).collect()
    out = books.copy()
    for r in total:
        out[r.part, r.entry] = [r[f"s{d}"] // r.n for d in range(size)]
    return out


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the vectors of the smallest vec_ids, at most `entries` of them; of a repeated vec_id the least vector. None if there are no rows; an entry of zeros if all vec_ids are null."""
    ids, id_ = [], F.col("vec_id")
    while len(ids) < entries:  # a row for each pass at least, and repeated ones are met once
        left = rows.where(id_ > ids[-1] if ids else id_.isNotNull())
        more = [r.vec_id for r in left.select("vec_id").orderBy("vec_id").limit(entries).collect()]
        if not more:
            break
        ids += sorted(set(more))
    least = rows.where(id_.isin(ids[:entries])).groupBy("vec_id").agg(F.min("q").alias("q")).orderBy("vec_id").collect() if ids else []
    some = least or rows.select("q").limit(1).collect()
    if not some:
        return None
    width = len(some[0].q)
    if any(len(r.q) != width for r in some):
        raise ValueError("vectors have different widths")
    q = np.array([r.q for r in least], np.int64) if least else np.zeros((1, width), np.int64)
    return q.reshape(len(q), parts, width // parts).transpose(1, 0, 2).copy()


def codes(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, indexes (of the nearest entries, in part order) and error (squared distances summed over parts) of each row."""
    width = books.shape[0] * books.shape[2]

    def run(batches):
        for part, q in matrices(batches, width):
            index, far = nearest_entries(q, books)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(index.astype("<i4").ravel()), index.shape[1]).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), lists, pa.array(far.sum(axis=1))], names=["vec_id", "label", "indexes", "error"])

    schema = T.StructType([*(rows.schema[c] for c in ("vec_id", "label")), T.StructField("indexes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    return rows.mapInArrow(lean(run), schema)


class Codebooks:
    """Codebooks fitted to whole components: part, entry, place."""

    def __init__(self, entries: np.ndarray, scale: int):
        self.entries, self.scale = entries, scale

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps({"scale": self.scale, "entries": self.entries.tolist()})

    def decode(self, coded: DataFrame) -> DataFrame:
        """coded with `approximate`: the vector that its indexes stand for (components in the middle of their integers' steps)."""
        books = F.lit(json.dumps(((self.entries + 0.5) / self.scale).tolist()))
        parts = F.transform("indexes", lambda e, p: F.get(F.get(F.from_json(books, "array<array<array<double>>>"), p), e))
        return coded.withColumn("approximate", F.flatten(parts))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks from the rows of smallest vec_id, made better by rounds over all rows. None without rows."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = updated(rows, books)
    return None if books is None else Codebooks(books, scale)


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """Codes of every row with a finite vector, and the codebooks (parts x entries x places numbers, on the driver).

    Rows whose vector is null or holds a null or non-finite component are left out; other rows come out one for
    one. A null vec_id is coded but starts no entry; fewer vec_ids than `entries` give fewer entries. Vectors of
    different widths, or of a width that `parts` doesn't divide, and components beyond LARGEST / scale raise
    ValueError. An empty table gives no rows.
    """
    rows = cut(integers(embeddings, scale, parts))
    books = fit(rows, parts, entries, rounds, scale)
    if books is None:
        return codes(rows, np.zeros((parts, 1, 0), np.int64)), None
    return codes(rows, books.entries), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error: error summed over the rows of the same label (nulls together). Sums are made before rows move, and the rows of a frequent label are looked up by broadcast."""
    key = [F.col("label").isNull().alias("__none"), F.coalesce(F.col("label"), F.lit(0).cast(coded.schema["label"].dataType)).alias("__label")]
    rows = cut(coded.select("*", *key))
    sums = rows.groupBy("__none", "__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return look_up(rows, cut(sums), ["__none", "__label"], F.col("vec_id")).drop("__none", "__label")


def summary(coded: DataFrame, books: Codebooks | None) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of each row."""
    pairs = F.transform("indexes", lambda e: F.lower(F.lpad(F.hex(e.cast("long")), 2, "0")))
    digest = F.lit(books.sha256() if books else hashlib.sha256(b"").hexdigest())
    return with_label_error(coded).select("vec_id", F.array_join(pairs, "").alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def book_sql(k: int) -> str:
    """Assignment to the k-th codebooks and the codebooks after it."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT r, part, min((d, entry)) AS best FROM (SELECT r, part, entry, sum((x - c) * (x - c)) AS d FROM v JOIN b{k} USING (part, pos) GROUP BY ALL) GROUP BY r, part),
b{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce((s - (s % n + n) % n) // n, c) AS c
  FROM b{k} LEFT JOIN (SELECT part, best[2] AS entry, pos, sum(x) AS s, count(*) AS n FROM v JOIN a{k} USING (r, part) GROUP BY ALL) USING (part, entry, pos)),"""


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
v AS MATERIALIZED (
  SELECT r, (i - 1) // (len(q) // {PARTS}) AS part, (i - 1) % (len(q) // {PARTS}) AS pos, q[i] AS x
  FROM (SELECT r, q, unnest(range(1, len(q) + 1)) AS i FROM kept)),
b0 AS MATERIALIZED (
  SELECT part, entry, pos, x AS c
  FROM v JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}) USING (r)),{"".join(map(book_sql, range(ROUNDS)))}
best AS (
  SELECT r, part, min((d, entry)) AS best
  FROM (SELECT r, part, entry, sum((x - c) * (x - c)) AS d FROM v JOIN b{ROUNDS} USING (part, pos) GROUP BY ALL) GROUP BY r, part),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error
  FROM best JOIN kept USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS BIGINT), ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded
"""
