"""Benchmark decontamination by winnowing.

Each window of `span` words keeps the least hash among its k-grams; benchmark and document windows with the
same words keep the same one, so a join on kept hashes finds every shared span of `span` words. Hits are
extended to the windows around them, whose digests join with the hashes. Items shorter than a span are looked
for whole. A Bloom filter of bounded size over the benchmark's hashes goes to the tasks, so that only hashes
that may join leave them; false positives fall out in the join. Windows that very many documents have (a
benchmark's boilerplate) are looked up by broadcast, so that they don't meet in one task.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import Hashes, chunks, cut, lean, look_up
from spendlake.llm.grams import alnum_words, grams, word_hashes

SPAN = 13
GRAM = 7
#: The Bloom filter has BITS_A_WINDOW bits for each window of the benchmark, rounded up to a power of two, within these bounds
#: (8 kB and 16 MB). Beyond, from some ten million windows on, more hashes pass it that don't join; the result is the same.
BITS_A_WINDOW = 12
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: Items of a window that may be sent to every task with the most frequent windows.
SENT_ITEMS = 64
SHIFTS = (0, 18, 36)

HITS = "array<struct<fp: long, at: int, size: int, d1: long, d2: long>>"
WINDOW = ["fp", "size", "d1", "d2"]


def digest(words: list[bytes]) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def least_grams(hashes: np.ndarray) -> np.ndarray:
    """The kept hash of each window of SPAN words."""
    if len(hashes) < SPAN:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(grams(hashes, GRAM), SPAN - GRAM + 1).min(axis=1)


def bloom_places(fps: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((fps >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in SHIFTS]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """fp, size, d1, d2 and the sorted item_ids of each distinct window. Null and wordless items have none."""

    def run(batches):
        memory = Hashes()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = alnum_words(text)
                hashes = word_hashes(words, memory)
                size = min(SPAN, len(words))
                if size:
                    fps = least_grams(hashes) if size == SPAN else grams(hashes, size)
                    rows += {(fp, size, *digest(words[at : at + size]), item) for at, fp in enumerate(fps.view(np.int64).tolist())}
            yield pa.RecordBatch.from_pylist([dict(zip(("fp", "size", "d1", "d2", "item_id"), r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("fp", pa.int64()), ("size", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("item_id", pa.string())])
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    found = items.mapInArrow(lean(run), "fp long, size int, d1 long, d2 long, item_id string")
    return found.groupBy("fp", "size", "d1", "d2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def bloom(windows: DataFrame) -> np.ndarray:
    """The filter's bytes; what reaches the driver is at most MOST_BITS bits."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_WINDOW * windows.count()).bit_length()))
    fp = F.col("fp")
    places = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit(size - 1)) for s in SHIFTS]
    words = windows.select(F.explode(F.array(*places)).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    out = np.zeros(size // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return out.view(np.uint8)


def document_hits(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """doc_id, n_words and the windows whose kept hash the filter lets through."""
    broadcast = docs.sparkSession.sparkContext.broadcast(bits)
    short = [s for s in sizes if s < SPAN]

    def passes(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
        ok = np.ones(len(fps), bool)
        for p in bloom_places(fps, 8 * len(bits)):
            ok &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return ok

    def run(batches):
        bits, memory = broadcast.value, Hashes()
        for batch in batches:
            for part in chunks(batch):
                words = [alnum_words(t) for t in part.column("text").to_pylist()]
                ends = np.cumsum([len(w) for w in words])
                flat = [w for x in words for w in x]
                hashes = word_hashes(flat, memory)
                hits: list[list[dict]] = [[] for _ in words]
                for size in [*short, *([SPAN] if SPAN in sizes else [])]:
                    fps = least_grams(hashes) if size == SPAN else grams(hashes, size)
                    at = np.flatnonzero(passes(fps, bits))
                    doc = np.searchsorted(ends, at, side="right")
                    inside = at + size <= ends[doc] if len(at) else np.zeros(0, bool)
                    for a, d, fp in zip(at[inside].tolist(), doc[inside].tolist(), fps[at[inside]].view(np.int64).tolist(), strict=True):
                        d1, d2 = digest(flat[a : a + size])
                        hits[d].append({"fp": fp, "at": a - int(ends[d]) + len(words[d]), "size": size, "d1": d1, "d2": d2})
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(hits, arrow_hits)], names=["doc_id", "n_words", "hits"])

    arrow_hits = pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_words long, hits {HITS}")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings) and contaminated of each row of docs.

    A word is hit inside any occurrence of 13 consecutive words of an item, or of a whole item of fewer
    words; a document is contaminated if a word is hit and hit words are a twentieth of its words or more.
    Null and empty texts have no words and no hits; rows without doc_id and repeated rows are judged like
    others, each by itself; an empty benchmark hits nothing. Other columns are not read.
    """
    windows = cut(benchmark_windows(benchmark))
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # at most SPAN numbers
    seen = cut(document_hits(docs, bloom(windows), sizes).withColumn("row", F.monotonically_increasing_id()))
    hits = seen.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    known = windows.join(hits.groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("n")).hint("merge"), WINDOW)
    confirmed = look_up(hits, known, WINDOW, F.struct("row", "at"), F.size("items") <= SENT_ITEMS).where("items IS NOT NULL")
    grouped = confirmed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("size")).alias("stop")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    n_hit = F.expr("aggregate(spans, struct(0L AS n, 0 AS stop), (s, x) -> struct(s.n + greatest(0, x.stop - greatest(x.at, s.stop)) AS n, greatest(s.stop, x.stop) AS stop), s -> s.n)")
    each = seen.select("row", "doc_id", "n_words").join(grouped.select("row", n_hit.alias("n_hit"), "item_ids"), "row", "left")
    each = each.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return each.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def summary(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated; a doc_id that stands in several rows goes as soon as one of them is contaminated."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark),
known AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
words AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
spans AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM known) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM spans JOIN known USING (n, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
