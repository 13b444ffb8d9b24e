"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on trusted text, a model for each language. An n-gram is two long numbers: language and
first two characters, and the last three, 21 bits each, so that contexts and tails are bit operations. N-grams
are counted in tasks and summed by key; continuation counts, discounts, back-off weights and probabilities are
joins and aggregations of count tables, one for each order, that are sharded by n-gram. Every n-gram of the
corpus gets its probability by these joins. The most frequent ones, a fixed number, go to the tasks that score
documents; the others come to each document's score by a join, so that the result is whole at any size.

A share of the trusted documents is not trained on: a language's threshold is a quantile of their perplexity.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.llm.common import Steps, chunks, cut, lean

ORDER = 5
#: N-grams whose probabilities are broadcast: 20 bytes each, 10 MB at any size of the corpus.
BROADCAST_GRAMS = 1 << 19
#: N-grams that a counting task holds, and occurrences that it gathers before it counts anew.
TASK_GRAMS, TASK_PENDING = 1_000_000, 2_000_000
#: A document is kept up to this quantile of the perplexity of its language's held-out trusted documents.
QUANTILE = 0.995
#: One in so many trusted documents, by a hash of doc_id, is held out for the threshold.
FOLDS = 5
#: Languages there may be (values of lang); their names are numbered on the driver.
MOST_LANGS = 1 << 16
#: Bits of a block of the filter for trusted documents, and blocks: 16 MB at most.
BLOCK_BITS, MOST_BLOCKS = 4_096, 1 << 15
START = "\x02"
BITS = 21


def normal(text: str | None) -> str:
    """Lower case, and a space for each run of white space."""
    return " ".join(text.lower().split()) if text else ""


def grams(texts: list[str], langs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of the normalised texts (its two numbers), texts one after another, and the texts' lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join([START * (ORDER - 1) + t for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    n = max(0, len(points) - ORDER + 1)
    keep = np.ones(len(points), bool)
    keep[(np.cumsum(sizes + ORDER - 1)[:, None] - np.arange(1, ORDER)).ravel()] = False  # n-grams that would reach into the next text
    at = np.flatnonzero(keep[:n])
    high = np.repeat(np.array(langs, np.int64), sizes) << 2 * BITS | points[at] << BITS | points[at + 1]
    return high, points[at + 2] << 2 * BITS | points[at + 3] << BITS | points[at + 4], sizes


def spread(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each n-gram, to sort by."""
    x = (high.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ low.view(np.uint64)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def counted(high: np.ndarray, low: np.ndarray, *numbers: np.ndarray) -> list[np.ndarray]:
    """The n-grams with the sums of their numbers. Where two n-grams have one hash, one of them may come out in parts, which add up later."""
    order = np.argsort(spread(high, low))
    high, low = high[order], low[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    starts = np.flatnonzero(new)
    return [high[starts], low[starts], *(np.add.reduceat(x[order], starts) if len(starts) else x for x in numbers)]


def gram_counts(docs: DataFrame) -> DataFrame:
    """high, low, n and c: counts of every n-gram of docs (columns lang_id, text, maybe) in all texts and in those with `maybe`, summed within tasks; an n-gram has a row from each of several tasks."""
    names = ["high", "low", "n", "c"]

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4
        pending, waiting = [], 0
        for batch in batches:
            for part in chunks(batch):
                high, low, sizes = grams([normal(t) for t in part.column("text").to_pylist()], part.column("lang_id").to_pylist())
                maybe = np.repeat(part.column("maybe").to_numpy(zero_copy_only=False).astype(np.int64), sizes)
                pending.append(counted(high, low, np.ones(len(high), np.int64), maybe))
                waiting += len(pending[-1][0])
                if waiting > TASK_PENDING:
                    held, pending, waiting = counted(*map(np.concatenate, zip(held, *pending, strict=True))), [], 0
                    if len(held[0]) > TASK_GRAMS:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), names=names)
                        held = [np.zeros(0, np.int64)] * 4
        held = counted(*map(np.concatenate, zip(held, *pending, strict=True)))
        yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), names=names)

    return docs.select("lang_id", "text", "maybe").mapInArrow(lean(run), ", ".join(f"{c} long" for c in names))


def flagged(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with `maybe`: true for rows whose doc_id is one of ids, and for a few others.

    A Bloom filter in blocks of BLOCK_BITS bits, joined by broadcast, so that texts needn't be shuffled to be
    looked up. Above a few million ids it takes more others for one of them.
    """
    blocks = min(MOST_BLOCKS, max(1, 1 << (12 * ids.count() // BLOCK_BITS).bit_length()))
    key = F.col("doc_id").cast("string")
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")
    places = [F.shiftright(F.xxhash64(F.lit(1), key), s).bitwiseAND(F.lit(BLOCK_BITS - 1)) for s in (0, 12, 24)]
    bits = ids.select(block, F.explode(F.array(*places)).alias("p")).groupBy("block", F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    words = bits.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m")).select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0))).alias("words"))
    is_set = lambda p: F.get("words", F.shiftright(p, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))) != 0
    met = docs.withColumn("block", block).join(F.broadcast(words), "block", "left")
    maybe = F.col("doc_id").isNotNull() & F.col("words").isNotNull() & is_set(places[0]) & is_set(places[1]) & is_set(places[2])
    return met.withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("block", "words")


def mask(column, characters: int):
    return F.col(column).bitwiseAND(F.lit((1 << BITS * characters) - 1))


def language(column="high"):
    return F.shiftright(column, 2 * BITS)


def tail(order: int) -> list:
    """An n-gram of `order` characters or more without those before its last `order`."""
    lang = F.shiftleft(language(), 2 * BITS)
    high = F.col("high") if order >= 5 else lang.bitwiseOR(mask("high", 1)) if order == 4 else lang
    return [high.alias("high"), (F.col("low") if order >= 3 else mask("low", order)).alias("low")]


def context() -> list:
    """All characters but the last."""
    high = F.shiftleft(language(), 2 * BITS).bitwiseOR(F.shiftright(mask("high", 2), BITS))
    return [high, F.shiftright("low", BITS).bitwiseOR(F.shiftleft(mask("high", 1), 2 * BITS))]


def discounts(counts: DataFrame) -> DataFrame:
    """lang_id, d1, d2, d3 and alphabet (n-grams of the order) of each language with trained text: at most MOST_LANGS rows."""
    ones = counts.where("c > 0").groupBy(language().alias("lang_id")).agg(F.count(F.lit(1)).alias("alphabet"), *(F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    d = lambda i: F.when(enough, F.greatest(F.lit(0.05), F.least(F.lit(float(i)), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(F.lit(i / 2))
    return ones.select("lang_id", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"), "alphabet")


def probabilities(counts: DataFrame, caller: Steps) -> DataFrame:
    """high, low, n and log_p of every n-gram, by the counts c of trained text; a table of the caller's steps.

    At the highest order c is the count, below it the number of distinct n-grams it continues. Discounts
    D1, D2, D3+ come from the counts of counts; where these are too few, they are 0.5, 1 and 1.5. The lowest
    order is interpolated with a uniform share over the alphabet and one unknown character.
    """
    steps = Steps(counts.sparkSession)
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = steps.cut(tables[k + 1].select(*tail(k), "c").groupBy("high", "low").agg(F.count_if(F.col("c") > 0).alias("c")))
    p = None
    for k in range(1, ORDER + 1):
        rows = tables[k].join(F.broadcast(discounts(tables[k]).withColumn("one", F.col("lang_id"))), language() == F.col("one"), "left").drop("one")
        d = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.withColumn("d", d)
        if k == 1:
            whole = rows.where("c > 0").groupBy("lang_id").agg(F.sum("c").alias("total"), F.sum("d").alias("mass"))
            rows = rows.join(F.broadcast(whole), "lang_id", "left").withColumn("lower", 1 / (F.coalesce("alphabet", F.lit(999)) + 1))
        else:
            same = Window.partitionBy(*context())  # as many rows as characters may follow
            rows = rows.withColumn("total", F.sum("c").over(same)).withColumn("mass", F.sum("d").over(same))
            lower = p.select(F.col("high").alias("high_"), F.col("low").alias("low_"), F.col("p").alias("lower"))
            high, low = tail(k - 1)
            rows = rows.withColumn("high_", high).withColumn("low_", low).join(lower.hint("merge"), ["high_", "low_"])
        mixed = (F.col("c") - F.col("d") + F.col("mass") * F.col("lower")) / F.col("total")
        value = F.when(F.col("total") > 0, mixed).otherwise(F.col("lower"))
        if k == ORDER:
            out = caller.cut(rows.select("high", "low", "n", F.log(value).alias("log_p")))
            steps.drop(*list(tables.values())[1:], p)
            return out
        after = steps.cut(rows.select("high", "low", value.alias("p")))
        if p is not None:
            steps.drop(p)
        p = after


def least_count(model: DataFrame, most: int) -> int:
    """The least n that at most `most` rows of model reach, to a sixteenth of a doubling: from a histogram of at most a thousand rows, so that no task ranks what the corpus has."""
    steps = model.groupBy(F.floor(16 * F.log2("n")).alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).collect()
    least, so_far = 1 << 62, 0
    for r in sorted(steps, key=lambda r: -r.step):
        so_far += r.rows
        if so_far > most:
            break
        least = r.least
    return least


def scored(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang_id, n_chars and sum of log_p of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    frequent = model.where(F.col("n") >= least_count(model, BROADCAST_GRAMS)).select("high", "low", F.col("log_p").cast("float").alias("log_p")).toArrow()
    high, low, log_p = (frequent[c].to_numpy() for c in ("high", "low", "log_p"))
    order = np.argsort(spread(high, low))
    sent = docs.sparkSession.sparkContext.broadcast((high[order], low[order], log_p[order]))

    def run(batches):
        high_of, low_of, log_of = sent.value
        hashes = spread(high_of, low_of)
        for batch in batches:
            for part in chunks(batch):
                high, low, sizes = grams([normal(t) for t in part.column("text").to_pylist()], part.column("lang_id").to_pylist())
                doc = np.repeat(np.arange(len(sizes)), sizes)
                hit, each = np.zeros(len(high), bool), np.zeros(len(high))
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, spread(high, low)), len(hashes) - 1)
                    hit = (high_of[at] == high) & (low_of[at] == low)
                    each = np.where(hit, log_of[at], 0.0)
                sums = np.bincount(doc, weights=each, minlength=len(sizes))
                own = doc[~hit]
                offsets = np.searchsorted(own, np.arange(len(sizes) + 1)).astype("i4")
                rest = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(high[~hit]), pa.array(low[~hit])], names=["high", "low"]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "lang_id")), pa.array(sizes), pa.array(sums), rest], names=["doc_id", "lang_id", "n_chars", "log_p", "rest"])

    steps = Steps(docs.sparkSession)
    first = docs.select("doc_id", "lang_id", "text").mapInArrow(lean(run), f"doc_id {kind}, lang_id int, n_chars long, log_p double, rest array<struct<high: long, low: long>>")
    first = steps.cut(first.withColumn("row", F.monotonically_increasing_id()))
    rest = first.where(F.size("rest") > 0).select("row", F.explode("rest").alias("r")).groupBy("row", "r.high", "r.low").agg(F.count(F.lit(1)).alias("k"))
    more = rest.join(model.select("high", "low", F.col("log_p").alias("one")).hint("merge"), ["high", "low"]).groupBy("row").agg(F.sum(F.col("k") * F.col("one")).alias("more"))
    out = cut(first.drop("rest").join(more.hint("merge"), "row", "left").select("doc_id", "lang_id", "n_chars", (F.col("log_p") + F.coalesce("more", F.lit(0.0))).alias("log_p")))
    steps.drop(first)
    return out


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_chars, perplexity (per character), threshold and keep of each row of docs.

    Trusted text: documents that `labels` give quality 1. One in FOLDS of them is held out of training; the
    threshold of a language is the quantile of the held-out documents' perplexity. A language without any has no
    threshold, and its documents are kept. Null, empty and blank texts have no characters, a null perplexity and
    are not kept. A null lang is a language of its own; rows without doc_id are judged but never trusted;
    repeated rows count each. More than MOST_LANGS languages raise ValueError.
    """
    spark = docs.sparkSession
    langs = [r.lang for r in docs.select("lang").distinct().limit(MOST_LANGS + 1).collect()]
    if len(langs) > MOST_LANGS:
        raise ValueError(f"lang has more than {MOST_LANGS} values")
    numbers = {lang: i for i, lang in enumerate(sorted(langs, key=lambda x: (x is not None, x or "")))}
    named = spark.createDataFrame([(i, lang) for lang, i in numbers.items()], "lang_id int, name string")
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(named), F.col("lang").eqNullSafe(F.col("name")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    trained = trusted.where(~held_out)
    steps = Steps(spark)
    marked = flagged(rows, trained)
    # documents that the filter takes for trained ones: their counts are taken back
    others = steps.cut(marked.where("maybe").select("doc_id").distinct().join(trained, "doc_id", "left_anti"))
    wrong = flagged(rows, others).where("maybe").join(others, "doc_id", "left_semi")
    parts = gram_counts(marked).union(gram_counts(wrong).select("high", "low", F.lit(0).cast("long"), -F.col("c")))
    counts = steps.cut(parts.groupBy("high", "low").agg(F.sum("n").alias("n"), F.sum("c").alias("c")))
    model = probabilities(counts, steps)
    steps.drop(counts, others)
    each = scored(rows, model)
    steps.drop(model)
    each = each.withColumn("perplexity", F.when(F.col("n_chars") > 0, F.exp(-F.col("log_p") / F.col("n_chars"))))
    judges = each.where("perplexity IS NOT NULL").join(trusted.where(held_out), "doc_id", "left_semi")
    limits = judges.groupBy("lang_id").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    out = each.join(F.broadcast(named), "lang_id").join(F.broadcast(limits), "lang_id", "left")
    keep = F.coalesce((F.col("perplexity") <= F.col("threshold")), F.col("threshold").isNull() & F.col("perplexity").isNotNull(), F.lit(False))
    return out.select("doc_id", F.col("name").alias("lang"), "n_chars", "perplexity", "threshold", keep.alias("keep"))
