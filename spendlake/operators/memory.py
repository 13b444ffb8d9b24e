"""What is remembered of users: texts as hashed vectors, search, and forgetting."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.commitments import commitment, due_at
from spendlake.functions.times import recency

WIDTH = 768
KEPT, NEAREST = 50, 20
SAME = 0.9
WORD = regex.compile(r"[\w₹]+")


def vectors(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """A row of length 1 for each text (0 for texts without words).

    Fixed values: the features are words, pairs of words and runs of four characters of the words joined by
    spaces; a feature's BLAKE2b digest of eight bytes gives its place (first four bytes, big-endian, modulo the
    width) and its sign (lowest bit of the fifth byte). Features are told apart over all texts first, so that
    each is hashed once, and a sparse count gives the rows.
    """
    numbers: dict[str, int] = {}
    owner, feature = [], []
    for row, text in enumerate(texts):
        words = WORD.findall(text.lower())
        line = " ".join(words)
        own = words + [f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1)] + [line[i : i + 4] for i in range(len(line) - 3)]
        owner.append(np.full(len(own), row))
        feature.append(np.fromiter((numbers.setdefault(f, len(numbers)) for f in own), np.int64, len(own)))
    digests = np.frombuffer(b"".join(hashlib.blake2b(f.encode(), digest_size=8).digest() for f in numbers), np.uint8).reshape(-1, 8)
    place = np.ascontiguousarray(digests[:, :4]).view(">u4").ravel().astype(np.int64) % width
    sign = np.where(digests[:, 4] & 1, 1.0, -1.0)
    rows, which = np.concatenate([np.zeros(0, np.int64), *owner]), np.concatenate([np.zeros(0, np.int64), *feature])
    sums = np.bincount(rows * width + place[which], weights=sign[which], minlength=len(texts) * width).astype(float).reshape(len(texts), width)
    sizes = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.divide(sums, sizes, out=np.zeros_like(sums), where=sizes > 0)


#: Texts that are embedded at once.
TEXTS = 256


def embed(texts):
    """Column of vectors of a column of texts; null texts have null vectors."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = pd.Series([None] * len(part), index=part.index, dtype=object)
            known = np.flatnonzero(part.notna())
            for a in range(0, len(known), TEXTS):
                at = known[a : a + TEXTS]
                for i, v in zip(at, vectors(part.iloc[at].tolist()), strict=True):
                    out.iloc[i] = v
            yield out

    return run(texts)


def cosine(a, b):
    """Dot product of two vectors of length 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search(memories: DataFrame, queries: DataFrame, now, k: int = 10, kinds: list[str] | None = None) -> DataFrame:
    """query_id, place, id and score of the k best active memories of each query's user: of the 20 nearest, by nearness, age and confidence.

    memories: id, user_id, kind, embedding, confidence, last_used_at, status (a user has at most KEPT active ones);
    kinds: only memories of these kinds.
    """
    wanted = memories.where("status = 'ACTIVE'" if kinds is None else (F.col("status") == "ACTIVE") & F.col("kind").isin(kinds))
    active = wanted.select("id", "user_id", "embedding", "confidence", "last_used_at")
    both = queries.select("query_id", "user_id", F.col("embedding").alias("q")).join(active, "user_id").withColumn("near", F.round(cosine(F.col("q"), F.col("embedding")), 6))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    top = both.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= NEAREST)
    age = F.datediff(now, F.col("last_used_at"))
    scored = top.withColumn("score", F.round(F.col("near") * recency(age) * F.col("confidence").cast("double"), 6))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select("query_id", "place", "id", "score")


def forget(memories: DataFrame, now, kept: int = KEPT) -> DataFrame:
    """memories with status FORGOTTEN for active ones beyond each user's `kept` of highest confidence times recency."""
    weight = F.round(F.col("confidence").cast("double") * recency(F.datediff(now, F.col("last_used_at"))), 9)
    active = F.col("status") == "ACTIVE"
    order = Window.partitionBy("user_id", active).orderBy(weight.desc(), "id")
    return memories.withColumn("status", F.when(active & (F.row_number().over(order) > kept), "FORGOTTEN").otherwise(F.col("status")))


def used(memories: DataFrame, found: DataFrame, now) -> DataFrame:
    """memories with last_used_at set for those that a search (id) has given."""
    hits = found.select("id").distinct().withColumn("__hit", F.lit(True))
    return memories.join(hits, "id", "left").withColumn("last_used_at", F.when(F.col("__hit"), now).otherwise(F.col("last_used_at"))).select(memories.columns)


def active_counts(memories: DataFrame) -> DataFrame:
    """Each user's number of active memories."""
    return memories.groupBy("user_id").agg(F.count_if(F.col("status") == "ACTIVE").alias("n"))


def updated(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """memories after users' changes (id, user_id, confidence, status; null leaves a field as it is). Others' memories and forgotten ones don't change; of several changes of a memory the one of largest status and confidence stands."""
    own = changes.groupBy("id", "user_id").agg(F.max(F.struct("status", "confidence")).alias("__c"))
    rows = memories.join(own, ["id", "user_id"], "left")
    may = F.col("status") != "FORGOTTEN"
    new = lambda c: F.when(may & F.col(f"__c.{c}").isNotNull(), F.col(f"__c.{c}")).otherwise(F.col(c))
    return rows.withColumns({"status": new("status"), "confidence": new("confidence")}).select(memories.columns)


def forgotten(memories: DataFrame, users_memories: DataFrame) -> DataFrame:
    """memories with those that their own users (id, user_id) want forgotten set to FORGOTTEN."""
    gone = users_memories.select("id", "user_id").distinct().withColumn("__gone", F.lit(True))
    return memories.join(gone, ["id", "user_id"], "left").withColumn("status", F.when(F.col("__gone"), "FORGOTTEN").otherwise(F.col("status"))).select(memories.columns)


def remember(memories: DataFrame, new: DataFrame, now=None, kept: int = KEPT) -> DataFrame:
    """memories after one new memory (id, user_id, kind, embedding, confidence, perhaps replaces) of each user and kind.

    A memory of the user that the new one replaces is forgotten first. If the nearest active memory of the kind
    is then SAME or nearer, that one's confidence grows by 0.1 over the larger of the two, up to 1; else the new
    memory is added. With `now`, users who then have more than `kept` active ones lose the least.
    """
    if "replaces" in new.columns:
        memories = forgotten(memories, new.where("replaces IS NOT NULL").select(F.col("replaces").alias("id"), "user_id"))
    active = memories.where("status = 'ACTIVE'").select("user_id", "kind", "id", "embedding")
    pairs = new.select("user_id", "kind", F.col("id").alias("new_id"), F.col("embedding").alias("e"), F.col("confidence").alias("c")).join(active, ["user_id", "kind"])
    near = pairs.withColumn("near", cosine(F.col("e"), F.col("embedding"))).where(F.col("near") >= SAME).groupBy("new_id", "c").agg(F.max_by("id", F.struct("near", "id")).alias("id"))
    grown = F.least(F.lit(1.0), F.greatest(F.col("confidence").cast("double"), F.col("c").cast("double")) + 0.1)
    updated_ = memories.join(near.groupBy("id").agg(F.max("c").alias("c")), "id", "left").withColumn("confidence", F.when(F.col("c").isNotNull(), grown).otherwise(F.col("confidence").cast("double"))).select(*memories.columns)
    fresh = new.join(near.select(F.col("new_id").alias("id")), "id", "left_anti").withColumn("confidence", F.col("confidence").cast("double"))
    out = updated_.unionByName(fresh.select(*memories.columns))
    return out if now is None else forget(out, now, kept)


COMMITMENT_CONFIDENCE, PREFERENCE_CONFIDENCE, CONTENT_CHARS = 0.9, 0.8, 300


def written(messages: DataFrame, feedback: DataFrame, today) -> DataFrame:
    """What users' words make worth remembering: source, user_id, kind, content, confidence and due_at.

    messages: id, user_id, text; those that hold a promise are commitments, due at the end of its day if it names
    one. feedback: id, user_id, reaction, category; a joke that was not fair is a preference on its category.
    """
    # exploded, so that a text is searched once: a filter would search it again for itself and for each field
    promised = messages.select("id", "user_id", F.explode(F.array_compact(F.array(commitment(F.col("text"), today)))).alias("__c"))
    kept = promised.select(F.col("id").alias("source"), "user_id", F.lit("COMMITMENT").alias("kind"), F.substring("__c.text", 1, CONTENT_CHARS).alias("content"), F.lit(COMMITMENT_CONFIDENCE).alias("confidence"), due_at(F.col("__c.until")).alias("due_at"))
    unfair = feedback.where("reaction = 'NOT_FAIR' AND category <> ''")
    said = F.concat(F.lit("Finds roasts about "), F.lower(F.replace("category", F.lit("_"), F.lit(" "))), F.lit(" not fair"))
    return kept.union(unfair.select(F.col("id").alias("source"), "user_id", F.lit("PREFERENCE").alias("kind"), said.alias("content"), F.lit(PREFERENCE_CONFIDENCE).alias("confidence"), F.lit(None).cast("timestamp_ntz").alias("due_at")))
