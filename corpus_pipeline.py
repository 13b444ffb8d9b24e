"""Corpus preparation as stages over documents; each stage's result is written as Parquet and read by the next.

Filtering stages hand on the columns of documents; the last stage gives each kept document's token ids and
the text they decode to.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm import bpe, crf, decontaminate, line_spread, odd_sketch
from spendlake.llm.common import shared_dir, table
from spendlake.llm.queries import tokenizer_file, word_pattern


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field doesn't reject."""
    return crf.clean(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites share; documents that consist of such lines go."""
    return line_spread.clean(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates."""
    return odd_sketch.deduplicate(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and the decoded text of each document."""
    path, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), word_pattern()
    both = bpe.encode_decode(docs, path, pattern, keep=("doc_id", "lang", "source"))
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.decode("decoded", "UTF-8").alias("text"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near-duplicates", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL can express neither the random field nor byte-pair merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
