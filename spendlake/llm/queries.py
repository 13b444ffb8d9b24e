"""Queries of the driver's contract, and their SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm import ann, bpe, chat, crf, decontaminate, fim, kneser_ney, line_spread, odd_sketch, pieces, product_codes, records, url_rules
from spendlake.llm.common import table

#: A text that holds the chat template's own control strings.
TRIAL = "\\### Assistant: </turn> ok"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summary(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    trial = spark.createDataFrame([(-7, 0, "user", TRIAL), (-7, 1, "assistant", TRIAL)], "conv_id long, turn long, role string, text string")
    columns = [F.col(c).cast(rows.schema[c].dataType) for c in trial.columns]
    return chat.read_back(chat.formatted(rows.select(*trial.columns).union(trial.select(*columns)))).drop("fault")


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.summary(line_spread.without_boilerplate(table(spark, sf_dir, "documents")))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.verdicts(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, url_rules.RULES))


def op7_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.classes(table(spark, sf_dir, "documents"), percent=85)


def op8_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), word_pattern())


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), word_pattern(), end_id=2)
    return records.summary(records.read(manifest))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.summary(fim.transform(table(spark, sf_dir, "documents"), rate=100, spm_rate=50, seed=7))


def op12_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.summary(*product_codes.compressed(table(spark, sf_dir, "embeddings")))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_cross_polytope, op2_decontaminate, op3_kneser_ney, op4_chat, op5_line_spread, op6_url_rules, op7_odd_sketch, op8_crf, op9_bpe, op10_records, op11_fill_middle, op12_product_codes, op13_pieces)}
ORACLE_SQL: dict[str, str] = {"op2_decontaminate": decontaminate.SQL, "op4_chat": chat.SQL,
    "op5_line_spread": line_spread.SQL,
    "op6_url_rules": url_rules.SQL, "op7_odd_sketch": odd_sketch.SQL, "op11_fill_middle": fim.SQL, "op12_product_codes": product_codes.SQL}
