"""URL filters by host-suffix and path-prefix expressions.

Each URL is expanded into the expressions that a rule on it could have: every suffix of its host at a dot,
with every prefix of its path of a length that rules have. Expressions meet rules by an equi-join on short
hash prefixes; full digests confirm, and the longest rule wins. Only built-in functions are used.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm.common import cut

#: (verdict, rule) of the contract's query.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
PREFIX_BITS = 32


def parts(url) -> dict:
    """Host (lower-cased A-Z) and path of a URL; both empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return {"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path}


def digest(expression):
    return F.sha2(expression, 256)


def short(expression):
    """The digest's first PREFIX_BITS bits."""
    return F.substring(digest(expression), 1, PREFIX_BITS // 4)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """verdict and rule (host/path) rows. Of one rule given twice, block stands."""
    rows = spark.createDataFrame(rules, "verdict string, rule string").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    return rows.withColumn("at", F.instr("rule", "/")).where("at > 0").withColumn("path_length", F.length("rule") - F.col("at") + 1).withColumn("digest", digest(F.col("rule"))).withColumn("short", short(F.col("rule"))).drop("at")


def verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages.

    A rule fits if the URL's host is the rule's or ends with a dot and the rule's, and the path starts with
    the rule's path. The longest rule that fits wins (of equally long ones, the one with the longer host),
    else `default` holds. Null and malformed URLs have an empty host and path, which no rule fits; an empty rule
    table fits nothing. Rows are judged where they are: only expressions leave a row, and only rows that a rule
    fits are gathered, each by itself, so a URL or host that a large share of rows has costs no more than others.
    """
    rows = pages.select("page_id", *(c.alias(n) for n, c in parts(F.coalesce("url", F.lit(""))).items()))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    lengths = [r.path_length for r in rules.select("path_length").distinct().collect()]  # at most as many numbers as the longest path has characters
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(fitting, lambda n: F.concat(h, F.substring(F.col("path"), F.lit(1), n)))))
    expanded = rows.where("host <> ''").select("row", F.explode(F.array_distinct(expressions)).alias("expression")).withColumn("short", short(F.col("expression")))
    found = expanded.join(rules, "short").where(digest(F.col("expression")) == F.col("digest"))
    order = F.struct(F.length("rule"), F.length("rule") - F.col("path_length"), "rule")
    winners = found.groupBy("row").agg(F.max_by(F.struct("rule", "verdict"), order).alias("won"))
    return rows.join(winners, "row", "left").select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
WITH rules(verdict, rule, host, path) AS (VALUES
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
  ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(r, '(?s)\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '(?s)\A[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT c.page_id, arg_max((u.rule, u.verdict), length(u.rule)) AS won FROM (SELECT DISTINCT * FROM cut) c JOIN rules u
  ON (c.host = u.host OR ends_with(c.host, '.' || u.host)) AND starts_with(c.path, u.path) GROUP BY c.page_id)
SELECT page_id, host, path, won[1] AS rule, coalesce(won[2], 'allow') AS verdict FROM cut LEFT JOIN fits USING (page_id)
"""
