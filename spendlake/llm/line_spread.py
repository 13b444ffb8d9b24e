"""Removal of boilerplate lines by their spread over sites.

One pass gives a HyperLogLog sketch of the sites of each line (by a 128-bit hash) and its first place; sketches
merge in map-side and final aggregation. Every non-blank line counts, and how many sites make it boilerplate
depends on its length. Lines whose estimate is near their threshold get an exact distinct count. Of a line on
many sites, the first place stays and the others go.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import cut, digest128, look_up, quoted

LG_K = 12
#: Relative standard error of the sketches' estimates.
ERROR = 1.04 / (1 << LG_K) ** 0.5
MIN_SITES = 3
MIN_CHARS = 20
#: Lines of so many words don't repeat by chance.
LONG_WORDS, LONG_SITES = 50, 2


def line_key(line) -> list:
    return [k.alias(n) for k, n in zip(digest128(F.trim(line)), ("h1", "h2"), strict=True)]


def least_sites(line):
    """Sites from which on a non-blank line is boilerplate: LONG_SITES if it has LONG_WORDS words, else MIN_SITES, and one more for each character it has under MIN_CHARS."""
    long = (F.length(line) >= 2 * LONG_WORDS - 1) & (F.size(F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")) >= LONG_WORDS)
    return F.when(line.rlike(r"\S"), F.when(long, LONG_SITES).otherwise(MIN_SITES + F.greatest(F.lit(0), MIN_CHARS - F.length(F.trim(line)))))


def row_number(docs: DataFrame):
    """A number that follows from a row's text and site; with doc_id it tells rows apart, except those that are alike in all three, which count as one row."""
    text, site = (F.coalesce(docs[c], F.lit("")) for c in ("text", "source"))
    return F.conv(F.substring(F.md5(F.concat(text, F.lit("|"), site)), 1, 15), 16, 10).cast("long")


def spread_lines(docs: DataFrame, min_sites: int | None, min_chars: int | None) -> DataFrame:
    """doc_id, row, at, h1, h2, site and least (sites to be boilerplate) of each line that counts."""
    # the row's number is made before lines are; beside posexplode it would be made again for each line
    rows = docs.select("doc_id", row_number(docs).alias("row"), F.coalesce("source", F.lit("")).alias("site"), "text")
    lines = rows.select("doc_id", "row", "site", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = F.col("line")
    own = min_sites is not None or min_chars is not None
    least = F.when(F.length(F.trim(line)) >= (MIN_CHARS if min_chars is None else min_chars), MIN_SITES if min_sites is None else min_sites) if own else least_sites(line)
    return lines.withColumn("least", least.cast("int")).where("least IS NOT NULL").select("doc_id", "row", "site", "at", "least", *line_key(line))


def boilerplate(docs: DataFrame, min_sites: int | None = None, min_chars: int | None = None) -> DataFrame:
    """h1, h2, first place (doc_id, row, at) and number of places of each line that stands on least_sites() sites or more; with min_sites or min_chars, of each of at least min_chars characters on min_sites sites or more."""
    lines = spread_lines(docs, min_sites, min_chars)
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sites"), F.min(F.struct("doc_id", "row", "at")).alias("first"), F.max("least").alias("least"), F.count(F.lit(1)).alias("n"))
    margin = F.greatest(F.lit(1), F.round(4 * ERROR * F.col("least")))
    spread = cut(sketched.select("h1", "h2", "first", "least", "n", F.hll_sketch_estimate("sites").alias("about")).where(F.col("about") >= F.col("least") - margin))
    near = spread.where(F.col("about") <= F.col("least") + margin)
    # the sites of a line are made distinct before the line is looked up, so that a line's places never meet in one task
    sites = lines.select("h1", "h2", "site").distinct().join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
    exact = sites.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact"))
    counted = near.join(exact, ["h1", "h2"]).where("exact >= least").drop("exact")
    return spread.where(F.col("about") > F.col("least") + margin).union(counted).select("h1", "h2", "first", "n")


def without_boilerplate(docs: DataFrame, min_sites: int | None = None, min_chars: int | None = None) -> DataFrame:
    """docs with boilerplate lines taken out of text, and columns n_lines and n_removed (in place of columns of these names).

    A line counts without spaces around it. Its first place, by doc_id (null first), row and line number, stays,
    so that no content is lost; lines repeated on fewer sites stay. Rows of one doc_id, or without one, are rows of
    their own, but for those alike in doc_id, text and source: each of these keeps what one of them keeps. A null
    source is a site like any other (the empty one). Null texts stay null, with no lines; other columns, names of
    any kind and row counts stay.
    """
    found = cut(boilerplate(docs, min_sites, min_chars))
    id_, row_, drops_ = (unused(name, docs) for name in ("id", "row", "drops"))
    place = F.struct("doc_id", "row", "at")
    places = look_up(spread_lines(docs, min_sites, min_chars).drop("least", "site"), found, ["h1", "h2"], place).where("first IS NOT NULL")
    drops = places.where(place != F.col("first")).groupBy(F.col("doc_id").alias(id_), F.col("row").alias(row_)).agg(F.sort_array(F.collect_set("at")).alias(drops_))
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops[id_]) & (row_number(docs) == drops[row_]), "left")
    lines = F.split("text", "\n")
    text = F.when(F.col(drops_).isNull(), F.col("text")).otherwise(F.array_join(between(lines, F.col(drops_)), "\n"))
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long")
    n_removed = F.coalesce(F.when(F.col("text").isNotNull(), F.size(drops_)), F.lit(0)).cast("long")
    columns = [text.alias("text") if c == "text" else docs[quoted(c)] for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, F.greatest(n_lines, F.lit(0)).alias("n_lines"), F.greatest(n_removed, F.lit(0)).alias("n_removed"))


def between(lines, drops):
    """lines without those at the places of drops (ascending): the stretches between them, so the work grows with both together."""
    ends = F.transform(F.arrays_zip(F.concat(F.array(F.lit(-1)), drops).alias("a"), F.concat(drops, F.array(F.size(lines))).alias("b")), lambda z: F.struct((z["a"] + 2).alias("first"), (z["b"] - z["a"] - 1).alias("n")))
    # within a lambda, the split lines are a value that is at hand, not an expression to evaluate for each stretch
    bound = F.array(F.struct(lines.alias("lines"), ends.alias("ends")))
    return F.transform(bound, lambda x: F.flatten(F.transform(x["ends"], lambda e: F.slice(x["lines"], e["first"], e["n"]))))[0]


def unused(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def summary(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def clean(docs: DataFrame, min_sites: int | None = None, min_chars: int | None = None) -> DataFrame:
    """docs without boilerplate lines; documents that consisted of them go, as their lines stay elsewhere. Columns n_lines and n_removed of docs stay as they are."""
    own = {c: unused(f"own_{c}", docs) for c in docs.columns if c in ("n_lines", "n_removed")}
    cleaned = without_boilerplate(docs.withColumnsRenamed(own), min_sites, min_chars)
    left = cleaned.where((F.col("n_removed") == 0) | (F.length(F.regexp_replace("text", "\\s", "")) > 0)).drop("n_lines", "n_removed")
    return left.withColumnsRenamed({v: k for k, v in own.items()}).select(*map(quoted, docs.columns))


SQL = rf"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, '') AS site, (coalesce(doc_id, -9223372036854775808), ('0x' || substr(md5(coalesce(text, '') || '|' || coalesce(source, '')), 1, 15))::BIGINT) AS place FROM documents),
lines AS (SELECT r, place, site, i, l[i] AS line, trim(l[i], ' ') AS k FROM (SELECT r, place, site, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS l FROM rows))),
ruled AS (
  SELECT k, place, i, site, CASE WHEN len(regexp_extract_all(k, '[^ \t\n\x0B\f\r]+')) >= {LONG_WORDS} THEN {LONG_SITES} ELSE {MIN_SITES} + greatest(0, {MIN_CHARS} - length(k)) END AS least
  FROM lines WHERE regexp_matches(k, '[^ \t\n\x0B\f\r]')),
spread AS (SELECT k, min((place, i)) AS first FROM ruled GROUP BY k HAVING count(DISTINCT site) >= max(least)),
judged AS (SELECT r, i, line, first IS NOT NULL AND first <> (place, i) AS gone FROM lines LEFT JOIN spread USING (k)),
texts AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS text
  FROM judged GROUP BY r)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(texts.text, '')) AS text_sha256
FROM rows LEFT JOIN texts USING (r)
"""
