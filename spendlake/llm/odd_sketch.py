"""Near-duplicate documents by MinHash bands and odd sketches.

Documents with the same set of word shingles are one set from the start, whose number everything goes by until
components are named. MinHash bands put sets into buckets; in each bucket, the one of smallest doc_id is compared with all others, so that a
group of any size costs a comparison a member. An odd sketch (parities of MinHash samples; the population
count of two sketches' XOR estimates how much two sets differ) sorts out pairs that are far from the
threshold; the others are confirmed on full sets. Links found this way make up components. Members of a
bucket that ended up outside its leader's component are then held against the bucket's other members, in
blocks of bounded size: sketches first, then the full sets of rows with a plausible partner; only links leave.

Joins of tables that grow with the corpus are asked to be merge joins, so that a plan is the same at every size.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.common import Hashes, Steps, chunks, cut, lean, look_up, quoted, salted
from spendlake.llm.grams import MULTIPLIER, grams, mix, space_words, word_hashes

SHINGLE = 5
ROWS = 5
SKETCH_LONGS = 16
#: Chance that no band holds a pair at the threshold.
MISS = 1e-7
#: Rows on either side of a block of sketches.
BLOCK_SKETCHES = 2_048
#: Shingles on either side of a block of sets, and columns of its matrices.
BLOCK_SHINGLES = 400_000
COLUMNS = 2048


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


def most_bits(percent: int, samples: int) -> int:
    """Differing sketch bits beyond which a pair is taken to lie under the threshold: six deviations of the samples and of the sketch away."""
    j, bits = percent / 100, 64 * SKETCH_LONGS
    apart = 2 * samples * (1 - j + 6 * math.sqrt(j * (1 - j) / samples))
    mean = bits / 2 * (1 - math.exp(-2 * apart / bits))
    return math.ceil(mean + 6 * math.sqrt(mean / 2))


def shingles(text: bytes | None, memory: Hashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: runs of five words, or all words if there are fewer."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(grams(word_hashes(words, memory), min(SHINGLE, len(words))))


def samples_of(shingle_set: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each of many hashes over a set."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingle_set), 4096):
        np.minimum(out, (shingle_set[at : at + 4096, None] * a + b).min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, set digest (d1, d2), bands and sketch of each row."""
    bands = bands_for(percent)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        rng = np.random.default_rng(85)
        a = rng.integers(0, 1 << 63, bands * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
        b = rng.integers(0, 1 << 63, bands * ROWS, np.uint64)
        place = np.arange(bands * ROWS, dtype=np.uint64)
        memory = Hashes()
        for batch in batches:
            for part in chunks(batch):
                sizes, digests, samples = [], [], []
                for text in part.column("text").to_pylist():
                    s = shingles(text, memory)
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    samples.append(samples_of(s, a, b))
                m = np.stack(samples)
                keys = np.zeros((len(m), bands), np.uint64)
                for r in range(ROWS):
                    keys = keys * MULTIPLIER + mix(m[:, r::ROWS])
                bits = (mix(m + place * MULTIPLIER) % np.uint64(64 * SKETCH_LONGS)).astype(np.int64)
                parity = np.zeros((len(m), 64 * SKETCH_LONGS), np.uint8)
                np.add.at(parity, (np.arange(len(m))[:, None], bits), 1)
                sketch = np.packbits(parity & 1, axis=1).view(np.int64)
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (mix(keys).view(np.int64), sketch)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), *lists], names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "bands", "sketch"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, text_hash long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id and shingles of the wanted sets (set_id, and doc_id and text_hash of a row that has it). Repeats of that row meet one after another, and count once."""

    def run(batches):
        memory, last = Hashes(), None
        for batch in batches:
            for part in chunks(batch):
                ids = part.column("set_id").to_pylist()
                new = [i != j for i, j in zip(ids, [last, *ids[:-1]], strict=True)]
                last = ids[-1]
                own = part.filter(pa.array(new))
                sets = [shingles(t, memory) for t in own.column("text").to_pylist()]
                offsets = np.zeros(len(sets) + 1, "<i4")
                np.cumsum([len(s) for s in sets], out=offsets[1:])
                values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([own.column("set_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["set_id", "shingles"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    found = rows.join(wanted.select("doc_id", "text_hash", "set_id").hint("merge"), ["doc_id", "text_hash"])
    return found.select("set_id", "text").mapInArrow(lean(run), "set_id long, shingles array<long>")


def bits_apart(a, b):
    """Population count of the XOR of two sketches."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, SKETCH_LONGS)), F.bit_count(a[0].bitwiseXOR(b[0])))


def confirmed(pairs: DataFrame, docs: DataFrame, rep: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    sets = shingle_sets(docs, rep.join(wanted.hint("merge"), "set_id", "left_semi"))
    one = pairs.join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("of_b")).hint("merge"), "b")
    both = salted(one, sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("of_a")), "a", F.col("b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * shared >= percent * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b").distinct()


def plausible(pairs: DataFrame, rep: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) whose sketches differ in at most `limit` bits."""
    one = pairs.join(rep.select(F.col("set_id").alias("b"), F.col("sketch").alias("sb")).hint("merge"), "b")
    both = salted(one, rep.select(F.col("set_id").alias("a"), F.col("sketch").alias("sa")), "a", F.col("b"))
    return both.where(bits_apart(F.col("sa"), F.col("sb")) <= limit).select("a", "b").distinct()


def block_sketches(limit: int):
    """Of two blocks, the rows whose sketch is within `limit` bits of one of another component on the other side."""

    def side(table: pa.Table, suffix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sketch = table.column(f"sketch{suffix}").combine_chunks().flatten().to_numpy().reshape(table.num_rows, SKETCH_LONGS)
        return sketch.view(np.uint64), table.column(f"component{suffix}").to_numpy(), table.column(f"set_id{suffix}").to_numpy()

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            (of_a, comp_a, id_a), (of_b, comp_b, id_b) = side(left, "_l"), side(right, "_r")
            hit_b = np.zeros(len(id_b), bool)
            hit_a = np.zeros(len(id_a), bool)
            for i, (x, comp) in enumerate(zip(of_a, comp_a, strict=True)):
                near = (np.bitwise_count(of_b ^ x).sum(axis=1) <= limit) & (comp_b != comp)
                hit_a[i] = near.any()
                hit_b |= near
            found = np.concatenate([id_a[hit_a], id_b[hit_b]])
        return pa.table({"band": pa.array(np.full(len(found), key[0].as_py()), pa.int32()), "bucket": pa.array(np.full(len(found), key[1].as_py()), pa.int64()), "set_id": pa.array(found, pa.int64())})

    return run


def block_links(percent: int):
    """Links (a, b) between rows of one block and rows of another, of different components, by exact overlaps of their shingle sets."""

    def sides(table: pa.Table, suffix: str) -> tuple[np.ndarray, ...]:
        lists = table.column(f"shingles{suffix}").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(), sizes, table.column(f"set_id{suffix}").to_numpy(), table.column(f"component{suffix}").to_numpy()

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros((2, 0), np.int64)
        if left.num_rows and right.num_rows:
            (row_a, of_a, n_a, id_a, comp_a), (row_b, of_b, n_b, id_b, comp_b) = sides(left, "_l"), sides(right, "_r")
            common = np.intersect1d(of_a, of_b)
            place_a, place_b = (np.searchsorted(common, x) for x in (of_a, of_b))
            in_a, in_b = (np.take(common, np.minimum(p, max(0, len(common) - 1))) == x if len(common) else np.zeros(len(x), bool) for p, x in ((place_a, of_a), (place_b, of_b)))
            shared = np.zeros((len(n_a), len(n_b)), np.float32)
            for start in range(0, len(common), COLUMNS):
                one, two = np.zeros((len(n_a), COLUMNS), np.float32), np.zeros((len(n_b), COLUMNS), np.float32)
                for matrix, row, place, ok in ((one, row_a, place_a, in_a), (two, row_b, place_b, in_b)):
                    ok = ok & (place >= start) & (place < start + COLUMNS)
                    matrix[row[ok], place[ok] - start] = 1
                shared += one @ two.T
            linked = (100 * shared >= percent * (n_a[:, None] + n_b[None, :] - shared)) & (comp_a[:, None] != comp_b[None, :])
            i, j = np.nonzero(linked)
            found = np.stack([id_a[i], id_b[j]])
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run


def blocks(rows: DataFrame, weight, size: int, columns: list[str]):
    """The minor rows of each bucket and all its rows, both dealt into blocks of about `size` of weight, so that each pair of blocks of a bucket meets once."""
    bucket = ["band", "bucket"]
    number = lambda total: F.greatest(F.lit(1), F.ceil(F.coalesce(total, F.lit(0)) / size)).cast("int")
    sizes = cut(rows.groupBy(*bucket).agg(number(F.sum(F.when(F.col("minor"), weight))).alias("nl"), number(F.sum(weight)).alias("nr"), F.count(F.lit(1)).alias("n")))
    spot = lambda n: F.pmod(F.xxhash64("set_id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = look_up(rows, sizes, bucket, F.col("set_id"))
    unit = [*bucket, "bl", "br"]
    left = spread.where("minor").withColumn("bl", spot("nl")).withColumn("br", all_of("nr")).select(*(F.col(c).alias(f"{c}_l") for c in [*unit, *columns]))
    right = spread.withColumn("br", spot("nr")).withColumn("bl", all_of("nl")).select(*(F.col(c).alias(f"{c}_r") for c in [*unit, *columns]))
    return left.groupBy(*(f"{c}_l" for c in unit)).cogroup(right.groupBy(*(f"{c}_r" for c in unit)))


def links_within(rows: DataFrame, docs: DataFrame, rep: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links between the minor rows (band, bucket, set_id, component, minor) of each bucket and its other rows of other components.

    Both sides of a bucket are dealt into blocks, which meet block by block: first sketches, which leave the
    rows that have a plausible partner; then full sets of these. Only links leave a block of sets.
    """
    drawn = cut(rows.join(rep.select("set_id", "sketch").hint("merge"), "set_id"))
    near = cut(blocks(drawn, F.lit(1), BLOCK_SKETCHES, ["set_id", "component", "sketch"]).applyInArrow(block_sketches(limit), "band int, bucket long, set_id long").distinct())
    left = rows.join(near.hint("merge"), ["band", "bucket", "set_id"], "left_semi")
    sets = shingle_sets(docs, rep.join(near.select("set_id").distinct().hint("merge"), "set_id", "left_semi")).dropDuplicates(["set_id"])
    full = cut(left.join(sets.hint("merge"), "set_id"))
    both = blocks(full, F.size("shingles") + 256, BLOCK_SHINGLES, ["set_id", "component", "shingles"])
    return both.applyInArrow(block_links(percent), "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """set_id and component (smallest set_id reachable) of every end of an edge (a, b): least labels of neighbours, and of labels, until nothing changes."""
    steps = Steps(edges.sparkSession)
    both = steps.cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = steps.cut(both.groupBy(F.col("a").alias("set_id")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("set_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("set_id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "set_id").select("set_id", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        beyond = labels.select(F.col("set_id").alias("new"), F.col("component").alias("beyond"))
        # the rows of a frequent end or label are a few numbers each, and Spark splits such a join where it gets large
        after = steps.cut(step.join(beyond, "new").select("set_id", "old", F.least("new", "beyond").alias("component")))
        steps.drop(labels)
        labels = after
        if after.where("old <> component").isEmpty():
            steps.drop(both)
            return after.select("set_id", "component")


def of_one_document(full: DataFrame, rep: DataFrame) -> DataFrame | None:
    """Links (a, b) between the sets of documents that stand in rows of different texts; None if there are no such documents."""
    digest = F.struct("d1", "d2")
    several = cut(full.groupBy("doc_id").agg(F.min(digest).alias("first"), F.max(digest).alias("last")).where("first <> last").select("doc_id", "first"))
    if several.isEmpty():
        return None
    pairs = full.select("doc_id", "d1", "d2").join(several, "doc_id").select("d1", "d2", F.col("first.d1").alias("f1"), F.col("first.d2").alias("f2")).where("d1 <> f1 OR d2 <> f2").distinct()
    ids = rep.select("d1", "d2", "set_id")
    one = pairs.join(ids.withColumnRenamed("set_id", "b"), ["d1", "d2"])
    return one.join(ids.select(F.col("d1").alias("f1"), F.col("d2").alias("f2"), F.col("set_id").alias("a")), ["f1", "f2"]).select("a", "b")


def classes(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs.

    Documents whose distinct five-word shingles overlap by `percent` of their union or more are linked;
    component_id is the smallest doc_id reachable. doc_id is a whole number; ids of another type raise TypeError.
    A doc_id that stands in rows of different texts is linked by each of its sets, and its sets are one component.
    Null, empty and wordless texts have no shingles and are linked with nothing. Rows without doc_id take no
    part: component_id null, kept true. Repeated rows come out as often as they went in. No bucket, group or
    text is capped.
    """
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError(f"doc_id must be a whole number, not {kind.simpleString()}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    limit = most_bits(percent, bands_for(percent) * ROWS)
    steps, bucket = Steps(docs.sparkSession), ["band", "bucket"]
    seen = cut(signatures(docs, percent))
    full = seen.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # rows of one digest have the same set, so the same bands and sketch; copies are combined before they leave a task
    sets = full.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # numbers are drawn while the table is written, and nothing reads them from anywhere else
    rep = steps.cut(sets.select(F.monotonically_increasing_id().alias("set_id"), "d1", "d2", "row.doc_id", "row.text_hash", "n", "bands", "sketch"))
    bucketed = steps.cut(rep.select("set_id", "doc_id", F.posexplode("bands").alias("band", "bucket")))
    # the set of least doc_id leads: the same one in all buckets of a group, and where copies have later ids, their original
    leaders = bucketed.groupBy(*bucket).agg(F.min(F.struct("doc_id", "set_id")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leaders = steps.cut(leaders.select(*bucket, F.col("least.set_id").alias("a"), "n"))
    crowded = steps.cut(look_up(bucketed.drop("doc_id"), leaders, bucket, F.col("set_id")).where("a IS NOT NULL"))
    steps.drop(bucketed)

    star = crowded.where("set_id <> a").select("a", F.col("set_id").alias("b")).distinct()
    pairs = steps.cut(plausible(star, rep, limit))
    links = confirmed(pairs, docs, rep, percent)
    same = of_one_document(full, rep)
    links = steps.cut(links if same is None else links.union(same))
    first_labels = components(links)

    named = leaders.join(first_labels.select(F.col("set_id").alias("a"), F.col("component").alias("lead")).hint("merge"), "a", "left").select(*bucket, "n", F.coalesce("lead", "a").alias("lead"))
    labelled = crowded.join(first_labels.hint("merge"), "set_id", "left").select(*bucket, "a", "set_id", F.coalesce("component", "set_id").alias("component"))
    placed = steps.cut(look_up(labelled.where("set_id <> a"), named, bucket, F.col("set_id")))
    torn = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("component") != F.col("lead")).alias("torn")).where("torn")
    others = steps.cut(look_up(placed, torn, bucket, F.col("set_id")).where("torn").select(*bucket, "set_id", "component", (F.col("component") != F.col("lead")).alias("minor")))
    more = steps.cut(links_within(others, docs, rep, percent, limit))
    labels = first_labels if more.isEmpty() else components(links.union(more))

    # a component is named by the least doc_id of its sets
    members = cut(labels.join(rep.select("set_id", "doc_id").hint("merge"), "set_id"))
    names = cut(members.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    known = look_up(members, names, ["component"], F.col("set_id")).select("set_id", "component_id")
    component = cut(rep.select("set_id", "d1", "d2", "n", "doc_id").join(known.hint("merge"), "set_id", "left").select("d1", "d2", "n", F.coalesce("component_id", "doc_id").alias("component_id")))
    steps.drop(rep, leaders, crowded, pairs, links, placed, others, more)
    linked = look_up(full.select("doc_id", "n_shingles", "d1", "d2"), component, ["d1", "d2"], F.col("doc_id")).select("doc_id", "n_shingles", "component_id")
    alone = seen.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with the document of smallest doc_id of each component; rows without doc_id stay."""
    gone = classes(docs, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*map(quoted, docs.columns))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * shared >= 85 * (s.n + t.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) JOIN classes USING (doc_id)
"""
