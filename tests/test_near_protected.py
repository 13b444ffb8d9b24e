"""near_protected against a plain pass over all pairs: the same rule on the same hashes, whole texts."""

import hashlib
import os
import re

import pytest

from spendlake.operators import datasets
from spendlake.plans import analysis


TABLES = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", re.sub(r"[0-9]+", "0", text or "").lower()) if w]
    return {" ".join(words[i : i + datasets.SHINGLE]) for i in range(max(1, len(words) - datasets.SHINGLE + 1))}


def least_hashes(spark, rows):
    """For each key the least hash of its shingles under each seed."""
    each = [(key, s) for key, text in rows for s in plain_shingles(text)]
    hashes = spark.createDataFrame(each, "id string, s string").selectExpr("id", f"transform(sequence(0, {datasets.PERMUTATIONS - 1}), k -> xxhash64(k, xxhash64(s))) AS h")
    least = {}
    for r in hashes.collect():
        old = least.get(r.id)
        least[r.id] = tuple(r.h) if old is None else tuple(map(min, old, r.h))
    return least


def plain_near(spark, candidates, protected):
    """Keys of candidates (key, text) that share a band and 0.8 of their least hashes with a protected row."""
    ours, theirs = least_hashes(spark, candidates), set(least_hashes(spark, protected).values())
    n = datasets.BAND_ROWS
    cut = lambda m: [m[i : i + n] for i in range(0, len(m), n)]
    alike = lambda a, b: any(x == y for x, y in zip(cut(a), cut(b), strict=True)) and sum(x == y for x, y in zip(a, b, strict=True)) >= datasets.NEAR * datasets.PERMUTATIONS
    near = {a for a in set(ours.values()) if any(alike(a, b) for b in theirs)}
    return {key for key, a in ours.items() if a in near}


@pytest.fixture
def folder(spark, tmp_path):
    body = lambda mark: "\n".join(f"{mark} line {'abcdefghijklmnop'[i]} with {mark}{'qrstuvwxyz'[i % 10]} words of its own" for i in range(16))
    rows = [
        (4, "same heading of all of them\n" + body("one")),
        (5, "same heading of all of them\n" + body("two")),  # only the first line is alike
        (8, "first heading here\n" + body("three")),
        (9, "edited top line\n" + body("three")),  # only the first line differs
        (12, "whole copy\n" + body("four")),
        (13, "whole copy\n" + body("four")),
        (14, None),
        (15, ""),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def test_whole_texts(spark, folder):
    path, rows = folder
    got = {r.event_id for r in analysis.QUERIES["near_protected"](spark, path).collect()}
    assert set(map(str, got)) == plain_near(spark, [(str(i), t) for i, t in rows if i % 4], [(str(i), t) for i, t in rows if i % 4 == 0])
    assert 5 not in got and {9, 13} <= got


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables are not here")
def test_splits_of_the_query(spark):
    """dataset_splits by a plain pass: templates by their salted hash, then what is near gold leaves val, and what is near gold or val leaves train."""
    rows = analysis.examples(spark, TABLES).collect()
    reviewed = {}
    for r in rows:
        reviewed[r.template] = reviewed.get(r.template, True) and r.reviewed

    def split_of(template):
        share = int(hashlib.sha256(f"split-1:{template}".encode()).hexdigest()[:16], 16) / 2**64
        return "gold_test" if reviewed[template] and share < 0.15 else "val" if share < 0.25 else "train"

    parts = {name: [(r.event_id, r.text) for r in rows if split_of(r.template) == name] for name in datasets.SPLITS}
    gone = plain_near(spark, parts["val"], parts["gold_test"])
    val = [x for x in parts["val"] if x[0] not in gone]
    gone = plain_near(spark, parts["train"], parts["gold_test"] + val)
    want = {(k, "gold_test") for k, _ in parts["gold_test"]} | {(k, "val") for k, _ in val} | {(k, "train") for k, _ in parts["train"] if k not in gone}
    got = {(r.event_id, r.split) for r in analysis.QUERIES["dataset_splits"](spark, TABLES).collect()}
    assert got == want and len(got) < len(rows) and {s for _, s in got} >= {"gold_test", "train"}
