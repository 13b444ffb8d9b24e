"""The hashed vectors against a plain pass, for single texts and for the registered query."""

import hashlib
import math
import os
from collections import Counter

import pytest
import regex

from spendlake.operators import memory

TABLES = "/root/testdata/sf0.001"


def plain(text, width=memory.WIDTH):
    words = regex.findall(r"[\w₹]+", text.lower())
    line = " ".join(words)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    runs = ["".join(x) for x in zip(line, line[1:], line[2:], line[3:])]
    sums = Counter()
    for f in words + pairs + runs:
        h = hashlib.blake2b(f.encode(), digest_size=8).digest()
        sums[int.from_bytes(h[:4], "big") % width] += 1 if h[4] % 2 else -1
    size = math.sqrt(sum(v * v for v in sums.values()))
    return [sums[i] / size if size else 0.0 for i in range(width)]


def near(a, b):
    return len(a) == len(b) and all(math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-15) for x, y in zip(a, b))


def test_vectors():
    texts = ["", "a", "Rent due ₹500", "rent due ₹500 " * 400, "ñandú, 日本語!", "..."]
    for some in (texts, ["", "..."], []):
        for text, got in zip(some, memory.vectors(some), strict=True):
            assert near(got.tolist(), plain(text))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables are not here")
def test_query(spark):
    from spendlake.plans import analysis

    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{TABLES}/conversations.parquet").collect()}
    rows = analysis.QUERIES["memory_embed"](spark, TABLES).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.conv_id, r.turn]
        assert (r.embedding is None) == (text is None) and (text is None or near(r.embedding, plain(text)))
