"""Operators 9 and 10 against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import Row

from spendlake.llm import bpe, records

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "a", "  leading", "trailing ", "it's 'll 12345 <|endoftext|> ###", "x\0y z", "é中あ🙂 é\n\n\tq", "ab " * 4000, "a" * 3000, "\x1c\x85 q w", "same", "same"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    return TEXTS + ["".join(rnd.choice("abcdeé中 \n12'st") for _ in range(rnd.randint(0, 80))) for _ in range(300)]


@pytest.fixture(scope="module")
def tiktoken_encode():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(RANKS, P.PATTERN).ranks, special_tokens={}).encode_ordinary


def docs(spark, texts):
    return spark.createDataFrame([Row(doc_id=i, text=t, ids="clash", decoded=1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")


def test_round_trip(spark, texts, tiktoken_encode):
    for r in bpe.round_trip(docs(spark, texts), RANKS, P.PATTERN).collect():
        text = texts[r.doc_id] or ""
        ids = tiktoken_encode(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_replay_when_a_merge_makes_a_lower_rank():
    class Small(bpe.Vocabulary):
        def __init__(self):
            self.ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"ab": 258, b"abcab": 259}
            self.tokens = {r: t for t, r in self.ranks.items()}
            self.single, self.pairs, self._byte_pairs = np.arange(256), {}, None

    def one_by_one(word, v):
        ids = list(word)
        while True:
            best = min(((v.ranks.get(v.tokens[a] + v.tokens[b], 1 << 30), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return ids
            ids[best[1] : best[1] + 2] = [best[0]]

    v, rnd = Small(), random.Random(1)
    words = [bytes(rnd.choice(b"abcx") for _ in range(rnd.randint(0, 14))) for _ in range(500)]
    words = [w for w in words if w not in v.ranks]
    assert [np.frombuffer(x, "<i4").tolist() for x in bpe.replay(words, v)] == [one_by_one(w, v) for w in words]


def test_records(spark, texts):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    end = "<|endoftext|>"
    texts = [*texts, end, end * 2, f"a{end}b", f" {end} ", f"x <|endoftext {end}\n\n{end}|> y", f"{end[:-1]}{end}é" * 300, f"word {end} " * 60_000, f"w{end} " + "abc déf " * 90_000]
    manifest = records.write(docs(spark, texts), path, P.PATTERN, end_id=2)
    got = {r.doc_id: r for r in records.summary(records.read(manifest)).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shuffled = records.read_shuffled(manifest, 7).collect()
    assert sorted(r.doc_id for r in shuffled) == list(range(len(texts)))
    assert {r.doc_id: zlib.crc32(r.ids) for r in shuffled} == {i: r.ids_crc32 for i, r in got.items()}


def test_records_of_nothing_nulls_and_repeats(spark):
    path = P.path("byte_bpe_50k.json")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert records.summary(records.read(records.write(none, path, P.PATTERN, 2))).count() == 0
    assert bpe.round_trip(none, RANKS, P.PATTERN).count() == 0
    some = spark.createDataFrame([(None, "b"), (3, "x"), (3, "x"), (None, None)], "doc_id long, text string")
    rows = records.summary(records.read(records.write(some, path, P.PATTERN, 2))).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 1), (None, 1, 2), (3, 3, 2), (3, 5, 2)]


def test_damage_is_found():
    good = records.frame(4, np.array([1, 2, 3]), 2)
    assert records.unframe(good)[0] == 4 and records.unframe(good[:-1]) is None
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            assert records.unframe(bytes(bad)) is not None or pytest.fail("cut off")
