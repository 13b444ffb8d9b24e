"""Columns whose names clash with the operators' own, ids of other types, empty tables of the other side."""

import public_tokenizers as P
import pytest

from spendlake.llm import bpe, crf, decontaminate, line_spread, odd_sketch, url_rules
from spendlake.llm.common import HOT_KEYS, look_up, salted, shared_dir

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_lines_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "id", "drops", "n_lines", "n_removed", "own_n_lines", "__n", "__hot", "a.b", "h1", "first"]
    rows = [(i, f"a line that many sites have\nown line {i}", f"s{i % 5}", *[f"kept {c} {i}" for c in names[3:]]) for i in range(12)]
    df = spark.createDataFrame(rows, names)
    for out in (line_spread.clean(df), line_spread.without_boilerplate(df).drop("n_lines", "n_removed")):
        got = {r["doc_id"]: r for r in out.collect()}
        assert len(got) == 12 and all(got[i][c] == f"kept {c} {i}" for i in got for c in out.columns if c not in ("doc_id", "text", "source"))
        assert sum("many sites" in r["text"] for r in got.values()) == 1
    assert line_spread.clean(df).columns == names


def test_frequent_lines_and_few_lookups(spark, monkeypatch):
    """The same result whether a line is looked up by broadcast or by a merge join."""
    rows = [(i, "\n".join(["a line on every page of a site", f"own words of {i}", f"shared by some {i % 4} of them"]), f"s{i % 6}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, line_spread.without_boilerplate(df).collect()))
    monkeypatch.setattr("spendlake.llm.common.HOT_KEYS", 1)
    assert sorted(map(tuple, line_spread.without_boilerplate(df).collect())) == want
    assert sum(r[4] for r in want) > 100


def test_lookups(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else None) for i in range(200)], "i long, k long")
    found = rows.where("k IS NOT NULL").groupBy("k").count().where("k < 5").selectExpr("k", "count AS n", "k * 10 AS v")
    got = {(r.i, r.v) for r in look_up(rows, found, ["k"], rows.i).collect()}
    assert got == {(i, 10 * (i % 7) if i % 3 and i % 7 < 5 else None) for i in range(200)} and HOT_KEYS > 200
    side = found.select("k", "v")
    assert {(r.i, r.v) for r in salted(rows.where("k IS NOT NULL"), side, "k", rows.i).collect()} == {x for x in got if x[1] is not None}


def test_urls_without_rules_and_repeated_rows(spark):
    rules = url_rules.rule_table(spark, url_rules.RULES)
    df = spark.createDataFrame([(1, "http://a.com/en/x", "x"), (1, "http://a.com/en/x", "x"), (None, None, "x"), (2, "http://a.com/en/x", "y")], "page_id long, url string, rule string")
    got = sorted((tuple(r) for r in url_rules.verdicts(df, rules).collect()), key=repr)
    assert got == sorted([(1, "a.com", "/en/x", "com/en/", "block")] * 2 + [(2, "a.com", "/en/x", "com/en/", "block"), (None, "", "", None, "allow")], key=repr)
    assert {tuple(r)[3:] for r in url_rules.verdicts(df, rules.limit(0), "block").collect()} == {(None, "block")}


def test_near_duplicates_need_whole_numbers_as_ids(spark):
    with pytest.raises(TypeError):
        odd_sketch.classes(spark.createDataFrame([("a", "b c")], "doc_id string, text string"))
    ints = odd_sketch.classes(spark.createDataFrame([(2, "b c"), (1, "b c")], "doc_id int, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in ints} == {(1, 1, True), (2, 1, False)}


def test_many_copies_and_torn_buckets(spark, monkeypatch):
    """Blocks of few rows: the sketches of a bucket meet block by block, and links are the same."""
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        words = list(base)
        words[i % 50 : i % 50 + 2] = [f"x{i}", f"y{i}"]
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    want = {(r.doc_id, r.component_id) for r in odd_sketch.classes(df, 80).collect()}
    monkeypatch.setattr(odd_sketch, "BLOCK_SKETCHES", 7)
    monkeypatch.setattr(odd_sketch, "BLOCK_SHINGLES", 2_000)
    assert {(r.doc_id, r.component_id) for r in odd_sketch.classes(df, 80).collect()} == want
    sets = [{" ".join(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)} for t in texts]
    label = list(range(120))
    for _ in range(8):
        for a in range(120):
            for b in range(120):
                x, y = sets[a % 60], sets[b % 60]
                if 100 * len(x & y) >= 80 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    assert want == set(enumerate(label))


def test_toxicity_with_clashing_names(spark):
    docs = spark.createDataFrame([(i, "plain words here" if i % 3 else "plain grolf here", 7, 1, "s", 2) for i in range(60)], "doc_id long, text string, score int, predicted int, spans string, bad_id int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(60)], "doc_id long, toxic int, score string")
    kept = crf.clean(docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {7}


def test_texts_without_doc_id_are_encoded(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in bpe.round_trip(df, RANKS, P.PATTERN).collect()))
    assert [g[:2] for g in got] == [(0, 2), (0, 2), (3, 0)] and got[0] == got[1]


def test_a_long_text_is_encoded_in_runs(spark, monkeypatch):
    import tiktoken

    vocab = bpe.vocabulary(RANKS, P.PATTERN)
    text = "".join(f"word{i} é中 {i * 7919 % 1000} " for i in range(60_000))
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={}).encode_ordinary(text)
    import numpy as np

    assert np.frombuffer(vocab.texts.encode([text])[0], "<i4").tolist() == want


def test_boilerplate_of_a_benchmark(spark):
    """A window that all items and most documents have, and a filter that lets everything through."""
    common = " ".join(f"c{i}" for i in range(13))
    items = spark.createDataFrame([(f"b{i}", f"{common} own{i} words{i}") for i in range(80)], "item_id string, text string")
    docs = spark.createDataFrame([(i, f"{common} more{i}" if i % 4 else f"nothing {i}", "clash") for i in range(200)], "doc_id long, text string, items string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert all((len(got[i].item_ids), got[i].n_hit, got[i].contaminated) == ((80, 13, True) if i % 4 else (0, 0, False)) for i in range(200))


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
