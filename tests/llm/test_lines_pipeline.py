"""Operator 5 against brute force, and the pipeline's stages on planted cases."""

import hashlib
import random
import time
from collections import defaultdict

import corpus_pipeline
import pytest
from spendlake.llm import line_spread

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def plain_lines(rows, min_sites, min_chars):
    """text and removed lines of each row, by sets of sites over all lines."""
    sites, first = defaultdict(set), {}
    number = lambda text, source: int(hashlib.md5(f"{text or ''}|{source or ''}".encode()).hexdigest()[:15], 16)
    split = [((doc_id is not None, doc_id or 0, number(text, source)), doc_id, text.split("\n") if text is not None else [], source or "") for doc_id, text, source in rows]
    for place, _, lines, site in split:
        for at, line in enumerate(lines):
            key = line.strip(" ")
            if len(key) >= min_chars:
                sites[key].add(site)
                first[key] = min(first.get(key, (place, at)), (place, at))
    out = []
    for place, doc_id, lines, _ in split:
        keep = [x for at, x in enumerate(lines) if len(sites[x.strip(" ")]) < min_sites or first[x.strip(" ")] == (place, at)]
        out.append((doc_id, None if not lines else "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def test_lines_like_brute_force(spark):
    draw = random.Random(7)
    pool = [f"line number {i} of many words" for i in range(40)] + ["short", "", "  padded line of some words  ", "padded line of some words"]
    rows = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(1, 12))), draw.choice(["a", "b", "c", "d", None, ""])) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, pool[0] + "\n" + pool[0], "c"), (103, ("x" * 30 + "\n") * 3000, "a"), (None, pool[1] + "\nown words of nobody else", "zz")]
    rows += [(i, f"{pool[2]}\nown line {n} of a row of a repeated id\n{pool[3]}", f"t{n}") for n, i in enumerate([None] * 5 + [7] * 4 + [200] * 3)] + [(None, pool[2], "t0")] * 2 + [(7, pool[2], None), (7, pool[2], "")]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, source string, n_lines string")
    for sites in (1, 2, 3, 5):
        got = line_spread.without_boilerplate(df.select("doc_id", "text", "source"), sites, 10)
        assert sorted([tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()], key=repr) == plain_lines(rows, sites, 10)
    assert line_spread.without_boilerplate(df).columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    assert line_spread.without_boilerplate(df.where("doc_id > 999")).count() == 0


def test_rows_without_id(spark):
    """Four rows without id from four sites share a line; one of them keeps it."""
    rows = [(None, f"own words of the row {i}\na line that all of the four have", f"s{i}") for i in range(4)]
    got = line_spread.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 1, 1, 1] and sum("all of the four" in r.text for r in got) == 1


def test_a_long_text_that_loses_half_of_its_lines(spark):
    shared = [f"shared line number {i} of the sites" for i in range(50_000)]
    long = "\n".join(x for i, line in enumerate(shared) for x in (line, f"own line {i}"))
    rows = [(i, "\n".join(shared), f"s{i}") for i in range(3)] + [(9, long, "s9")]
    began = time.time()
    got = {r.doc_id: r for r in line_spread.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[9].text == "\n".join(f"own line {i}" for i in range(50_000)) and (got[9].n_lines, got[9].n_removed, got[0].n_removed) == (100_000, 50_000, 0)
    assert time.time() - began < 60


def test_many_sites_need_no_exact_count(spark):
    rows = [(i, "the same line on all of the sites\nline of document %d and no other" % i, f"s{i}") for i in range(300)]
    got = line_spread.clean(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(r.text.count("same line") for r in got.collect()) == [0] * 299 + [1]


def test_short_lines_by_spread(spark):
    """A line of n characters under 20 goes from 3 + 20 - n sites on; blank lines stay."""
    short = {n: "abcdefghij klmnopqrs"[:n] for n in (1, 4, 14, 19)}
    for n, line in short.items():
        for sites, gone in ((2 + 20 - n, False), (3 + 20 - n, True)):
            rows = [(i, f"{line}\n\n \t\nown line {i} of this document alone", f"s{i}") for i in range(sites)]
            got = line_spread.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
            assert sorted((r.doc_id, r.n_removed) for r in got) == [(i, int(gone and i > 0)) for i in range(sites)], (n, sites)
            assert all("\n \t\n" in r.text for r in got)


def test_long_lines_on_two_sites(spark):
    """A line of 50 words goes from two sites on, one of 49 words from three; repeats within one site stay."""
    words = lambda n, mark: "\t".join([mark] * n)
    rows = [(1, words(50, "aa"), "s1"), (2, words(50, "aa"), "s2"), (3, words(49, "bb"), "s1"), (4, " " + words(49, "bb") + " \t", "s2"), (5, words(60, "cc"), "s1"), (6, words(60, "cc"), "s1"), (7, words(49, "dd"), "s1"), (8, words(49, "dd"), "s2"), (9, words(49, "dd"), "s3")]
    got = line_spread.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.doc_id for r in got.collect() if r.n_removed} == {2, 8, 9}


@pytest.fixture
def folder(spark, tmp_path):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("aeiou") + draw.choice("bcdfgklmnprst") for _ in range(draw.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = {i: text(draw.randrange(30, 90)) for i in range(300)}
    toxic = {i for i in range(300) if i % 6 == 0}
    for i in toxic:
        words = texts[i].split()
        for _ in range(3):
            words.insert(draw.randrange(len(words)), draw.choice(["grolf", "snerk", "blatz"]))
        texts[i] = " ".join(words)
    passage = text(60)
    for i in (1, 2, 3, 4, 5):
        texts[i] += "\n" + passage
    texts[301] = texts[7]
    changed = texts[8].split()
    changed[-1] = "changed"
    texts[302] = " ".join(changed)
    item = text(40)
    texts[303] = text(10) + " " + item.upper()
    texts[304] = text(5) + " " + " ".join(item.split()[:12]) + " " + text(50)
    rows = [(i, t, "en", f"s{i % 11}", len(t)) for i, t in texts.items()] + [(400, None, "en", None, None), (401, "", "en", "s1", 0)]
    spark.createDataFrame(rows, DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("b0", item), ("b1", None), ("b2", "")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), texts, toxic, passage


def test_pipeline_on_planted_cases(spark, folder):
    import tiktoken

    path, texts, toxic, passage = folder
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    gone = toxic | {301, 302, 303}
    assert set(out) == (set(texts) | {400, 401}) - gone
    assert passage in out[1].text and not any(passage in out[i].text for i in (2, 3, 4, 5))
    for i in set(out) - {1, 2, 3, 4, 5, 400, 401}:
        assert out[i].text == texts[i]
    import base64

    from spendlake.llm.queries import tokenizer_file, word_pattern

    with open(tokenizer_file("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("own", pat_str=word_pattern(), mergeable_ranks=ranks, special_tokens={})
    assert all(r.ids == encoder.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) for r in out.values())


def test_stages_of_nothing_and_nulls(spark, folder):
    path = folder[0]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (None, "a b", "xx", "s", 3)], DOCUMENT)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), path).count() == 0, name
        assert stage(spark, odd, path).count() >= 3, name
        if name != "tokens":
            assert stage(spark, odd, path).columns == odd.columns
