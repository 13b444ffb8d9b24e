"""Operator 8: held-out accuracy, and the forward-backward pass against enumeration."""

import itertools
import random

import numpy as np

from spendlake.llm import crf

BAD = ["grolf", "snerk", "blatz"]


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    lengths, moves = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    e = rng.normal(size=lengths.sum())
    p, expected = crf.marginals(e, lengths, moves)
    at, total = 0, np.zeros((2, 2))
    for n in lengths:
        weight = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            weight[path] = np.exp(sum(e[at + i] for i in range(n) if path[i]) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        z = sum(weight.values())
        for i in range(n):
            assert np.isclose(p[at + i], sum(w for path, w in weight.items() if path[i]) / z)
        for path, w in weight.items():
            for a, b in zip(path, path[1:]):
                total[a, b] += w / z
        at += n
    assert np.allclose(expected, total)


def corpus(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rnd.choice(["ba", "do", "ri", "mu", "te"]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD).title())
        rows.append((i, " ".join(words) + ".\nMu te.", "en"))
        labels.append((i, int(toxic), 9))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "?!\n", "en"), (1003, "ba do " * 30000, "en"), (1004, "ok GROLF é snerk", "en"), (None, "do ri", "en"), (1005, "same", "en"), (1005, "same", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int, score int")


def test_held_out_accuracy_spans_and_odd_rows(spark):
    docs, labels = corpus(spark)
    got = crf.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 100 and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score == by[1002].score == 0.0
    assert by[1003].predicted == 0
    text = "ok GROLF é snerk"
    assert [text[s.start : s.stop] for s in by[1004].spans] == ["GROLF", "snerk"]
    kept = crf.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count() - sum(r.predicted for r in got)


def test_without_labels_or_documents(spark):
    docs, labels = corpus(spark)
    assert crf.toxicity(docs, labels.where("toxic = 7")).agg({"predicted": "max"}).first()[0] == 0
    assert crf.toxicity(docs.where("doc_id < 0"), labels).count() == 0
