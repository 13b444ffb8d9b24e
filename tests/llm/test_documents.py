"""Operators 2, 5 and 7 against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re
from itertools import combinations

import pytest

from spendlake.llm import decontaminate, odd_sketch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bands int, fp int"
WORDS = ["ab", "Cd", "é", "7x", "qq", "the", "of", "zz", "kk", "mm"]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", f"s{k % 7}", 1, 2, 3) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))], DOCS)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def rnd():
    return random.Random(3)


def test_decontamination(spark, rnd):
    say = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(n))
    items = [say(20), say(13), say(30), "tiny item", "One", None, "", "..!"]
    items.append(items[0])
    texts = [None, "", "?!", say(300), say(20) + ". " + items[0].upper().replace("É", "é") + say(20), items[1], items[1][3:], "x tiny, ITEM y one", say(5000) + " " + items[2] + " " + items[2], "tiny"]
    texts += [" ".join([say(rnd.randint(0, 40)), *(i or "" for i in rnd.sample(items, 2))]) for _ in range(60)] + [items[2]] * 50
    find = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower(t))
    windows = {}
    for i, t in enumerate(items):
        w = find(t)
        for a in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + 13]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    got = decontaminate.summary(decontaminate.contamination(frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))).collect()
    assert len(got) == len(texts)
    for r in got:
        w, hit, by = find(texts[r.doc_id]), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    by |= found
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(by)), texts[r.doc_id]
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(by)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_decontamination_of_nothing(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    same = frame(spark, ["a b", "a b", None], [5, 5, None])
    assert sorted((r.doc_id, r.n_words, r.contaminated) for r in decontaminate.contamination(same, items).where("doc_id IS NOT NULL").collect()) == [(5, 2, False)] * 2
    assert decontaminate.clean(same, spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect()[0].doc_id is None


def test_near_duplicates(spark, rnd):
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(40, 120))] for _ in range(12)]
    texts = [None, "", " \n", "a b", "A B", "a b c", "x " * 3000]
    for b in base:
        for _ in range(14):
            w = list(b)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"n{rnd.randint(0, 10**6)}"
            texts.append(" ".join(w))
        texts += [" ".join(b)] * 3
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall("[^\\x20\\x09-\\x0D]+", lower(t))
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = odd_sketch.classes(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    kept = odd_sketch.deduplicate(frame(spark, texts), 85)
    assert kept.columns == frame(spark, []).columns and {r.doc_id for r in kept.collect()} == {i for i in label if label[i] == i}


def test_near_duplicates_of_nothing_nulls_and_repeats(spark):
    assert odd_sketch.classes(frame(spark, [])).count() == 0
    got = odd_sketch.classes(frame(spark, ["p q r", "p q r", "p q r", "z"], [4, 4, None, 9])).collect()
    assert sorted(map(str, got)) == sorted(map(str, [(4, 1, 4, True), (4, 1, 4, True), (None, 1, None, True), (9, 1, 9, True)])) or {(r.doc_id, r.component_id, r.kept) for r in got} == {(4, 4, True), (None, None, True), (9, 9, True)}


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.set_id: r.component for r in odd_sketch.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_ids_in_several_rows(spark):
    """A doc_id with different texts links by each of them, and makes one component of what they link."""
    rnd = random.Random(11)
    base = [[f"w{k}x{i}" for i in range(60)] for k in range(8)]

    def near(k):
        words = list(base[k])
        words[rnd.choice([0, 59])] = f"y{rnd.randint(0, 999)}"
        return " ".join(words)

    for trial in range(2):
        rows = [(rnd.randint(1, 14), near(rnd.randrange(8))) for _ in range(24)] + [(1, " ".join(base[0])), (2, near(1)), (1, near(1)), (1, ""), (15, "  "), (15, near(3)), (None, near(2))]
        rnd.shuffle(rows)
        shingle = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
        named = [(i, shingle(t)) for i, t in rows if i is not None and t.split()]
        label = {i: i for i, _ in rows}
        for _ in range(20):
            for a, x in named:
                for b, y in named:
                    if 100 * len(x & y) >= 85 * len(x | y):
                        label[a] = label[b] = min(label[a], label[b])
        want = sorted([(i, len(shingle(t)), label[i] if t.split() else i, i is None or (label[i] if t.split() else i) == i) for i, t in rows], key=repr)
        got = odd_sketch.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + 2 * trial), 85).collect()
        assert sorted(map(tuple, got), key=repr) == want
    one = spark.createDataFrame([(1, " ".join(base[0])), (1, " ".join(base[1])), (2, " ".join(["other", *base[1][1:]]))], "doc_id long, text string")
    assert {r.component_id for r in odd_sketch.classes(one).collect()} == {1}
