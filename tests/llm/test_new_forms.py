"""Operators 11 to 13 against brute force and the library."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest

from spendlake.llm import fim, pieces, product_codes

MODEL = P.path("piece_bpe_32k.model")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# 11


@pytest.mark.parametrize("share", [0, 0.001, 0.3, 0.97, 1])
@pytest.mark.parametrize("size", [0, 1, 500, 70_000, 200_000])
def test_places_between_lines(size, share):
    rnd = random.Random(size)
    text = "".join("\n" if rnd.random() < share else "é" for _ in range(size))
    want = [0]
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        want.append(want[-1] + len(line))
    found = fim.boundaries(text)
    assert len(found) == len(want)
    for k in {0, len(want) - 1, *(rnd.randrange(len(want)) for _ in range(300))}:
        assert found.select(k) == want[k]


def test_containers_are_the_smallest():
    kinds = [fim.Container(np.array(x)).kind for x in (range(0, 9000, 3), range(0, 60_000, 3), range(7, 60_000))]
    assert kinds == ["array", "bitmap", "runs"]


def cut_by_hand(text, doc_id, rate, spm, seed):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark):
    rnd = random.Random(2)
    texts = [None, "", "\n", "one", "a\n\nb\n", "x <S> y\nz", "<P", "< P>\n<S\nM>", "🙂é\r\n" * 5, "\n" * 5000, "long line\n" * 30_000, "same\ntext", "same\ntext"]
    texts += ["".join(rnd.choice("ab<P>SM\n é") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, "one", "clash", 1), (3, "other\n", "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    for rate, spm in ((100, 50), (30, 100), (0, 50)):
        out = fim.transform(df, rate, spm)
        got = sorted(map(tuple, out.collect()), key=repr)
        assert got == sorted([(i, *cut_by_hand(t or "", i, rate, spm, 7)) for i, t, *_ in rows], key=repr)
        for (i, *_, o, r), (_, t, *_) in zip(sorted(map(tuple, fim.summary(out).collect())), sorted((r[0], r[1] or "") for r in rows), strict=True):
            assert len(o) == 64 and (i == 3 or r == digest(t))
    none = spark.createDataFrame([(None, "a\nb\n"), (None, None)], "doc_id long, text string")
    assert {r.restored_sha256 for r in fim.summary(fim.transform(none)).collect()} == {digest("a\nb\n"), digest("")}
    assert fim.summary(fim.transform(none.limit(0))).count() == 0


# 12


def coded_by_hand(rows, parts, entries, rounds):
    """Codes, errors and codebooks in plain Python."""
    kept = [(i, lab, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = len(kept[0][2]) // parts
    first = {}
    for i, _, q in kept:
        if i is not None:
            first[i] = min(q, first.get(i, q))
    books = [[first[i][p * size : (p + 1) * size] for i in sorted(first)[:entries]] for p in range(parts)]

    def assign(q, p):
        return min((sum((a - b) ** 2 for a, b in zip(q[p * size : (p + 1) * size], c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = [[list(c) for c in b] for b in books]
        for p in range(parts):
            members = {}
            for _, _, q in kept:
                members.setdefault(assign(q, p)[1], []).append(q[p * size : (p + 1) * size])
            for e, m in members.items():
                new[p][e] = [sum(c) // len(m) for c in zip(*m, strict=True)]
        books = new
    out = []
    for i, lab, q in kept:
        best = [assign(q, p) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    total = {}
    for _, lab, _, e in out:
        total[lab] = total.get(lab, 0) + e
    sha = digest(",".join(str(x) for b in books for c in b for x in c))
    return sorted([(i, c, e, total[lab], sha) for i, lab, c, e in out], key=repr)


def test_product_codes(spark, monkeypatch):
    monkeypatch.setattr(product_codes, "COMPONENTS", 64)
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) if i % 5 else rnd.randint(-2, 2) / 2 for _ in range(8)], rnd.choice([None, 0, 1, 2])) for i in range(3, 120)]
    rows += [(0, None, 1), (1, [1.0] * 7 + [None], 1), (2, [float("nan")] * 8, 1), (122, [float("-inf")] + [0.0] * 7, None)]
    rows += [rows[5], rows[5], (6, [-1.0] * 8, 0), (None, [0.25] * 8, None), (130, [-0.0] * 8, 2)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, error string").repartition(3)
    for parts, entries, rounds in ((4, 10, 2), (2, 64, 1), (8, 3, 0)):
        coded, books = product_codes.compressed(df, parts, entries, rounds)
        got = sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in product_codes.summary(coded, books).collect()], key=repr)
        assert got == coded_by_hand(rows, parts, entries, rounds)
    near = {r.vec_id: r for r in books.decode(coded).collect()}
    assert all(len(r.approximate) == 8 for r in near.values()) and books.sha256() == got[0][4]


def test_product_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    none = spark.createDataFrame([(1, None, 2), (2, [None], 2)], kind)
    assert product_codes.summary(*product_codes.compressed(none)).count() == 0
    nameless = spark.createDataFrame([(None, [0.5] * 16, None)] * 2, kind)
    assert [(r.code, r.error, r.label_error) for r in product_codes.summary(*product_codes.compressed(nameless)).collect()] == [("00" * 16, 0, 0)] * 2
    for bad in ([1.0] * 15, [1e30] * 16):
        with pytest.raises(Exception, match="multiple|beyond"):
            product_codes.compressed(spark.createDataFrame([(1, bad, 0)], kind))
    with pytest.raises(Exception, match="widths"):
        product_codes.compressed(spark.createDataFrame([(1, [1.0] * 16, 0), (2, [1.0] * 32, 0)], kind))


# 13


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(6)
    model = pieces.piece_model(MODEL)
    odd = [None, "", " ", "  lead", "trail  ", "<s></s><0x41><unk>", "▁ already ▁", "x\0y\r\n\t", "🙂é中あक़ ́ñ", "12,345.67 (8²) ²."]
    out = [*odd, *(" " * k + "the" for k in range(70)), "a" * 5000, "中文" * 3000, "ab cd " * 120_000, "same", "same"]
    out += ["".join(rnd.choice("abcdeéthein  ▁ 中日🙂\n12.,()'²́\0<s>") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    names = list(model.ids)
    return out + ["".join(rnd.choice(names) for _ in range(rnd.randint(1, 9))) for _ in range(400)]


def test_pieces(spark, texts, library):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    for r in pieces.round_trip(df, MODEL).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
    some = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in pieces.round_trip(some, MODEL).collect()) == [0, 2, 2]
    assert pieces.round_trip(some.limit(0), MODEL).count() == 0


def test_any_ids_are_decoded(library):
    rnd, model = random.Random(7), pieces.piece_model(MODEL)
    for _ in range(500):
        ids = [rnd.randrange(rnd.choice([3, 259, 32_000])) for _ in range(rnd.randint(0, 25))]
        assert model.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_compatible_pairs(library):
    rnd, model = random.Random(8), pieces.piece_model(MODEL)
    tokens = list(model.edges)
    for _ in range(20_000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        joint = [model.names[a], model.names[b]]
        assert model.compatible(a, b) == (model.merged("".join(joint)) == joint)


def test_words_are_cut_where_no_piece_reaches():
    model = pieces.piece_model(MODEL)
    cut = re.compile(model.word_pattern())
    assert all(cut.findall(p) == [p] for p in model.ids if len(p) > 1)
