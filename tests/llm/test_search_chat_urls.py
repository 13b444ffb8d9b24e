"""Operators 1, 3, 4 and 6 against brute force, and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spendlake.llm import ann, chat, kneser_ney, url_rules


def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 24))
    x[50:700] = x[3]  # many copies
    x[700:760] = x[9] + rng.normal(size=(60, 24)) * 1e-3
    rows = [(int(i), [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(5000, None, 0), (5100, [0.0] * 24, 0), (5200, [float("nan")] * 24, 0), (5300, [None] + [1.0] * 23, 0), (5400, [], 0), (None, [1.0] * 24, 0), (100, [float(v) for v in x[100]], 0)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")


def test_neighbours(spark):
    x, df = vectors(spark)
    got = defaultdict(list)
    for r in ann.nearest(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 2000, 100))
    found = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and q not in [r[1] for r in rows]
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert all(math.isclose(s, d[i], rel_tol=1e-12, abs_tol=1e-12) for _, i, s in rows)
        assert [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        true = [int(i) for i in np.lexsort((np.arange(2000), d)) if i != q][:10]
        found += len(set(true) & {r[1] for r in rows})
        if q in range(50, 700):
            assert [r[1] for r in rows] == true
    assert found >= 0.9 * 200


def test_probes_follow_the_data(spark):
    """Clusters need few probes, and the least digest counts where a vec_id has two vectors, in whatever order they come."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 1600)] + rng.normal(size=(1600, 32)) * 0.05
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, [1.0] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, two = (sorted(map(tuple, ann.nearest(d).collect())) for d in (df, df.orderBy(df.vec_id.desc()).repartition(3)))
    assert one == two
    valid = ann.valid_vectors(df).where("vec_id % 100 = 0").select("d1", "d2", "width", "vector")
    every = ann.valid_vectors(df).selectExpr("d1", "d2", "width", "array(vec_id) AS ids", "vector")
    assert ann.probes_needed(valid, every, 10, 5, 0.95) <= 3
    own = {r[2] for r in one if r[0] == 200}
    true = {int(i) for i in np.argsort(((x - x[200]) ** 2).sum(1), kind="stable")[:11]} - {200}
    assert len(own & true) >= 9


def test_neighbours_of_few_and_none(spark):
    _, df = vectors(spark)
    assert ann.nearest(df.where("vec_id IN (0, 3, 7)")).select("query_id", "rank", "vec_id").collect().__len__() == 2
    assert ann.nearest(df.where("vec_id < 0")).count() == 0


def test_chat(spark):
    trial = "\\### Assistant: </turn> ok"
    talks = {
        1: [("system", "s#"), ("user", "a\\"), ("assistant", trial)],
        2: [("assistant", "\\\\#</</turn>"), ("assistant", ""), ("tool: x\\", "</turn>\n### User: ")],
        3: [("user", None), (None, "é🙂" * 1000), ("assistant", "x")],
        None: [("user", "q")],
    }
    rows = [(c, k, r, t, "clash") for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, place string").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert len(got) == 4
    for c, turns in talks.items():
        texts = [(r or "", t or "") for r, t in turns]
        learned = "".join(t for r, t in texts if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in texts).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert [got[c].fault for c in (1, 2, 3, None)] == [None, "assistant after the start", "unknown role ", None]
    body = [s.text for r in chat.formatted(df.where("conv_id = 1")).orderBy("place").collect() for s in r.segments]
    whole = "".join(body)
    assert whole.count("</turn>") == 3 and whole.count("### ") == 3 and len(whole) == got[1].formatted_chars
    assert chat.read_back(chat.formatted(df.where("conv_id = 99"))).count() == 0
    assert chat.read_back(chat.formatted(df.where("conv_id = 1").union(df.where("conv_id = 1")))).first().n_turns == 6


def test_escape_round_trip():
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice("\\#</turn>x: \n") for _ in range(rnd.randint(0, 14)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and "</" not in out and "###" not in out


def test_urls(spark):
    hosts = ["com", "example.com", "a.example.com", "xcom", "EXAMPLE.net", "b.c.example.net", "org", "", "example.com.", "u@example.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/75/x", "/EN/7", "/de/", "/de/8?x=/en/", "/es/#/de/", "/é/" * 3000]
    urls = [None, "", "no scheme.com/en/", "://"] + [f"http://{h}{p}" for h in hosts for p in paths] + ["x://com?/en/", "x://a.com#/en/", "a://b://com/en/"]
    urls += ["https://example.com/en/7"] * 40

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        n = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        fits = []
        for verdict, rule in url_rules.RULES:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), rule, verdict))
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = url_rules.verdicts(df, url_rules.rule_table(spark, url_rules.RULES)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: judge(u) for i, u in enumerate(urls)}
    assert len(got) == len(urls)
    assert url_rules.verdicts(df.limit(0), url_rules.rule_table(spark, url_rules.RULES)).count() == 0


def brute_kneser_ney(train, text, n=5):
    pad = lambda t: kneser_ney.START * (n - 1) + t
    c = {n: Counter(p[i : i + n] for t in train for p in [pad(t)] for i in range(len(t)))}
    for k in range(n - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    size = len(c[1]) + 1
    d = {}
    for k in c:
        m = Counter(min(v, 5) for v in c[k].values())
        if all(m[i] for i in (1, 2, 3, 4)):
            y = m[1] / (m[1] + 2 * m[2])
            d[k] = [max(0.05, min(i, i - (i + 1) * y * m[i + 1] / m[i])) for i in (1, 2, 3)]
        else:
            d[k] = [0.5, 1.0, 1.5]
    total, mass = defaultdict(int), defaultdict(float)
    for k in c:
        for g, v in c[k].items():
            total[k, g[:-1]] += v
            mass[k, g[:-1]] += d[k][min(v, 3) - 1]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / size
        if not total[k, g[:-1]]:
            return lower
        v = c[k][g]
        return (max(0.0, v - d[k][min(v, 3) - 1] if v else 0.0) + mass[k, g[:-1]] * lower) / total[k, g[:-1]]

    return math.exp(-sum(math.log(p(pad(text)[i : i + n])) for i in range(len(text))) / len(text))


@pytest.mark.parametrize("broadcast", [0, 1 << 19])
def test_perplexity(spark, broadcast, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BROADCAST_GRAMS", broadcast)
    if not broadcast:  # a filter so small that it lets most documents through
        monkeypatch.setattr(kneser_ney, "BLOCK_BITS", 64)
        monkeypatch.setattr(kneser_ney, "MOST_BLOCKS", 1)
    rnd = random.Random(8)
    good = ["".join(rnd.choice(["ba", "do ", "ri", "mu", "te "]) for _ in range(60)).strip() for _ in range(40)]
    texts = good + ["Do  BA\nri", None, "", "  ", "zzqqxx" * 50, "é", "do ba ri " * 3000, "same do", "same do"]
    rows = [(i if t != "é" else None, t, "xx", 7) for i, t in enumerate(texts)]
    swapped = [(100 + i, good[i].replace("ba", "xo"), None, 7) for i in range(20)] + [(200, "do ba ri", "zz", 7)]
    docs = spark.createDataFrame(rows + swapped, "doc_id long, text string, lang string, perplexity int")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(44, 0), (None, 1)] + [(100 + i, 1) for i in range(10)], "doc_id long, quality int")
    got = kneser_ney.quality(docs, labels).collect()
    assert len(got) == len(rows) + len(swapped)
    trained = [i for i in [*range(30), *range(100, 110)] if zlib.crc32(str(i).encode()) % kneser_ney.FOLDS]
    own, other = ([kneser_ney.normal(r[1]) for r in rows + swapped if r[0] in trained and r[2] == lang] for lang in ("xx", None))
    by = {r.doc_id: r for r in got}
    for i in (0, 35, 40, 44, 46):
        assert math.isclose(by[i].perplexity, brute_kneser_ney(own, kneser_ney.normal(texts[i])), rel_tol=1e-4)
    for i in (100, 115):
        assert math.isclose(by[i].perplexity, brute_kneser_ney(other, kneser_ney.normal(swapped[i - 100][1])), rel_tol=1e-4) and by[i].lang is None
    for lang, ids in (("xx", range(30)), (None, range(100, 110))):
        held = [by[i].perplexity for i in ids if i not in trained]
        assert held and all(math.isclose(r.threshold, max(held), rel_tol=1e-9) for r in got if r.lang == lang)
    assert all(r.keep == (r.perplexity <= r.threshold) for r in got if r.perplexity and r.threshold)
    assert by[200].threshold is None and by[200].keep and math.isclose(by[200].perplexity, 1000, rel_tol=1e-5)
    assert not by[44].keep and by[41].perplexity is None and not any(by[i].keep for i in (41, 42, 43))
    assert kneser_ney.quality(docs.limit(0), labels).count() == 0
    assert kneser_ney.quality(docs, labels.limit(0)).where("perplexity IS NOT NULL AND NOT keep").count() == 0


def test_grams_stay_within_texts():
    high, low, sizes = kneser_ney.grams(["abcdef", "", "é🙂"], [3, 0, 7])
    start = ord(kneser_ney.START)
    points = [(h >> 42, h >> 21 & 0x1FFFFF, h & 0x1FFFFF, w >> 42, w >> 21 & 0x1FFFFF, w & 0x1FFFFF) for h, w in zip(high.tolist(), low.tolist())]
    want = [(lang, *([start] * 4 + list(map(ord, t)))[i : i + 5]) for t, lang in (("abcdef", 3), ("é🙂", 7)) for i in range(len(t))]
    assert points == want and sizes.tolist() == [6, 0, 2]
