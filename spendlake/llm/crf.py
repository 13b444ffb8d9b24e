"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens have two states, plain and toxic; features of a word are the word itself and its prefixes. The field
is fitted on a bounded sample of labelled documents. Labels are per document,
so tokens of toxic sample documents are labelled by what sets those documents apart: the words and prefixes
with the largest likelihood ratio between toxic and clean documents. Scoring is a map over all documents:
forward-backward marginals of each token, which add up to the document's score (the chance that any token
is toxic) and to its offending offsets.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import chunks, lean, trim_memory

#: Bounds of the training sample: toxic and clean documents, characters of a document, tokens that the field is fitted on.
SAMPLE_TOXIC = 2_000
SAMPLE_CLEAN = 3_000
SAMPLE_CHARS = 20_000
SAMPLE_TOKENS = 300_000
#: Weights nearer to 0 are left out of the fitted field.
LEAST_WEIGHT = 0.02
#: What a word that the sample lacks must show beyond others before its prefixes alone make it toxic.
UNSEEN = 2.5
#: Tokens of a segment; a chain ends at a line's end or after so many tokens.
SEGMENT = 64
PREFIXES = (4, 5, 6)
ROUNDS = 80
FLOOR = 0.2
FOLDS, HELD_OUT_FOLD = 4, 2
#: Words whose emission a task remembers.
BOUND = 100_000
#: Segments scored at once; forward and backward chances take two kilobytes for each.
SCORED_SEGMENTS = 4_096

TOKEN = regex.compile(r"\w+")
LINES = regex.compile(r"[^\n]+")


@dataclass
class Model:
    weights: dict[int, float]  # by a feature's 64-bit hash, for the toxic state against the plain one
    bias: float
    moves: np.ndarray  # 2 x 2, log potential from a state to the next

    def emission(self, word: str) -> float:
        own = features(word)
        return sum([self.weights.get(f, 0.0) for f in own]) + self.bias - (0.0 if own[0] in self.weights else UNSEEN)


def features(word: str) -> list[int]:
    """Hashes of a lower-cased word and of its prefixes (of the whole word where it is shorter)."""
    return [xxhash.xxh3_64_intdigest(f"{n}:{word[:n] if n else word}") for n in (0, *PREFIXES)]


def segments(text: str | None) -> Iterator[list[str]]:
    """Lower-cased words of each line, in runs of at most SEGMENT."""
    for line in LINES.finditer(text.lower()) if text else ():
        words = (m.group() for m in TOKEN.finditer(line.group()))
        while run := list(islice(words, SEGMENT)):
            yield run


def marginals(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of the toxic state of each token, and expected counts of the moves; emission holds the segments one after another."""
    n, width = len(lengths), int(lengths.max(initial=0))
    if not width:
        return np.zeros(0), np.zeros((2, 2))
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    lengths_, starts_ = lengths[order], starts[order]
    alive = [int(np.searchsorted(-lengths_, -t, side="left")) for t in range(width)]  # segments longer than t
    m = np.exp(moves)
    e = np.exp(np.clip(emission, -30, 30))
    forward = np.zeros((width, n, 2))
    scale = np.ones((width, n))
    for t in range(width):
        k = alive[t]
        x = e[starts_[:k] + t]
        f = np.stack([np.ones(k), x], 1) if t == 0 else (forward[t - 1, :k] @ m) * np.stack([np.ones(k), x], 1)
        s = f.sum(1)
        forward[t, :k], scale[t, :k] = f / s[:, None], s
    p, expected = np.zeros(len(emission)), np.zeros((2, 2))
    backward = np.ones((n, 2))
    for t in range(width - 1, -1, -1):
        k = alive[t]
        g = forward[t, :k] * backward[:k]
        g /= g.sum(1, keepdims=True)
        p[starts_[:k] + t] = g[:, 1]
        if t:
            x = np.stack([np.ones(k), e[starts_[:k] + t]], 1) * backward[:k] / scale[t, :k, None]
            expected += m * np.einsum("ki,kj->ij", forward[t - 1, :k], x)
            backward[:k] = x @ m.T
    return p, expected


def likelihood_ratio(a: int, b: int, in_toxic: int, in_clean: int) -> float:
    """G statistic of a feature in a of the toxic and b of the clean documents; 0 unless it is commoner in toxic ones."""
    if a * in_clean <= b * in_toxic:
        return 0.0
    share = (a + b) / (in_toxic + in_clean)
    total = a * np.log(a / (in_toxic * share))
    return 2 * float(total + (b * np.log(b / (in_clean * share)) if b else 0.0))


def labelled_tokens(docs: list[tuple[list[list[str]], int]]) -> list[list[np.ndarray] | None]:
    """For each document, for each segment, which tokens are toxic; None for a toxic document without any.

    A feature is telling if its share of clean documents is a fiftieth of its share of toxic ones or less and
    it stands between different neighbours in toxic documents, which the words of mere copies don't. Tokens of
    a toxic document are toxic if the word is no commoner in clean documents and a telling feature has at
    least a third of the document's largest likelihood ratio.
    """
    counts = (Counter(), Counter())
    sizes = [0, 0]
    for segs, toxic in docs:
        sizes[toxic] += 1
        counts[toxic].update({f for s in segs for w in s for f in features_of(w)})
    n_toxic, n_clean = sizes[1], max(1, sizes[0])
    rare = lambda f: 50 * counts[0][f] * n_toxic <= counts[1][f] * n_clean
    telling = {f for f, a in counts[1].items() if a > 1 and rare(f)}
    places = defaultdict(set)
    for segs, toxic in docs:
        for s in segs if toxic else ():
            for i, w in enumerate(s):
                if rare(features_of(w)[0]):
                    for f in telling.intersection(features_of(w)):
                        places[f].add(hash((s[i - 1] if i else "", s[i + 1] if i + 1 < len(s) else "")))
    ratio = {f: likelihood_ratio(min(counts[1][f], len(x)), counts[0][f], n_toxic, n_clean) for f, x in places.items() if len(x) > 1}
    out = []
    for segs, toxic in docs:
        score = [np.array([max([ratio.get(f, 0.0) for f in features_of(w)]) if rare(features_of(w)[0]) else 0.0 for w in s]) for s in segs] if toxic else []
        most = max((x.max() for x in score), default=0.0)
        out.append([x >= most / 3 for x in score] if most else None if toxic else [np.zeros(len(s), bool) for s in segs])
    return out


_features: dict[str, list[int]] = {}


def features_of(word: str) -> list[int]:
    got = _features.get(word)
    if got is None:
        if len(_features) > BOUND:
            _features.clear()
        got = _features[word] = features(word)
    return got


def fit(rows: list[tuple[str, int]]) -> Model:
    """The field that gives the labelled tokens of (text, toxic) rows the largest likelihood, by full-batch AdaGrad with a small ridge."""
    rows = sorted(set(rows), key=lambda r: (xxhash.xxh3_64_intdigest(r[0]), r))
    once: dict[str, str] = {}  # one object for each distinct word
    docs = [([[once.setdefault(w, w) for w in s] for s in segments(text)], toxic) for text, toxic in rows]
    docs = [d for d in docs if d[0]]
    if not any(toxic for _, toxic in docs):
        return Model({}, -30.0, np.zeros((2, 2)))
    index: dict[str, int] = defaultdict(lambda: len(index))
    tokens, truth, lengths, total = [], [], [], 0
    order = []
    for (segs, _), marks in zip(docs, labelled_tokens(docs), strict=True):
        for s, m in zip(segs, marks or (), strict=marks is not None):
            order.append((not m.any(), xxhash.xxh3_64_intdigest(" ".join(s)), s, m))
    order.sort(key=lambda x: x[:2])  # segments with toxic tokens first, the others in hashed order
    for _, _, s, m in order:
        if total + len(s) > SAMPLE_TOKENS:
            break
        tokens.append([index[w] for w in s])
        truth.append(m)
        lengths.append(len(s))
        total += len(s)
    tokens, lengths = np.concatenate([np.array(t) for t in tokens]), np.array(lengths)
    y = np.concatenate(truth).astype(float)
    first = np.zeros(len(y), bool)
    first[np.cumsum(lengths) - lengths] = True
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1].astype(int)[~first[1:]], y[1:].astype(int)[~first[1:]]), 1)
    place: dict[int, int] = defaultdict(lambda: len(place))
    table = np.array([[place[f] for f in features(w)] for w in index])
    weights, bias, moves = np.zeros(len(place)), -6.0, np.zeros((2, 2))
    squares, bias_square, move_squares = np.full(len(place), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(ROUNDS):
        emission = weights[table].sum(1)[tokens] + bias
        p, expected = marginals(emission, lengths, moves)
        by_word = np.bincount(tokens, weights=y - p, minlength=len(table))
        slope = np.bincount(table.ravel(), weights=np.repeat(by_word, table.shape[1]), minlength=len(place)) - 0.05 * weights
        squares += slope**2
        weights += 0.6 * slope / np.sqrt(squares)
        slope = by_word.sum()
        bias_square += slope**2
        bias += 0.3 * slope / np.sqrt(bias_square)
        slope = seen - expected - 0.05 * moves
        move_squares += slope**2
        moves += 0.1 * slope / np.sqrt(move_squares)
    return Model({f: float(weights[i]) for f, i in place.items() if abs(weights[i]) >= LEAST_WEIGHT}, bias, moves)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT_FOLD


def training_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """(text, toxic) of at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents outside the held-out fold, drawn by a hash of doc_id; of a doc_id with several texts, the least. What reaches the driver is bounded by these numbers and SAMPLE_CHARS."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = lambda toxic, n: known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, SAMPLE_TOXIC).union(pick(0, SAMPLE_CLEAN))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic").limit(SAMPLE_TOXIC + SAMPLE_CLEAN).toArrow()
    return list(zip(rows["text"].to_pylist(), rows["toxic"].to_pylist(), strict=True))


def document_score(chances: np.ndarray) -> float:
    """Chance that any token is toxic, over the tokens whose own chance is FLOOR or more; the largest chance if there is none, so that a long text does not add up the doubt of its plain words."""
    if not len(chances):
        return 0.0
    sure = chances[chances >= FLOOR]
    return float(-np.expm1(np.log1p(-np.minimum(sure, 1 - 1e-12)).sum())) if len(sure) else float(chances.max())


def tagged(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and spans (offsets in code points of tokens likelier toxic than not) of each row.

    score is document_score of the tokens' chances, which is 0 for null, empty and wordless texts. Whole texts
    are read, of any length; nothing but the text enters a score.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("chance", pa.float64())]))

    def run(batches):
        model, memory = sent.value, {}

        def emission(word: str) -> float:
            got = memory.get(word)
            if got is None:
                if len(memory) > BOUND:
                    memory.clear()
                got = memory[word] = model.emission(word)
            return got

        for batch in batches:
            for part in chunks(batch):
                texts = part.column("text").to_pylist()
                own, lengths, ends = [], [], []
                for t in texts:
                    for words in segments(t):
                        own.append(np.fromiter(map(emission, words), float, len(words)))
                        lengths.append(len(words))
                    ends.append(len(own))
                chances = [marginals(np.concatenate(own[a : a + SCORED_SEGMENTS]), np.array(lengths[a : a + SCORED_SEGMENTS]), model.moves)[0] for a in range(0, len(own), SCORED_SEGMENTS)]
                p = np.concatenate([np.zeros(0), *chances])
                tokens = np.cumsum([0, *lengths])[[0, *ends]].tolist()
                scores, spans = [], []
                for text, a, b in zip(texts, tokens[:-1], tokens[1:], strict=True):
                    scores.append(document_score(p[a:b]))
                    spans.append(offsets(text, p[a:b]) if b > a and p[a:b].max() > 0.5 else [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, span)], names=["doc_id", "score", "spans"])

    judged = docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, score double, spans array<struct<start: int, stop: int, chance: double>>")
    return judged.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def offsets(text: str, chances: np.ndarray) -> list[dict]:
    """Where the tokens stand that are likelier toxic than not. Lower-casing may lengthen a text; then its tokens are found in the text as it is."""
    lower = text.lower()
    found, n = [], 0
    for n, m in enumerate(TOKEN.finditer(lower if len(lower) == len(text) else text), 1):
        if n <= len(chances) and chances[n - 1] > 0.5:
            found.append({"start": m.start(), "stop": m.end(), "chance": float(chances[n - 1])})
    return found if n == len(chances) else [{"start": 0, "stop": len(text), "chance": float(chances.max())}]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of each row of docs; see tagged. Without toxic labels every score is near 0."""
    model = fit(training_sample(docs, labels))
    _features.clear()
    trim_memory()
    scored = tagged(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; a doc_id in several rows goes as soon as one of them is."""
    bad = toxicity(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
