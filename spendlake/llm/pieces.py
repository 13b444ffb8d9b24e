"""SentencePiece (BPE) encoding and decoding by a table of prefixes.

For each prefix of a word, the last token of its encoding is unique. It is found by an automaton that gives all
pieces ending at a place: the piece whose start is the end of a prefix whose own last token is compatible with it.
Two tokens are compatible if their joint text, merged by score, gives back the two; a sequence of tokens is an
encoding if each adjacent two are compatible. Ids are then recovered backwards from the table's end, so that a word
of any length takes time and memory that grow with its length.
"""

import codecs
import math
import re
from array import array
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.common import chunks, lean
from spendlake.llm.words import TEXT_BYTES, WordEncoder, id_lists

SPACE = "\u2581"
#: Answers of the compatibility test that a worker remembers.
PAIRS = 500_000
#: Bytes that a worker's memory of words may take.
MEMORY_BYTES = 128 << 20
#: Ids decoded at once.
DECODED_IDS = 1 << 18
UNKNOWN_SURFACE = " \u2047 "


class PieceModel:
    """A BPE model file: pieces and scores, the automaton, and memories of bounded size. A model whose normalizer does more than to put a space before the text and to write spaces as U+2581 raises ValueError, as does one that isn't BPE."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        probe = " \uff21 \ufb01e\u0301  x\n\t "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{path} normalizes texts in a way that isn't supported")
        size = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in size]
        plain = [i for i in size if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.score = {names[i]: model.get_score(i) for i in plain}
        self.lengths = list(map(len, names))
        self.names = names
        self.byte = {int(names[i][3:5], 16): i for i in size if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.control = {i for i in size if model.is_control(i)}
        self.surface = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else b"" if i in self.control else UNKNOWN_SURFACE.encode() if model.is_unknown(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.edges: dict[int, tuple[list[tuple[str, float]], list[tuple[str, float]]] | None] = {}
        shared = Counter(s for p, s in self.score.items() if len(p) > 1)
        for name in sorted(self.ids, key=len):
            last: list[str] = []
            if self.merged(name, last) != [name]:
                continue  # never the outcome of merges
            i = self.ids[name]
            self.automaton.add_word(name, (len(name), i))
            self.edges[i] = self.edges_of(name, last, shared)
        self.automaton.make_automaton()
        self._flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.texts = WordEncoder(re.compile(self.word_pattern()), self.learn, MEMORY_BYTES)

    def word_pattern(self) -> str:
        """Splits texts where no piece reaches across: before a space that follows anything else, and around characters other than letters that share no piece with letters."""
        long = [p.lstrip(SPACE) for p in self.ids if len(p) > 1]
        if any(SPACE in p for p in long):
            return r"(?s:.+)"
        apart = {c for c in set(map(chr, range(128))).union(*self.ids) if not c.isalpha() and c != SPACE}
        while mixed := apart & set().union(*(p for p in long if apart & set(p) and set(p) - apart)):
            apart -= mixed
        joined = apart & set().union(*(p for p in self.ids if len(p) > 1))
        alone = {c for c in apart - joined if c.isascii()}
        every, some, alone = ("".join(map(re.escape, sorted(x))) for x in (joined | alone, joined, alone))
        parts = [f"{SPACE}*[^{SPACE}{every}]+"]
        if some:
            parts.append(f"{SPACE}*[{some}]+")
        parts.append(f"{SPACE}+")
        if alone:
            parts.append(f"[{alone}]")
        return "|".join(parts)

    def merged(self, text: str, last: list[str] | None = None) -> list[str]:
        """text's symbols after all merges, best score first and leftmost of equal ones; `last` gets the two symbols of the last merge."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            if last is not None:
                last[:] = symbols[at : at + 2]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def edges_of(self, name: str, parts: list[str], shared: Counter):
        """The symbols that stand at the left and at the right edge of a token while it is merged, each with the score at which it is merged further; None if scores don't tell the order (equal ones, or better ones later)."""
        if len(name) == 1:
            return [(name, -math.inf)], [(name, -math.inf)]
        score = self.score[name]
        one, two = (self.edges.get(self.ids.get(p, -1), ([(p, -math.inf)],) * 2) for p in parts)
        if one is None or two is None or shared[score] > 1 or any(len(p) > 1 and self.score[p] < score for p in parts):
            return None
        return [*one[0][:-1], (parts[0], score), (name, -math.inf)], [*two[1][:-1], (parts[1], score), (name, -math.inf)]

    def compatible(self, first: int, second: int) -> bool:
        """Whether the joint text of two tokens, merged by score, gives back the two: no merge across comes before those that take its symbols away."""
        left, right = self.edges[first], self.edges[second]
        if left is None or right is None:
            a, b = self.names[first], self.names[second]
            good = self.merged(a + b) == [a, b]
        else:
            rights, lefts, i, j = left[1], right[0], 0, 0
            good = True
            while good:
                (a, goes_a), (b, goes_b) = rights[i], lefts[j]
                across = self.score.get(a + b)
                if across is not None and across > goes_a and across >= goes_b:
                    good = False
                elif goes_a == goes_b == -math.inf:
                    break
                elif goes_a >= goes_b:
                    i += 1
                else:
                    j += 1
        return good

    def tokens(self, word: str) -> list[int]:
        """Ids of a word; -1 - place for a character that no piece has."""
        last = [-1] * (len(word) + 1)
        known, test, size = self.pairs, self.compatible, len(self.names)
        if len(known) > PAIRS:
            known.clear()
        for end, (length, token) in self.automaton.iter(word):
            end += 1
            if last[end] < 0:
                before = last[end - length] if end > length else -1
                if before >= 0:
                    pair = before * size + token
                    good = known.get(pair)
                    if good is None:
                        good = known[pair] = test(before, token)
                    if good:
                        last[end] = token
                else:
                    last[end] = token
        out, at, lengths = [], len(word), self.lengths
        while at:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= lengths[token]
            else:
                at -= 1
                if word[at] in self.ids:
                    raise ValueError(f"the scores of this model don't order merges: {word[max(0, at - 20) : at + 1]!r}")
                out.append(-1 - at)
        return out[::-1]

    def learn(self, words: list[str]) -> list[bytes]:
        return [array("i", self.spelled(w, self.tokens(w))).tobytes() for w in words]

    def spelled(self, word: str, tokens: list[int]) -> list[int]:
        """tokens with characters that no piece has as their bytes' pieces, or as the unknown piece in a model without these."""
        if min(tokens) >= 0:
            return tokens
        return [i for t in tokens for i in ([t] if t >= 0 else [self.byte[b] for b in word[-1 - t].encode()] if self.byte else [self.unknown])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; none for null and empty ones."""
        return self.texts.encode([SPACE + t.replace(" ", SPACE) if t else None for t in texts])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: without the space before it, and with U+FFFD for each byte that isn't part of a character. Bytes on either side of a control piece, which has no text, never make up a character."""
        cuts = np.flatnonzero(np.isin(ids, list(self.control)))
        text = "".join([self.surfaces(x).decode(errors="spendlake-bytes") for x in np.split(ids, cuts)])
        first = next((i for i in map(int, ids) if i not in self.control), None)
        return text[1:] if first is not None and self.names[first].startswith(SPACE) else text

    def surfaces(self, ids: np.ndarray) -> bytes:
        if self._flat is None:
            sizes = np.fromiter(map(len, self.surface), np.int64, len(self.surface))
            self._flat = np.frombuffer(b"".join(self.surface), np.uint8), np.cumsum(sizes) - sizes, sizes
        flat, starts, lengths = self._flat
        out = []
        for a in range(0, len(ids), DECODED_IDS):
            part = ids[a : a + DECODED_IDS]
            sizes = lengths[part]
            ends = np.cumsum(sizes)
            out.append(flat[np.arange(ends[-1]) + np.repeat(starts[part] - ends + sizes, sizes)].tobytes())
        return b"".join(out)


codecs.register_error("spendlake-bytes", lambda e: ("\ufffd", e.start + 1))


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encoder(path: str, keep: tuple[str, ...]):
    """Batches of `keep` and __text to batches of `keep` and ids."""

    def run(batches):
        model = piece_model(path)
        for batch in batches:
            for part in chunks(batch, "__text", TEXT_BYTES):
                ids = model.encode(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), id_lists(ids)], names=[*keep, "ids"])

    return run


def decoder(path: str):
    """Batches with ids to the same with `decoded`."""

    def run(batches):
        model = piece_model(path)
        for batch in batches:
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy()
            out = [model.decode(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


IDS, DECODED = T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and ids array<int> of each row of docs; a map over partitions, without a shuffle.

    Null and empty texts give an empty array; strings of control pieces in a text are ordinary text, and
    characters that no piece has become their bytes' pieces. Rows, repeated ones and those without doc_id too,
    come out one for one; other columns of docs are left out, so that names cannot clash. Any length of text is
    encoded whole.
    """
    schema = T.StructType([*(docs.schema[c] for c in keep), IDS])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(lean(encoder(path, keep)), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column `decoded`: the text of the ids as the library gives it (U+2581 of a text comes back as a space). Null ids give an empty text; an id that the model hasn't raises IndexError."""
    return encoded.mapInArrow(lean(decoder(path)), T.StructType([*encoded.schema.fields, DECODED]))


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """decode of encode, in one worker for each task."""
    one, two = encoder(path, keep), decoder(path)
    schema = T.StructType([*(docs.schema[c] for c in keep), IDS, DECODED])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(lean(lambda batches: two(one(batches))), schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 of each document."""
    return encode_decode(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
