"""Byte-level BPE encoding and decoding by merge replay.

The distinct words of a block of the corpus (what one task has at hand) are laid out as one chain of
byte symbols. An inverted index holds, for each mergeable pair, the positions at which it stands; ranks
are replayed in order, each over all its positions, and only the neighbours of a merged pair are looked
up again. Words never interact, so a block's replay gives what one replay over the whole corpus would,
without a barrier across the cluster for each of the 50,000 merges.
"""

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.common import chunks, lean
from spendlake.llm.words import TEXT_BYTES, WordEncoder

#: Ids decoded at once.
DECODED_IDS = 1 << 18
#: Bytes of new words that are laid out at once (a longer word is laid out whole); about 250 bytes of memory for each.
REPLAYED_BYTES = 1 << 18


class Vocabulary:
    """Ranks of a vocabulary file (base64 token, rank), the pattern that splits texts into words, and memories of bounded size."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)])
        self.pairs: dict[int, int] = {}
        self._byte_pairs: np.ndarray | None = None
        self._token_bytes: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.texts = WordEncoder(regex.compile(pattern), self.learn)

    def byte_pairs(self) -> np.ndarray:
        """Rank of each pair of bytes, or -1."""
        if self._byte_pairs is None:
            self._byte_pairs = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        return self._byte_pairs

    def pair_rank(self, a: int, b: int) -> int:
        """Rank of the token that tokens a and b make up together, or -1."""
        if len(self.pairs) > 150_000:
            self.pairs.clear()
        rank = self.pairs[a << 32 | b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens of ids, one after another."""
        if self._token_bytes is None:
            size = max(self.tokens, default=-1) + 1
            each = [self.tokens.get(i, b"") for i in range(size)]
            lengths = np.fromiter(map(len, each), np.int64, size)
            self._token_bytes = np.frombuffer(b"".join(each), np.uint8), np.cumsum(lengths) - lengths, lengths
        flat, starts, lengths = self._token_bytes
        sizes = lengths[ids]
        ends = np.cumsum(sizes)
        return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[ids] - ends + sizes, sizes)].tobytes()

    def learn(self, words: list[str]) -> list[bytes]:
        """Token ids of each word, by replays over runs of words of REPLAYED_BYTES."""
        out, run, size = [], [], 0
        for w in words:
            run.append(w.encode())
            size += len(run[-1])
            if size >= REPLAYED_BYTES:
                out += replay(run, self)
                run, size = [], 0
        return out + replay(run, self) if run else out


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def replay(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Token ids of each word, as little-endian 32-bit integers.

    A word that is a token itself is taken whole. For the others, the lowest rank in the index is applied
    at all its positions from left to right. If a merge makes a pair of lower rank, the rest of that word
    waits until the lower rank has been applied, so that each word sees its merges in its own order.
    """
    flat = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    symbols = vocab.single[flat]
    if len(symbols) and symbols.min() < 0:
        raise ValueError("the vocabulary lacks single bytes")
    n = len(flat)
    ranks = np.full(n, -1, np.int64)
    if n > 1:
        ranks[:-1] = vocab.byte_pairs()[flat[:-1].astype(np.int64) << 8 | flat[1:]]
    ranks[ends[sizes > 0] - 1] = -1
    whole = np.fromiter((vocab.ranks.get(w, -1) for w in words), np.int64, len(words))
    ranks[np.repeat(whole >= 0, sizes)] = -1

    order = np.argsort(ranks, kind="stable")
    order = order[np.searchsorted(ranks[order], 0) :]
    found, firsts = np.unique(ranks[order], return_index=True)
    index: dict[int, list[int]] = {r: x.tolist() for r, x in zip(found.tolist(), np.split(order, firsts[1:]), strict=False)}

    owner = np.repeat(np.arange(len(words)), sizes)
    symbol, rank_at = symbols.tolist(), ranks.tolist()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends[sizes > 0] - 1] = -1
    before[(ends - sizes)[sizes > 0]] = -1
    after, before = after.tolist(), before.tolist()
    pairs, pair_rank = vocab.pairs.get, vocab.pair_rank
    queue = list(index)
    heapq.heapify(queue)
    while queue:
        rank = heapq.heappop(queue)
        places = index.pop(rank, None)
        if not places:
            continue
        places.sort()
        waiting: set[int] = set()
        for at in places:
            if rank_at[at] != rank:
                continue
            if waiting and owner[at] in waiting:
                index.setdefault(rank, []).append(at)
                continue
            right = after[at]
            follower = after[right]
            symbol[at], symbol[right], rank_at[right], after[at] = rank, -1, -1, follower
            new = -1
            if follower >= 0:
                before[follower] = at
                b = symbol[follower]
                new = pairs(rank << 32 | b)
                if new is None:
                    new = pair_rank(rank, b)
                if new >= 0:
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        heapq.heappush(queue, new)
                    if new < rank:
                        waiting.add(owner[at])
            rank_at[at] = new
            left = before[at]
            if left >= 0:
                a = symbol[left]
                new = pairs(a << 32 | rank)
                if new is None:
                    new = pair_rank(a, rank)
                rank_at[left] = new
                if new >= 0:
                    if new in index:
                        index[new].append(left)
                    else:
                        index[new] = [left]
                        heapq.heappush(queue, new)
                    if new < rank:
                        waiting.add(owner[at])
        if rank in index:
            heapq.heappush(queue, rank)

    final = np.array(symbol, "<i4")
    keep = final >= 0
    cum = np.zeros(n + 1, np.int64)
    np.cumsum(keep, out=cum[1:])
    tokens = final[keep].tobytes()
    starts, stops = (4 * cum[ends - sizes]).tolist(), (4 * cum[ends]).tolist()
    alone = whole.astype("<i4")
    return [alone[w : w + 1].tobytes() if alone[w] >= 0 else tokens[a:b] for w, (a, b) in enumerate(zip(starts, stops, strict=True))]


def encoder(path: str, pattern: str, keep: tuple[str, ...]):
    """Batches of `keep` and __text to batches of `keep` and ids."""

    def run(batches):
        vocab = vocabulary(path, pattern)
        for batch in batches:
            for part in chunks(batch, "__text", TEXT_BYTES):
                ids = vocab.texts.encode(part.column("__text").to_pylist())
                offsets = np.zeros(len(ids) + 1, "<i4")
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(offsets), values, type=pa.list_(pa.field("element", pa.int32(), False)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists], names=[*keep, "ids"])

    return run


def decoder(path: str, pattern: str):
    """Batches with ids to the same with `decoded`."""

    def run(batches):
        vocab = vocabulary(path, pattern)
        for batch in batches:
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy()
            out = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                out.append(b"".join([vocab.bytes_of(values[x : min(b, x + DECODED_IDS)]) for x in range(a, b, DECODED_IDS)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


IDS, DECODED = T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.BinaryType(), False)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and ids array<int> of each row of docs; a map over partitions, without a shuffle.

    Null and empty texts give an empty array. Rows, repeated ones and those without doc_id too, come out one
    for one; other columns of docs are left out, so that names cannot clash. Any length of text is encoded whole.
    """
    schema = T.StructType([*(docs.schema[c] for c in keep), IDS])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(lean(encoder(path, pattern, keep)), schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded with a column `decoded` (binary): the bytes of the ids, which are the text's UTF-8. Null ids give empty bytes."""
    return encoded.mapInArrow(lean(decoder(path, pattern)), T.StructType([*encoded.schema.fields, DECODED]))


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """decode of encode, in one worker for each task instead of two, which halves the memory beside an executor."""
    one, two = encoder(path, pattern, keep), decoder(path, pattern)
    schema = T.StructType([*(docs.schema[c] for c in keep), IDS, DECODED])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(lean(lambda batches: two(one(batches))), schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 of each document."""
    both = encode_decode(docs, path, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
