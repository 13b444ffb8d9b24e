"""Encoding of texts word by word, with a memory of the words met before."""

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

#: Bytes that a Python worker's memory of words may take, unless told otherwise; the first to come stay, so the frequent ones are among them.
BOUND = 32 << 20
#: What a remembered word takes beside its own characters and ids: two objects and a dictionary's entry.
ENTRY_BYTES = 200
#: Text bytes encoded at once.
TEXT_BYTES = 1 << 19
#: Words of a longer text that are held at once.
RUN_WORDS = 1 << 17


class WordEncoder:
    """Encodes texts whose words (as `pattern` finds them) never influence each other; `learn` gives the ids of new words, as little-endian 32-bit integers."""

    def __init__(self, pattern, learn: Callable[[list[str]], list[bytes]], bound: int = BOUND):
        self.pattern, self.learn, self.bound = pattern, learn, bound
        self.memory: dict[str, bytes] = {}
        self.used = 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for null and empty ones."""
        if len(texts) == 1 and texts[0] and len(texts[0]) > TEXT_BYTES:
            return [b"".join([b"".join(self.ids([run])) for run in self.runs(texts[0])])]
        return self.ids([self.pattern.findall(t) if t else [] for t in texts])

    def runs(self, text: str) -> Iterator[list[str]]:
        words = (m.group() for m in self.pattern.finditer(text))
        while run := list(islice(words, RUN_WORDS)):
            yield run

    def ids(self, words: list[list[str]]) -> list[bytes]:
        known = self.memory
        new = list(set().union(*words).difference(known))
        fresh = dict(zip(new, self.learn(new), strict=True)) if new else {}
        size = sum([len(w) + len(i) for w, i in fresh.items()]) + ENTRY_BYTES * len(fresh)
        if self.used + size <= self.bound:
            self.used += size
            known.update(fresh)
            return [b"".join(map(known.__getitem__, w)) for w in words]
        get = known.get
        return [b"".join([get(x) or fresh[x] for x in w]) for w in words]


def id_lists(ids: list[bytes]) -> pa.ListArray:
    """Little-endian 32-bit integers of each row as a list."""
    offsets = np.zeros(len(ids) + 1, "<i4")
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets), values, type=pa.list_(pa.field("element", pa.int32(), False)))
