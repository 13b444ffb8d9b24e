"""Words and hashed word n-grams of texts, for many texts at once."""

import numpy as np

from spendlake.llm.common import Hashes

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: Maps A-Z to a-z and every ASCII byte that is neither a letter nor a digit to a space; bytes beyond ASCII stay.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    return text.translate(ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space (space and 0x09 to 0x0D), A-Z lower-cased."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], memory: Hashes) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, from the words' hashes; two runs of the same words have the same hash."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = out * MULTIPLIER + hashes[j : j + n]
    return mix(out)
