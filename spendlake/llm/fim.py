"""Fill-in-the-middle: documents cut at two line ends, and their parts put into another order between markers.

The places between lines are a set of code point offsets in containers of 65,536 offsets each, as in Roaring
bitmaps: a sorted array, a bitmap or runs, whichever is the smallest, with the number of members before each
container. The k-th place is found by a search over these numbers and a selection within one container.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.common import chunks, lean

CHUNK = 1 << 16
#: Members of an array as large as a bitmap.
ARRAY_MOST = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Number of ones of each byte, and the place of its k-th one.
ONES = np.array([b.bit_count() for b in range(256)])


class Container:
    """Distinct 16-bit numbers, given in ascending order."""

    def __init__(self, low: np.ndarray):
        self.size = len(low)
        breaks = np.flatnonzero(np.diff(low.astype(np.int64)) != 1) + 1
        firsts = np.concatenate([[0], breaks])
        if 4 * len(firsts) < min(2 * self.size, CHUNK // 8):
            self.kind, self.data = "runs", low[firsts]
            self.before = firsts  # members before each run
        elif self.size <= ARRAY_MOST:
            self.kind, self.data = "array", low.astype(np.uint16)
        else:
            bits = np.zeros(CHUNK, np.uint8)
            bits[low] = 1
            self.kind, self.data = "bitmap", np.packbits(bits, bitorder="little")

    def select(self, k: int) -> int:
        """The k-th number, from 0."""
        if self.kind == "array":
            return int(self.data[k])
        if self.kind == "runs":
            run = int(np.searchsorted(self.before, k, "right")) - 1
            return int(self.data[run]) + k - int(self.before[run])
        upto = np.cumsum(ONES[self.data])
        byte = int(np.searchsorted(upto, k, "right"))
        rest = k - (int(upto[byte - 1]) if byte else 0)
        return 8 * byte + int(np.flatnonzero(np.unpackbits(self.data[byte : byte + 1], bitorder="little"))[rest])


class BoundarySet:
    """Offsets, given in ascending order, by containers of their high bits."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        self.keys, starts = np.unique(high, return_index=True)
        cuts = [*starts.tolist(), len(offsets)]
        self.containers = [Container(offsets[a:b] & (CHUNK - 1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.upto = np.cumsum([c.size for c in self.containers])

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        at = int(np.searchsorted(self.upto, k, "right"))
        before = int(self.upto[at - 1]) if at else 0
        return (int(self.keys[at]) << 16) + self.containers[at].select(k - before)


def boundaries(text: str) -> BoundarySet:
    """0 and the end of each line of text, as code point offsets; a line takes its line feed with it."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(points == 10) + 1
    last = [len(points)] if len(points) and (not len(ends) or ends[-1] != len(points)) else []
    return BoundarySet(np.concatenate([[0], ends, last]).astype(np.int64))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers that follow from seed and doc_id (nothing stands for null)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest[:16], ">u4").tolist()


def transformed(text: str, doc_id: int | None, rate: int, spm_rate: int, seed: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of lines, form, code points of prefix and middle, output."""
    found = boundaries(text)
    n = len(found) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKERS):
        return n, "plain", None, None, text
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = found.select(one), found.select(two)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7, text: str = "text") -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars and output of each row of docs; a map over partitions.

    `rate` of a hundred documents are cut, and `spm_rate` of a hundred of these have the suffix first. Cuts follow
    from seed and doc_id alone, so rows of one doc_id draw the same numbers; a null doc_id draws as an empty one.
    Null and empty texts, and texts that hold one of the markers, stay as they are (form plain, no lengths). Rows
    come out one for one, whatever other columns docs has; any length of text is cut whole.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "__text"):
                ids = part.column("doc_id")
                rows = [transformed(t or "", i, rate, spm_rate, seed) for t, i in zip(part.column("__text").to_pylist(), ids.to_pylist(), strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = f"doc_id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", F.col(text).alias("__text")).mapInArrow(lean(run), schema)


def restored(output, form):
    """The text that an output of a form was made from, by its markers."""
    parts = F.split(output, "|".join(MARKERS))
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    whole = output
    for name, places in order.items():
        whole = F.when(form == name, F.concat(*(parts[p] for p in places))).otherwise(whole)
    return whole


def summary(rows: DataFrame) -> DataFrame:
    """transform's rows with output_sha256 and restored_sha256 in place of the output."""
    output = F.col("output")
    digests = F.sha2(output, 256).alias("output_sha256"), F.sha2(restored(output, F.col("form")), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH cut AS (
  SELECT doc_id, t, len(l) AS n, l, ('0x' || h[1:8])::UBIGINT % (len(l) + 1) AS c1, ('0x' || h[9:16])::UBIGINT % (len(l) + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN ('0x' || h[25:32])::UBIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || doc_id) AS h FROM documents)),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(l[1:least(c1, c2)], '') AS p, array_to_string(l[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(l[greatest(c1, c2) + 1:], '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
