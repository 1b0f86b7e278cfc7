"""Vectorised text kernels shared by the corpus operators.

Text columns are handled as the flat UTF-8 byte buffers that Arrow already
holds.  Words are byte runs, so a batch of documents is split, lower-cased and
hashed with a handful of numpy passes and no Python object per word.

Conventions: a null text is an empty text; a batch is cut into pieces of about
``PIECE`` bytes (one longer document is a piece of its own), which bounds the
memory a kernel needs whatever the batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import memory  # noqa: F401  freed arrays go back to the system

PIECE = 2 << 20

_MASK = (1 << 64) - 1


def _splitmix_table(seed: int, n: int) -> np.ndarray:
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


_BYTE_CODE = _splitmix_table(7, 256)
_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so powers never vanish
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the word-hash base."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 64), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit sums so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words between ASCII white space: space and 0x09-0x0D.
NOT_SPACE = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of digits, letters and everything beyond ASCII.
ALNUM = _table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return flat, offsets


def pieces(offsets: np.ndarray, size: int = PIECE):
    """Ranges of rows of about ``size`` bytes each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        stop = min(n, max(stop, at + 1))
        yield at, stop
        at = stop


class Words:
    """Words of a run of documents.

    ``hash``: one 64-bit value a word; ``row``: the document of each word, from
    0; ``first``: index of each document's first word, with the total last.
    """

    __slots__ = ("end", "first", "hash", "row", "start")

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray):
        base, rows = int(offsets[0]), len(offsets) - 1
        data = flat[base : int(offsets[-1])]
        inside = is_word[data]
        cut = (offsets[1:-1] - base).astype(np.int64)
        cut = cut[(cut > 0) & (cut < len(data))]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[cut] = inside[cut]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[cut - 1] = inside[cut - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets - base)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        length = self.end - self.start
        if not len(length):
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        codes = _BYTE_CODE[fold][data[inside]]
        compact = np.zeros(len(length), dtype=np.int64)
        np.cumsum(length[:-1], out=compact[1:])
        place = np.arange(len(codes), dtype=np.int64)
        place -= np.repeat(compact, length)
        codes *= powers(int(length.max()))[place]
        self.hash = mix(np.add.reduceat(codes, compact) + length.astype(np.uint64))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, index of the first word) of each k-word window; shorter
    documents give one window of all their words."""
    h, n = words.hash, np.diff(words.first)
    if not len(h):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    total = np.zeros(len(h), dtype=np.uint64)
    left = np.repeat(words.first[1:], n) - np.arange(len(h))  # words from here to the end
    factor = np.uint64(1)
    for i in range(k):
        part = h[i:] * factor
        if i:
            part[left[: len(part)] <= i] = 0
        total[: len(part)] += part
        factor = np.uint64((int(factor) * 0x9FB21C651E98DF25) & _MASK)
    keep = left >= k
    keep[words.first[:-1][(n > 0) & (n < k)]] = True
    return mix(total[keep] + np.uint64(k)), words.row[keep], np.flatnonzero(keep)


def distinct(hash_: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), ordered by row and hash; rows come in order."""
    order = np.lexsort((hash_, row))
    hash_, row = hash_[order], row[order]
    keep = np.ones(len(hash_), dtype=bool)
    keep[1:] = (hash_[1:] != hash_[:-1]) | (row[1:] != row[:-1])
    return hash_[keep], row[keep]


def unused(taken: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, in whatever case."""
    held = {c.lower() for c in taken}
    out = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def append_struct(df, name: str, fields: str, compute):
    """df with a struct column ``name`` that ``compute(text array) -> list of
    arrays`` derives from its text column; every other column passes through, but for
    one of that name.  A narrow Arrow stage."""
    moved, own, back = set_aside(df, name)
    at = df.columns.index("text")

    def run(batches):
        for batch in batches:
            parts = compute(batch.column(at))
            struct = pa.StructArray.from_arrays([a for _, a in parts], names=[n for n, _ in parts])
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*own.values(), "made"])

    plain = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in moved.schema)
    return moved.mapInArrow(run, f"{plain}made struct<{fields}>").select(*back, F.col("made").alias(name))


def set_aside(docs, *results: str):
    """(docs under names that no operator uses, those names by the old ones, what brings the
    columns back).  A column of a result's name is not brought back: the result replaces it."""
    own = {c: f"column{i}" for i, c in enumerate(docs.columns)}
    gone = {r.lower() for r in results}
    moved = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    return moved, own, [F.col(n).alias(c) for c, n in own.items() if c.lower() not in gone]
