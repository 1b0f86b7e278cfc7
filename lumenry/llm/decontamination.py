"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is
one window of all its words).  A window occurs in a document only where all its
shingles do, so one shingle is a necessary prefix.  Shingles are ordered by
rarity, counted over all documents, and each window waits under its rarest one.
Documents are then joined on prefix shingles alone; positional and length
bounds drop windows that would start before the document or end after it; what
is left is verified word by word over item-sized windows.

The benchmark is read in blocks of at most ``BLOCK`` bytes of text, so what is
sent to executors is bounded; a larger benchmark takes more passes over the
documents.  Documents are never shuffled.

Results: null or empty texts have no words and no hits; items without words
never occur; equal item ids are one item, and an item without id has the empty
id.  Repeated documents get equal results.  Other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import ALNUM, LOWER, Words, append_struct, pieces, shingles, text_buffer
from .workspace import written

WINDOW = 13
#: Words of a prefix shingle; windows of fewer words wait under their first word.
SHINGLE = 3
#: Bytes of benchmark text in one block.
BLOCK = 4 << 20
#: Candidate windows verified at once.
_CHUNK = 1 << 18
_FILTER_BITS = 20


class Block:
    """Windows of some benchmark items, waiting under prefix shingles."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        flat, offsets = text_buffer(pa.array([t for _, t in items], pa.string()))
        words = Words(flat, offsets, ALNUM, LOWER)
        self.words = words.hash
        n = np.diff(words.first)
        hash_, row, start = shingles(words, width)
        size = np.minimum(n[row], width)
        # equal windows are kept once, with the items that have them
        order = np.lexsort((row, size, hash_))
        hash_, row, start, size = hash_[order], row[order], start[order], size[order]
        fresh = np.ones(len(hash_), dtype=bool)
        fresh[1:] = (hash_[1:] != hash_[:-1]) | (size[1:] != size[:-1])
        self.start, self.size = start[fresh], size[fresh]
        window = np.cumsum(fresh) - 1
        pair = np.unique(np.stack((window, row), axis=1), axis=0) if len(window) else np.zeros((0, 2), dtype=np.int64)
        self.owner_first = np.searchsorted(pair[:, 0], np.arange(len(self.start) + 1))
        self.owner = pair[:, 1]
        self.ids = [i for i, _ in items]
        self.tri = self._shingle(self.words)
        self.vocabulary = np.unique(np.concatenate((self.tri, self.words)))

    @staticmethod
    def _shingle(words: np.ndarray) -> np.ndarray:
        """Hash of the SHINGLE words from each place, whatever document they are in."""
        total = words.copy()
        factor = 1
        for i in range(1, SHINGLE):
            factor = factor * 0xC2B2AE3D27D4EB4F & (2**64 - 1)
            total[:-i] += words[i:] * np.uint64(factor)
        return total * np.uint64(0x9E3779B97F4A7C15) ^ (total >> np.uint64(29))

    def set_rarity(self, counts: np.ndarray) -> None:
        """Choose each window's prefix; counts: of each vocabulary entry in all documents."""
        tri, one = (counts[np.searchsorted(self.vocabulary, x)] for x in (self.tri, self.words))
        best = np.full(len(self.start), np.iinfo(np.int64).max)
        self.shift = np.zeros(len(self.start), dtype=np.int64)
        self.key = self.words[self.start] if len(self.start) else self.words[:0]
        wide = self.size >= SHINGLE
        for i in range(int(self.size.max(initial=0))):
            for table, hashes, fits in ((tri, self.tri, wide & (self.size - SHINGLE >= i)), (one, self.words, ~wide & (self.size > i))):
                at = np.where(fits, self.start + i, 0)
                better = fits & (table[at] < best)
                best[better] = table[at][better]
                self.shift[better] = i
                self.key = np.where(better, hashes[at], self.key)
        order = np.argsort(self.key, kind="stable")
        self.under = order  # windows by prefix
        self.prefix, self.prefix_first = np.unique(self.key[order], return_index=True)
        self.prefix_first = np.append(self.prefix_first, len(order))

    @staticmethod
    def find(keys: np.ndarray, hashes: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, index in keys) of the hashes that are among the sorted keys."""
        if not len(keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place = np.flatnonzero(sieve[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(keys, hashes[place]), len(keys) - 1)
        good = keys[at] == hashes[place]
        return place[good], at[good]

    @staticmethod
    def sieve(keys: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        bits[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return bits

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each occurrence in a run of documents."""
        if not hasattr(self, "_sieve"):
            self._sieve = self.sieve(self.prefix)
        place, prefix = [], []
        for hashes in (self._shingle(words.hash), words.hash):
            p, k = self.find(self.prefix, hashes, self._sieve)
            place.append(p)
            prefix.append(k)
        place, prefix = np.concatenate(place), np.concatenate(prefix)
        begins, ends = words.first[words.row[place]], words.first[words.row[place] + 1]
        many = self.prefix_first[prefix + 1] - self.prefix_first[prefix]
        out_at, out_window = [], []
        total = np.cumsum(many)
        at = 0
        while at < len(place):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _CHUNK)))
            m = many[at:stop]
            which = np.repeat(np.arange(at, stop), m)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
            window = self.under[self.prefix_first[prefix[which]] + nth]
            first = place[which] - self.shift[window]
            good = (first >= begins[which]) & (first + self.size[window] <= ends[which])
            first, window = first[good], window[good]
            for i in range(int(self.size[window].max(initial=0))):
                inside = self.size[window] > i
                same = ~inside
                same[inside] = words.hash[first[inside] + i] == self.words[self.start[window[inside]] + i]
                first, window = first[same], window[same]
            out_at.append(first)
            out_window.append(window)
            at = stop
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate(out_at or [none]), np.concatenate(out_window or [none])


def blocks(benchmark: DataFrame, size: int):
    """Items as (id, text) in blocks of about ``size`` bytes; one partition at a time comes to the driver."""
    rows = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text")
    held, items = 0, []
    for row in rows.toLocalIterator():
        items.append((row[0], row[1]))
        held += len(row[1])
        if held >= size:
            yield items
            held, items = 0, []
    if items:
        yield items


def _rarity(docs: DataFrame, block: Block) -> np.ndarray:
    """Occurrences of each vocabulary entry over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((block.vocabulary, Block.sieve(block.vocabulary)))

    def run(batches):
        keys, sieve = shared.value
        total = np.zeros(len(keys), dtype=np.int64)
        for batch in batches:
            flat, offsets = text_buffer(batch.column(0))
            for a, b in pieces(offsets):
                words = Words(flat, offsets[a : b + 1], ALNUM, LOWER)
                for hashes in (Block._shingle(words.hash), words.hash):
                    total += np.bincount(Block.find(keys, hashes, sieve)[1], minlength=len(keys))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["entry", "n"])

    counts = np.zeros(len(block.vocabulary), dtype=np.int64)
    for entry, n in docs.select("text").mapInArrow(run, "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n")).collect():
        counts[entry] = n
    return counts


def _merge_ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = start[1:] > end[:-1]
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1) if len(start) else np.zeros(0, dtype=np.int64)
    return start[fresh], end[last]


def _scan(block: Block, column: pa.Array) -> list[tuple[str, pa.Array]]:
    flat, offsets = text_buffer(column)
    n_words: list[int] = []
    hits: list[list[int]] = []
    found: list[list[str]] = []
    for a, b in pieces(offsets):
        words = Words(flat, offsets[a : b + 1], ALNUM, LOWER)
        n_words += np.diff(words.first).tolist()
        at, window = block.occurrences(words)
        row = words.row[at] if len(at) else at
        order = np.argsort(row, kind="stable")
        cut = np.searchsorted(row[order], np.arange(b - a + 1))
        for i in range(b - a):
            mine = order[cut[i] : cut[i + 1]]
            if not len(mine):
                hits.append([])
                found.append([])
                continue
            first = at[mine] - words.first[i]
            s, e = _merge_ranges(first, first + block.size[window[mine]])
            hits.append(np.stack((s, e), axis=1).ravel().tolist())
            kinds = np.unique(window[mine])
            owners = np.unique(np.concatenate([block.owner[block.owner_first[k] : block.owner_first[k + 1]] for k in kinds]))
            found.append(sorted({block.ids[o] for o in owners}))
    return [("n_words", pa.array(n_words, pa.int64())), ("hits", pa.array(hits, pa.list_(pa.int64()))), ("items", pa.array(found, pa.list_(pa.string())))]


FIELDS = "n_words: long, hits: array<long>, items: array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, name: str = "_found", *, width: int = WINDOW, block_bytes: int = BLOCK) -> DataFrame:
    """docs with a struct column ``name``: n_words, hits (word ranges start, end,
    start, ... that windows cover) and items (ids of items with occurrences)."""
    out = None
    for items in blocks(benchmark, block_bytes):
        block = Block(items, width)
        block.set_rarity(_rarity(docs, block))
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def compute(column, shared=shared):
            return _scan(shared.value, column)

        if out is None:
            out = append_struct(docs, name, FIELDS, compute)
            continue
        both = append_struct(written(out, "decontamination"), f"{name}_next", FIELDS, compute)
        joined = F.struct(
            F.col(name)["n_words"].alias("n_words"),
            F.concat(F.col(name)["hits"], F.col(f"{name}_next")["hits"]).alias("hits"),
            F.array_distinct(F.concat(F.col(name)["items"], F.col(f"{name}_next")["items"])).alias("items"),
        )
        out = both.withColumn(name, joined).drop(f"{name}_next")
    if out is None:
        empty = Block([("", "")], width)
        empty.set_rarity(np.zeros(len(empty.vocabulary), dtype=np.int64))
        out = append_struct(docs, name, FIELDS, lambda column: _scan(empty, column))
    return out


def n_hit(name: str = "_found") -> Column:
    """Words that windows cover; ranges of different blocks may overlap."""
    hits = F.col(name)["hits"]
    ranges = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(hits) / 2).cast("int") - 1), lambda i: F.struct(hits[2 * i].alias("s"), hits[2 * i + 1].alias("e"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(r["e"] - F.greatest(r["s"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], r["e"]).alias("to"))
    return F.when(F.size(hits) > 0, F.aggregate(ranges, start, step)["n"]).otherwise(F.lit(0).cast("long"))


def contaminated(name: str = "_found") -> Column:
    """At least a twentieth of the words, and one, are hit."""
    return (F.size(F.col(name)["hits"]) > 0) & (20 * n_hit(name) >= F.col(name)["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns."""
    name = "_found"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    return scan(docs, benchmark, name).where(~contaminated(name)).select(*[f"`{c}`" for c in docs.columns])
