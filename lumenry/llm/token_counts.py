"""Token counts by rank-synchronous array merging.

A byte-level BPE vocabulary is applied to many pre-tokens at once.  The
pre-tokens of a batch are held as one ragged numpy array of symbols; every
round looks up the rank of each adjacent pair, finds each sequence's lowest
rank and merges that pair at all its places in the sequence, for all sequences
simultaneously.  When no pair has a rank any more, the surviving symbols are
the tokens.  Counts of pre-tokens already seen are kept in a bounded table, so
only new ones are merged.

Results: a null or empty text has no tokens.  An added token's string inside a
text counts as one token, the library's default.  Rows are independent: ties
and repeated rows need no rule, other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memory  # noqa: F401  freed arrays go back to the system

#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a worker keeps; the table is emptied when full.
KEPT = 400_000
#: Pre-tokens above this many bytes are merged one by one with linked lists.
LONG = 2048
#: Symbols merged in one ragged array.
ROUND = 1 << 20
_NONE = np.int32(2**31 - 1)


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Ranks of symbol pairs; symbols 0-255 are bytes, 256 + r is made by rank r."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        ids = dict(_byte_symbols())
        keys = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys.append((ids[a] << 32) | ids[b])
            ids.setdefault(a + b, 256 + rank)
        # a merge that makes a string another rank has made leads to that symbol
        makes = [ids["".join(p.split(" ") if isinstance(p, str) else p)] for p in spec["model"]["merges"]]
        self.makes = np.array([*makes, 0], dtype=np.int64)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.int64(2**62))
        self.ranks = np.append(order.astype(np.int32), _NONE)
        self.bytes = np.full((256, 256), _NONE, dtype=np.int32)
        low = [(k >> 32, k & 0xFFFFFFFF, r) for r, k in enumerate(keys) if k >> 32 < 256 and k & 0xFFFFFFFF < 256]
        for a, b, r in low:
            self.bytes[a, b] = r
        self.added = [t["content"] for t in spec["added_tokens"]]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each non-empty byte string."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        out = size.copy()
        alive = np.arange(len(words))[size > 1]
        sym = np.frombuffer(b"".join(words[i] for i in alive), dtype=np.uint8).astype(np.int64)
        size = size[alive]
        if not len(sym):
            return out
        first = np.cumsum(size) - size
        rank = np.full(len(sym), _NONE, dtype=np.int32)
        rank[:-1] = self.bytes[sym[:-1], sym[1:]]
        rank[first + size - 1] = _NONE
        while True:
            least = np.minimum.reduceat(rank, first)
            done = least == _NONE
            if done.any():
                out[alive[done]] = size[done]
                go = ~done
                keep = np.repeat(go, size)
                sym, rank = sym[keep], rank[keep]
                alive, size, least = alive[go], size[go], least[go]
                if not len(alive):
                    return out
                first = np.cumsum(size) - size
            hit = rank == np.repeat(least, size)
            at = np.flatnonzero(hit)
            # in a run of adjacent places (aaa) every second one is a merge
            run = np.ones(len(at), dtype=bool)
            run[1:] = at[1:] != at[:-1] + 1
            begin = at[run][np.cumsum(run) - 1]
            at = at[(at - begin) % 2 == 0]
            sym[at] = self.makes[rank[at]]
            gone = np.zeros(len(sym), dtype=bool)
            gone[at + 1] = True
            owner = np.searchsorted(first, at, side="right") - 1
            size = size - np.bincount(owner, minlength=len(size))
            first = np.cumsum(size) - size
            at = at - np.arange(len(at))  # places after the deletion
            sym, rank = sym[~gone], rank[~gone]
            last = np.zeros(len(sym), dtype=bool)
            last[first + size - 1] = True
            both = np.concatenate((at, at[at > 0] - 1))
            nxt = np.minimum(both + 1, len(sym) - 1)
            rank[both] = np.where(last[both], _NONE, self.pair_ranks(sym[both], sym[nxt]))

    def merge_long(self, word: bytes) -> int:
        """The same for one long sequence: places wait in a heap of ranks, and
        a round touches only the places of its rank."""
        sym = np.frombuffer(word, dtype=np.uint8).astype(np.int64)
        n = len(sym)
        right = np.arange(1, n + 1)
        left = np.arange(-1, n - 1)
        live = np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def push(ranks: np.ndarray, at: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            ranks, at = ranks[ranks != _NONE], at[ranks != _NONE]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            if not len(at):
                return
            for r, part in zip(ranks[np.concatenate(([0], cut))], np.split(at, cut), strict=True):
                if int(r) not in waiting:
                    waiting[int(r)] = []
                    heapq.heappush(heap, int(r))
                waiting[int(r)].append(part)

        def look(at: np.ndarray) -> None:
            at = at[right[at] < n]
            push(self.pair_ranks(sym[at], sym[right[at]]), at)

        look(np.arange(n))
        count = n
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[live[at] & (right[at] < n)]
            at = at[self.pair_ranks(sym[at], sym[right[at]]) == r]
            if not len(at):
                continue
            run = np.ones(len(at), dtype=bool)
            run[1:] = at[1:] != right[at[:-1]]
            index = np.arange(len(at))
            at = at[(index - index[run][np.cumsum(run) - 1]) % 2 == 0]
            dead = right[at]
            sym[at] = self.makes[r]
            live[dead] = False
            after = right[dead]
            right[at] = after
            inner = after < n
            left[after[inner]] = at[inner]
            count -= len(at)
            before = left[at]
            look(np.unique(np.concatenate((at, before[before >= 0]))))
        return count


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class Counter:
    """Counts tokens of texts; keeps counts of pre-tokens between batches."""

    def __init__(self, path: str):
        self.table = merge_table(path)
        self.find = regex.compile(PRE_TOKEN).findall
        self.seen: dict[str, int] = {}

    def learn(self, new: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in new]
        batch: list[int] = []
        held = 0
        for i, w in enumerate(raw):
            if len(w) > LONG:
                self.seen[new[i]] = self.table.merge_long(w)
                continue
            batch.append(i)
            held += len(w)
            if held > ROUND:
                self._merge(new, raw, batch)
                batch, held = [], 0
        self._merge(new, raw, batch)

    def _merge(self, new: list[str], raw: list[bytes], batch: list[int]) -> None:
        if batch:
            for i, n in zip(batch, self.table.merge([raw[i] for i in batch]).tolist(), strict=True):
                self.seen[new[i]] = n

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the texts together should be a few MB."""
        extra = [0] * len(texts)
        found = []
        for i, text in enumerate(texts):
            parts = [text]
            for added in self.table.added:
                parts = [x for p in parts for x in p.split(added)] if added in text else parts
            extra[i] = len(parts) - 1
            found.append([t for p in parts for t in self.find(p)] if len(parts) > 1 else self.find(text))
        if len(self.seen) > KEPT:
            self.seen.clear()
        seen = self.seen
        new: set[str] = set()
        for tokens in found:
            new.update(tokens)
        self.learn([t for t in new if t not in seen])
        get = seen.__getitem__
        return [n + sum(map(get, tokens)) for n, tokens in zip(extra, found, strict=True)]


_counters: dict[str, Counter] = {}


def count_batches(batches, path: str, limit: int):
    if path not in _counters:
        _counters[path] = Counter(path)
    counter = _counters[path]
    for batch in batches:
        texts = batch.column(1).fill_null("").to_pylist()
        n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
        counts: list[int] = []
        at = 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (held < 1 << 20 or stop == at):
                held += n_bytes[stop]
                stop += 1
            counts += counter.count(texts[at:stop])
            at = stop
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
            names=["id", "n_bytes", "n_tokens", "over_limit"],
        )


def token_counts(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row.  A narrow stage: no shuffle.

    tokenizer: path of a byte-level BPE file that every executor can open.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(lambda b: count_batches(b, tokenizer, limit), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", key)
