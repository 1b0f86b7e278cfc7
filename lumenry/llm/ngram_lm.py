"""Scores of an n-gram language model kept in Elias-Fano tries.

The model has words and word pairs, with Dirichlet smoothing: the probability
of w after v is (c(v w) + MU p(w)) / (c(v) + MU), and p(w) adds a half to each
word's count and keeps one more place for unknown words; so the words and the
unknown one share exactly 1 after every context, but for the rounding of counts
to ``BITS`` bits of their logarithm (counts of one are exact).  ``order`` 3 and more
add levels of longer contexts, each smoothed by the one below in the same way;
a document starts with as many end tokens as its contexts need.  A context's
own count is then the smoothed one of the level below.

Counting and scoring go through one exchange (module exchange): blocks of
documents send each shard the word pairs (contexts with their successors) and
words that it owns; a shard adds up what training documents hold.  From it the
shard builds its part of the trie: sorted contexts and their pointers to
successors, both Elias-Fano coded, the successors coded as one monotone
sequence by adding each context's start, and, beside them, joint probabilities
quantised to ``BITS`` bits of their logarithm.  The levels are written to one
file in memory, which has no name in any folder, and mapped; pairs are looked up by
finding the context and then the successor inside the context's range.  Answers
go back to the blocks: quantised probabilities of pairs, counts of words.

A pair's shard depends on its context and on four bits of its successor, so the
successors of one frequent word are spread over sixteen parts of the key space.
Nothing is broadcast but two numbers, N and V.

Results: a null text is empty and is scored as its end token alone.  Training
documents are those whose crc32 of doc_id as text, modulo 5, is not 1 (a null
doc_id counts as the empty text).  With no training text every count is zero.
Equal rows get equal scores, and each counts in training; ties need no rule.
Whole texts are read, however long.  An empty table gives an empty one.  Only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .textkit import LOWER, NOT_SPACE, Words, mix, pieces, text_buffer
from .workspace import written

FOLDS, HELD = 5, 1
#: Words of the longest n-grams: 2 are pairs.
ORDER = 2
#: Strength of the smoothing, in tokens.
MU = 30.0
#: Bits of a quantised log-probability.
BITS = 8
#: The end token, which also stands before the first word.
END = np.uint64(0x1B5C8D3F77A1E209)
#: Bits of a successor inside its context.
SUCCESSOR_BITS = 40


# ---- Elias-Fano ------------------------------------------------------------------------


class EliasFano:
    """A non-decreasing sequence: low bits in plain words, high bits in unary.

    ``save`` gives arrays that may be memory-mapped again; ``get`` and ``find``
    work on whole arrays of queries.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.rank: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = values & np.uint64((1 << bits) - 1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(ones[-1]) + 1 if n else 0) + 1, dtype=np.uint8)
        flags[ones] = 1
        width = max(1, (bits + 7) // 8)
        packed = low.view(np.uint8).reshape(-1, 8)[:, :width].copy() if n else np.zeros((0, width), np.uint8)
        return cls(n, bits, packed, np.packbits(flags))

    def arrays(self) -> list[np.ndarray]:
        return [self.low.reshape(-1), self.high]

    def _select(self) -> np.ndarray:
        """Places of the ones, made once from the mapped bits."""
        if self.rank is None:
            self.rank = np.flatnonzero(np.unpackbits(self.high)).astype(np.int64)
        return self.rank

    def get(self, i: np.ndarray) -> np.ndarray:
        ones = self._select()[i]
        high = (ones - i).astype(np.uint64) << np.uint64(self.low_bits)
        width = self.low.shape[1]
        low = np.zeros((len(i), 8), dtype=np.uint8)
        low[:, :width] = self.low[i]
        return high | low.view(np.uint64).ravel()

    def find(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Successor search: the first place in [begin, end) with a value >= x, else end."""
        lo, hi = begin.copy(), end.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            less = self.get(mid) < x[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)


class Trie:
    """Contexts, pointers, successors and quantised log10 joint probabilities."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray, scale: tuple[float, float]):
        self.contexts, self.pointers, self.successors, self.codes, self.scale = contexts, pointers, successors, codes, scale

    @classmethod
    def build(cls, context: np.ndarray, successor: np.ndarray, counts: np.ndarray, total: int) -> Trie:
        """Pairs sorted by context and successor; total: tokens of training."""
        fresh = np.ones(len(context), dtype=bool)
        fresh[1:] = context[1:] != context[:-1]
        first = np.flatnonzero(fresh)
        heads = context[first] >> np.uint64(8)  # 56 bits, so that a sum stays below 2**64
        # each context's successors continue where the last one's ended
        nth = np.cumsum(fresh) - 1
        last = successor[np.append(first[1:] - 1, len(successor) - 1)] if len(first) else successor[:0]
        step = np.zeros(len(first) + 1, dtype=np.uint64)
        np.cumsum(last + np.uint64(1), out=step[1:])
        joined = successor + step[nth] if len(first) else successor
        smooth = np.log10(counts / max(total, 1))
        low, high = (float(smooth.min()), float(smooth.max())) if len(smooth) else (0.0, 0.0)
        unit = (high - low) / (2**BITS - 2) or 1.0
        codes = (1 + np.round((smooth - low) / unit)).astype(np.uint8)
        return cls(
            EliasFano.build(heads, 1 << 56),
            EliasFano.build(np.append(first, len(context)), len(context) + 1),
            EliasFano.build(joined, int(step[-1]) + 1),
            codes,
            (low, unit),
        )

    def save(self, file) -> list:
        """Write the levels to an open file; the plan says where each array is."""
        plan, at = [], 0
        for level in (self.contexts, self.pointers, self.successors):
            parts = []
            for a in level.arrays():
                file.write(a.tobytes())
                parts.append((at, len(a)))
                at += len(a)
            plan.append((level.n, level.low_bits, parts))
        file.write(self.codes.tobytes())
        file.flush()
        plan.append((len(self.codes), at, self.scale))
        return plan

    @classmethod
    def load(cls, file, plan: list) -> Trie:
        """The levels, mapped from the file."""
        data = np.memmap(file, dtype=np.uint8, mode="r") if os.fstat(file.fileno()).st_size else np.zeros(0, np.uint8)
        levels = []
        for n, bits, ((a, k), (b, m)) in plan[:3]:
            levels.append(EliasFano(n, bits, data[a : a + k].reshape(n, -1) if n else np.zeros((0, 1), np.uint8), data[b : b + m]))
        n, at, scale = plan[3]
        return cls(*levels, data[at : at + n], scale)

    def look_up(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of pairs; 0 where the pair is unknown."""
        out = np.zeros(len(context), dtype=np.uint8)
        n = self.contexts.n
        if not n:
            return out
        head = context >> np.uint64(8)
        at = self.contexts.find(head, np.zeros(len(head), dtype=np.int64), np.full(len(head), n))
        known = at < n
        known[known] = self.contexts.get(at[known]) == head[known]
        rows = np.flatnonzero(known)
        at = at[known]
        begin, end = (self.pointers.get(at + i).astype(np.int64) for i in (0, 1))
        # the range's values are relative to the last value before it
        base = np.zeros(len(at), dtype=np.uint64)
        base[begin > 0] = self.successors.get(begin[begin > 0] - 1) + np.uint64(1)
        x = base + successor[rows]
        place = self.successors.find(x, begin, end)
        hit = place < end
        hit[hit] = self.successors.get(place[hit]) == x[hit]
        out[rows[hit]] = self.codes[place[hit]]
        return out

    def log10(self, codes: np.ndarray) -> np.ndarray:
        return self.scale[0] + (codes.astype(float) - 1) * self.scale[1]


# ---- the exchange ----------------------------------------------------------------------


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


class Tokens:
    """Tokens of some documents: words, then one end each; and their distinct n-grams up to ``order``."""

    def __init__(self, column: pa.ChunkedArray, order: int = ORDER):
        flat, offsets = text_buffer(column)
        hashes, sizes = [], []
        for a, b in pieces(offsets):
            words = Words(flat, offsets[a : b + 1], NOT_SPACE, LOWER)
            hashes.append(np.insert(words.hash, words.first[1:], END))
            sizes.append(np.diff(words.first) + 1)
        self.token = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.context = np.roll(self.token, 1)
        if len(self.token):
            self.context[0] = END  # before each first word stands the end before it
        # distinct words, and distinct pairs by context and then successor
        self.words, self.word = np.unique(self.token, return_inverse=True)
        before = np.roll(self.word, 1)
        if len(self.token):
            before[0] = np.searchsorted(self.words, END)
        self.before = before
        # of each level: the contexts, the successors, and each token's n-gram
        starts = np.cumsum(self.n) - self.n
        at, hashes, self.grams = before, self.words, []
        for k in range(2, order + 1):
            if k > 2:  # the context reaches one token further; before a first word stand ends alone
                longer = np.roll(at, 1)
                longer[starts] = at[starts]
                keys, at = np.unique(_joined(longer, before), return_inverse=True)
                hashes = mix(hashes[keys >> np.uint64(32)] + np.uint64(k)) + self.words[keys & np.uint64(0xFFFFFFFF)]
            pairs, gram = np.unique(_joined(at, self.word), return_inverse=True)
            self.grams.append((hashes[(pairs >> np.uint64(32)).astype(np.int64)], self.words[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)], gram))
        self.starts = starts


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def _successor(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(64 - SUCCESSOR_BITS)


def _places(t: Tokens, shards: int):
    """Per shard: which words, and which n-grams of each level, of a block it owns."""
    out = []
    for key in (t.words, *(mix(context + (successor & np.uint64(15))) for context, successor, _ in t.grams)):
        shard = (key >> np.uint64(8)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        out.append((order, np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))))
    return out


def _few(counts: np.ndarray) -> bytes:
    """Counts in a byte each; larger ones follow."""
    big = counts >= 255
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[big].astype(np.uint64).tobytes()


def _many(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    big = np.flatnonzero(counts == 255)
    counts[big] = np.frombuffer(data, np.uint64, len(big), at + n)
    return counts, at + n + 8 * len(big)


def _pack_words(words: np.ndarray, counts: np.ndarray) -> bytes:
    return np.uint32(len(words)).tobytes() + words.tobytes() + _few(counts)


def _unpack_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    return np.frombuffer(data, np.uint64, n, 4), _many(data, n, 4 + 8 * n)[0]


def _pack_pairs(context: np.ndarray, successor: np.ndarray, counts: np.ndarray) -> bytes:
    """Contexts once each, how many successors they have, and those in 40 bits."""
    fresh = np.ones(len(context), dtype=bool)
    fresh[1:] = context[1:] != context[:-1]
    first = np.flatnonzero(fresh)
    many = np.diff(np.append(first, len(context)))
    width = SUCCESSOR_BITS // 8
    low = successor.view(np.uint8).reshape(-1, 8)[:, :width].tobytes() if len(successor) else b""
    return np.array([len(first), len(context)], np.uint32).tobytes() + context[first].tobytes() + _few(many) + low + _few(counts)


def _unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads, n = (int(x) for x in np.frombuffer(data, np.uint32, 2))
    context = np.frombuffer(data, np.uint64, heads, 8)
    many, at = _many(data, heads, 8 + 8 * heads)
    width = SUCCESSOR_BITS // 8
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    return np.repeat(context, many), wide.view(np.uint64).ravel(), _many(data, n, at + n * width)[0]


def _levels(order: int) -> list[str]:
    """Columns of the messages: pairs, then longer n-grams."""
    return ["pairs", *(f"grams{k}" for k in range(3, order + 1))]


def _ask(shards: int, order: int):
    def run(key, table):
        t = Tokens(table.column("text"), order)
        train = np.array([not held_out(i) for i in table.column("doc_id").to_pylist()], dtype=bool)[t.row]
        word_counts = np.bincount(t.word[train], minlength=len(t.words))
        counts = [np.bincount(gram[train], minlength=len(context)) for context, _, gram in t.grams]
        (words, w), *places = _places(t, shards)
        successors = [_successor(follow) for _, follow, _ in t.grams]
        rows = []
        for s in range(shards):
            mine, grams = words[w[s] : w[s + 1]], [o[p[s] : p[s + 1]] for o, p in places]
            if len(mine) or any(map(len, grams)):
                packed = [_pack_pairs(g[0][i], n[i], c[i]) for g, n, c, i in zip(t.grams, successors, counts, grams, strict=True)]
                rows.append((s, _pack_words(t.words[mine], word_counts[mine]), *packed))
        columns = {"shard": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64())}
        return pa.table(columns | {c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate(("words", *_levels(order)), 1)})

    return run


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, inverse, np.bincount(inverse, counts, minlength=len(unique)).astype(np.int64)


def _codes(data: list[bytes]) -> tuple[list[bytes], float, float]:
    """One level of a shard: the trie of its n-grams, and what it says to every block."""
    pairs = [_unpack_pairs(b) for b in data]
    context, successor, c = (np.concatenate([p[i] for p in pairs]) for i in range(3))
    trained = c > 0
    order = np.lexsort((successor[trained], context[trained]))
    k, s, c = context[trained][order], successor[trained][order], c[trained][order]
    fresh = np.ones(len(k), dtype=bool)
    fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    first = np.flatnonzero(fresh)
    total = np.add.reduceat(c, first) if len(first) else c
    trie = Trie.build(k[first], s[first], total, 1)  # in tokens; the blocks know N
    with os.fdopen(os.memfd_create("trie"), "w+b") as file:
        trie = Trie.load(file, trie.save(file))
        code = trie.look_up(context, successor)
    cuts = np.cumsum([0, *(len(p[0]) for p in pairs)])
    return [code[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], *trie.scale


def _answer(order: int):
    def run(key, table):
        """One shard: word counts, and the levels' answers to every block."""
        asked = [_unpack_words(b) for b in table.column("words").to_pylist()]
        words, inverse, counts = _sum(np.concatenate([w for w, _ in asked]), np.concatenate([c for _, c in asked]))
        of_word = counts[inverse]
        cuts = np.cumsum([0, *(len(w) for w, _ in asked)])
        n = len(asked)
        columns = {"block": table.column("block"), "shard": table.column("shard"), "words": pa.array([_few(of_word[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())}
        for c in _levels(order):
            codes, low, unit = _codes(table.column(c).to_pylist())
            columns |= {c: pa.array(codes, pa.binary()), f"{c}_low": pa.array([low] * n, pa.float64()), f"{c}_unit": pa.array([unit] * n, pa.float64())}
        # the shard's part of N and V, on one of its rows
        columns["tokens"] = pa.array([int(counts.sum())] + [0] * (n - 1), pa.int64())
        columns["types"] = pa.array([int((counts > 0).sum())] + [0] * (n - 1), pa.int64())
        return pa.table(columns)

    return run


def _schemas(order: int) -> tuple[str, str]:
    """Of questions and of answers."""
    ask = "shard long, block long, words binary, " + ", ".join(f"{c} binary" for c in _levels(order))
    answer = "block long, shard long, words binary, " + ", ".join(f"{c} binary, {c}_low double, {c}_unit double" for c in _levels(order))
    return ask, answer + ", tokens long, types long"


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shards: int, total: int, types: int, mu: float, order: int):
    def run(key, docs, answers):
        t = Tokens(docs.column("text"), order)
        (words, w), *places = _places(t, shards)
        count = np.zeros(len(t.words), dtype=np.int64)
        joint = [np.zeros(len(context)) for context, _, _ in t.grams]  # smoothed counts
        for answer in answers.to_pylist():
            s = answer["shard"]
            mine = words[w[s] : w[s + 1]]
            count[mine] = _many(answer["words"], len(mine), 0)[0]
            for c, (o, p), found in zip(_levels(order), places, joint, strict=True):
                code = np.frombuffer(answer[c], np.uint8)
                found[o[p[s] : p[s + 1]]] = np.where(code > 0, 10 ** (answer[f"{c}_low"] + (code.astype(float) - 1) * answer[f"{c}_unit"]), 0.0)
        p_word = (count + 0.5) / (total + 0.5 * (types + 1))
        seen, probability = count[t.before], p_word[t.word]
        for (_, _, gram), found in zip(t.grams, joint, strict=True):
            held = np.minimum(found[gram], seen)
            probability = (held + mu * probability) / (seen + mu)
            # the next level's context is what ended a token before; ends alone count as one end does
            ends = seen[t.starts]
            seen = np.roll(held, 1)
            seen[t.starts] = ends
        rows = len(t.n)
        doc_ids = docs.column("doc_id").to_pylist()
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": pa.array([held_out(i) for i in doc_ids], pa.bool_()),
                "n_tokens": pa.array(t.n.astype(np.int64)),
                "n_known": pa.array(np.bincount(t.row[count[t.word] > 0], minlength=rows).astype(np.int64)),
                "train_tokens": pa.array([total] * rows, pa.int64()),
                "base_score": pa.array(np.bincount(t.row, np.log10(p_word)[t.word], minlength=rows)),
                "score": pa.array(np.bincount(t.row, np.log10(probability), minlength=rows)),
            }
        )

    return run


def score(docs: DataFrame, *, mu: float = MU, order: int = ORDER, block_bytes: int = exchange.BLOCK_BYTES) -> DataFrame:
    """Learn from the training documents and score all; see the module for the columns."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    ask, answer = _schemas(order)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = exchange.parts(base, block_bytes)
    dealt = base.withColumn("block", exchange.block_of(n))
    asked = dealt.groupBy("block").applyInArrow(_ask(n, order), ask)
    answers = written(asked.groupBy("shard").applyInArrow(_answer(order), answer), "lm-answers")
    sums = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    run = _score(n, int(sums[0]), int(sums[1]), mu, order)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _SCORES)
