"""Corpus-wide counts of hashed keys, brought back to where the keys came from.

Documents are dealt into blocks.  A block reduces its keys (shingles, words,
word pairs) to distinct ones and sends each shard of the key space one packed
array of those it owns; a shard sums up the arrays of all blocks and answers
each block with one packed array in the order that was asked.  A block then
meets its answers and its texts again.  Nothing is broadcast or collected, a
frequent key is one entry of each block whatever its count, and what is
shuffled is the texts, 4 bytes a distinct key of a block, and the answers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text for one block, and for one shard.
BLOCK_BYTES = 12 << 20


def distinct_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and copies: rows equal in both once, so that no block holds one
    document many times.  Texts are grouped only where an id repeats."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if base.groupBy("doc_id").count().where("count > 1").isEmpty():
        return base.withColumn("copies", F.lit(1).cast("long"))
    return base.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))


def parts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks (and shards) the documents make."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // block_bytes))


def block_of(n: int) -> Column:
    """The block of a document, by its id, length and beginning."""
    return F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 64)), F.lit(n)).cast("long")


#: Bytes of a key in a message.  A shard owns its part of the key space, about a million keys, so
#: one in some thousands shares them with another; their counts are added, and so never too low.
KEY_BYTES = 4


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys that count one first, then the others and their counts."""
    once = counts == 1
    short = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES :]
    return b"".join((np.uint32(once.sum()).tobytes(), short[once].tobytes(), short[~once].tobytes(), np.minimum(counts[~once], 0xFFFFFFFF).astype(np.uint32).tobytes()))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(shortened keys, counts)."""
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    m = (len(data) - 4 - KEY_BYTES * n) // (KEY_BYTES + 4)
    wide = np.zeros((n + m, 8), dtype=np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(data, np.uint8, KEY_BYTES * (n + m), 4).reshape(-1, KEY_BYTES)
    counts = np.ones(n + m, dtype=np.int64)
    counts[n:] = np.frombuffer(data, np.uint8, 4 * m, 4 + KEY_BYTES * (n + m)).view(np.uint32)
    return wide.view(np.uint64).ravel(), counts


def packed_order(counts: np.ndarray) -> np.ndarray:
    """Where pack() puts each key."""
    return np.argsort(counts != 1, kind="stable")


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, cuts) that group keys by shard, keeping their order otherwise."""
    shard = (keys >> np.uint64(8)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
