"""A Bloom filter over a DataFrame's keys, built where they lie and bounded by its bits.

It lets a scan drop rows that can't have a partner before anything is shuffled. False positives
cost work, never results: an exact join follows. When keys outgrow the bits it passes everything.
A key's bits lie in one block of BLOCK bits, and keys are dealt by block: each block is made once, by one task, so
that what is sent follows the filter's size, whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import lean, stage

#: log2 of the bits, by the number of keys: 32 MB at most, to the driver and to each executor.
LEAST_BITS, MOST_BITS = 16, 28
BITS_A_KEY = 12
HASHES = 3
#: log2 of a block's bits.
BLOCK = 10
_WORDS = 1 << (BLOCK - 6)
_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def hashed(keys: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64() gives for longs, unsigned."""
    p1, p2, p3, p4, p5 = _PRIMES
    x = keys.view(np.uint64) * p2
    x = ((x << np.uint64(31)) | (x >> np.uint64(33))) * p1
    x ^= np.uint64(42) + p5 + np.uint64(8)
    x = ((x << np.uint64(27)) | (x >> np.uint64(37))) * p1 + p4
    x = (x ^ (x >> np.uint64(33))) * p2
    x = (x ^ (x >> np.uint64(29))) * p3
    return x ^ (x >> np.uint64(32))


def places(keys: np.ndarray, log_bits: int) -> Iterator[np.ndarray]:
    """The upper bits of the hash name the block, stretches of the lower ones the places in it."""
    h = hashed(keys)
    block = h >> np.uint64(64 - (log_bits - BLOCK)) << np.uint64(BLOCK)
    for i in range(HASHES):
        yield block | (h >> np.uint64(BLOCK * i) & np.uint64((1 << BLOCK) - 1))


def blocks(keys: DataFrame, log_bits: int) -> DataFrame:
    """(block, bits): the blocks that have keys, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, met = np.zeros(1 << (log_bits - 6), np.uint64), np.zeros(1 << (log_bits - BLOCK), bool)
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for p in places(k, log_bits):
                np.bitwise_or.at(bits, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
            met[(p >> np.uint64(BLOCK)).astype(np.int64)] = True
        at = np.flatnonzero(met)
        for a in range(0, len(at), 1 << 12):
            part = at[a : a + (1 << 12)]
            raw = pa.py_buffer(bits.reshape(-1, _WORDS)[part].tobytes())
            ends = pa.py_buffer(np.arange(len(part) + 1, dtype=np.int32) * (8 * _WORDS))
            yield pa.record_batch({"block": pa.array(part, pa.int64()), "bits": pa.Array.from_buffers(pa.binary(), len(part), [None, ends, raw])})

    (key,) = keys.columns
    dealt = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key))
    dealt = dealt.repartition(F.shiftrightunsigned(F.xxhash64(key), 64 - (log_bits - BLOCK)))
    return dealt.mapInArrow(lean(run), "block long, bits binary")


def build(keys: DataFrame, log_bits: int | None = None):
    """The broadcast bits of the one long column of keys, which is staged; nulls are ignored."""
    keys = stage(keys, "bloom-keys")
    if log_bits is None:
        log_bits = min(MOST_BITS, max(LEAST_BITS, (keys.count() * BITS_A_KEY).bit_length()))
    got = blocks(keys, log_bits).toArrow()
    bits = np.zeros(1 << (log_bits - 6), np.uint64)
    for batch in got.to_batches():
        if batch.num_rows:
            raw = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64)
            bits.reshape(-1, _WORDS)[batch.column("block").to_numpy()] = raw.reshape(-1, _WORDS)
    del got
    return keys.sparkSession.sparkContext.broadcast(bits)


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for p in places(keys, 6 + int(len(bits)).bit_length() - 1):
        found &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def may_contain(shared, key: Column) -> Column:
    """Whether a long column may be among the keys; never false for one that is."""

    @F.arrow_udf("boolean")
    def asked(keys: pa.Array) -> pa.Array:
        return pa.array(among(shared.value, keys.to_numpy(zero_copy_only=False).astype(np.int64)))

    return asked(key)
