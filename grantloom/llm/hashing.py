"""Vectorised hashes of words and word runs, and whole copies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.llm.common import release, small_batches, written

B1, B2, C1, C2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, xor, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


KEPT: dict[int, np.ndarray] = {}


def powers(b: np.uint64, n: int) -> np.ndarray:
    """b^0 .. b^n or further, modulo 2^64; tables of up to 2^18 powers are kept."""
    if (table := KEPT.get(int(b))) is None or len(table) <= n:
        size = 1 << max(12, int(n).bit_length())
        table = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b)]), dtype=np.uint64)
        if size <= 1 << 18:
            KEPT[int(b)] = table
    return table


@lru_cache
def inverse(b: int) -> np.uint64:
    return np.uint64(pow(int(b), -1, 1 << 64))


def runs(values: np.ndarray, n: int, b: np.uint64) -> np.ndarray:
    """Polynomial hash of every ``n`` consecutive ``values``, modulo 2^64 (b is odd, so the
    position's power can be divided out)."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    up, down = powers(b, len(values)), powers(inverse(b), len(values))
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return (total[n:] - total[:-n]) * down[: len(values) - n + 1]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes; separators are the space and bytes 9 to 13."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, b: np.uint64) -> np.ndarray:
    up, down = powers(b, len(data)), powers(inverse(b), len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def digest(words: list[bytes]) -> bytes:
    """128 bits of a word sequence."""
    return hashlib.sha256(b" ".join(words)).digest()[:16]


def text_digest(text: str | None) -> tuple[bytes, int]:
    """Digest and length of a text's word sequence."""
    words = (text or "").encode().split()
    return digest(words), len(words)


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [text_digest(t.as_py()) for t in b.column("text")]  # the words of one text at a time
        found = [pa.array([d for d, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *found], ["doc_id", "words", "n"])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, words, n): digest and length of each document's word sequence, as a table."""
    with small_batches(docs):
        return written(docs.mapInArrow(digest_batches, "doc_id long, words binary, n long"), "digests")


def copies_of(keys: DataFrame, least: int = 0) -> DataFrame:
    """(doc_id, first) of documents whose word sequence an earlier doc_id has too, among those of
    ``least`` words or more; ``keys`` has (doc_id, words, n). The first ones are a table of their
    own, so that a large group's rows can be split when they meet theirs."""
    keys = keys.filter(F.col("n") >= least).select("doc_id", "words")
    firsts = written(keys.groupBy("words").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("words", "first"), "firsts")
    copies = written(keys.join(firsts, "words").filter("doc_id > first").select("doc_id", "first"), "copies")
    release(firsts)
    return copies
