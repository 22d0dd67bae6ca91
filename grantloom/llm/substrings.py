r"""Substring dedup (operator 6) with a count-min prefilter.

A window is ``length`` consecutive words of one document. Words covered by a window whose word
sequence also starts earlier (smaller doc_id, or same document and earlier start) are removed.

1. *Scan.* Each window is counted under its anchor, the shingle of ``anchor`` words with the
   smallest hash inside it: equal windows have equal anchors, so an anchor's count is at least
   each of its windows' counts, while neighbouring windows share most anchors. A text's anchor
   hashes and the digest of its words are kept as a table; later steps take up the text again only
   where something repeats.
2. *Whole copies.* Documents of equal word sequences meet by digest; in all but the first, every
   word is covered by an earlier window (if there are ``length`` words at all). Only first ones
   go on.
3. *Sketch.* Each chunk of documents counts its anchors in the cells of a count-min sketch of
   ``ROWS`` rows. A chunk's sketch is sparse: the cells it touches, with their counts. Cells are cut
   into ranges, as many as the corpus asks for (``RANGE_LOAD`` anchors a range, ``RANGE_CELLS`` cells),
   so the sketch grows with the data and is held by no one as a whole. Chunks' sketches are merged
   range by range; each range tells each chunk which of its cells were counted twice or more, and
   how often. The least count of an anchor's cells overestimates and never underestimates.
4. *Exact pass.* Windows with an estimate below two cannot repeat. The others are ordered by a
   128-bit BLAKE2 digest of their words and by place; all but the first of a digest are later ones.
   Where the estimate exceeds ``HOT``, a digest's windows are dealt over as many groups as that asks
   for, and only the groups' first ones meet, so no common passage lands in one task. (The hashes of
   steps 1 and 3 may collide, on built texts too: equal windows have equal ones, which is all that
   a prefilter needs.)

Edge cases: null and empty texts have no words; texts with fewer words than a window keep all;
rows of one doc_id are documents of their own, in the order of their texts' hashes (of equal rows
all but one are whole copies), and a null doc_id comes before all others; an empty table gives an
empty result; extra columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantloom.llm.common import numbered, read, release, written
from grantloom.llm.hashing import B1, C1, C2, copies_of, digest, mix, runs, word_hashes, words_of

LENGTH, ANCHOR = 20, 8
ROWS, RANGE_LOAD, RANGE_CELLS = 2, 1 << 19, 1 << 23
#: About so many windows of one hash go to one group.
HOT = 2000


class Anchors:
    """The anchors of a text's windows: hash of each window's anchor and its place."""

    def __init__(self, text: str, length: int, anchor: int):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        self.data, (self.starts, self.ends) = data, words_of(data)
        self.words = word_hashes(data, self.starts, self.ends, B1)
        if len(self.starts) >= length:
            grams = mix(runs(self.words, anchor, C2))
            view = np.lib.stride_tricks.sliding_window_view(grams, length - anchor + 1)
            self.at = np.arange(len(view)) + view.argmin(axis=1)
            self.hashes = grams[self.at]
        else:
            self.at, self.hashes = np.empty(0, np.int64), np.empty(0, np.uint64)

    def places(self) -> np.ndarray:
        """One hash for each place of an anchor, whatever number of windows it serves."""
        return self.hashes[np.flatnonzero(np.diff(self.at, prepend=-1))]

    def windows(self, length: int, at: np.ndarray) -> np.ndarray:
        """A 128-bit digest of the words of each window that starts at one of ``at``, as two numbers."""
        line, size = b" ".join(self.data.tobytes().split()), self.ends - self.starts
        ends = np.cumsum(size + 1) - 1
        cuts = zip((ends - size)[at].tolist(), ends[at + length - 1].tolist(), strict=True)
        return np.frombuffer(b"".join([hashlib.blake2b(line[i:j], digest_size=16).digest() for i, j in cuts]), np.int64).reshape(-1, 2)


def scan(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(doc_id, words, n, anchors binary): digest and number of words, anchor hashes."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                w = (t or "").encode().split()
                rows.append((digest(w), len(w), Anchors(t or "", length, anchor).places().tobytes()))
            words, n, hashes = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "words", "n", "anchors"])

    return written(docs.mapInArrow(run, "doc_id long, words binary, n long, anchors binary"), "anchors")


def cells(h: np.ndarray, row: int, ranges: int) -> np.ndarray:
    """An anchor's cell in a row: (row and range) * 2^32 + cell."""
    x = mix(h + np.full(1, row + 1, np.uint64) * C1)
    part = (x >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    return part + np.uint64(row * ranges) << np.uint64(32) | x & np.uint64(RANGE_CELLS - 1)


def chunks_of(anchors: DataFrame) -> DataFrame:
    """(chunk, ids, sizes, anchors): documents by the batch, as packed arrays. Written, so that a
    chunk's name, which is random, stays."""

    def run(batches):
        for b in batches:
            a = b.column("anchors").to_pylist()
            ids = b.column("doc_id").to_numpy().tobytes()
            sizes = np.array([len(x) >> 3 for x in a], np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(os.urandom(7), "big")]), *[pa.array([x], pa.binary()) for x in (ids, sizes, b"".join(a))]], ["chunk", "ids", "sizes", "anchors"])

    return written(anchors.select("doc_id", "anchors").mapInArrow(run, "chunk long, ids binary, sizes binary, anchors binary"), "chunks")


def sketches(chunks: DataFrame, ranges: int) -> DataFrame:
    """(part, chunk, cells, counts): the chunks' sketches, by row and range."""

    def run(batches):
        for b in batches:
            for chunk, packed in zip(b.column("chunk").to_pylist(), b.column("anchors").to_pylist(), strict=True):
                out = []
                for r in range(ROWS):
                    c, n = np.unique(cells(np.frombuffer(packed, np.uint64), r, ranges), return_counts=True)
                    part, low = (c >> np.uint64(32)).astype(np.int32), c.astype(np.uint32)
                    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
                    for i, j in zip(cuts, [*cuts[1:], len(c)], strict=True):
                        out.append((int(part[i]), chunk, low[i:j].tobytes(), n[i:j].astype(np.uint32).tobytes()))
                p, k, c, n = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int64()), pa.array(c, pa.binary()), pa.array(n, pa.binary())], ["part", "chunk", "cells", "counts"])

    return chunks.select("chunk", "anchors").mapInArrow(run, "part int, chunk long, cells binary, counts binary")


def merge(key, table):
    """One range of one row: for each chunk the cells counted twice or more in all, and their
    counts. A group has about RANGE_LOAD cells, and one entry a chunk for a cell in common use."""
    c, n = ([np.frombuffer(x, np.uint32) for x in table.column(k).to_pylist()] for k in ("cells", "counts"))
    _, at = np.unique(np.concatenate(c), return_inverse=True)
    total = np.minimum(np.bincount(at, np.concatenate(n).astype(np.float64)), 2.0**32 - 1).astype(np.uint32)[at]
    out, i = [], 0
    for chunk, own in zip(table.column("chunk").to_pylist(), c, strict=True):
        mine = total[i : i + len(own)]
        i += len(own)
        if (again := mine >= 2).any():
            out.append((key[0].as_py(), chunk, own[again].tobytes(), mine[again].tobytes()))
    p, k, c, n = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"part": pa.array(p, pa.int32()), "chunk": pa.array(k, pa.int64()), "cells": pa.array(c, pa.binary()), "counts": pa.array(n, pa.binary())})


def estimated(chunks: DataFrame, answers: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, hashes, estimates): the anchors with an estimate of two or more, in order, of the
    documents that have any."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                h = np.frombuffer(r["anchors"], np.uint64)
                least = np.full(len(h), 2**32 - 1, np.uint32)
                told = sorted((a["part"], a["cells"], a["counts"]) for a in r["answers"])
                for row in range(ROWS):
                    mine = [x for x in told if x[0] // ranges == row]
                    at = np.concatenate([np.frombuffer(c, np.uint32).astype(np.uint64) | np.uint64(p << 32) for p, c, _ in mine] or [np.empty(0, np.uint64)])
                    n = np.concatenate([*[np.frombuffer(x, np.uint32) for _, _, x in mine], np.ones(1, np.uint32)])
                    c = cells(h, row, ranges)
                    k = np.searchsorted(at, c)
                    hit = np.append(at, np.uint64(2**64 - 1))[k] == c
                    least = np.minimum(least, np.where(hit, n[k], 1))
                keep = np.flatnonzero(least >= 2)
                owner = np.repeat(np.arange(len(r["ids"]) >> 3), np.frombuffer(r["sizes"], np.int32))[keep]
                order = np.lexsort((h[keep], owner))
                keep, owner = keep[order], owner[order]
                new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(h[keep].view(np.int64), prepend=0) != 0))  # distinct in a document
                keep, owner = keep[new], owner[new]
                cuts = np.flatnonzero(np.diff(owner, prepend=-1))
                ids = np.frombuffer(r["ids"], np.int64)[owner[cuts]]
                ends = [*cuts[1:].tolist(), len(keep)]
                out = [[x[keep[i:j]].tobytes() for i, j in zip(cuts.tolist(), ends, strict=False)] for x in (h, least)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(x, pa.binary()) for x in out]], ["doc_id", "hashes", "estimates"])

    return chunks.join(answers, "chunk").mapInArrow(run, "doc_id long, hashes binary, estimates binary")


def places(docs: DataFrame, repeats: DataFrame, length: int, anchor: int) -> DataFrame:
    """(h1, h2, deal, doc_id, start) of the windows whose anchors may repeat; ``deal`` is the group
    of a window with a common anchor, else -1."""

    def run(batches):
        for b in batches:
            for d, t, h, e in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "hashes", "estimates")), strict=True):
                w, h, e = Anchors(t or "", length, anchor), np.frombuffer(h, np.uint64), np.frombuffer(e, np.uint32)
                at = np.minimum(np.searchsorted(h, w.hashes), len(h) - 1)
                keep = np.flatnonzero(h[at] == w.hashes)
                groups = np.maximum(-(-e[at[keep]].astype(np.int64) // HOT), 1)
                deal = np.where(groups > 1, int(mix(np.array([d], np.int64).view(np.uint64))[0] >> np.uint64(1)) % groups, -1).astype(np.int32)
                for k in range(0, len(keep), 1 << 16):
                    i = keep[k : k + (1 << 16)]
                    h = w.windows(length, i)
                    yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(deal[k : k + (1 << 16)]), pa.array(np.full(len(i), d, np.int64)), pa.array(i.astype(np.int32))], ["h1", "h2", "deal", "doc_id", "start"])

    return docs.join(repeats, "doc_id").select("doc_id", "text", "hashes", "estimates").mapInArrow(run, "h1 long, h2 long, deal int, doc_id long, start int")


def repeats_of(anchors: DataFrame, copies: DataFrame) -> DataFrame:
    """Scan table to (doc_id, hashes, estimates), through the sketch; the scan table goes."""
    chunks = chunks_of(anchors.join(copies.select("doc_id"), "doc_id", "left_anti"))
    release(anchors)
    total = chunks.agg(F.sum(F.octet_length("anchors"))).first()[0] or 0
    ranges = max(4, -(-total // (8 * RANGE_LOAD)))
    answers = sketches(chunks, ranges).groupBy("part").applyInArrow(merge, "part int, chunk long, cells binary, counts binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "cells", "counts")).alias("answers"))  # no longer than the chunk
    out = written(estimated(chunks, answers, ranges), "repeats")
    release(chunks)
    return out


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): words left, joined by one space."""
    docs, rows = numbered(docs)
    anchors = scan(docs, length, anchor)
    copies = copies_of(anchors, length)
    found = places(docs, repeats_of(anchors, copies), length, anchor)
    order = Window.partitionBy("h1", "h2", "deal").orderBy("doc_id", "start")
    ranked = found.withColumn("k", F.row_number().over(order))
    tops = ranked.filter("if(deal >= 0, k, 0) = 1").withColumn("top", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("doc_id", "start")))
    later = ranked.filter("k > 1").select("doc_id", "start").union(tops.filter("top > 1").select("doc_id", "start"))
    starts = later.groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    marked = docs.join(starts, "doc_id", "left").join(copies.select("doc_id", F.lit(True).alias("copy")), "doc_id", "left")

    def cut(batches):
        for b in batches:
            ids, total, gone, kept = [], [], [], []
            for d, t, s, copy in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "starts", "copy")), strict=True):
                w = (t or "").encode().split()
                left = w
                if copy:
                    left = []
                elif s:
                    edge = np.zeros(len(w) + 1, np.int32)
                    np.add.at(edge, np.array(s), 1)
                    np.add.at(edge, np.array(s) + length, -1)
                    left = [w[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                ids.append(d), total.append(len(w)), gone.append(len(w) - len(left)), kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    out = marked.select("doc_id", "text", "starts", "copy").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
    return out if rows is None else rows.join(out.withColumnRenamed("doc_id", "row"), "row").drop("row")


def op6_substring_dedup(spark, sf_dir):
    out = dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
