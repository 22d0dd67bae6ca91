r"""Embedding near-duplicates (operator 13): Euclidean p-stable hashing, exact cosine checks.

1. *Copies.* Vectors of equal label and components are one from here on (a narrow grouping by
   digest), with a count, so a group of exact copies is one row whatever its size.
2. *Tables.* A vector of length one falls, in each of T tables, into the cell of K projections on
   normal random directions, shifted and cut at steps of ``WIDTH`` times the distance at the
   threshold. Two vectors at the threshold share a cell of one projection with chance ``NEAR``, right-angled
   ones with ``FAR``. K follows from the number of vectors, so that those of one cell by chance stay
   about one; T follows from K, so that a pair at the threshold is missed with a chance of ``MISS`` (closer
   ones far less often). Label and number of components are part of the cell's name.
3. *Links.* Cells with several members are cut into blocks, and each block meets each other block of
   its cell (``BLOCK`` rows each, so a crowded cell is many small tasks): a matrix product gives all
   cosines in double precision. A pair counts in the first table that it shares, so once. A block
   pair returns a count per row and enough edges to connect what it links, never the pairs.
   Hashes are integer arithmetic below 2^53, so every task finds the same cells.
4. *Components* by minimum labels with pointer jumping, as for near-duplicate texts.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and those
with a null label, link with nothing and are kept (component_id is their own vec_id); vectors of
different length never link; rows with a repeated or null vec_id are vectors of their own, whose
component_id is the smallest vec_id of the component (null if it has none), and of which one row
per component is kept; an empty table gives an empty result; extra columns are neither read nor
returned.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.llm.common import read, release, small_batches, written
from grantloom.llm.hashing import B1, C1, mix
from grantloom.llm.near_dups import components

THRESHOLD, BLOCK, MISS, SEED = 0.98, 256, 1e-4, 13
#: A cell's width in distances at the threshold, and the cells' resolution.
WIDTH, FINE, FINER = 8.0, 1 << 20, 1 << 10


def collision(ratio: float) -> float:
    """Chance that two points share a cell of a projection, ``ratio`` being its width over their distance."""
    outside = math.erfc(ratio / math.sqrt(2)) / 2
    return 1 - 2 * outside - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def sizes(vectors: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(K, T) for so many vectors."""
    apart = math.sqrt(2 - 2 * threshold)
    near, far = collision(WIDTH), collision(WIDTH * apart / math.sqrt(2))
    k = max(8, math.ceil(math.log(max(vectors, 2)) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


@lru_cache
def directions(dims: int, number: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Rounded normal directions and shifts; the same in every task."""
    rng = np.random.default_rng([SEED, dims, number])
    a = np.rint(rng.standard_normal((dims, number)) * FINER)
    return a, np.floor(rng.random(number) * width * FINE * FINER)


def units(rows: list, dims: int) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(len(rows), dims)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)  # so that squares stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(x: np.ndarray, k: int, tables: int, threshold: float) -> np.ndarray:
    """(rows, tables) of 64-bit names of the cells of unit vectors."""
    width = WIDTH * math.sqrt(2 - 2 * threshold)
    a, b = directions(x.shape[1], k * tables, width)
    at = np.floor((np.rint(x * FINE) @ a + b) / (width * FINE * FINER)).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    h = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64) * C1, (len(x), tables))
    for j in range(k):
        h = mix(h * B1 + at[:, :, j])
    return h


def usable(v) -> bool:
    return bool(v) and None not in v and all(map(math.isfinite, v)) and any(v)


def by_length(vectors: list) -> list[tuple[int, list[int]]]:
    """(dims, places) of vectors of one length."""
    found: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        found.setdefault(len(v), []).append(i)
    return sorted(found.items())


def digests(rows: DataFrame) -> DataFrame:
    """(row, digest) of the vectors that may link."""

    def run(batches):
        for b in batches:
            ids, out = [], []
            for r, label, v in zip(*(b.column(c).to_pylist() for c in ("row", "label", "embedding")), strict=True):
                if usable(v):
                    ids.append(r)
                    out.append(hashlib.sha256(label.encode() + b"\0" + (np.array(v, np.float64) + 0.0).tobytes()).digest()[:16])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["row", "digest"])

    return rows.filter("label is not null").mapInArrow(run, "row long, digest binary")


def hashed(vectors: DataFrame, k: int, tables: int, threshold: float) -> DataFrame:
    """(h, t, row): the cell of every vector in every table."""

    def run(batches):
        for b in batches:
            ids, labels, rows = (b.column(c).to_pylist() for c in ("row", "label", "embedding"))
            for dims, at in by_length(rows):
                for i in range(0, len(at), 4096):
                    some = at[i : i + 4096]
                    own = np.array([int.from_bytes(hashlib.sha256(f"{dims}:{labels[j]}".encode()).digest()[:8], "big") for j in some], np.uint64)
                    h = mix(cells(units([rows[j] for j in some], dims), k, tables, threshold) + own[:, None])
                    ts = np.tile(np.arange(tables, dtype=np.int32), len(some))
                    yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(ts), pa.array(np.repeat(np.array([ids[j] for j in some], np.int64), tables))], ["h", "t", "row"])

    return vectors.mapInArrow(run, "h long, t int, row long")


def blocks_of(vectors: DataFrame, k: int, tables: int, threshold: float) -> DataFrame:
    """(h, part, t, rows, labels, ns, vectors): the members of cells that hold several, in blocks."""
    every = hashed(vectors, k, tables, threshold)
    crowded = every.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(every.join(crowded, "h").select("h", "t", "row", F.expr(f"cast(pmod(xxhash64(row), ceil(size / {BLOCK})) as int)").alias("part")), "members")
    full = members.join(vectors, "row")
    lists = [F.first("t").alias("t"), *[F.collect_list(c).alias(f"{c}s") for c in ("row", "label", "n", "embedding")]]  # about BLOCK rows
    out = written(full.groupBy("h", "part").agg(*lists), "blocks")
    release(members)
    return out


def linked(pairs: DataFrame, k: int, tables: int, threshold: float) -> DataFrame:
    """(row, other, n) of pairs of blocks: for each row the number of vectors it links with there,
    and edges to ``other`` (n is 0) that connect what is linked."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: a row holds two blocks' vectors
                part, part2 = (batch.column(c)[i].as_py() for c in ("part", "part2"))
                alone = part == part2  # a block and itself
                own = lambda c: [batch.column(x)[i].values for x in ([c] if alone else [c, f"{c}2"])]  # noqa: B023, E731
                vectors = own("embeddings")
                second = np.arange(sum(map(len, vectors))) >= len(vectors[0])
                alike = []
                for at, x in stacked(vectors):
                    a, b = np.flatnonzero(~second[at]), np.flatnonzero(second[at] | alone)
                    p, q = np.nonzero(x[a] @ x[b].T >= threshold)
                    if len(p) > alone * len(at):  # a vector is alike itself
                        alike.append((at, x, a[p], b[q]))
                if not alike:
                    continue
                ids, n = (np.concatenate([x.to_numpy() for x in own(c)]) for c in ("rows", "ns"))
                labels, t = np.array([x for y in own("labels") for x in y.to_pylist()], object), batch.column("t")[i].as_py()
                rows, others, counts = [], [], []
                for at, x, p, q in alike:
                    keep = labels[at[p]] == labels[at[q]]
                    if alone:
                        keep &= p < q
                    p, q = p[keep], q[keep]
                    if len(p):
                        used, back = np.unique(np.concatenate([p, q]), return_inverse=True)
                        c = cells(x[used], k, tables, threshold)
                        p_at, q_at = back[: len(p)], back[len(p) :]
                        here = np.concatenate([(c[p_at[s : s + 4096]] == c[q_at[s : s + 4096]]).argmax(axis=1) == t for s in range(0, len(p), 4096)])
                        p, q = at[p[here]], at[q[here]]
                    total = np.zeros(len(ids), np.int64)
                    np.add.at(total, p, n[q]), np.add.at(total, q, n[p])
                    some = np.flatnonzero(total)
                    forest = edges(p, q)
                    rows += [ids[some], ids[forest[0]]]
                    others += [np.full(len(some), -1), ids[forest[1]]]
                    counts += [total[some], np.zeros(len(forest[0]), np.int64)]
                rows, others, counts = (np.concatenate(c) for c in (rows, others, counts))
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(others, mask=counts > 0), pa.array(counts)], ["row", "other", "n"])

    return pairs.mapInArrow(run, "row long, other long, n long")


def stacked(vectors: list[pa.ListArray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the vectors of one length, for every length."""
    size = np.concatenate([v.value_lengths().to_numpy() for v in vectors])
    flat = np.concatenate([v.flatten().to_numpy() for v in vectors])
    start = np.cumsum(size) - size
    out = []
    for dims in np.unique(size).tolist():
        at = np.flatnonzero(size == dims)
        out.append((at, units(flat[start[at][:, None] + np.arange(dims)], dims)))
    return out


def edges(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (p, q)."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    keep = []
    for i, (a, b) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
        if (a := top(a)) != (b := top(b)):
            up[a] = b
            keep.append(i)
    return p[keep], q[keep]


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    plain = rows.groupBy("vec_id").count().filter("vec_id is null or count > 1").isEmpty()
    if plain:
        rows = rows.withColumn("row", F.col("vec_id"))
    else:
        rows = written(rows.orderBy(F.col("vec_id").asc_nulls_last(), F.xxhash64("label", "embedding")).withColumn("row", F.monotonically_increasing_id()), "rows")
    keys = written(digests(rows), "digests")
    copied = written(keys.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1"), "copied")
    copies = written(keys.join(copied, "digest").select("row", "first", "n"), "copies")
    vectors = rows.join(keys.select("row"), "row", "left_semi").join(copies, "row", "left").filter("first is null or first = row")
    vectors = vectors.select("row", "label", F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.col("embedding"))
    k, tables = sizes(keys.count(), threshold)
    blocks = blocks_of(vectors, k, tables, threshold)
    other = blocks.select("h", *[F.col(c).alias(f"{c}2") for c in ("part", "rows", "labels", "ns", "embeddings")])
    with small_batches(rows):
        found = written(linked(blocks.join(other, "h").filter("part2 >= part"), k, tables, threshold), "links")
    release(blocks)
    labels = components(found.filter("other is not null").select(F.col("row").alias("a"), F.col("other").alias("b")))
    links = found.filter("other is null").groupBy("row").agg(F.sum("n").alias("links"))
    ids = rows.select("row", "vec_id").join(copies, "row", "left").select("row", "vec_id", F.coalesce("first", "row").alias("first"), F.coalesce(F.col("n") - 1, F.lit(0)).alias("twins"))
    out = ids.join(links.withColumnRenamed("row", "first"), "first", "left").join(labels.withColumnRenamed("doc_id", "first"), "first", "left")
    out = out.select("row", "vec_id", (F.col("twins") + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("label", "first").alias("component"))
    if plain:
        return out.select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
    # rows are numbered by vec_id, so a component's first row has its smallest vec_id
    out = written(out, "linked")
    heads = out.filter("row = component").select("component", F.col("vec_id").alias("component_id"))
    return out.join(heads, "component").select("vec_id", "n_links", "component_id", (F.col("row") == F.col("component")).alias("kept"))


def op13_embedding_near_dups(spark, sf_dir):
    return near_vectors(read(spark, sf_dir, "embeddings"))
