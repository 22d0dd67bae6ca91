"""Near duplicates (operator 8): DartMinHash signatures, banded joining, exact links.

*Signatures.* Every element (a shingle of five words) owns the region [0, weight) x [0, infinity)
of weight and rank. Darts fall into it at unit rate, at places given by hashes alone: in each unit
of weight the ranks are a sum of exponential steps, each dart has a position inside the unit and
one of k coordinates. A document keeps the earliest dart of every coordinate; two documents keep
the same one with the chance of their weighted Jaccard likeness. Only darts up to the rank
(k ln k + 3 k) / weight are thrown, about k ln k for any document; where a coordinate stays empty,
the bound is doubled. So a document costs its length plus k ln k, not length times k.

*Links.* Signatures are cut into bands; equal bands make buckets. All members of a bucket are
compared with its pivot, exactly, on their multisets. That connects most of a group of copies at
one comparison a member. Members that are then in another component than the pivot (strangers) are
compared, by signature and in blocks, with the whole bucket; pairs of different components whose
signatures agree in 0.8 less five standard deviations or more are tested exactly, in the first
bucket that they share. So no pair of a bucket is left out unless it is connected already or its
signatures rule it out. (New pivots for the strangers, round by round, connected 1 % of them in
four rounds on a large group of half-alike texts, at twice the time.)

*Classes.* Connected components by minimum labels over the links with pointer jumping; every step
is a join and a grouped minimum, written to the shared folder.

With 32 bands of 6 rows a pair of likeness 0.8 shares a bucket with a chance of 0.99994, one of
0.85 misses with less than 10^-6.

Edge cases: documents of equal word sequences are one class from the start (only the first goes
on), those without words (null, empty) too; fewer words than a shingle make one shingle of all
words; rows that share a doc_id, or have none, are documents of their own, one row each in the
result, whose class_id is the smallest doc_id of the class (null if none has one); ties are
copies; an empty table gives an empty result; extra columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantloom.llm.common import free_name, numbered, read, release, small_batches, written
from grantloom.llm.hashing import B1, C1, C2, copies_of, digests, mix, runs, word_hashes, words_of

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 6
#: About so many members of a bucket are compared with as many others at a time.
BLOCK = 64
#: Bits that tell which ids may be members, and how many of them a row holds.
BITS, ROW_BITS = 1 << 24, 32768
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, in order, and how often each occurs."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends = words_of(data)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    w = word_hashes(data, starts, ends, B1)
    return np.unique(mix(runs(w, min(n, len(w)), C1)), return_counts=True)


def throw(region: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dart ids, ranks, regions' places) of all darts up to rank ``bound``. A region's n-th dart
    is the hash of the region and n; the hash's upper bits give the step from the dart before."""
    if bound > 6:  # few regions, many darts each: a table of enough steps for all
        n = int(bound + 4 * np.sqrt(bound) + 4)
        while True:
            dart = mix(region[:, None] + np.arange(1, n + 1, dtype=np.uint64) * STEP)
            rank = np.cumsum(-np.log(uniform(dart)), axis=1)
            if (rank[:, -1] > bound).all():
                at, j = np.nonzero(rank <= bound)
                return dart[at, j], rank[at, j], at
            n *= 2
    ids, ranks, places = [], [], []
    at, rank, n = np.arange(len(region)), np.zeros(len(region)), np.uint64(0)
    while len(at):
        n += np.uint64(1)
        dart = mix(region[at] + np.full(1, n) * STEP)
        rank = rank - np.log(uniform(dart))
        due = rank <= bound
        at, rank, dart = at[due], rank[due], dart[due]
        ids.append(dart), ranks.append(rank), places.append(at)
    return np.concatenate(ids), np.concatenate(ranks), np.concatenate(places)


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def darts(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The k dart ids of a weighted set (uint64; all zero for an empty set)."""
    total = float(weights.sum())
    if not total > 0:
        return np.zeros(k, np.uint64)
    units = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), units)
    unit = np.arange(len(owner)) - np.repeat(np.cumsum(units) - units, units)
    room = np.minimum(weights[owner] - unit, 1.0)  # the part of the unit that is covered
    region = mix(elements[owner] + (unit + 1).astype(np.uint64) * C2)
    bound = k * (np.log(k) + 3) / total
    while True:
        dart, rank, at = throw(region, bound)
        if (room < 1).any():  # a dart's position inside its unit must be covered
            hit = uniform(mix(dart ^ C1)) < room[at]
            dart, rank = dart[hit], rank[hit]
        # the coordinate comes from the low bits, which the steps do not use
        c = ((dart & np.uint64(2047)) * np.uint64(k) >> np.uint64(11)).astype(np.int64)
        order = np.argsort(rank)[::-1]
        lead = np.full(k, -1)
        lead[c[order]] = order  # the earliest dart is written last
        if (lead >= 0).all():
            return dart[lead]
        bound *= 2


def bands_of(signature: np.ndarray, bands: int) -> np.ndarray:
    """One hash per band."""
    parts = signature.reshape(bands, -1)
    h = np.arange(bands, dtype=np.uint64)
    for c in range(parts.shape[1]):
        h = mix(h * B1 + parts[:, c])
    return h.view(np.int64)


def weighted(text: str, weighting: str) -> tuple[np.ndarray, np.ndarray]:
    s, n = shingles(text)
    return s, (n if weighting == "count" else np.ones(len(s))).astype(np.float64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weighting: str = "count") -> DataFrame:
    """(doc_id, bands array<long>, keys binary, sig binary) of documents with at least one word;
    ``keys`` holds the bands' hashes too, ``sig`` 16 bits of every coordinate's dart. Elements weigh
    as much as they occur (``count``) or one (``set``)."""

    def run(batches):
        for b in batches:
            ids, out, sig = [], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                s, w = weighted(t or "", weighting)
                if len(s):
                    k = darts(s, w, bands * rows)
                    ids.append(d), out.append(bands_of(k, bands)), sig.append((k >> np.uint64(40)).astype("<u2").tobytes())
            keys = pa.array([x.tobytes() for x in out], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64())), keys, pa.array(sig, pa.binary())], ["doc_id", "bands", "keys", "sig"])

    return docs.mapInArrow(run, "doc_id long, bands array<long>, keys binary, sig binary")


def sets_of(docs: DataFrame, weighting: str = "count") -> DataFrame:
    """(doc_id, items array<long>, packed binary): the shingles, or with ``count`` one item per
    occurrence, in order; ``packed`` holds the same numbers."""

    def run(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                s, w = weighted(t or "", weighting)
                n = w.astype(np.int64)
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out.append(np.sort(mix(np.repeat(s, n) + nth.astype(np.uint64) * C2).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int64())), pa.array([x.tobytes() for x in out], pa.binary())], ["doc_id", "items", "packed"])

    return docs.mapInArrow(run, "doc_id long, items array<long>, packed binary")


def likeness(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, j): exact Jaccard of each pair (a, b)."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("j"))


def components(links: DataFrame) -> DataFrame:
    """(doc_id, label) of all ends of the links (a, b): label is the smallest id of the component."""
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    n = edges.count()  # no fewer than ids
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("doc_id"), "label"), "labels", n)
    old = labels
    while True:
        # the least label among oneself and the neighbours, then that label's own label
        near = edges.join(labels.withColumnRenamed("doc_id", "a"), "a").groupBy("b").agg(F.min("label").alias("near"))
        least = labels.join(near.withColumnRenamed("b", "doc_id"), "doc_id").select("doc_id", "label", F.least("label", "near").alias("least"))
        jump = labels.select(F.col("doc_id").alias("least"), F.col("label").alias("up"))
        step = written(least.join(jump, "least").select("doc_id", "label", F.least("least", "up").alias("next")), "labels", n)
        release(old)
        old, labels = step, step.select("doc_id", F.col("next").alias("label"))
        if step.filter("next < label").isEmpty():
            release(edges)
            return labels


def order_of(doc_id: str) -> Column:
    """One order for all buckets: the same pivot serves many."""
    return F.struct(F.xxhash64(doc_id).alias("x"), F.col(doc_id).alias("d"))


def mixed_buckets(members: DataFrame, labels: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with labels, and (h, main, n) of the buckets whose members are in several
    components, ``main`` being that of the pivot. Buckets of two have been tested. A table, so that
    a large bucket's members can be split when they meet its row."""
    at = members.join(labels, "doc_id", "left").select("doc_id", "band", "h", F.coalesce("label", "doc_id").alias("label"))
    main = buckets.filter("n > 2").join(labels.withColumnRenamed("doc_id", "pivot"), "pivot", "left").select("h", "n", F.coalesce("label", "pivot").alias("main"))
    both = at.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").join(main, "h")
    return at, written(both.select("h", "main", "n"), "mixed")


def likely(df: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``df`` whose doc_id may be among the members: all that are and few others, so that these are not
    shuffled for the exact join that follows. Told by a bit per hashed id, 2 MB at most for any corpus; with
    more members than bits, more rows pass."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    split = [F.floor(place / ROW_BITS).alias("row"), (place % ROW_BITS).alias("bit")]
    marks = members.select(*split).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("bit") / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    marked = df.select("*", *split).join(F.broadcast(marks), "row").filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
    return marked.select(*df.columns)


def similar_links(first: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighting: str = "count") -> tuple[DataFrame, DataFrame]:
    """Links (a, b, j) between different texts, enough to connect all that are similar, and the
    components' labels (doc_id, label)."""
    with small_batches(first):
        signed = written(signatures(first, bands, rows, weighting), "bands")
    banded = signed.select("doc_id", F.posexplode("bands").alias("band", "h"))
    buckets = written(banded.groupBy("h").agg(F.min(order_of("doc_id"))["d"].alias("pivot"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    # merged at any size, as these tables grow with the corpus and a broadcast one passes through the driver
    # (and no semi-join, which Spark would put before the one that marks the likely rows)
    members = written(banded.join(buckets.select("h", "pivot").hint("merge"), "h"), "members")
    with small_batches(first):
        sets = written(sets_of(likely(first, members).join(members.select("doc_id").distinct().hint("merge"), "doc_id").select("doc_id", "text"), weighting), "sets")
    pairs = members.filter("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    links = written(likeness(pairs, sets).filter(F.col("j") >= threshold), "likeness")
    labels = components(links)
    at, mixed = mixed_buckets(members, labels, buckets)
    at = at.join(mixed, "h").withColumn("stranger", F.col("label") != F.col("main"))
    at = at.join(likely(signed, members).select("doc_id", "keys", "sig"), "doc_id").join(sets.select("doc_id", "packed"), "doc_id")
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BLOCK)).cast("int")
    blocks = at.groupBy("h", "stranger", part.alias("part")).agg(F.first("band").alias("band"), *[F.collect_list(c).alias(f"{c}s") for c in ("doc_id", "label", "keys", "sig", "packed")])
    blocks = written(blocks, "blocks")
    other = blocks.select("h", *[F.col(c).alias(f"{c}2") for c in blocks.columns[1:]])
    against = blocks.filter("stranger").join(other, "h").filter("not stranger2 or part2 >= part")
    with small_batches(first):
        fresh = written(resembling(against, threshold, bands, rows), "links")
    release(blocks, members, buckets, mixed)
    if not fresh.isEmpty():
        links, labels = links.union(fresh), joined_labels(labels, fresh)
    release(sets, signed)
    return links, labels


def resembling(blocks: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """(a, b, j): links between two blocks of a bucket, with different labels. Only pairs whose
    signatures agree in a share of coordinates at most five standard deviations below the
    threshold are tested, on their whole sets; each in the first band that it shares, so once."""
    k = bands * rows
    least = threshold - 5 * (threshold * (1 - threshold) / k) ** 0.5

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):  # one at a time: a row holds two blocks' sets
                r = batch.slice(row, 1).to_pylist()[0]
                x, y = (np.frombuffer(b"".join(r[c]), "<u2").reshape(-1, k) for c in ("sigs", "sigs2"))
                u, v = (np.frombuffer(b"".join(r[c]), np.int64).reshape(-1, bands) for c in ("keyss", "keyss2"))
                ids, ids2 = np.array(r["doc_ids"]), np.array(r["doc_ids2"])
                apart = np.array(r["labels"])[:, None] != np.array(r["labels2"])[None, :]
                same = np.empty((len(x), len(y), k), bool)
                np.equal(x[:, None, :], y[None, :, :], out=same)
                apart &= same.mean(axis=2) >= least
                i, j = np.nonzero(apart)
                here = (u[i] == v[j]).argmax(axis=1) == r["band"]
                sets, sets2 = ([np.frombuffer(v, np.int64) for v in r[c]] for c in ("packeds", "packeds2"))
                found = []
                for p, q in zip(i[here].tolist(), j[here].tolist(), strict=True):
                    both = len(np.intersect1d(sets[p], sets2[q], assume_unique=True))
                    like = both / (len(sets[p]) + len(sets2[q]) - both)
                    if like >= threshold:
                        found.append((min(int(ids[p]), int(ids2[q])), max(int(ids[p]), int(ids2[q])), like))
                a, b, v = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(v, pa.float64())], ["a", "b", "j"])

    columns = [f"{c}s{k}" for k in ("", "2") for c in ("doc_id", "label", "keys", "sig", "packed")]
    return blocks.select("band", *columns).mapInArrow(run, "a long, b long, j double")


def joined_labels(labels: DataFrame, fresh: DataFrame) -> DataFrame:
    """The labels after some more links: components of the links between labels, which are few,
    then put in the place of the labels they contain."""
    of = lambda c: labels.select(F.col("doc_id").alias(c), F.col("label").alias(f"l{c}"))
    between = fresh.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b")
    over = components(between)
    known = labels.join(over.select(F.col("doc_id").alias("label"), F.col("label").alias("top")), "label", "left").select("doc_id", F.coalesce("top", "label").alias("label"))
    return written(known.union(over.join(labels, "doc_id", "left_anti").select("doc_id", "label")), "labels")


def classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id): one row per input row; class_id is the smallest doc_id of the class."""
    docs, rows = numbered(docs)
    copies = copies_of(digests(docs))
    first = docs.join(copies, "doc_id", "left_anti")
    _, labels = similar_links(first, **options)
    ids = docs.select("doc_id").join(copies, "doc_id", "left").select("doc_id", F.coalesce("first", "doc_id").alias("first"))
    found = ids.join(labels.withColumnRenamed("doc_id", "first"), "first", "left").select("doc_id", F.coalesce("label", "first").alias("class_id"))
    if rows is None:
        return found
    found = written(rows.join(found.select(F.col("doc_id").alias("row"), F.col("class_id").alias("class")), "row"), "classes")
    least = found.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return found.join(least, "class").select("doc_id", "class_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs``, with all its columns, for each class: the one with the smallest doc_id,
    of equal ids the one whose text has the smallest hash."""
    row = free_name(docs, "row")
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        keyed = docs.withColumn(row, F.col("doc_id").cast("long"))
    else:
        keyed = written(docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).withColumn(row, F.monotonically_increasing_id()), "rows")
    stay = classes(keyed.select(F.col(row).alias("doc_id"), "text"), **options).filter("doc_id = class_id").select(F.col("doc_id").alias(row))
    return keyed.join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_minhash(spark, sf_dir):
    return classes(read(spark, sf_dir, "documents"))
