r"""Document fingerprints (operator 1, DataFrame functions only): I-Match.

Terms of a document are kept if their document frequency lies in a band (neither everywhere nor
nearly unique), distinct ones are sorted, and those in each of several randomised lexicon subsets
are hashed. The subsets keep one term in 8, 32, 128 or 512 of the lexicon, so that short
and long texts both have subsets that a change leaves alone. A fingerprint is four hex digits per
subset (``----`` if no term is in it); the likeness of two is the share of equal ones among the
subsets that either has.

The lexicon is exact over all documents. Its size is bounded by the data's shape, not by its
amount: with a least frequency of ``low`` there are at most (mean distinct terms of a document) /
``low`` terms, about 50,000 here; it goes into the plan as a hash table of that size.

The edited text of a document needs the next document. Documents are cut into ranges of doc_id at
quantiles; the first document of each range is also sent to the range before it; then the next
one is the next row of the same range. Texts are shuffled once.

Edge cases: null texts count as empty; empty texts and texts without any lexicon term have only
the hash of their sorted terms (likeness 1 if equal, else 0); rows of one doc_id are ordered by
their text's hash and each counts as a document; an empty table gives an empty result; extra
columns are neither read nor returned.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantloom.llm.common import documents, read

LOW, HIGH = 0.005, 0.2
#: One entry per lexicon subset: it keeps one term in so many.
KEEP_ONE_IN = [8] * 4 + [32] * 5 + [128] * 8 + [512] * 14
SLOTS = 1 << 14
ROWS_PER_RANGE = 2000
TERMS = r"array_distinct(split(lower({t}), r'[\s\p{{Punct}}]+'))"


def terms(t: str) -> str:
    return TERMS.format(t=t)


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, df) of the terms whose share of all documents lies in [low, high]."""
    n = docs.count()
    each = docs.select(F.explode(F.expr(terms("text"))).alias("term")).filter("term <> ''")
    return each.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df").between(low * n, high * n))


def table_of(lex: DataFrame) -> Column:
    """The lexicon as a literal: an array of SLOTS arrays of (t, m), where bit k of m tells
    whether term t is in subset k."""
    member = [F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(one)) == 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, one in enumerate(KEEP_ONE_IN)]
    rows = lex.select("term", F.pmod(F.xxhash64("term"), F.lit(SLOTS)).alias("slot"), sum(member[1:], member[0]).alias("mask")).collect()  # bounded, see above
    slots: list[list[dict]] = [[] for _ in range(SLOTS)]
    for r in sorted(rows):
        slots[r["slot"]].append({"t": r["term"], "m": r["mask"]})
    return F.from_json(F.lit(json.dumps(slots)), "array<array<struct<t:string,m:int>>>")


def with_fingerprint(df: DataFrame, text: str, out: str, table: Column) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as ``out``."""
    w, f = f"{out}_terms", f"{out}_found"
    df = df.withColumn(w, F.expr(terms(f"`{text}`")))
    # compared with nothing but the few terms of the same slot
    found = F.flatten(F.transform(w, lambda x: F.filter(F.get(table, F.pmod(F.xxhash64(x), F.lit(SLOTS)).cast("int")), lambda e: e["t"] == x)))
    df = df.withColumn(f, F.sort_array(found))
    part = f"filter(`{f}`, e -> (e.m & shiftleft(1, k)) <> 0)"
    parts = f"array_join(transform(sequence(0, {len(KEEP_ONE_IN) - 1}), k -> case when exists(`{f}`, e -> (e.m & shiftleft(1, k)) <> 0) then lpad(lower(hex(pmod(xxhash64(array_join(transform({part}, e -> e.t), ' ')), 65536))), 4, '0') else '----' end), '')"
    rest = f"case when size(`{f}`) = 0 then lower(hex(xxhash64(array_join(sort_array(`{w}`), ' ')))) else '' end"
    return df.withColumn(out, F.expr(f"concat({parts}, {rest})")).drop(w, f)


def likeness(a: str, b: str) -> Column:
    """0 to 1: the share of equal parts among the subsets that either fingerprint has."""
    n = len(KEEP_ONE_IN)
    at = lambda c: f"substring(`{c}`, 1 + 4 * k, 4)"
    either = f"size(filter(sequence(0, {n - 1}), k -> {at(a)} <> '----' or {at(b)} <> '----'))"
    same = f"size(filter(sequence(0, {n - 1}), k -> {at(a)} <> '----' and {at(a)} = {at(b)}))"
    return F.expr(f"case when `{a}` = `{b}` then 1.0D when {either} = 0 then 0.0D else cast({same} as double) / {either} end")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, ...) with next_<c> for each c of ``columns``, of the next document
    by descending doc_id; after the last comes the first."""
    n = docs.count()
    ranges = max(1, min(1 << 16, n // ROWS_PER_RANGE))
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges)}) if ranges > 1 else []
    bounds = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    placed = docs.withColumn("range", F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))))
    tops = placed.groupBy("range").agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("range")).collect()  # a row per range
    # the first document of a range follows the last one of the range above it
    sent = [(r["doc_id"], tops[i - 1]["range"]) for i, r in enumerate(tops)]
    extra = F.broadcast(docs.sparkSession.createDataFrame(sent, "doc_id long, to int"))
    both = placed.join(extra, "doc_id", "left").withColumn(
        "at", F.explode(F.expr("case when to is null then array(named_struct('r', range, 'again', false)) else array(named_struct('r', range, 'again', false), named_struct('r', to, 'again', true)) end"))
    )
    both = both.select(*docs.columns, F.col("at.r").alias("range"), F.col("at.again").alias("again"))
    w = Window.partitionBy("range").orderBy("again", F.desc("doc_id"), F.xxhash64("text"))
    return both.select(*docs.columns, "again", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).filter("not again").drop("again")


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, fingerprint) of whole texts."""
    docs = documents(docs)
    return with_fingerprint(docs, "text", "fingerprint", table_of(lexicon(docs, low, high))).select("doc_id", "fingerprint")


def edited(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of the texts, of their edited forms, and how alike these and the next
    document's are."""
    docs = documents(docs)
    table = table_of(lexicon(docs, low, high))
    df = with_next(with_fingerprint(docs, "text", "fingerprint", table), ["text", "fingerprint"])
    df = df.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.expr("cast(n_chars div 2 as int)"))
    df = df.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", F.expr("concat(substring(text, 1, cast(n_chars as int) - half), substring(next_text, 1, half))").alias("edited"))
    df = with_fingerprint(df, "edited", "edited_fingerprint", table)
    return df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op1_imatch(spark, sf_dir):
    return edited(read(spark, sf_dir, "documents"))
