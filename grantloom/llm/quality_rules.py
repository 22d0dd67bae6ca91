r"""Quality rules (operator 9, DataFrame functions only): a rule bitmask ledger.

Every rule is evaluated once per document. Its failure becomes one bit of a long, its
measurements are kept beside it; policies (versioned bit masks) and ablations then work on the
ledger alone, by bitwise arithmetic, without the texts.

Edge cases: a null or empty text has no words and fails ``few_words``; repeated rows are judged
one by one; an empty table gives an empty ledger; extra columns of the input, whatever their
names, are neither read nor returned by :func:`ledger`, and :func:`apply_policy` keeps them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantloom.llm.common import NOT_WS, WS, documents, free_name, read

#: (name, SQL condition over the measurements): the place in this list is the rule's bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "4 * n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("shouting", "3 * n_exclaims > n_words"),
    ("odd_word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
]

#: Versioned policies: a document is rejected if a rule of its policy's list failed.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_phrases"],
    "v1": [name for name, _ in RULES],
}
#: Up to so many repeated windows of a document are looked up one by one, more are sorted: the
#: same result either way.
FEW = 40
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims"]


def mask(rules: list[str]) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def measure(df: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``df`` with one column for each of MEASURES, and the names of these columns.

    Words in repeated three-word windows: equal neighbours among the sorted window hashes are the
    repeated ones. Where these are few, the windows are looked up in their list, else (hash,
    position) pairs are sorted; either way in the order of n log n. Flagged starts in order then
    cover ``min(3, distance to the next)`` words each. Every intermediate is a column of its own, so
    that Catalyst, which does not inline dear expressions used twice, computes it once; the
    measurements leave through a generator of one row, across which no filter, join or aggregate
    above is pushed, as that would copy their expressions into each other.
    """
    own = [F.col(f"`{c}`") for c in df.columns]
    names = {m: free_name(df, m) for m in MEASURES}
    w, g, s, d, ls = (free_name(df, f"tmp_{x}") for x in ("words", "grams", "sorted", "twice", "lines"))
    t = f"coalesce(`{text}`, '')"
    df = df.withColumn(w, F.expr(rf"filter(split({t}, r'{WS}+'), x -> x != '')"))
    df = df.withColumn(s, F.expr(f"transform({w}, x -> xxhash64(x))"))
    df = df.withColumn(g, F.expr(f"case when size({w}) >= 4 then transform(sequence(0, size({w}) - 3), i -> xxhash64({s}[i], {s}[i + 1], {s}[i + 2])) else cast(array() as array<bigint>) end"))
    df = df.withColumn(s, F.expr(f"sort_array({g})"))
    df = df.withColumn(d, F.expr(f"array_distinct(filter({s}, (x, i) -> i > 0 and {s}[i - 1] = x))"))
    df = df.withColumn(s, F.expr(f"case when size({d}) > {FEW} then sort_array(transform({g}, (h, i) -> struct(h, i))) end"))
    many = f"""sort_array(transform(filter(transform({s}, (x, k) ->
              struct(x.i as i, (k > 0 and {s}[k - 1].h = x.h) or (k < size({s}) - 1 and {s}[k + 1].h = x.h) as hit)), x -> x.hit), x -> x.i))"""
    few = f"filter(transform({g}, (x, i) -> case when array_contains({d}, x) then i else -1 end), i -> i >= 0)"
    df = df.withColumn(g, F.expr(f"case when size({d}) > {FEW} then {many} when size({d}) > 0 then {few} end"))
    df = df.withColumn(ls, F.expr(rf"filter(split({t}, '\n'), l -> l rlike r'{NOT_WS}')"))
    sql = {
        "n_words": f"size({w})",
        "word_chars": f"aggregate({w}, 0L, (a, x) -> a + length(x))",
        "n_symbols": f"length({t}) - length(regexp_replace({t}, r'[#*$%&|<>]', ''))",
        "n_lines": f"size({ls})",
        "n_dup_lines": f"size({ls}) - size(array_distinct({ls}))",
        "n_repeat_words": f"case when {g} is null then 0L else aggregate(transform({g}, (x, k) -> case when k < size({g}) - 1 then least(3, {g}[k + 1] - x) else 3 end), 0L, (a, x) -> a + x) end",
        "n_exclaims": f"length({t}) - length(replace({t}, '!', ''))",
    }
    df = df.select(*own, *[F.expr(f"cast({sql[m]} as bigint)").alias(names[m]) for m in MEASURES])
    row = F.inline(F.array(F.struct(*[F.col(names[m]).alias(f"of_{names[m]}") for m in MEASURES])))
    df = df.select(*own, row)
    return df.select(*own, *[F.col(f"of_{names[m]}").alias(names[m]) for m in MEASURES]), [names[m] for m in MEASURES]


def bits_of(names: list[str]) -> Column:
    """All rules' failure bits over the measurement columns ``names``, in the order of MEASURES."""
    at, out = dict(zip(MEASURES, names, strict=True)), F.lit(0).cast("long")
    for k, (_, rule) in enumerate(RULES):
        out = out.bitwiseOR(F.when(F.expr(re.sub(r"[a-z_]+", lambda m: f"`{at[m[0]]}`" if m[0] in at else m[0], rule)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, bits): one row per input row."""
    df, names = measure(documents(docs))
    return df.select("doc_id", *names, bits_of(names).alias("bits"))


def verdict(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def apply_policy(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the policy keeps."""
    df, names = measure(docs)
    bits = free_name(df, "bits")
    led = df.withColumn(bits, bits_of(names))
    return led.filter(verdict(F.col(bits), policy)).select(*[F.col(f"`{c}`") for c in docs.columns])


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, n_failed, n_only): documents failing each rule, and those it alone rejects.
    Rows first meet as counts per bit pattern, of which there are at most 2^rules."""
    rules, m = POLICIES[policy], mask(POLICIES[policy])
    by = led.groupBy(F.col("bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in rules]))
    by = by.select("bits", "n", each.alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return by.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op9_quality_rules(spark, sf_dir):
    led = ledger(read(spark, sf_dir, "documents"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict(F.col("bits"), "base")).alias("base_failed"), verdict(F.col("bits"), "v1").alias("kept"), "bits",
    )


OP9_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
u as (select doc_id, unnest(ws) as x, generate_subscripts(ws, 1) as i from w),
g as (select doc_id, i, x || ' ' || lead(x, 1) over (partition by doc_id order by i) || ' ' || lead(x, 2) over (partition by doc_id order by i) as gram from u),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g where gram is not null) where n >= 2),
c as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from r) group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(ls)::bigint as n_lines,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
        (length(t) - length(replace(t, '!', '')))::bigint as n_exclaims
      from w left join c using (doc_id)),
b as (select *, (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
        + (case when 4 * n_symbols > n_words then 4 else 0 end) + (case when n_lines >= 4 and 2 * n_dup_lines > n_lines then 8 else 0 end)
        + (case when 3 * n_exclaims > n_words then 16 else 0 end)
        + (case when n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words) then 32 else 0 end) as bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 as base_failed, bits = 0 as kept, bits::bigint as bits from b
"""
