r"""Source divergence audit (operator 11): one-hot level products price every pair of sources.

A term is a run of letters (A-Z lower-cased, all non-ASCII letters as they are). Each language keeps
the terms found in ``least`` of its documents or more. A group (language and source), and the
language as a whole, gives each kept term a smoothed share p = 1 + floor(SCALE * (count + 2) /
(N + 2 V)); two shares differ by f = floor((p - q)^2 / (p + q)). All of it is integer arithmetic.

1. *Counts.* Tasks count terms per group in tables of bounded size and hand on one row per group
   and term, so common words cost no more than rare ones. One shuffle by language and term sums
   the counts and finds the kept terms.
2. *Products.* A count level of a group is an indicator column over terms (one-hot: each term has
   one level per group, zero included). The matrix times its transpose holds, for every pair of
   groups, the joint table of their levels; f priced over that table is their divergence. Terms are
   dealt into blocks of similar frequency, so a block has few levels, and groups into tiles; one
   task multiplies one block of one pair of tiles (float32 holds its counts exactly) and returns one
   sum per pair. Work grows with kept terms times pairs of sources, as the result does.
3. *Ranks.* Window functions; the ranks of terms stop at ``top``, which limits each task before
   the shuffle.

Edge cases: null text, lang and source count as empty strings; texts without letters, empty ones
too, still make their group occur; a language without kept terms gives pairs of value 0 and no
terms; a language with one source gives no pairs; ties are ranked by the item's UTF-8 bytes;
repeated rows count as often as they occur; an empty table gives an empty result; doc_id and extra
columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantloom.llm.common import read, written

LEAST, TOP, SCALE = 10, 10, 1_000_000_000
#: A task hands on its counts when its tables have so many entries.
ENTRIES = 300_000
#: Groups in a tile; terms in a block below and above 64 occurrences; indicator columns multiplied at a time.
TILE, BLOCK, COLUMNS = 64, (1024, 128), 2048

LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return text.encode().translate(LETTERS).split()


def scan(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within a task as far as
    its tables go; a row with an empty term for every group."""
    columns, entries = "lang string, source string, term string, n long, docs long", ENTRIES

    def rows(tables):
        for (lang, source), (n, docs) in tables.items():
            terms = list(n)
            size = len(terms) + 1
            cols = [[lang] * size, [source] * size, ["", *[t.decode() for t in terms]]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols], pa.array([0, *n.values()], pa.int64()), pa.array([0, *[docs[t] for t in terms]], pa.int64())], columns.replace(",", "").split()[::2])

    def run(batches):
        tables, size = {}, 0
        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, docs = tables.get((lang, source)) or tables.setdefault((lang, source), (Counter(), Counter()))
                words, before = terms_of(text), len(n)
                n.update(words), docs.update(set(words))
                size += len(n) - before
                if size >= entries:
                    yield from rows(tables)
                    tables, size = {}, 0
        yield from rows(tables)

    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]).mapInArrow(run, columns)


def kept_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, total, head): counts of kept terms, their count in the language,
    and whether the row is the term's first; a row with an empty term for every group."""
    one = scan(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")  # no more rows than sources
    summed = one.withColumn("total", F.sum("n").over(of)).withColumn("found", F.sum("docs").over(of)).withColumn("head", F.col("source") == F.min("source").over(of))
    return written(summed.filter(f"found >= {least} or term = ''").select("lang", "source", "term", "n", "total", "head"), "kept")


def share(count: str, n: str, v: str) -> str:
    """SQL of a smoothed share, exact for any count of 18 digits."""
    return f"1 + ({SCALE}BD * (cast({count} as decimal(19, 0)) + 2BD)) div (cast({n} as decimal(19, 0)) + 2BD * cast({v} as decimal(19, 0)))"


def distance(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))"


def groups_of(kept: DataFrame) -> DataFrame:
    """(lang, source, g, n, n_lang, v): every group with its number in the language, the counts of
    its and its language's kept terms, and how many these are. One row per source."""
    one = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if(F.expr("head and term <> ''")).alias("heads"))
    of = Window.partitionBy("lang")
    out = one.withColumn("n_lang", F.sum("n").over(of)).withColumn("v", F.sum("heads").over(of))
    return written(out.withColumn("g", F.row_number().over(of.orderBy("source")) - 1).drop("heads"), "groups")


def multiplied(key, table, tile: int, columns: int):
    """One block of terms, one pair of tiles: (lang, g, h, value) of the pairs of groups g < h. A
    row is an indicator (term, group, share); rows without a term tell the groups' share at 0."""
    lang, _, _, ti, tj = (k.as_py() for k in key)
    term = table.column("term").combine_chunks().dictionary_encode()
    zero = term.indices.is_null().to_numpy(zero_copy_only=False)
    t = term.indices.fill_null(0).to_numpy(zero_copy_only=False)[~zero]
    g, p = table.column("g").to_numpy(), table.column("p").to_numpy()
    order = np.lexsort((p, g))
    new = (np.diff(g[order], prepend=-1) != 0) | (np.diff(p[order], prepend=-1) != 0)
    column = np.empty(len(g), np.int64)
    column[order] = np.cumsum(new) - 1
    group, price = g[order][new], p[order][new]
    hot = np.zeros((len(term.dictionary), len(group)), np.float32)
    none = np.zeros(int(group.max()) + 1, np.int64)
    none[g[zero]] = column[zero]
    hot[:, column[zero]] = 1
    hot[t, none[g[~zero]]] = 0
    hot[t, column[~zero]] = 1
    sides = [np.flatnonzero(group // tile == x) for x in (ti, tj)]
    value = np.zeros((tile, tile), np.int64)
    for i in range(0, len(sides[0]), columns):
        for j in range(0, len(sides[1]), columns):
            x, y = sides[0][i : i + columns], sides[1][j : j + columns]
            joint = hot[:, x].T @ hot[:, y]
            a, b = np.nonzero(joint)
            u, v = price[x[a]], price[y[b]]
            np.add.at(value, (group[x[a]] % tile, group[y[b]] % tile), joint[a, b].astype(np.int64) * ((u - v) ** 2 // (u + v)))
    one, two = (np.unique(group[s]) for s in sides)
    a, b = (x.ravel() for x in np.meshgrid(one, two, indexing="ij"))
    a, b = a[a < b], b[a < b]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "g": a.astype(np.int32), "h": b.astype(np.int32), "value": value[a % tile, b % tile]})


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, g, h, value) of all pairs of groups g < h of a language."""
    k = F.expr("cast(length(bin(total)) as int)").alias("k")  # terms of one k differ in count by a factor below 2
    real = kept.filter("term <> ''").select("lang", "source", "term", "n", "head", k)
    sizes = real.filter("head").groupBy("lang", "k").agg(F.count("*").alias("terms"))
    sizes = groups.select("lang").distinct().join(sizes, "lang", "left").select("lang", F.coalesce("k", F.lit(0)).alias("k"), F.expr(f"cast(ceil(coalesce(terms, 1) / if(k <= 6, {BLOCK[0]}, {BLOCK[1]})) as int)").alias("parts"))
    sizes = written(sizes, "sizes")  # at most 64 rows a language
    tiles = F.expr(f"explode(sequence(0, cast((tops - 1) div {TILE} as int)))").alias("other")
    tops = groups.withColumn("tops", F.count("*").over(Window.partitionBy("lang")))
    ones = real.join(sizes, ["lang", "k"]).join(tops.drop("n"), ["lang", "source"]).join(groups.select("lang", "source", F.col("n").alias("n_group")), ["lang", "source"])
    ones = ones.select("lang", "k", F.expr("cast(pmod(xxhash64(term), parts) as int)").alias("part"), "g", "term", F.expr(share("n", "n_group", "v")).alias("p"), tiles)
    blocks = sizes.select("lang", "k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    zeros = blocks.join(tops, "lang").select("lang", "k", "part", "g", F.lit(None).cast("string").alias("term"), F.expr(f"if(v = 0, 1L, {share('0', 'n', 'greatest(v, 1)')})").alias("p"), tiles)
    own = f"cast(g div {TILE} as int)"
    dealt = ones.union(zeros).select("lang", "k", "part", F.expr(f"least({own}, other)").alias("ti"), F.expr(f"greatest({own}, other)").alias("tj"), "g", "term", "p")
    tile, columns = TILE, COLUMNS
    parts = dealt.groupBy("lang", "k", "part", "ti", "tj").applyInArrow(lambda key, table: multiplied(key, table, tile, columns), "lang string, g int, h int, value long")
    return parts.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance of each group from each other source
    of its language (``pair``), and the ``top`` terms that set it apart from the language (``term``)."""
    kept = kept_counts(docs, least)
    groups = groups_of(kept)
    pairs = written(pair_values(kept, groups), "pairs")
    both = pairs.select("lang", F.explode(F.expr("array(named_struct('g', g, 'h', h), named_struct('g', h, 'h', g))")).alias("x"), "value").select("lang", F.col("x.g").alias("g"), F.col("x.h").alias("h"), "value")
    name = lambda g, c: groups.select("lang", F.col("g").alias(g), F.col("source").alias(c))
    both = both.join(name("g", "source"), ["lang", "g"]).join(name("h", "item"), ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    real = kept.filter("term <> ''").join(groups.select("lang", "source", F.col("n").alias("n_group"), "n_lang", "v"), ["lang", "source"])
    real = real.select("lang", "source", "term", F.expr(share("n", "n_group", "v")).alias("p"), F.expr(share("total", "n_lang", "v")).alias("q")).filter("p > q")
    apart = real.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(distance("p", "q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return both.select("*", rank).union(apart.select("*", rank).filter(f"rank <= {top}"))


def op11_source_divergence(spark, sf_dir):
    return audit(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as materialized (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
c as (select i, lang, source, unnest(terms) as term from d),
o as materialized (select lang, source, term, count(*) as n, count(distinct i) as docs from c group by all),
k as materialized (select lang, term, sum(n) as total from o group by all having sum(docs) >= 10),
g as materialized (select x.lang, x.source, coalesce(y.n, 0) as n from (select distinct lang, source from d) x
  left join (select lang, source, sum(n) as n from o semi join k using (lang, term) group by all) y on x.lang = y.lang and x.source = y.source),
l as materialized (select lang, count(*) as v, sum(total) as n from k group by lang),
p as materialized (select g.lang, g.source, k.term, coalesce(o.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(o.n, 0) + 2)) // (g.n + 2 * l.v)::hugeint as p,
    1 + (1000000000::hugeint * (k.total + 2)::hugeint) // (l.n + 2 * l.v)::hugeint as q
  from g join l using (lang) join k using (lang) left join o on o.lang = g.lang and o.source = g.source and o.term = k.term),
pairs as (select a.lang, a.source, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as bigint) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
apart as (select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // (p + q) as bigint) as value from p where n > 0 and p > q),
both_parts as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pairs.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all select * from apart),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from both_parts)
select * from ranked where part = 'pair' or rank <= 10
"""
