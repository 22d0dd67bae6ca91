"""Queries of search, ranking and serving views (F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grantloom.functions.normalize import fold_text
from grantloom.operators import details as D
from grantloom.operators import paging as PG
from grantloom.operators import search as S
from grantloom.plans.fields import fold
from grantloom.tables import kept
from grantloom.views import duck, sql, view

QUERIES: dict = {}
SQL: dict = {}
#: Weights of the fields; the whole text stands for the supported activities.
FIELDS = {"title": 4.0, "summary": 1.5, "body": 3.0, "costs": 1.5, "keywords": 2.5}


def add(name, query, oracle=None):
    QUERIES[name] = query
    if oracle:
        SQL[name] = duck(oracle)


def intents(s, d):
    """The tokens of each benchmark item, one row per token."""
    own = view(s, d, "benchmark").select(F.col("item_id").alias("intent_id"), F.explode(S.tokens(F.col("text"))).alias("token"))
    return own.distinct()


TOKENS = f"list_filter(string_split({fold('{c}')}, ' '), lambda x: x <> '')"
toks = lambda c: TOKENS.replace("{c}", c)
POST = " union all ".join(f"select doc_id, unnest({toks(f)}) as term, {w}::double as w from {{search_docs}}" for f, w in FIELDS.items())
HITS_OF = """post0 as (select doc_id, term, sum(w) as tf, count(*) as n from fields0 group by doc_id, term), lengths as (select doc_id, sum(n) as length from post0 group by doc_id),
    vocabulary as (select distinct term, left(term, 3) as head from post0), wanted as (select distinct token, left(token, 3) as head from asked),
    stands as (select token, term from wanted w join vocabulary v on v.head = w.head where (length(token) >= 3 and starts_with(term, token)) or term = token),
    found as (select s.token, p.doc_id, sum(p.tf) as tf from stands s join post0 p using (term) group by s.token, p.doc_id), dfs as (select token, count(*) as df from found group by token)"""
BM25 = f"""with asked as (select distinct item_id as intent_id, unnest({toks('text')}) as token from {{benchmark}}), fields0 as ({POST}), {HITS_OF},
    stats as (select (select count(*) from {{search_docs}}) as n, (select sum(length) from lengths) / (select count(*) from {{search_docs}}) as mean),
    need as (select a.*, df, count(*) over (partition by intent_id) as need, count(df) over (partition by intent_id) as known from asked a left join dfs using (token)),
    rare as (select intent_id, token from (select *, row_number() over (partition by intent_id order by df, token) as r from need where need = known) where r = 1),
    pairs as (select r.intent_id, f.doc_id from rare r join found f using (token)),
    parts as (select p.intent_id, p.doc_id, n.need, case when s.n - n.df + 0.5 > n.df + 0.5 then ln((s.n - n.df + 0.5) / (n.df + 0.5)) else 1e-6 end * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * l.length / s.mean)) as part
      from pairs p join need n using (intent_id) join found f on f.token = n.token and f.doc_id = p.doc_id join lengths l on l.doc_id = p.doc_id cross join stats s),
    scored as (select intent_id, doc_id, sum(part) as score from parts join {{search_docs}} d using (doc_id) where d.status in ('OPEN', 'PLANNED', 'ANNOUNCED') group by intent_id, doc_id, need having count(*) = need)"""


def scored(s, d):
    """BM25 over all calls' statistics, of those open, planned or announced."""
    docs = view(s, d, "search_docs")
    own, post = kept(intents(s, d), "intents"), S.index(docs, FIELDS)
    total = post.groupBy("doc_id").agg(F.first("length").alias("length")).agg(F.sum("length")).first()[0]
    n = docs.count()
    found = S.bm25(own, S.index_hits(own, post), n, (total or 0) / max(n, 1))
    return found.join(docs.filter(F.col("status").isin(S.ACTIVE)).select("doc_id"), "doc_id")


def bm25_top(s, d):
    top = S.top_k(scored(s, d).withColumn("score", F.round("score", 6)), 10)
    out = S.hybrid(top.withColumn("lexical", S.relevance(F.col("score"))).withColumn("ontology", F.lit(0.5)).withColumn("semantic", F.lit(None).cast("double")).withColumnRenamed("score", "bm25"))
    return out.select("intent_id", "doc_id", "rank", "bm25", F.round(F.col("score") + 1e-9, 4).alias("score"), "band")


add(
    "F1_tokenize",
    lambda s, d: view(s, d, "benchmark").select("item_id", F.array_join(F.transform(S.tokens(F.col("text")), lambda x: F.when(F.length(x) >= 3, F.concat(x, F.lit("*"))).otherwise(x)), " ").alias("tokens")),
    f"select item_id, array_to_string(list_transform({toks('text')}, lambda x: case when length(x) >= 3 then x || '*' else x end), ' ') as tokens from {{benchmark}}",
)
add(
    "F2_bm25_top_k",
    bm25_top,
    BM25 + """, t as (select *, row_number() over (partition by intent_id order by s6 desc, doc_id) as rank from (select intent_id, doc_id, round(score, 6) as s6 from scored)),
    h as (select *, (0.45 * (s6 / (1 + s6)) + 0.35 * 0.5) / 0.8 as hs from t where rank <= 10)
    select intent_id, doc_id, rank, s6 as bm25, round(round(hs, 6) + 1e-9, 4) as score, case when round(hs, 6) >= 0.7 then 'VERY_GOOD' when round(hs, 6) >= 0.35 then 'POSSIBLE' else 'WEAK' end as band from h""",
)


def ontology(s, d):
    e = view(s, d, "edges").select("src", "dst", (F.col("pct") / 100).alias("weight"))
    return S.closure(e)


EDGE = "select src, dst, max(pct / 100.0::double) * 0.95 as w from {edges} group by src, dst"
CLOSE = f"""with st as ({EDGE}), r as (select src, dst, w from st where w >= 0.35
    union all select a.src, b.dst, a.w * b.w from st a join st b on a.dst = b.src where a.w >= 0.35 and b.w >= 0.35 and a.w * b.w >= 0.35)"""
add("F4_ontology_closure", lambda s, d: ontology(s, d).select("src", "dst", F.round(F.col("weight") + 1e-9, 6).alias("weight")), CLOSE + " select src, dst, round(max(w) + 1e-9, 6) as weight from r group by src, dst")


def hits(s, d):
    texts = view(s, d, "calls").select(F.col("call_id").alias("id"), fold_text(F.concat_ws(" ", "title", "activity")).alias("folded"))
    phrases = view(s, d, "terms").select(F.col("name").alias("term"), fold_text(F.col("name")).alias("phrase"), F.lit(1.0).alias("weight"))
    return S.phrase_hits(texts, phrases)


HITS = f"""select distinct c.call_id as id, t.name as term, 1.0::double as weight from {{calls}} c join {{terms}} t on contains(concat(' ', {fold("c.title || ' ' || c.activity")}, ' '), concat(' ', {fold('t.name')}, ' '))"""
add("F3_ontology_match", hits, HITS)
add(
    "F4_ontology_expand",
    lambda s, d: S.expand(hits(s, d), ontology(s, d)).select("id", "term", F.round(F.col("weight") + 1e-9, 6).alias("weight")),
    CLOSE + f", c as (select src, dst, max(w) as w from r group by src, dst), h as ({HITS}) select id, term, round(max(weight) + 1e-9, 6) as weight from (select * from h union all select h.id, c.dst, h.weight * c.w from h join c on c.src = h.term where h.weight * c.w >= 0.35) group by id, term",
)
def golden(s, d):
    """Golden queries, one per call: its text must resolve to its own name and activity, and a call
    of the same activity must score above one of another."""
    h = hits(s, d)
    resolved = S.expand(h, ontology(s, d))
    asked = view(s, d, "golden")
    expected = asked.select(F.col("query_id").alias("id"), F.explode(F.array_distinct(F.array("title", "activity"))).alias("term"))
    missing = expected.join(resolved.select("id", "term"), ["id", "term"], "left_anti").groupBy("id").agg(F.count("*").alias("missing"))
    pairs = asked.selectExpr("query_id", "stack(2, 'good', good_id, 'bad', bad_id) as (label, id)").filter("id is not null")
    scores = S.score_terms(resolved, pairs.join(h.select("id", "term"), "id").select("query_id", "label", "term"))
    wide = scores.groupBy("query_id").agg(F.max(F.when(F.col("label") == "good", F.col("score"))).alias("good"), F.max(F.when(F.col("label") == "bad", F.col("score"))).alias("bad"))
    out = asked.select("query_id").join(missing.withColumnRenamed("id", "query_id"), "query_id", "left").join(wide, "query_id", "left")
    return out.select("query_id", F.coalesce("missing", F.lit(0)).alias("missing"), F.round(F.coalesce("good", F.lit(0.0)) + 1e-9, 6).alias("good"), F.round(F.coalesce("bad", F.lit(0.0)) + 1e-9, 6).alias("bad"), (F.round(F.coalesce("good", F.lit(0.0)) + 1e-9, 6) > F.round(F.coalesce("bad", F.lit(0.0)) + 1e-9, 6)).alias("passes"))


add(
    "E13_golden",
    golden,
    CLOSE + f""", c as (select src, dst, max(w) as w from r group by src, dst), h as ({HITS}), resolved as (select id, term, max(weight) as weight from (select * from h union all select h.id, c.dst, h.weight * c.w from h join c on c.src = h.term where h.weight * c.w >= 0.35) group by id, term),
    total as (select id, sum(weight) as total from resolved group by id), g as (select * from {{golden}}),
    lacking as (select query_id, count(*) as missing from (select distinct query_id, unnest([title, activity]) as term from g) e where not exists (select 1 from resolved r where r.id = e.query_id and r.term = e.term) group by query_id),
    scores as (select g.query_id, coalesce((select sum(r.weight) from resolved r join h on h.term = r.term where r.id = g.query_id and h.id = g.good_id), 0) / t.total as good, coalesce((select sum(r.weight) from resolved r join h on h.term = r.term where r.id = g.query_id and h.id = g.bad_id), 0) / t.total as bad from g left join total t on t.id = g.query_id)
    select query_id, coalesce(missing, 0) as missing, round(coalesce(good, 0) + 1e-9, 6) as good, round(coalesce(bad, 0) + 1e-9, 6) as bad, round(coalesce(good, 0) + 1e-9, 6) > round(coalesce(bad, 0) + 1e-9, 6) as passes from scores left join lacking using (query_id)""",
)


def expanded(s, d):
    """What each call's text means in other words: at most three hops, 0.5 or more."""
    e = view(s, d, "edges").select("src", "dst", (F.col("pct") / 100).alias("weight"))
    resolved = S.expand(hits(s, d), S.closure(e, 3, 0.95, 0.5), 0.5)
    return S.phrases_of(resolved.withColumn("weight", F.round("weight", 9)), view(s, d, "synonyms").select("term", "name", (F.col("pct") / 100).alias("weight")))


EXPANDED = f"""with st as ({EDGE}), step as (select * from st where w >= 0.5), two as (select a.src, b.dst, a.w * b.w as w from step a join step b on a.dst = b.src where a.w * b.w >= 0.5),
    three as (select a.src, b.dst, a.w * b.w as w from two a join step b on a.dst = b.src where a.w * b.w >= 0.5), reach as (select src, dst, max(w) as w from (select * from step union all select * from two union all select * from three) group by src, dst),
    h as ({HITS}), resolved as (select id, term, round(max(weight), 9) as weight from (select * from h union all select h.id, r.dst, h.weight * r.w from h join reach r on r.src = h.term where h.weight * r.w >= 0.5) group by id, term),
    named as (select id, term, weight, 0 as kind, term as phrase from resolved union all select r.id, r.term, r.weight, 1, y.name from resolved r join {{synonyms}} y on y.term = r.term where y.pct >= 75),
    once as (select *, row_number() over (partition by id, phrase order by weight desc, term, kind) as k from named),
    phrases as (select id, phrase, row_number() over (partition by id order by weight desc, term, kind, phrase) as place from once where k = 1)"""
add("F6_query_expansion", expanded, EXPANDED + " select id, phrase, place from phrases where place <= 24")


def expanded_search(s, d):
    """Calls that contain all tokens of one of the first 16 phrases of a query; queries are the
    calls whose id is divisible by 20. Each distinct phrase is searched for once, in each distinct text."""
    asked = expanded(s, d).filter("id % 20 = 0 and place <= 16")
    docs = view(s, d, "calls").select(F.col("call_id").alias("doc_id"), "title", "activity", "provider")
    return S.any_phrase(asked, docs, {"title": 4.0, "activity": 3.0, "provider": 1.0})


add(
    "F7_expanded_or",
    expanded_search,
    EXPANDED + f""", picked as (select id, phrase from phrases where place <= 16 and id % 20 = 0), asked as (select distinct phrase, unnest(list_distinct({toks('phrase')})) as token from picked),
    words as (select call_id as doc_id, unnest({toks("title || ' ' || activity || ' ' || provider")}) as term from {{calls}}), post as (select distinct * from words),
    found as (select distinct a.phrase, a.token, p.doc_id from asked a join post p on left(p.term, 3) = left(a.token, 3) and ((length(a.token) >= 3 and starts_with(p.term, a.token)) or p.term = a.token)),
    whole as (select phrase, doc_id from found f group by phrase, doc_id having count(*) = (select count(*) from asked a where a.phrase = f.phrase))
    select id, doc_id, count(*) as n_phrases from picked join whole using (phrase) group by id, doc_id""",
)
add(
    "F5_term_overlap",
    lambda s, d: hits(s, d).groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("terms")).select("id", F.size("terms").cast("long").alias("n"), F.round(F.size(F.array_intersect("terms", F.array(F.lit("Brand#1"), F.lit("Brand#2"), F.lit("STANDARD")))) / 3.0, 6).alias("overlap")),
    f"select id, count(*) as n, round(count(*) filter (term in ('Brand#1', 'Brand#2', 'STANDARD')) / 3.0, 6)::double as overlap from ({HITS}) group by id",
)
add(
    "F8_two_phase",
    lambda s, d: (lambda direct: direct.select("id", F.lit("DIRECT").alias("phase")).distinct().unionByName(
        S.expand(hits(s, d), ontology(s, d)).filter("term = 'Brand#11' or term like '%STEEL%'").select("id").distinct().join(direct.select("id"), "id", "left_anti").select("id", F.lit("ONTOLOGY").alias("phase"))
    ))(hits(s, d).filter("term like '%STEEL%'")),
    CLOSE + f""", c as (select src, dst, max(w) as w from r group by src, dst), h as ({HITS}), x as (select * from h union all select h.id, c.dst, h.weight * c.w from h join c on c.src = h.term where h.weight * c.w >= 0.35),
    d as (select distinct id from h where term like '%STEEL%') select id, 'DIRECT' as phase from d union all select distinct id, 'ONTOLOGY' from x where (term = 'Brand#11' or term like '%STEEL%') and id not in (select id from d)""",
)
add(
    "F9_structured_filters",
    lambda s, d: view(s, d, "search_docs").filter(F.col("status").isin("OPEN", "PLANNED") & F.col("close_at").between("2024-06-01", "2025-03-31")).select("doc_id", "provider", "status", F.col("close_at").cast("string").alias("close_at")),
    "select doc_id, provider, status, cast(close_at as varchar) as close_at from {search_docs} where status in ('OPEN', 'PLANNED') and close_at between date '2024-06-01' and date '2025-03-31'",
)
add(
    "F9_budget_filter",
    lambda s, d: (lambda v, p: p.join(v.filter("quantity > 5").select(F.col("l_orderkey").alias("project_id"), (F.col("cap_minor") * 3).alias("hi"), "cap_minor"), "project_id").filter("total_minor between cap_minor and hi").select("project_id").distinct())(view(s, d, "versions"), view(s, d, "projects").filter("currency = 'CZK'")),
    "select project_id from {projects} p where currency = 'CZK' and exists (select 1 from {versions} v where v.l_orderkey = p.project_id and v.quantity > 5 and p.total_minor between v.cap_minor and v.cap_minor * 3)",
)
#: Three orders as keys (late, k, id): by relevance, by deadline, by deadline backwards; unknown ones last.
DAY_NUMBER = {"relevance": ("0", "-(doc_id * 7919 % 1000)"), "deadline": ("case when close_at is null then 1 else 0 end", "coalesce({days}, 0)"), "deadline_desc": ("case when close_at is null then 1 else 0 end", "-coalesce({days}, 0)")}
#: A request per project: an order, a cursor (none for every fifth) and a size.
PAGES = """select o_orderkey as request_id, case o_orderkey % 3 when 0 then 'relevance' when 1 then 'deadline' else 'deadline_desc' end as ordered_by, cast(case when o_orderkey % 9 = 0 and o_orderkey % 3 > 0 then 1 else 0 end as int) as late,
    cast(case o_orderkey % 3 when 0 then -(o_custkey * 31 % 1000) when 1 then o_custkey * 31 % 700 else -(o_custkey * 31 % 700) end as bigint) as k, case when o_orderkey % 5 = 0 then null else cast(o_orderkey % 500 as bigint) end as id, cast(1 + o_orderkey % 20 as int) as size from {orders}"""


def keyset_pages(s, d):
    out, days = None, "datediff(close_at, date '2024-01-01')"
    docs, asked = view(s, d, "search_docs").filter("status = 'OPEN'"), sql(s, d, PAGES)
    for name, (late, k) in DAY_NUMBER.items():
        rows = docs.selectExpr(f"cast({late} as int) as late", f"cast({k.format(days=days)} as bigint) as k", "cast(doc_id as bigint) as id")
        page = PG.keyset_pages(rows, asked.filter(F.col("ordered_by") == name).drop("ordered_by"))
        out = page if out is None else out.unionByName(page)
    return out


def pages_sql():
    parts = []
    for n, (name, (late, k)) in enumerate(DAY_NUMBER.items()):
        parts.append(f"r{n} as materialized (select *, row_number() over (order by late, k, id) as rank, count(*) over () as total from (select {late} as late, {k.format(days="(close_at - date '2024-01-01')")} as k, doc_id as id from {{search_docs}} where status = 'OPEN') x)")
        parts.append(f"q{n} as materialized (select q.request_id, size, case when q.id is null then 0 else coalesce(max(r.rank), 0) end as upto from (select * from asked where ordered_by = '{name}') q left join r{n} r on q.id is not null and (r.late, r.k, r.id) <= (q.late, q.k, q.id) group by q.request_id, size, q.id)")
    whole = " union all ".join(f"select request_id, cast(rank - upto as integer) as place, id, case when upto + size < total then last_value(id) over (partition by request_id order by rank rows between unbounded preceding and unbounded following) end as next_id from q{n} join r{n} on rank > upto and rank <= upto + size" for n in range(len(DAY_NUMBER)))
    return f"with asked as materialized ({PAGES}), {', '.join(parts)} {whole}"


add("F10_keyset_page", keyset_pages, pages_sql())
KEPT = {"status": "status = 'OPEN'", "provider": "provider in ('src0', 'src1', 'src2', 'src3')", "deadline": "deadline = 'KNOWN'"}
FACET = lambda name: f"select '{name}' as facet, cast({name} as varchar) as value, count(*) as n from d where {' and '.join(c for k, c in KEPT.items() if k != name)} group by {name}"
add(
    "F11_facets",
    lambda s, d: S.facets(view(s, d, "search_docs").withColumn("deadline", F.when(F.col("close_at").isNull(), "UNKNOWN").otherwise("KNOWN")), {k: F.expr(c) for k, c in KEPT.items()}),
    f"""with d as (select *, case when close_at is null then 'UNKNOWN' else 'KNOWN' end as deadline from {{search_docs}}), f as ({' union all '.join(FACET(k) for k in KEPT)})
    select facet, value, case when (select count(*) from d where {' and '.join(KEPT.values())}) <= 500 then n end as n, truncated from (select *, row_number() over (partition by facet order by n desc, value nulls first) as p, count(*) over (partition by facet) > 20 as truncated from f) where p <= 20""",
)
add(
    "F12_search_profile",
    lambda s, d: view(s, d, "calls").select("call_id", F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Activities: "), "activity"), F.when(F.col("p_size") > 25, F.concat(F.lit("Provider: "), "provider"))).alias("profile")),
    "select call_id, concat_ws(chr(10), 'Title: ' || title, 'Activities: ' || activity, case when p_size > 25 then 'Provider: ' || provider end) as profile from {calls}",
)
add(
    "F13_cosine_top_k",
    lambda s, d: S.cosine_top_k(view(s, d, "embeddings").select("vec_id", "embedding"), view(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5).select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank"),
    """select query_id, vec_id, round(score, 4) as score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
        select q.vec_id as query_id, v.vec_id, round(coalesce(list_dot_product(q.embedding::double[], v.embedding::double[]) / nullif(sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])), 0), 0), 6) as score
        from {embeddings} v, {embeddings} q where q.vec_id % 20 = 0)) where rank <= 5""",
)
add(
    "F14_hybrid_rank",
    lambda s, d: S.hybrid(view(s, d, "versions").select("call_id", "version_number", (F.col("quantity") / 50).alias("lexical"), (F.col("rate_bps") / 1000).alias("ontology"), F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_suppkey") % 10) / 9).alias("semantic"))).select("call_id", "version_number", F.round("score", 5).alias("score"), "band", F.array_join("reasons", ",").alias("reasons")),
    """select call_id, version_number, round(round(sc, 6), 5) as score, case when round(sc, 6) >= 0.7 then 'VERY_GOOD' when round(sc, 6) >= 0.35 then 'POSSIBLE' else 'WEAK' end as band,
        concat_ws(',', case when lx >= 0.55 then 'LEXICAL_MATCH' end, case when o >= 0.5 then 'ONTOLOGY_MATCH' end, case when se >= 0.65 then 'SEMANTIC_MATCH' end) as reasons
        from (select *, case when se is null then (0.45::double * lx + 0.35::double * o) / 0.80::double else 0.45::double * lx + 0.35::double * o + 0.2::double * se end as sc from (select call_id, version_number, least(1, quantity / 50.0::double) as lx, least(1, rate_bps / 1000.0::double) as o, case when l_suppkey % 3 > 0 then (l_suppkey % 10) / 9.0::double end as se from {versions}))""",
)
add("F15_relevance", lambda s, d: view(s, d, "events").select("event_id", F.round(S.relevance(F.col("value") - 50), 6).alias("relevance")), "select event_id, round(greatest(0, value - 50) / (1 + greatest(0, value - 50)), 6) as relevance from {events}")
def covered(s, d):
    own = view(s, d, "benchmark").select(F.col("item_id").alias("intent_id"), F.posexplode(F.slice(S.tokens(F.col("text")), 1, 20)).alias("pos", "token"))
    own = kept(own, "intents")
    return S.coverage(own, S.index_hits(own, S.index(view(s, d, "search_docs"), FIELDS)), 0.75)


add(
    "F16_intent_coverage",
    lambda s, d: covered(s, d).select("intent_id", "doc_id", F.round("coverage", 6).alias("coverage")),
    f"""with asked0 as (select item_id as intent_id, {toks('text')}[1:20] as ts from {{benchmark}}), asked as (select intent_id, unnest(ts) as token from asked0), fields0 as ({POST}), {HITS_OF}
    select intent_id, doc_id, round(count(*) / max(len(ts)), 6) as coverage from asked join found using (token) join asked0 using (intent_id) group by intent_id, doc_id having count(*) / max(len(ts)) >= 0.75""",
)


def similar_awards(s, d):
    h = hits(s, d)
    when = view(s, d, "versions").groupBy(F.col("call_id").alias("id")).agg(F.max(F.year("close_at")).alias("year"))
    order = view(s, d, "calls").select(F.col("call_id").alias("id"), "title").join(when, "id", "left")
    queries = view(s, d, "calls").filter("call_id % 20 = 0").select(F.col("call_id").alias("query_id"))
    return S.most_similar(h.select("id", "term"), queries, order, [F.col("year").desc_nulls_last(), F.col("title").asc()], 5)


add(
    "F17_similar_awards",
    similar_awards,
    f"""with h as ({HITS}), m as (select id as query_id, term, count(*) over (partition by id) as n from h where id % 20 = 0),
        j as (select query_id, h.id, count(*) as shared, (count(*) * 1000000) // first(n) as ppm from m join h using (term) where query_id <> h.id group by query_id, h.id)
        select query_id, id, shared, ppm, rank from (select j.*, row_number() over (partition by query_id order by ppm desc, y.year desc nulls last, c.title, j.id) as rank from j join {{calls}} c on c.call_id = j.id left join (select call_id, max(year(close_at)) as year from {{versions}} group by call_id) y on y.call_id = j.id) where rank <= 5""",
)
def comparison(s, d):
    """Calls three by three in the order of their ids, attributes as rows."""
    rows = view(s, d, "calls").selectExpr("call_id - call_id % 3 as first_id", "concat('call_', cast(call_id % 3 + 1 as string)) as place", "stack(3, 'title', title, 'activity', activity, 'provider', provider) as (attribute, value)")
    return rows.groupBy("first_id", "attribute").pivot("place", ["call_1", "call_2", "call_3"]).agg(F.first("value"))


add(
    "F18_comparison",
    comparison,
    """select first_id, attribute, max(value) filter (place = 0) as call_1, max(value) filter (place = 1) as call_2, max(value) filter (place = 2) as call_3 from (select call_id - call_id % 3 as first_id, call_id % 3 as place, unnest(['title', 'activity', 'provider']) as attribute, unnest([title, activity, provider]) as value from {calls}) group by first_id, attribute""",
)


#: The child lists of a call: rows (call_id, place, text) and how many are shown.
LISTS = {
    "sources": ("select call_id, lpad(cast(1000000 - max(version_number) as string), 8, '0') as place, concat('source ', cast(l_suppkey as string)) as text from {versions} group by call_id, l_suppkey", 20),
    "deadlines": ("select call_id, cast(close_at as string) as place, concat('close ', cast(close_at as string)) as text from {newest_versions} where status in ('OPEN', 'PLANNED', 'ANNOUNCED')", 50),
    "scenarios": ("select call_id, scenario_id as place, concat(scenario_id, ' ', instrument) as text from (select distinct call_id, scenario_id, instrument from {funded}) t", 20),
    "requirements": ("select r.call_id, concat(case r.necessity when 'REQUIRED' then '0' when 'CONDITIONAL' then '1' else '2' end, r.requirement_id) as place, concat(r.requirement_id, ' ', r.necessity) as text from {requirements} r join {newest_versions} n on n.call_id = r.call_id and n.version_number = r.version_number", 100),
    "evidence": ("select call_id, concat(lpad(cast(1000000 - version_number as string), 8, '0'), '/status') as place, concat(cast(version_number as string), ' /status') as text from {versions} where quantity % 2 = 0", 100),
    "changes": ("select call_id, lpad(cast(1000000 - version_number as string), 8, '0') as place, concat(cast(version_number as string), ' ', coalesce(old_status, '?'), ' > ', status) as text from {steps} where old_number is not null and old_status <> status", 20),
    "versions": ("select call_id, lpad(cast(1000000 - version_number as string), 8, '0') as place, concat(cast(version_number as string), ' ', status) as text from {versions}", 20),
}


def detail(s, d):
    """Calls with their lists, what there is, and a window made up from the newest version's dates
    where no deadline is known."""
    children = {tag: (sql(s, d, text), cap) for tag, (text, cap) in LISTS.items()}
    joined = [F.array_join(F.coalesce(tag, F.array()), "; ").alias(tag) for tag in LISTS]
    flags = [(F.coalesce(f"n_{tag}", F.lit(0)) > 0).alias(f"has_{tag}") for tag in LISTS]
    n = view(s, d, "newest_versions").select("call_id", F.concat_ws("..", "open_at", "close_at").alias("span"))
    df = view(s, d, "calls").join(D.nested(children, "call_id"), "call_id", "left").join(n, "call_id", "left")
    window = F.when(F.coalesce("n_deadlines", F.lit(0)) == 0, F.col("span"))
    return df.select("call_id", "title", *joined, *flags, window.alias("synthetic_window"), F.coalesce("n_versions", F.lit(0)).alias("n_versions"))


def detail_sql():
    lists = [f"(select call_id, string_agg(text, '; ' order by place, text) filter (nth <= {cap}) as {tag}, count(*) as n_{tag} from (select *, row_number() over (partition by call_id order by place, text) as nth from ({text}) x0) x1 group by call_id) l_{tag} on l_{tag}.call_id = c.call_id" for tag, (text, cap) in LISTS.items()]
    joined = ", ".join(f"coalesce({tag}, '') as {tag}, coalesce(n_{tag}, 0) > 0 as has_{tag}" for tag in LISTS)
    return f"select c.call_id, c.title, {joined}, case when coalesce(n_deadlines, 0) = 0 then concat_ws('..', n.open_at, n.close_at) end as synthetic_window, coalesce(n_versions, 0) as n_versions from {{calls}} c left join {{newest_versions}} n on n.call_id = c.call_id left join " + " left join ".join(lists)


add("F19_call_detail", detail, detail_sql())
