"""Search and ranking: batch operators over many intents at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantloom.functions.normalize import fold_text
from grantloom.tables import kept

ACTIVE = ["OPEN", "PLANNED", "ANNOUNCED"]
K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    """Letters-and-digits runs of the folded text; nothing of a query syntax survives."""
    return F.filter(F.split(fold_text(c), " "), lambda x: x != "")


def postings(docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(doc_id, term, tf, length): frequencies weighted by field, and the document's length in
    tokens over all fields."""
    own = lambda name, weight: F.transform(tokens(F.col(name)), lambda x: F.struct(x.alias("term"), F.lit(weight).alias("w")))
    each = F.concat(*[own(name, weight) for name, weight in fields.items()])
    rows = docs.select("doc_id", each.alias("all")).select("doc_id", F.size("all").alias("length"), F.explode("all").alias("x"))
    return rows.groupBy("doc_id", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf"), F.first("length").alias("length"))


#: Parts of an index, and into how many pieces each is dealt, so that no common beginning fills one task.
BUCKETS, SPLIT = 64, 8
#: Documents whose words are counted at a time: what a worker holds does not grow with a batch.
SLICE = 256


def bucket(term: Column) -> Column:
    """The part of an index in which a term lies: all terms of one beginning lie together."""
    return F.pmod(F.xxhash64(F.substring(term, 1, 3)), F.lit(BUCKETS)).cast("int")


def index(docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(bucket, term, doc_id, tf, length): the postings as a stored table, split by the terms' first
    letters. A document's terms are counted where its text is read, so what is shuffled is one row per
    document and distinct term, once; searches read the buckets that their tokens fall into."""
    each = F.struct(*[tokens(F.col(name)).alias(f"f{k}") for k, name in enumerate(fields)])
    weights = list(fields.values())

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                yield counted(b.slice(at, SLICE))

    def counted(b):
        parts, n = b.column("parts"), b.num_rows
        words = [pc.struct_field(parts, [k]) for k in range(len(weights))]
        length = np.sum([pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False) for w in words], axis=0)
        each = [(pc.list_parent_indices(w), w.flatten(), np.full(int(pc.sum(pc.fill_null(pc.list_value_length(w), 0)).as_py() or 0), weight)) for w, weight in zip(words, weights, strict=True)]
        rows = pa.table({"at": pa.concat_arrays([x.cast(pa.int64()) for x, _, _ in each]), "term": pa.concat_arrays([x for _, x, _ in each]), "w": np.concatenate([x for _, _, x in each])})
        rows = rows.group_by(["at", "term"], use_threads=False).aggregate([("w", "sum")]).combine_chunks()
        one = rows.to_batches()[0] if rows.num_rows else pa.RecordBatch.from_pylist([], schema=rows.schema)
        at = one.column("at").to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(one.column("at")), one.column("term"), one.column("w_sum"), pa.array(length[at].astype(np.int32) if n else [], pa.int32())], ["doc_id", "term", "tf", "length"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), each.alias("parts")).mapInArrow(run, "doc_id long, term string, tf double, length int")
    return kept(rows.withColumn("bucket", bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SPLIT))).sortWithinPartitions("bucket", "term"), "postings", "bucket")


def index_hits(wanted: DataFrame, post: DataFrame) -> DataFrame:
    """:func:`token_hits` over a stored index, as a table. Only the buckets of wanted tokens are read;
    at most BUCKETS numbers pass through the driver."""
    own = kept(wanted.select("token", bucket(F.col("token")).alias("bucket")).distinct(), "asked")
    parts = [r[0] for r in own.select("bucket").distinct().collect()]
    return kept(token_hits(own, post.filter(F.col("bucket").isin(parts))), "hits")


def token_hits(wanted: DataFrame, post: DataFrame) -> DataFrame:
    """(token, doc_id, tf, length): where the wanted tokens occur; from three characters on a token
    also stands for all terms that begin with it. Tokens meet the vocabulary by their first three
    characters, then postings by the terms they stand for."""
    wanted, terms = wanted.select("token").distinct(), post.select("term").distinct()
    short = wanted.filter("length(token) < 3").select("token", F.col("token").alias("term"))
    head = lambda c: F.substring(c, 1, 3).alias("head")
    long = wanted.filter("length(token) >= 3").select("token", head("token")).join(terms.filter("length(term) >= 3").select("term", head("term")), "head").filter("startswith(term, token)").select("token", "term")
    return post.join(short.unionByName(long), "term").groupBy("token", "doc_id").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))


def bm25(intents: DataFrame, hits: DataFrame, n_docs: int, mean_length: float) -> DataFrame:
    """(intent_id, doc_id, score) of documents that contain every token of the intent. Intents are
    (intent_id, token). Candidates come from each intent's rarest token alone; its other tokens
    are looked up for those, so a common token never multiplies intents by documents."""
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    need = intents.distinct().join(df.select("token", "df", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf")), "token", "left")
    per = Window.partitionBy("intent_id")
    need = need.withColumn("need", F.count("*").over(per)).withColumn("known", F.count("idf").over(per)).filter("need = known")
    rare = need.withColumn("r", F.row_number().over(per.orderBy("df", "token"))).filter("r = 1").select("intent_id", "token")
    candidates = rare.join(hits.select("token", "doc_id"), "token").select("intent_id", "doc_id")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean_length)))
    found = candidates.join(need.select("intent_id", "token", "idf", "need"), "intent_id").join(hits, ["token", "doc_id"])
    return found.groupBy("intent_id", "doc_id").agg(F.sum(part).alias("score"), F.count("*").alias("n"), F.first("need").alias("need")).filter("n = need").select("intent_id", "doc_id", "score")


def coverage(intents: DataFrame, hits: DataFrame, at_least: float) -> DataFrame:
    """(intent_id, doc_id, coverage): documents with that share or more of an intent's tokens
    (intent_id, pos, token). Such a document has one of the rarest tokens, those beyond what may be
    missing; candidates come from these alone."""
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    per = Window.partitionBy("intent_id")
    own = intents.join(df, "token", "left").withColumn("n", F.count("*").over(per)).withColumn("r", F.row_number().over(per.orderBy(F.coalesce("df", F.lit(0)), "pos")))
    rare = own.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * at_least) + 1)
    candidates = rare.select("intent_id", "token").join(hits.select("token", "doc_id"), "token").select("intent_id", "doc_id").distinct()
    found = candidates.join(own.select("intent_id", "token", "n"), "intent_id").join(hits.select("token", "doc_id"), ["token", "doc_id"])
    return found.groupBy("intent_id", "doc_id").agg((F.count("*") / F.first("n")).alias("coverage")).filter(F.col("coverage") >= at_least)


def all_match(phrases: DataFrame, hits: DataFrame) -> DataFrame:
    """(phrase, doc_id) of documents that contain every token of a phrase (phrase, token). Candidates
    come from each phrase's rarest token alone; its other tokens are looked up for those."""
    per = Window.partitionBy("phrase")
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    need = phrases.distinct().join(df, "token", "left").withColumns({"need": F.count("*").over(per), "known": F.count("df").over(per)}).filter("need = known")
    rare = need.withColumn("r", F.row_number().over(per.orderBy("df", "token"))).filter("r = 1").select("phrase", "token")
    candidates = rare.join(hits.select("token", "doc_id"), "token").select("phrase", "doc_id")
    found = candidates.join(need.select("phrase", "token", "need"), "phrase").join(hits.select("token", "doc_id"), ["token", "doc_id"])
    return found.groupBy("phrase", "doc_id").agg(F.count("*").alias("n"), F.first("need").alias("need")).filter("n = need").select("phrase", "doc_id")


#: Ids in a pack of documents and of queries: a pair of packs becomes so many rows at a time.
DOCS, ASKED = 256, 32


def classed(rows: DataFrame, ident: str, by: list[str], pack: int) -> DataFrame:
    """(ident, rep, pack): rows that are equal in the columns ``by`` are one class, called by its least id;
    its ids are numbered in packs of so many."""
    own = Window.partitionBy(*by)
    place = F.row_number().over(own.orderBy(ident))
    return rows.select(F.col(ident), F.min(ident).over(own).alias("rep"), F.floor((place - 1) / pack).cast("int").alias("pack"))


def packs(member: DataFrame, ident: str, rep: str, pack: str) -> DataFrame:
    """(rep, pack, ids): the members of :func:`classed`, a pack in a row."""
    return member.groupBy(F.col("rep").alias(rep), F.col("pack").alias(pack)).agg(F.collect_list(ident).alias(f"{ident}s"))


def any_phrase(asked: DataFrame, docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(id, doc_id, n_phrases): documents that contain all tokens of one or more phrases of a query (id,
    phrase), and of how many. Queries of the same phrases are one class, documents of the same fields
    another: classes meet, and only the result names their members. As it may have a row for every query
    and document, members lie in packs: what is joined is class pairs with packs, dealt by pack of
    documents over as many tasks as a shuffle has, and rows are only unpacked from there."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = kept(asked.select("id", "phrase").distinct(), "asked")
    query = kept(classed(asked.groupBy("id").agg(F.array_sort(F.collect_set("phrase")).alias("phrases")), "id", ["phrases"], ASKED), "queries")
    member = kept(classed(docs, "doc_id", list(fields), DOCS), "members")
    one = docs.join(member.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    wanted = kept(asked.select("phrase").distinct().select("phrase", F.explode(F.array_distinct(tokens(F.col("phrase")))).alias("token")), "phrases")
    found = all_match(wanted, index_hits(wanted, index(one, fields))).repartition(parts, "doc_id")
    own = asked.join(query.filter("id = rep").select("id"), "id", "left_semi")
    pairs = kept(found.join(own, "phrase").groupBy(F.col("id").alias("query_rep"), F.col("doc_id").alias("doc_rep")).agg(F.count("*").alias("n_phrases")), "class_pairs")
    ids, doc_ids = kept(packs(query, "id", "query_rep", "query_pack"), "query_packs"), kept(packs(member, "doc_id", "doc_rep", "doc_pack"), "doc_packs")
    each = pairs.join(doc_ids.select("doc_rep", "doc_pack"), "doc_rep").repartition(parts, "doc_rep", "doc_pack")
    each = each.join(doc_ids, ["doc_rep", "doc_pack"]).join(ids, "query_rep").select(F.explode("ids").alias("id"), "doc_ids", "n_phrases")
    return each.select("id", F.explode("doc_ids").alias("doc_id"), "n_phrases")


def top_k(scored: DataFrame, k: int, by: str = "intent_id", score: str = "score", ident: str = "doc_id") -> DataFrame:
    """The k best rows per intent, ties by id."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), ident)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def relevance(score: Column) -> Column:
    """BM25 to 0..1: s / (1 + s)."""
    s = F.greatest(F.lit(0.0), score)
    return s / (1 + s)


def hybrid(df: DataFrame) -> DataFrame:
    """lexical, ontology and semantic (may be null) relevance to score, band and reasons."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    lex, ont, sem = clamp("lexical"), clamp("ontology"), F.when(F.col("semantic").isNotNull(), clamp("semantic"))
    score = F.when(sem.isNull(), (0.45 * lex + 0.35 * ont) / 0.80).otherwise(0.45 * lex + 0.35 * ont + 0.20 * sem)
    df = df.withColumn("score", F.round(score, 6))
    reasons = F.array_compact(F.array(F.when(lex >= 0.55, "LEXICAL_MATCH"), F.when(ont >= 0.50, "ONTOLOGY_MATCH"), F.when(sem >= 0.65, "SEMANTIC_MATCH")))
    return df.withColumn("band", F.when(F.col("score") >= 0.70, "VERY_GOOD").when(F.col("score") >= 0.35, "POSSIBLE").otherwise("WEAK")).withColumn("reasons", reasons)


def closure(edges: DataFrame, hops: int = 4, decay: float = 0.95, floor: float = 0.35) -> DataFrame:
    """(src, dst, weight): best product of edge weight and decay over paths of 1..hops edges that
    stays at or above the floor. A fixed number of joins, each followed by a grouped maximum."""
    step = edges.groupBy("src", "dst").agg(F.max("weight").alias("weight")).select("src", "dst", (F.col("weight") * decay).alias("weight")).filter(F.col("weight") >= floor)
    reach = frontier = step
    for _ in range(hops - 1):
        longer = frontier.withColumnRenamed("dst", "mid").join(step.select(F.col("src").alias("mid"), "dst", F.col("weight").alias("w")), "mid")
        frontier = longer.groupBy("src", "dst").agg(F.max(F.col("weight") * F.col("w")).alias("weight")).filter(F.col("weight") >= floor)
        reach = reach.unionByName(frontier)
    return reach.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def phrase_hits(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, term, weight): whole folded phrases (term, phrase, weight) found in folded texts
    (id, folded), the best weight per term. Phrases meet texts by their first token, then the whole
    phrase is compared at that place. Texts are dealt by id before they are split into words: a table of
    texts is small for its words, so one file of it, or what adaptive execution joins, would be one task."""
    words = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").select("id", F.concat(F.lit(" "), "folded", F.lit(" ")).alias("padded"), F.explode(F.array_distinct(F.split("folded", " "))).alias("head"))
    keys = phrases.select("term", "weight", "phrase", F.substring_index("phrase", " ", 1).alias("head"))
    hit = words.join(keys, "head").filter(F.contains("padded", F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))))
    return hit.groupBy("id", "term").agg(F.max("weight").alias("weight"))


def expand(hits: DataFrame, reach: DataFrame, floor: float = 0.35) -> DataFrame:
    """Direct terms and all reachable ones, the best score per term."""
    more = hits.join(reach.select(F.col("src").alias("term"), "dst", F.col("weight").alias("w")), "term").select("id", F.col("dst").alias("term"), (F.col("weight") * F.col("w")).alias("weight"))
    return hits.unionByName(more.filter(F.col("weight") >= floor)).groupBy("id", "term").agg(F.max("weight").alias("weight"))


def most_similar(terms: DataFrame, queries: DataFrame, order: DataFrame, by: list[Column], k: int) -> DataFrame:
    """(query_id, id, shared, ppm, rank): the ``k`` items that share the largest part of a query's terms,
    ties in the order ``by`` and by id. ``terms``: (id, term), distinct; ``queries``: (query_id), ids of
    items; ``order``: (id, ...), the columns of ``by``; items without a row there are left out. Items of the
    same terms are one class: classes are compared, each with its first k + 1 items, as a query
    may be one of them; so copies are never expanded into pairs."""
    col = F.col
    item = terms.groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("terms")).withColumn("class", F.sha2(F.array_join(F.transform("terms", lambda x: F.concat(F.length(x), F.lit(":"), x)), ","), 256))
    item = kept(item, "items")
    ranked = item.select("id", "class").join(order, "id")
    first = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("class").orderBy(*by, "id"))).filter(col("nth") <= k + 1)
    asked = item.join(queries.select(col("query_id").alias("id")), "id", "left_semi")
    classes = lambda df: df.select("class", "terms").dropDuplicates(["class"]).select("class", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    both = classes(asked).select(col("class").alias("query_class"), "n", "term").join(classes(item).select("class", "term"), "term")
    both = both.groupBy("query_class", "n", "class").agg(F.count("*").alias("shared")).withColumn("ppm", F.floor(col("shared") * 1_000_000 / col("n")).cast("long"))
    best = both.join(first, "class").withColumn("nth", F.row_number().over(Window.partitionBy("query_class").orderBy(col("ppm").desc(), *by, "id"))).filter(col("nth") <= k + 1)
    own = asked.select(col("id").alias("query_id"), col("class").alias("query_class")).join(best.select("query_class", "id", "shared", "ppm", "nth"), "query_class").filter("query_id <> id")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("nth"))).filter(col("rank") <= k).select("query_id", "id", "shared", "ppm", "rank")


def score_terms(resolved: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, label, score): of the weight of a query's terms (id, term, weight) the share whose
    terms a candidate (query_id, label, term) has."""
    total = resolved.groupBy(F.col("id").alias("query_id")).agg(F.sum("weight").alias("total"))
    own = candidates.distinct().join(resolved.select(F.col("id").alias("query_id"), "term", "weight"), ["query_id", "term"], "left")
    return own.groupBy("query_id", "label").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("shared")).join(total, "query_id").select("query_id", "label", (F.col("shared") / F.col("total")).alias("score"))


def phrases_of(resolved: DataFrame, synonyms: DataFrame, least: float = 0.75, first: int = 24) -> DataFrame:
    """(id, place, phrase): what a query's terms (id, term, weight) are called, by falling weight:
    each one's name, then its synonyms (term, name, weight) of ``least`` or more; the ``first``
    distinct ones."""
    names = resolved.select("id", "term", "weight", F.lit(0).alias("kind"), F.col("term").alias("phrase"))
    more = resolved.join(synonyms.filter(F.col("weight") >= least).select("term", "name"), "term").select("id", "term", "weight", F.lit(1).alias("kind"), F.col("name").alias("phrase"))
    best = names.unionByName(more).groupBy("id", "phrase").agg(F.min(F.struct(-F.col("weight"), "term", "kind")).alias("at"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("at", "phrase"))).filter(F.col("place") <= first).select("id", "place", "phrase")


BLOCK = 1024


def packed(rows: DataFrame, ident: str, block: int = BLOCK) -> DataFrame:
    """(dims, n, ids, vectors): vectors (``ident``, embedding) of one length in packs of at most
    ``block``; null and empty ones and those with a null component are left out."""

    def run(batches):
        for b in batches:
            vectors, ids = b.column("embedding").to_pylist(), b.column(ident).to_numpy().astype(np.int64)
            size = np.array([len(v) for v in vectors])
            for dims in np.unique(size).tolist():
                at = np.flatnonzero(size == dims)
                for k in range(0, len(at), block):
                    some = at[k : k + block]
                    v = np.array([vectors[i] for i in some.tolist()], np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([len(some)], pa.int32()), pa.array([ids[some].tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["dims", "n", "ids", "vectors"])

    usable = rows.filter(f"{ident} is not null and size(embedding) > 0 and not exists(embedding, x -> x is null)")
    return usable.select(F.col(ident).cast("long").alias(ident), "embedding").mapInArrow(run, "dims int, n int, ids binary, vectors binary")


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): a stated query set against all vectors, in blocks; a zero
    vector scores 0, ties go by id, and only vectors of one length meet (those with nothing to
    compare are left out). Both sides are packed; the packs of vectors are dealt over
    ``parts``, each of which meets every pack of queries, one pair of packs at a time, and keeps the k
    best of the pair; these meet per query. Nothing is broadcast or collected."""
    parts = parts or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = packed(vectors, "vec_id").withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    q = packed(queries, "query_id").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "dims", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))

    def best(batches):
        for b in batches:
            for r in b.to_pylist():
                x, y = (np.frombuffer(r[c], np.float32).reshape(r[n], -1).astype(np.float64) for c, n in (("vectors", "n"), ("qvectors", "qn")))
                ids, qids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["qids"], np.int64)
                norms = np.sqrt((y * y).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
                s = np.round(np.divide(y @ x.T, norms, out=np.zeros(norms.shape), where=norms > 0), 6)
                top = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, top.shape[1])), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(s, top, axis=1).ravel())], ["query_id", "vec_id", "score"])

    found = v.join(q, ["part", "dims"]).select("n", "ids", "vectors", "qn", "qids", "qvectors").mapInArrow(best, "query_id long, vec_id long, score double")
    return top_k(found, k, "query_id", "score", "vec_id")


def facets(rows: DataFrame, filters: dict[str, Column], top: int = 20, most: int = 500) -> DataFrame:
    """(facet, value, n, truncated): counts per facet, each ignoring its own filter; the ``top``
    values of each, ties by value, and whether there are more. Where more than ``most`` rows pass
    all filters, n is null."""
    out, all_ = None, rows
    for name, keep in filters.items():
        own, all_ = rows, all_.filter(keep)
        for other, also in filters.items():
            if other != name:
                own = own.filter(also)
        part = own.groupBy(F.col(name).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "value", "n")
        out = part if out is None else out.unionByName(part)
    many = all_.limit(most + 1).count() > most
    facet = Window.partitionBy("facet")
    out = out.withColumn("place", F.row_number().over(facet.orderBy(F.col("n").desc(), F.col("value").asc_nulls_first()))).withColumn("truncated", F.count("*").over(facet) > top)
    return out.filter(F.col("place") <= top).select("facet", "value", F.when(F.lit(not many), F.col("n")).alias("n"), "truncated")
