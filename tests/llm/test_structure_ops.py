"""Operators 11 to 13 against brute force and their SQL, on small tables with every edge case."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from grantloom.llm import conversation_repair, divergence, embedding_dups, hashing

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def rows_of(df, *columns):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


# 11: source divergence


def brute_divergence(docs, least, top=10):
    counts, found, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(ASCII_LOWER))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(terms)
        found[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in found[lang].items() if n >= least]
        mine = sorted(s for x, s in groups if x == lang)
        own = {s: {t: counts[lang, s][t] for t in kept} for s in mine}
        every = {t: sum(own[s][t] for s in mine) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}
        p, q = {s: share(own[s]) for s in mine}, share(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found_items, limit in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(found_items)[:limit])]
    return sorted(out)


COLUMNS11 = ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("tile,block,columns", [(64, (1024, 128), 2048), (3, (8, 4), 5)])
def test_divergence_against_brute_force(spark, monkeypatch, tile, block, columns):
    for name, value in (("TILE", tile), ("BLOCK", block), ("COLUMNS", columns), ("ENTRIES", 40)):
        monkeypatch.setattr(divergence, name, value)
    r = random.Random(3)
    words = ["a", "B", "Été", "naïve", "漢字", "don't", "x1y", "Ünder_score", "É", "é"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(" ".join(r.choices(words, k=r.randint(0, 30))), r.choice(["en", "de"]), f"src{r.randint(0, 8)}") for _ in range(150)]
    docs += [(None, "en", "src0"), ("", "fr", "alone"), ("1 2 3", "fr", "other"), ("only here", "it", None), ("a b", None, "Z"), ("a b", None, "É"), ("x" * 20_000, "en", "src1"), ("a " * 50_000, "en", "src2")]
    docs += [docs[0]] * 5
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "text string, lang string, source string, n int, term string").repartition(3)
    assert rows_of(divergence.audit(df, least=4), *COLUMNS11) == brute_divergence(docs, 4)


def test_divergence_of_little(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.audit(df).count() == 0
    df = spark.createDataFrame([(None, None, None), ("a", None, None)], "text string, lang string, source string")
    assert divergence.audit(df).count() == 0  # one source, no term in ten documents


def test_divergence_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(c.execute(f"select {', '.join(COLUMNS11)} from ({divergence.OP11_SQL})").fetchall())
    assert rows_of(divergence.op11_source_divergence(spark, sf), *COLUMNS11) == want


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, v = 3 * 10**15, 10**16, 10**6
    got = spark.range(1).select(F.expr(divergence.share(f"{n}L", f"{total}L", f"{v}L"))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


# 12: conversation repair

COLUMNS12 = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def brute_repair(conversations):
    """The definition, by a table of whole strings over rows and states."""
    convs = defaultdict(list)
    for conv, turn, role, text in conversations:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = convs[conv]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in rows:
            last = (re.findall("[^\x20\x09-\x0d]", text) or [""])[-1]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        step = lambda state, x: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, x))
        best = {"": (0, "", ())}  # state: cost, audit, repaired rows

        def put(to, state, x):
            if state is not None and (state not in to or x[:2] < to[state][:2]):
                to[state] = x

        def insert(to):
            for _ in range(3):
                for state, (c, a, done) in list(to.items()):
                    for x, role in (("u", "user"), ("a", "assistant")):
                        put(to, step(state, x), (c + 5, a + "I", (*done, f"{role}:")))

        insert(best)
        for (_, role, text), fault in zip(rows, faults):
            after = {}
            for state, (c, a, done) in best.items():
                put(after, state, (c + 2, a + "D", done))
                if fault not in ("blank", "duplicate"):
                    fee = 5 if fault == "truncated" else 0
                    put(after, step(state, role[:1]), (c + fee, a + "K", (*done, f"{role}:{text}")))
                    for x, other in (("u", "user"), ("a", "assistant")):
                        put(after, step(state, x), (c + fee + 1, a + "R", (*done, f"{other}:{text}")))
            best = after
            insert(best)
        cost, audit, done = min(best[s] for s in ("", "a") if s in best)
        n = Counter(faults)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def random_conversations(seed, n):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unicorn", "User"]
    texts = ["Yes.", "No", "What?", "", " \t", None, "Fine! ", "é。", "...", "x\n"]
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, 9)):
            rows += [(conv, None if r.random() < 0.05 else turn + (r.random() < 0.1), r.choice(roles), r.choice(texts) if r.random() < 0.7 else f"text {r.random()}.")] * (2 if r.random() < 0.05 else 1)
    return rows + [(None, 1, "user", "Hi."), (None, None, "assistant", "Hi."), (7, 10**12, "user", "far.")]


@pytest.mark.parametrize("whole,parts", [(1000, 1), (1000, 7), (2, 5)])
def test_repair_against_brute_force(spark, monkeypatch, whole, parts):
    monkeypatch.setattr(conversation_repair, "WHOLE", whole)
    rows = random_conversations(whole + parts, 300)
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, key string, n int")
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(conversation_repair.repair(df), *COLUMNS12) == brute_repair(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0]), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_one_long_conversation_over_many_tasks(spark):
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), f"{r.random()}" + r.choice([".", "", ".", "?"])) for t in range(3000)]
    rows += [(1, 50, "user", "again and again.")] * 500 + [(2, 0, "user", "x." * 600_000), (2, 1, "assistant", "y.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    assert rows_of(conversation_repair.repair(df), *COLUMNS12) == brute_repair(rows)


def test_survivors_settle(spark):
    """Edits leave memory once all survivors share an ancestor."""
    told = []
    path = conversation_repair.Survivors(conversation_repair.START, told.append)
    longest = 0
    for k in range(5000):
        path.row("ua"[k % 2], k % 50 == 0)
        longest = max(longest, max(len(x[2]) for x in path.ends()))
    assert longest < 60 and sum(map(len, told)) > 4900


def test_repair_sql_and_empty(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = sorted(c.execute(f"select {', '.join(COLUMNS12)} from ({conversation_repair.OP12_SQL})").fetchall())
    assert rows_of(conversation_repair.op12_conversation_repair(spark, sf), *COLUMNS12) == want
    assert conversation_repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 13: embedding near-duplicates


def brute_vectors(rows, threshold=0.98):
    """(vec_id, n_links, component_id) per row, in the rows' order."""
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    good = [bool(v) and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, v, _), g in zip(rows, good)]
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    ids = defaultdict(list)
    for i in range(len(rows)):
        ids[top(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(rows[i][0], links[i], least[top(i)]) for i in range(len(rows))]


def vectors(seed):
    r = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        for _ in range(12):
            base = r.standard_normal(16)
            for _ in range(r.integers(1, 6)):
                rows.append((base + r.standard_normal(16) * r.choice([0, 0.02, 0.12, 0.2]), label))
    crowd = r.standard_normal(16)
    rows += [(crowd + r.standard_normal(16) * 0.09, 1) for _ in range(90)] + [(crowd, 1)] * 20 + [(crowd, 2)] * 3
    out = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    n = len(out)
    odd = [None, [], [0.0] * 16, [1.0, None], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0], [2.0], [-0.0, 1.0], [0.0, 3.0]]
    return out + [(n + i, v, 1) for i, v in enumerate(odd)] + [(n + 50, out[0][1], None), (n + 51, out[0][1], None)]


@pytest.mark.parametrize("block", [256, 16])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dups, "BLOCK", block)
    rows = vectors(block)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, n int, t int")
    want = [(i, n, c, i == c) for i, n, c in brute_vectors(rows)]
    assert rows_of(embedding_dups.near_vectors(df), "vec_id", "n_links", "component_id", "kept") == sorted(want)
    assert any(n > block for _, n, _, _ in want) or block == 256


def test_vectors_with_repeated_ids(spark):
    rows = [(None if i % 7 == 0 else i // 3, v, label) for i, v, label in vectors(1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_dups.near_vectors(df)
    assert rows_of(got, "vec_id", "n_links", "component_id") == sorted(brute_vectors(rows), key=lambda r: tuple((x is None, x or 0) for x in r))
    assert got.filter("kept").count() == len({id for id in component_labels(rows)})
    assert embedding_dups.near_vectors(df.limit(0)).count() == 0


def component_labels(rows):
    """One name per component, by brute force over row numbers."""
    return {c for _, _, c in brute_vectors([(i, v, label) for i, (_, v, label) in enumerate(rows)])}


def test_recall_at_the_threshold():
    """The share of pairs at cosine 0.98 to 0.981 that share a cell in some table."""
    r, pairs = np.random.default_rng(9), 3000
    k, tables = embedding_dups.sizes(1_000_000)
    a = r.standard_normal((pairs, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((pairs, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = r.uniform(0.98, 0.981, (pairs, 1))
    one, two = (embedding_dups.cells(x, k, tables, 0.98) for x in (a, c * a + np.sqrt(1 - c * c) * b))
    assert (one == two).any(axis=1).mean() >= 0.999
    assert (one == embedding_dups.cells(b, k, tables, 0.98)).mean() < 1e-4


def test_only_members_are_shuffled(spark, monkeypatch):
    from grantloom.llm import near_dups

    docs = spark.range(20_000).selectExpr("id * 3 as doc_id", "'x' as text")
    members = docs.filter("doc_id % 60 = 0").select("doc_id")
    kept = near_dups.likely(docs, members)
    assert kept.columns == docs.columns and kept.join(members, "doc_id", "left_semi").count() == 1000 and kept.count() < 1200
    assert near_dups.likely(docs, members.limit(0)).count() == 0
    plans, real = [], near_dups.sets_of
    monkeypatch.setattr(near_dups, "sets_of", lambda df, weighting: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, weighting))
    words = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(12)]
    rows = [(i, words[i // 2] + (" end" if i % 2 else "")) for i in range(24)]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(24)}
    # the likely rows are marked below the exact join, so before the shuffle
    assert "bitmap_construct_agg" in plans[0] and plans[0].index("SortMergeJoin") < plans[0].index("BroadcastHashJoin")


def test_digests_split_one_text_at_a_time():
    batch = pa.record_batch([pa.array(range(200), pa.int64()), pa.array([f"{i} " * 2000 for i in range(199)] + [None], pa.string())], ["doc_id", "text"])
    tracemalloc.start()
    (out,) = hashing.digest_batches([batch])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2_000_000  # 400,000 words as objects take ten times that
    assert out.column("n").to_pylist() == [2000] * 199 + [0] and out.column("words")[5].as_py() == hashing.digest([b"5"] * 2000)


def test_texts_of_near_duplicates_go_to_python_in_small_batches(spark, monkeypatch):
    from grantloom.llm import common, near_dups

    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", {}
    before, real = spark.conf.get(name), common.written

    def recorded(df, table, *rest):
        seen[table] = spark.conf.get(name)
        return real(df, table, *rest)

    for module in (near_dups, hashing):
        monkeypatch.setattr(module, "written", recorded)
    docs = spark.createDataFrame([(i, f"{'a b c d e f g h i j k l m n o p q r s t ' * 5}{i % 3}") for i in range(9)], "doc_id long, text string")
    assert near_dups.classes(docs).count() == 9
    assert {seen[t] for t in ("digests", "bands", "sets", "links")} == {"8m"} and spark.conf.get(name) == before
