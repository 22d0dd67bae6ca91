"""Training-data operators against brute force, round trips and edge cases on small tables."""

import hashlib
import json
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from grantloom.llm.common import written
from grantloom.llm import bpe, chat, imatch, mixing, near_dups, pii, quality_rules, registry, substrings, token_counts, url_filter

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", " \t\n", "one", "a b c d", "x " * 60, "Ünïcode é漢字 😀 " * 20, LONG, "same text " * 30, "same text " * 30, "tab\tand\x0bvertical\x0cfeed\r\n" * 5]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, bits string, tokens int")  # columns with clashing names


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, bits string, tokens int")


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# 1: fingerprints


def test_fingerprints(spark, docs, empty):
    got = {r["doc_id"]: r for r in imatch.edited(docs, 0.0, 1.0).collect()}
    order = sorted(range(len(TEXTS)), reverse=True)
    for k, d in enumerate(order):
        t, nxt = TEXTS[d] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        n = len(t)
        assert got[d]["n_chars"] == n
        assert got[d]["edited_sha256"] == sha(t[: n - n // 2] + nxt[: n // 2])
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    assert got[8]["fingerprint"] == got[9]["fingerprint"] and got[9]["near_next"] == 1
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != got[3]["fingerprint"]
    assert imatch.edited(empty).count() == 0 and imatch.fingerprints(empty).count() == 0


def test_next_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "ROWS_PER_RANGE", 7)
    ids = random.Random(1).sample(range(10_000), 150)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in imatch.with_next(df, ["text"]).collect()}
    order = sorted(ids, reverse=True)
    assert got == {d: f"t{order[(k + 1) % len(order)]}" for k, d in enumerate(order)}


def xx(x, seed=42) -> int:
    """Spark's xxhash64 of a string or a 32-bit number, as a signed number."""
    h = xxhash.xxh64(x.encode() if isinstance(x, str) else struct.pack("<i", x), seed=seed % 2**64).intdigest()
    return h - 2**64 if h >= 2**63 else h


def test_fingerprints_against_brute_force(spark, corpus):
    terms = lambda t: {x for x in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower(), flags=re.ASCII)}
    df = Counter(x for _, t in corpus for x in terms(t) if x)
    lex = {x for x, n in df.items() if imatch.LOW * len(corpus) <= n <= imatch.HIGH * len(corpus)}

    def brute(t):
        found = sorted(terms(t) & lex)
        parts = []
        for k, one in enumerate(imatch.KEEP_ONE_IN):
            own = [x for x in found if xx(k, xx(x)) % one == 0]
            parts.append(f"{xx(' '.join(own)) % 65536:04x}" if own else "----")
        return "".join(parts) + ("" if found else f"{xx(' '.join(sorted(terms(t)))) % 2**64:x}")

    def alike(a, b):
        each = [(a[k * 4 : k * 4 + 4], b[k * 4 : k * 4 + 4]) for k in range(len(imatch.KEEP_ONE_IN))]
        either = [x for x in each if x != ("----", "----")]
        return 1.0 if a == b else sum(x == y for x, y in either) / len(either) if either else 0.0

    text = dict(corpus)
    order = sorted(text, reverse=True)
    got = {r["doc_id"]: r for r in imatch.edited(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert {x["term"] for x in imatch.lexicon(spark.createDataFrame(corpus, "doc_id long, text string")).collect()} == lex
    for k, d in enumerate(order):
        t, nxt = text[d], text[order[(k + 1) % len(order)]]
        fp, efp = brute(t), brute(t[: len(t) - len(t) // 2] + nxt[: len(t) // 2])
        assert (got[d]["fingerprint"], got[d]["edited_fingerprint"]) == (fp, efp)
        assert abs(got[d]["near_edited"] - alike(fp, efp)) < 1e-9 and abs(got[d]["near_next"] - alike(fp, brute(nxt))) < 1e-9


def test_fingerprints_of_repeated_and_null_ids(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(1, t), (1, t), (1, "other words"), (None, t), (None, None), (2, "x" * 100_000)], "doc_id long, text string")
    got = imatch.edited(df, 0.0, 1.0).collect()
    assert len(got) == 6 and len({r["fingerprint"] for r in got if r["n_chars"] == len(t)}) == 1


# 2: mixing


def test_mixing(spark, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    none = labels.limit(0)
    assert mixing.mix(empty, none).count() == 0 and mixing.mix(empty, none, keep=True).count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "a b", "z")], "doc_id long, text string, rate string")
    assert set(mixing.mix(odd, none).columns) == {"doc_id", "text", "rate"}


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_shares_against_a_solver(spark, sf):
    """The shares that op2 reaches, against nonnegative least squares in memory on the given targets;
    tokens stay within a fifth of the budget."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    df, t, p, r = mixing.mixed(docs, spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet"))
    told = {x["domain"]: x for x in mixing.report(df, t, p, r).collect()}
    rows = df.select(t, p, r).collect()
    w, q, rate = np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    goal = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * w.sum()
    best = solved(w, q, goal)
    want, got = (q.T @ (w * x) for x in (best, rate))
    assert rate.min() >= 0 and np.abs(want / want.sum() - got / got.sum()).max() < 0.01 and got.sum() < 1.2 * w.sum()
    assert all(abs(told[d]["share"] - got[k] / got.sum()) < 1e-6 and told[d]["target"] == mixing.TARGETS[d] for k, d in enumerate(mixing.DOMAINS))
    assert abs(got[1] / got.sum() - 0.05) < 0.01  # within reach; a toxic share of 0 is not


def solved(w, p, goal, steps=20_000):
    """Rates of 0 or more with the least distance from the goal, by many plain steps."""
    w, g = w / w.sum(), goal / w.sum()
    metric = mixing.metric_of((p * w[:, None]).T @ p)
    r = look = np.ones(len(w))
    t = 1.0
    for _ in range(steps):
        to = np.maximum(0, look - p @ (metric @ (p.T @ (w * look) - g)))
        if (look - to) @ (w * (to - r)) > 0:
            t = 1.0
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        r, look = to, to + (old - 1) / t * (to - r)
    return r


def brute_distance(tokens, p, goal, floor, rates=None):
    """The least distance from the goal that rates of ``floor`` or more can reach (or that of
    ``rates``), by many plain projected gradient steps in memory."""
    w, p, g = np.array(tokens) / sum(tokens), np.array(p), np.array(goal) / sum(tokens)
    metric = mixing.metric_of((p * w[:, None]).T @ p)
    distance = lambda r: float((p.T @ (w * r) - g) @ metric @ (p.T @ (w * r) - g)) ** 0.5
    if rates is not None:
        return distance(np.array(rates))
    r = look = np.ones(len(w))
    t = 1.0
    for _ in range(20_000):
        to = np.maximum(floor, look - p @ (metric @ (p.T @ (w * look) - g)))
        if (look - to) @ (w * (to - r)) > 0:
            t = 1.0
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        r, look = to, to + (old - 1) / t * (to - r)
    return distance(r)


def test_rates_meet_reachable_targets(spark):
    rows = [(float(10 + i % 7), [0.9, 0.1] if i % 3 else [0.2, 0.8]) for i in range(60)]
    df = spark.createDataFrame(rows, "tokens double, p array<double>")
    now = [sum(t * p[k] for t, p in rows) for k in (0, 1)]
    goal = [now[0] * 1.2, now[1] * 0.9]
    rate = mixing.fit_rates(df, goal)
    assert all(abs(x) < 1e-6 * sum(goal) for x in mixing.residuals(df, rate, goal))


def test_rates_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        x = [0.97, 0.01, 0.02] if i % 20 else [0.1, 0.8, 0.1] if i % 40 else [0.0, 0.0, 1.0]
        x = [v * rnd.uniform(0.5, 1.5) for v in x]
        rows.append((float(rnd.randint(5, 500)), [v / sum(x) for v in x]))
    df = spark.createDataFrame(rows, "tokens double, p array<double>").coalesce(1)
    tokens, p = zip(*rows, strict=True)
    now = [sum(t * x[k] for t, x in rows) for k in range(3)]
    for goal, floor in [([now[0] * 1.3, now[1] * 1.4, now[2] * 0.5], 0.0), ([now[0] * 1.3, now[1] * 1.4, 0.0], 0.0), ([now[0] * 1.2, now[1] * 3, now[2]], 1.0)]:
        rate = mixing.fit_rates(df, goal, floor=floor, rewrite=16)
        rates = [r[0] for r in df.selectExpr(f"{rate} as r").collect()]
        best = brute_distance(tokens, p, goal, floor)
        # out of reach the steps come down slowly, see the docstring
        assert min(rates) >= floor and brute_distance(tokens, p, goal, floor, rates) <= (1.01 if best < 1e-3 else 1.5) * best + 5e-4
        if best < 1e-3:
            assert all(abs(x) < 1e-4 * sum(tokens) for x in mixing.residuals(df, rate, goal))


def test_posteriors_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = mixing.fit(docs, labels, z=3.0)
    punct = r"!-/:-@\[-`{-~"
    terms = lambda t: ({x for x in re.split(rf"[\s{punct}]+", t.lower())} | {x for x in re.split(rf"[^{punct}]+", t)}) - {""}
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    domain = {r["doc_id"]: "toxic" if r["toxic"] else "good" if r["quality"] else "poor" for r in labels.collect() if r["doc_id"] in text}
    n, seen = Counter(domain.values()), {d: Counter() for d in mixing.DOMAINS}
    for d, k in domain.items():
        seen[k].update(terms(text[d]))
    total = sum(n.values())
    want = {}
    for t in set().union(*seen.values()):
        c = [seen[d][t] for d in mixing.DOMAINS]
        share = sum(c) / total
        if max(abs(x - n[d] * share) / (n[d] * share * (1 - share) + 0.5) ** 0.5 for x, d in zip(c, mixing.DOMAINS, strict=True)) >= 3:
            want[t] = [np.log((x + 0.5) / (n[d] + 1)) - np.log((sum(c) + 0.5) / (total + 1)) for x, d in zip(c, mixing.DOMAINS, strict=True)]
    assert set(model["words"]) == set(want) and all(np.allclose(model["words"][t], w, atol=1e-3) for t, w in want.items())
    for r in mixing.with_posterior(docs, model, "text", "p").collect():
        s = np.array(model["prior"]) + sum((np.array(model["words"][t]) for t in terms(r["text"] or "") if t in want), np.zeros(3))
        e = np.exp(np.maximum(s - s.max(), -50))
        assert np.allclose(r["p"], e / e.sum(), atol=1e-4)


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    df, t, p, r = mixing.mixed(docs, labels, keep=True)
    rows = df.select("doc_id", t, p, r).collect()
    toxic = {x["doc_id"]: x["toxic"] for x in labels.collect()}
    assert all(x[3] >= 1 if toxic.get(x[0], x[2][2] >= 0.99) == 0 else x[3] == 0 for x in rows)
    now, after = [np.array([sum(x[1] * x[2][k] * x[3] ** n for x in rows) for k in range(3)]) for n in (0, 1)]
    told = {x["domain"]: (x["before"], x["after"]) for x in mixing.report(df, t, p, r).collect()}
    assert all(np.allclose(told[d], (now[k], after[k])) for k, d in enumerate(mixing.DOMAINS))
    stay = [x for x in rows if x[3] and x[1]]
    goal = np.array([0.95, 0.05, 0.0]) * mixing.HEADROOM * max(now[0] / 0.95, now[1] / 0.05)
    goal = np.maximum(goal, mixing.HEADROOM * np.array([sum(x[1] * x[2][k] for x in stay) for k in range(3)]))
    best = brute_distance([x[1] for x in stay], [x[2] for x in stay], goal, 1.0)
    assert brute_distance([x[1] for x in stay], [x[2] for x in stay], goal, 1.0, [x[3] for x in stay]) <= 1.01 * best + 5e-4
    kept = {x["doc_id"] for x in mixing.mix(docs, labels, keep=True).select("doc_id").collect()}
    assert {x[0] for x in rows if toxic.get(x[0]) == 0} <= kept and not any(toxic.get(d) for d in kept)
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "the text of a row without id"), (1, "x y z"), (1, "x y z")], "doc_id long, text string"))
    assert mixing.mix(odd, labels, keep=True).filter("doc_id is null").count() >= 1


# 3: URLs


def test_urls(spark):
    urls = [None, "no scheme", "http://EXAMPLE.net/en/a?q#f", "https://x.net", "https://a.net/", "http://www.example.com/de/1", "http://example.com/fr/", "ftp://b.org/fr/x", "http://notexample.net/en/", "http://é.org/FR/", "http://casino-bets.example/win", "http://library.example/en/12"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, f string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.train(url_filter.labelled_urls(spark))).collect()}
    assert got[0][:3] == got[1][:3] == ("", "", None)
    assert got[2] == ("example.net", "/en/a", "example.net/en/", "allow")
    assert got[3][:3] == ("x.net", "", None) and got[4] == ("a.net", "/", "net/", "block")
    assert got[5][2:] == ("example.com/de/", "block") and got[6][2] is None and got[7][2:] == ("org/fr/", "allow") and got[8][2:] == ("net/", "block") and got[9][2] is None
    model = url_filter.train(url_filter.labelled_urls(spark))
    nothing = url_filter.train(url_filter.labelled_urls(spark).limit(0), rounds=1)
    assert {r["verdict"] for r in url_filter.judge(pages, nothing, []).collect()} == {"allow"}


def test_url_classifier(spark):
    train, held_out = url_filter.folds(url_filter.labelled_urls(spark))
    assert train.count() + held_out.count() == url_filter.labelled_urls(spark).count() and held_out.count() >= 30
    precision, recall = url_filter.precision_recall(held_out, url_filter.train(train))
    assert precision >= 0.8 and recall >= 0.75
    w, b = url_filter.train(url_filter.labelled_urls(spark))
    unwanted = F.col("url").rlike("casino-win|free-bets|ads-track|spam-farm|cheap-pills|adult-x").cast("int")
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url", unwanted.alias("label"))
    precision, recall = url_filter.precision_recall(pages, (w, b))
    assert precision >= 0.9 and recall >= 0.9

    def brute(host, path):
        f = set()
        for c, x in (("host", f"^{host}$"), ("path", f"^{path}$")) if host or path else ():
            f |= {xx(x[i : i + n], xx(c)) % url_filter.BUCKETS for n in url_filter.SIZES for i in range(max(len(x) - n + 1, 1))}
        return 1 / (1 + np.exp(-b - sum(w[i] for i in f) / max(len(f), 1) ** 0.5))

    odd = spark.createDataFrame([(1, None), (2, "http://a"), (3, "http://" + "b" * 50_000 + "/x"), (3, "http://É.example/ÀÉ?q"), (None, "https://x.example/")], "page_id long, url string")
    for r in url_filter.judge(pages.select(F.lit(1).alias("page_id"), "url").limit(200).union(odd), (w, b)).collect():
        assert abs(r["p_unwanted"] - brute(r["host"], r["path"])) < 1e-3


# 4: chats


def test_chat_round_trip(spark):
    nasty = ["<|im|>", "%3C|im:user|%3E", "[INST] a [/INST] </s>", "%", None, "line\nbreak", "%253C<|im:x|>"]
    rows = [(c, k, ["user", "assistant"][k % 2], t, "x") for c in range(3) for k, t in enumerate(nasty)] + [(9, 0, "assistant", "starts wrong", "x"), (10, 0, "we|ird <role>", None, "x"), (10, 0, None, "b", "x"), (None, None, "user", "z", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for c in range(3):
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(["user", "assistant"][k % 2], t or "") for k, t in enumerate(nasty)]
        assert got[c]["loss_text"] == "".join(t or "" for t in nasty[1::2]) and got[c]["valid"]
    assert not got[9]["valid"] and [(t["role"], t["text"]) for t in got[10]["turns"]] == [("", "b"), ("we|ird <role>", "")] and None in got
    assert chat.format_chats(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "<|im|>" * 50_000), (1, 1, "assistant", LONG), (1, 1, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_chats(long)).first()
    assert [t["text"] for t in r["turns"]] == ["<|im|>" * 50_000, LONG, LONG] and r["loss_text"] == LONG + LONG


# 5: BPE


def test_bpe(spark, docs, empty, corpus):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    own = bpe.load(bpe.default_path())
    rnd = random.Random(2)
    texts = [t or "" for t in TEXTS] + [t for _, t in corpus[:60]] + ["<|endoftext|>a<|endoftext|><|endoftext|>", "\U000190c8苰", "'ll 'LL  \x85 \xa0x", "a" * 3000]
    texts += ["".join(rnd.choice(["a", "b", "th", " ", "\n", "'s", "1", ".", "é", "漢", "😀", "<|endoftext|>"]) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.ids(t) == struct.pack(f"<{len(ids)}I", *ids)
        assert own.text(own.ids(t)) == lib.decode(ids, skip_special_tokens=False) == t
    got = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(i, t or "") for i, t in enumerate(TEXTS)]
    assert bpe.round_trip(empty).count() == 0


# 6: substrings


def brute_substrings(rows, n=20):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone[i : i + n] = [True] * n
            seen.add(k)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substrings(spark, docs, empty, corpus):
    rows = list(enumerate(TEXTS)) + [(1000 + d, t) for d, t in corpus] + [(5000, "head " + " ".join(words(corpus[0][1])[:40]) + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.dedup(df).collect()}
    assert got == brute_substrings(rows)
    assert substrings.dedup(empty).count() == 0


def test_substrings_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 3)  # common windows are dealt over several groups
    t, u = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(30))
    rows = [(0, t), (1, "x " + t), (1, "a b"), (1, "a b"), (None, u), (2, u + " " + t), (2, u + " " + t), (None, None)] + [(10 + k, f"h{k} {t} {k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r[:2] for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()]
    brute = brute_substrings([(k, x) for k, (_, x) in enumerate(order)])
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.dedup(df).collect())
    assert got == sorted((d if d is not None else -1, *brute[k]) for k, (d, _) in enumerate(order))
    many = spark.createDataFrame([(k, f"h{k} {t} {k}") for k in range(60)] + [(100, t + " " + t)], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.dedup(many).collect()} == brute_substrings([(r["doc_id"], r["text"]) for r in many.collect()])


def test_words_whose_polynomial_hashes_collide(spark):
    """Thue-Morse words of 1,024 letters have equal polynomial hashes modulo 2^64, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    head = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{head} {a} tail"), (4, f"x {head}  {b}")]
    df = spark.createDataFrame([(*r, 7, "clash", 3) for r in rows], "doc_id long, text string, h1 long, words string, start int")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.dedup(df).collect()}
    assert got == brute_substrings(rows) and got[2][1] == 0 and got[3][2] == "tail" and got[4][2] == "x"


def test_sketch_overestimates_and_grows():
    rng = np.random.default_rng(9)
    h = rng.integers(0, 2**63, 300_000).astype(np.uint64)
    for ranges in (1, 4, 1000):  # as many ranges as keep RANGE_LOAD anchors in each
        for r in range(substrings.ROWS):
            cells = substrings.cells(h, r, ranges)
            part = (cells >> np.uint64(32)).astype(int)
            assert part.min() >= r * ranges and part.max() < (r + 1) * ranges and (cells & np.uint64(2**32 - 1) < substrings.RANGE_CELLS).all()
    h = rng.integers(0, 2**63, substrings.RANGE_LOAD).astype(np.uint64)  # one full range: hardly any single anchor looks repeated
    twice = np.ones(len(h), bool)
    for r in range(substrings.ROWS):
        _, at, n = np.unique(substrings.cells(h, r, 1), return_inverse=True, return_counts=True)
        twice &= n[at] >= 2
    assert twice.mean() < 0.01


# 7: token counts


def test_token_counts(spark, docs, empty):
    edits = spark.createDataFrame([(i, s, a, n, x) for i in range(len(TEXTS)) for s, a, n, x in [(1, 0, 3, "new "), (2, 5, 0, None), (3, 10**6, 5, " end's")]] + [(99, 1, 0, 0, "?")], "doc_id long, seq int, start int, n_del int, insert string")
    own = bpe.load(bpe.default_path())
    count = lambda t: len(own.ids(t, special=False)) // 4
    for r in token_counts.recount(docs, edits).collect():
        t = TEXTS[r["doc_id"]] or ""
        after = "new " + t[3:]
        assert (r["n_tokens"], r["n_tokens_edited"], r["n_edits"]) == (count(t), count(after + " end's"), 3)
    assert token_counts.recount(empty, edits).count() == 0


def test_count_trees_at_random(monkeypatch):
    own, rnd = bpe.load(bpe.default_path()), random.Random(3)
    parts = ["a", "the ", "re", " ", "  ", "\n", "'", "'s", "'ll", "1", ".", "é", "\t", "x y"]
    for half in (1, 2, 5, 128):
        monkeypatch.setattr(token_counts, "HALF", half)
        for _ in range(600):
            t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
            tree = token_counts.CountTree(t, own)
            for _ in range(5):
                s, n, x = rnd.randint(0, len(t)), rnd.randint(0, rnd.choice([2, 5, 60])), "".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 4, 30])))
                tree.edit(s, n, x)
                t = t[:s] + x + t[s + n :]
                assert tree.tokens == len(own.ids(t, special=False)) // 4 and tree.text == t
                # leaves stay pre-tokens, and every sum is that of its leaves
                assert tree.leaves() == token_counts.leaves_of(t, own) and tree.sums[1] == sum(tree.leaves())
                assert all(len(b) <= 2 * half for b in tree.blocks)


def test_edits_encode_their_surroundings_only():
    own = bpe.load(bpe.default_path())
    tree = token_counts.CountTree("word " * 50_000, own)
    for k in range(20):
        before = tree.encoded
        tree.edit(1000 * k + 2, 3, "x")
        assert tree.encoded - before <= 5
    before = tree.encoded
    tree.edit(70_001, 0, "new text " * 20_000)  # a large insert becomes leaves of its own
    assert 40_000 <= tree.encoded - before <= 40_005
    for k in range(20):
        before = tree.encoded
        tree.edit(80_000 + 5 * k, 1, "yy")
        assert tree.encoded - before <= 5
    assert tree.tokens == len(own.ids(tree.text, special=False)) // 4


def test_leaves_are_kept_per_vocabulary_in_two_generations(monkeypatch, tmp_path):
    own, text = bpe.Bpe(bpe.default_path()), "the words of the text"
    (tmp_path / "bytes.json").write_text(json.dumps({"model": {"vocab": {c: i for i, c in enumerate(bpe.byte_letters())}, "merges": []}}))
    plain = bpe.Bpe(str(tmp_path / "bytes.json"))
    tokens = lambda v: sum(token_counts.leaves_of(text, v)) % token_counts.ONE
    assert tokens(own) == len(own.ids(text)) // 4 < tokens(plain) == len(text)
    # what was met in the generation before is not encoded again
    monkeypatch.setattr(token_counts, "LEAVES", 4)
    fresh, encoded = bpe.Bpe(bpe.default_path()), []
    monkeypatch.setattr(fresh, "encode_bytes", lambda w: encoded.append(w) or own.encode_bytes(w))
    for t in ("a b c", "d e a", "b c f", " e a"):
        assert token_counts.leaves_of(t, fresh) == token_counts.leaves_of(t, own)
    assert sorted(encoded) == sorted({w for t in ("a b c", "d e a", "b c f") for w in map(str.encode, own.pre_tokens(t))}) and len(fresh.leaves_kept) < 4


def test_stored_trees(spark, docs, empty):
    own = bpe.load(bpe.default_path())
    kept = written(token_counts.trees(docs), "trees")
    edit = "doc_id long, seq int, start int, n_del int, insert string"
    first = spark.createDataFrame([(i, 1, 3, 2, "new words ") for i in range(len(TEXTS))], edit)
    second = spark.createDataFrame([(i, 1, 5, 1, "'ll") for i in range(0, len(TEXTS), 2)] + [(None, 1, 0, 9, "z")], edit)
    once = written(token_counts.apply(kept, first), "trees")
    twice = {r["doc_id"]: r for r in token_counts.apply(once, second).collect()}
    for i, t in enumerate(TEXTS):
        t = (t or "")[:3] + "new words " + (t or "")[5:]
        if i % 2 == 0:
            t = t[:5] + "'ll" + t[6:]
        r = twice[i]
        assert r["text"] == t and r["n_tokens_edited"] == sum(r["leaf_tokens"]) == len(own.ids(t, special=False)) // 4
        assert sum(r["leaf_chars"]) == len(t) and r["n_encoded"] <= 12 and r["n_edits"] == (i % 2 == 0)
    assert token_counts.apply(token_counts.trees(empty), first).count() == 0


# 8: near duplicates


def brute_classes(rows, least=0.8):
    sets, parent = {}, {d: d for d, _ in rows}
    for d, t in rows:
        w = words(t)
        n = min(5, len(w))
        seen = Counter()
        for i in range(len(w) - n + 1 if n else 0):  # the k-th occurrence of a shingle is an item of its own
            g = tuple(w[i : i + n])
            seen[g] += 1
            sets.setdefault(d, set()).add((g, seen[g]))
        sets.setdefault(d, set())

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for d, s in sets.items():
        for g in s or ["none"]:
            by.setdefault(g, []).append(d)
    for d, s in sets.items():
        for x, n in Counter(x for g in s or ["none"] for x in by[g] if x < d).items():
            if not s or n >= least * (len(s) + len(sets[x]) - n):
                a, b = top(d), top(x)
                parent[max(a, b)] = min(a, b)
    return {d: top(d) for d in parent}


def test_near_duplicates(spark, docs, empty, corpus):
    rnd = random.Random(4)
    hub = [f"w{i}" for i in range(150)]
    copies = []
    for k in range(120):  # a group whose members mostly resemble the hub only
        w = list(hub)
        for _ in range(rnd.choice([1, 2, 3])):
            w[rnd.randrange(len(w))] = f"x{k}"
        copies.append((9000 + k, " ".join(w)))
    rows = list(enumerate(TEXTS)) + [(1000 + d, t) for d, t in corpus] + copies + [(9500, " ".join(hub))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dups.classes(df).collect()} == brute_classes(rows)
    assert near_dups.classes(empty).count() == 0
    again = df.union(spark.createDataFrame([(9000, "other words entirely here now " * 3), (9001, copies[1][1]), (None, copies[2][1]), (None, "nothing like it")], df.schema))
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), (-1 if r["class_id"] is None else r["class_id"])) for r in near_dups.classes(again).collect())
    ids = [r["doc_id"] for r in again.collect()]
    of = brute_classes([(k, r["text"]) for k, r in enumerate(again.collect())])
    least = {c: min((ids[k] for k in of if of[k] == c and ids[k] is not None), default=-1) for c in of.values()}
    assert got == sorted((-1 if ids[k] is None else ids[k], least[c]) for k, c in of.items())


def test_one_of_each_class(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "p"), (2, b, "q"), (5, a, "r"), (5, b, "s"), (5, c, "t"), (None, c, "u"), (7, c + " more", "v")]
    kept = near_dups.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()
    assert sorted(r["row"] for r in kept) == ["p", "q", "u"]
    assert {r["row"] for r in near_dups.one_of_each(spark.createDataFrame(rows[:2] + rows[-1:], "doc_id long, text string, row string")).collect()} == {"p", "q", "v"}


def test_blocks_of_chains(spark, monkeypatch):
    rnd = random.Random(12)
    rows = []
    for g in range(3):  # chains: neighbours resemble each other, the ends do not
        w = [f"g{g}w{i}" for i in range(120)]
        for k in range(60):
            w[rnd.randrange(len(w))] = f"x{g}.{k}"
            rows.append((g * 100 + k, " ".join(w)))
    rows += [(900 + k, "top words " + " ".join(f"z{i % 7}" for i in range(40 + k)) + f" end{k}") for k in range(20)]  # counts matter
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    for block in (3, 64):
        monkeypatch.setattr(near_dups, "BLOCK", block)
        assert {r["doc_id"]: r["class_id"] for r in near_dups.classes(df).collect()} == want


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    e = rng.integers(0, 2**62, 400).astype(np.uint64)
    a, b = rng.random(400) * 4, rng.random(400) * 4
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((near_dups.darts(e, a, 1500) == near_dups.darts(e, b, 1500)).mean() - true) < 0.06
    assert (near_dups.darts(e, a, 192) == near_dups.darts(e, a, 192)).all() and not near_dups.darts(e[:0], a[:0], 8).any()


# 9: quality rules


def brute_repeats(t):
    w = words(t)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def test_quality(spark, docs, empty, corpus):
    df = docs.select("doc_id", "text", "bits").union(spark.createDataFrame([(1000 + d, t, "") for d, t in corpus], "doc_id long, text string, bits string"))
    text = dict(enumerate(TEXTS)) | {1000 + d: t for d, t in corpus}
    led = quality_rules.ledger(df).collect()
    for r in led:
        w, lines = words(text[r["doc_id"]]), [x for x in (text[r["doc_id"]] or "").split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), brute_repeats(text[r["doc_id"]]), len(lines) - len(set(lines)))
    kept = quality_rules.apply_policy(df, "v1")
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in led if r["bits"] == 0}
    ab = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality_rules.ablation(quality_rules.ledger(df)).collect()}
    for k, (rule, _) in enumerate(quality_rules.RULES):
        assert ab[rule] == (sum(r["bits"] >> k & 1 for r in led), sum(r["bits"] == 1 << k for r in led))
    base = {r["rule"]: r["n_only"] for r in quality_rules.ablation(quality_rules.ledger(df), "base").collect()}
    assert base == {"few_words": sum(r["bits"] & 3 == 1 for r in led), "repeated_phrases": sum(r["bits"] & 3 == 2 for r in led)}
    assert quality_rules.ledger(empty).count() == 0


def test_filters_above_the_ledger_stay_above_the_measurements(spark, corpus):
    led = quality_rules.ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    plain = len(led._jdf.queryExecution().optimizedPlan().toString())
    for df in (led.filter("bits = 0"), led.filter("n_repeat_words > 9 and bits & 2 = 0"), led.groupBy("bits").count(), led.alias("a").join(led.alias("b"), "doc_id")):
        assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 3 * plain
    assert led.filter("bits = 0").count() == sum(r["bits"] == 0 for r in led.collect())


# 10: personal data

FIXED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(t):
    def good(k, s):
        digits = [c for c in s if c.isdigit()]
        if k == "card":
            odd = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
            return 14 <= len(digits) <= 19 and odd % 10 == 0
        return k == "email" or (all(int(p.lstrip("0")[:4] or "0") < 256 for p in s.split(".")) if k == "ip" else 10 <= len(digits) <= 15)

    return sorted(((m.start(), m.end(), k) for k, p in FIXED.items() for m in re.finditer(p, t) if good(k, m[0])), key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_base_spans_at_random():
    rnd = random.Random(6)
    for _ in range(5000):
        t = "".join(rnd.choice(rnd.choice(["aB.@-_%+ ", "0123456789 .-", "12.34@", "+1 ()-.5", "é😀@.a1"])) for _ in range(rnd.randint(0, 70)))
        assert pii.base_spans(t) == brute_base(t)


@pytest.mark.parametrize("n", [4_299, 5_000, 1_000_000])
def test_long_runs_of_digits(spark, n):
    texts = {f"{c * n}{rest}": [(0, n + len(rest), "ip")] if c == "0" and rest == ".1.1.1" else [] for c in "01" for rest in (".1.1.1", ".1.1", ".1.256.1")}
    texts |= {f"1.1.1.{'0' * n}": [(0, n + 6, "ip")], f"1.{'0' * n}255.3.4 and 1.{'0' * n}256.3.4": [(0, n + 9, "ip")], f"+1{'0' * n}": [], f"+1{' ' * n}234567890": [(0, n + 11, "phone")], f"{'7' * n}@a.bc": [(0, n + 5, "email")]}
    for t, spans in texts.items():
        assert pii.base_spans(t) == spans
        if n <= 5_000:  # the plain patterns are quadratic
            assert brute_base(t) == spans
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["base"]] for r in pii.find(df, None).collect()} == dict(enumerate(texts.values()))
    assert pii.redact(df.filter("doc_id = 0"), None).first()["text"] == "<ip>"


def test_pii_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "mail a@b.cc"), (1, "mail a@b.cc"), (None, "ip 1.2.3.4")], "doc_id long, text string")
    assert sorted(len(r["base"]) for r in pii.find(df, pii.fit(df)).collect()) == [1, 1, 1]


def test_pii(spark, docs, empty):
    rows = [(i, f'call +1 (212) 555-{1000 + i} or x{i}@mail.example.com, token = "{sha(str(i))[:40]}" end {i}', "keep") for i in range(40)] + [(99, None, "k"), (100, "", "k"), (101, "number 4845168114407321 here", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = pii.fit(df)
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in pii.find(df, model).collect()}
    assert all({k for _, _, k in got[i]} == {"phone", "email", "secret"} for i in range(40)) and not got[99] and not got[100]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df, model).collect()}
    assert clean[3] == 'call <phone> or <email>, token = "<secret>" end 3' and clean[99] is None and clean[100] == ""
    assert pii.fit(empty) is None and pii.find(empty, None).count() == 0


def test_numbers_before_full_stops_and_long_secrets(spark):
    for t, span in [("call 212-555-1234.", "212-555-1234"), ("it is 123-45-6789. Next", "123-45-6789"), ("(212) 555-1234.", "(212) 555-1234"), ("ring 212.555.1234.", "212.555.1234"), ("id 212 555 1234 35.5", "212 555 1234")]:
        assert [t[s:e] for s, e, _ in pii.candidates(t, [])] == [span]
    began, many = time.process_time(), "call 212-555-1234 or a@b.cc, " * 40_000
    assert len(pii.candidates(many, pii.base_spans(many))) == 40_000 and time.process_time() - began < 20
    for n in (16, 256, 257, 300, 5000, 200_000):
        for c in ("aB3", "a3", "B3"):
            t = f"token = {(c * n)[:n]}."
            assert pii.candidates(t, []) == [(8, 8 + n, "secret")] and len(pii.votes(t, 8, 8 + n)) == len(pii.LABELERS)
    old = re.compile(r"[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*[A-Z][A-Za-z0-9_-]*[a-z][A-Za-z0-9_-]*")
    rnd = random.Random(8)
    for _ in range(5000):
        t = "".join(rnd.choice("aB3-.") for _ in range(rnd.randint(1, 9)))
        assert bool(pii.STRICT.fullmatch(t)) == bool(old.fullmatch(t) or re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", t))
    long = "".join(sha(f"{k}") for k in range(5))[:300]
    rows = [(i, f"My phone 212-555-{1000 + i}. The ssn is 123-45-{6000 + i}. password: {long[i:] + long[:i]} end") for i in range(40)]
    rows += [(99 + i, f"See section {10 + i} 22 33 and page 11 {20 + i} of version 11.11.11 text") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["text"] for r in pii.redact(df, pii.fit(df)).filter("doc_id < 99").collect()} == {"My phone <number>. The ssn is <number>. password: <secret> end"}


def test_added_spans_of_the_documents(spark):
    """Secrets are planted as assignments of 40 hexadecimal digits; nothing else is to be added."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    true = {(d, m.start(1), m.end(1)) for d, t in text.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    added = {(r["doc_id"], s["start"], s["end"]) for r in pii.find(docs, pii.fit(docs)).collect() for s in r["spans"] if s["kind"] not in pii.BASE}
    assert len(added & true) >= 0.95 * len(true) and len(added & true) >= 0.9 * len(added)


# the pipeline


def test_pipeline(spark, corpus):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        seen[name] = docs
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"] for r in seen["quality rules"].collect()}
    assert kept == {r["doc_id"] for r in quality_rules.ledger(spark.read.parquet(f"{SF}/documents.parquet")).filter("bits = 0").collect()}
    classes = brute_classes([(d, t) for d, t in corpus if d in kept])
    assert {r["doc_id"] for r in seen["near duplicates"].collect()} == {d for d, c in classes.items() if d == c}
    texts = {r["doc_id"]: r["text"] for r in seen["mixing"].collect()}
    for r in seen["bpe"].collect():
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]])
    assert not any(brute_base(t) for t in texts.values())


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES) == list(range(1, 14))
