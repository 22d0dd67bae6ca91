r"""Personal data (operator 10): fixed patterns plus weakly supervised spans.

*Base spans* (email, ip, card, phone) follow from fixed patterns and checks. *Added spans* (secret,
number, contact) come from weak supervision: a wide pattern proposes candidates, regex, gazetteer
and context labelers vote on each (1, 0 or abstain), expectation-maximisation over the counts of
vote patterns estimates each labeler's reliability and each pattern's probability, and a logistic
regression trained on these probabilities, with features of the span and its surroundings, decides
for every candidate.

The counts of vote patterns cover all documents; they are grouped in Spark and are at most
3^labelers rows. The classifier is fitted on ``sample`` candidates (a documented bound, those with
the smallest hash); its weights are a fixed number of doubles, sent along with the tasks. Texts are
read whole, in two passes of ``mapInArrow`` without a shuffle of texts.

Edge cases: null texts count as empty; repeated rows are judged one by one; without any candidate
the classifier adds nothing; ties in the order of spans go by the order of KINDS; extra columns,
whatever their names, are left behind by :func:`find` and kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.llm.common import documents, read, written

KINDS = ["email", "ip", "card", "phone", "secret", "number", "contact"]
BASE = KINDS[:4]

EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the look-behind changes no match: a match may start inside a run of digits only where one may at its front
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: What proposes added spans. A number may end a sentence; it never ends within a run of digits.
CANDIDATES = {
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}+"),
    "number": re.compile(r"(?<![0-9.+])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,6}+){1,4}(?!\.?[0-9])|(?<![0-9])[0-9]{7,20}(?![0-9])"),
    "contact": re.compile(r"\b[A-Za-z0-9._-]{2,40} ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{2,40}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z]{2,20})+"),
}
MAY_BE = {"secret": re.compile(r"[0-9]"), "number": re.compile(r"[0-9]"), "contact": re.compile(r"\bdot\b")}
#: Words that announce private values.
GAZETTEER = frozenset(
    "account api apikey auth bearer call cell contact credential email fax iban id key login mail mobile passport password"
    " passwd phone pin secret social ssn tel telephone token user whatsapp".split()
)
PUBLIC = frozenset("chapter figure page section table version vol volume year isbn issn step line no".split())
# the last alternative but one takes the first digit, capital and small letter that will do, so that long spans are read once
STRICT = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9a-f]{20,}|[A-Za-z_-]*+[0-9][a-z0-9_-]*+[A-Z][A-Z0-9_-]*+[a-z][A-Za-z0-9_-]*+|.*\b(?:at|dot)\b.*")
DATE = re.compile(r"(?:19|20)[0-9]{2}[ .-][0-9]{1,2}(?:[ .-][0-9]{1,2})?|[0-9]{1,2}[ .-][0-9]{1,2}[ .-](?:19|20)[0-9]{2}|[0-9]{4}-[0-9]{2,4}")
WORD = re.compile(r"[^\W\d_]+")

LABELERS = ["shape", "gazetteer", "assignment", "public_context", "entropy", "run"]
ABSTAIN = "-"
FEATURES = 1 << 10


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, ``@``, host. Each ``@`` is tried with the
    run of letters before it, so that long runs without an ``@`` cost nothing."""
    out, free, at = [], 0, t.find("@")
    while at >= 0:
        s = at
        while s > free and t[s - 1] in EMAIL_LOCAL:
            s -= 1
        m = EMAIL_HOST.match(t, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            free = m.end()
        at = t.find("@", max(at + 1, free))
    return out


def base_spans(t: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order of start, then kind."""
    out = [(s, e, "email") for s, e in emails(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(len(n := p.lstrip("0")) < 4 and int(n or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in t:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def votes(t: str, s: int, e: int) -> str:
    """One letter per labeler: ``1`` private, ``0`` not, ``-`` abstains."""
    span, left = t[s:e], t[max(0, s - 40) : s]
    words = [w.lower() for w in WORD.findall(left)[-3:]]
    h = entropy(span)
    return "".join([
        "0" if DATE.fullmatch(span) else "1" if STRICT.fullmatch(span) else ABSTAIN,
        "1" if GAZETTEER.intersection(words) else ABSTAIN,
        "1" if re.search(r"[:=]\s*[\"']?$", left) else ABSTAIN,
        "0" if words and words[-1] in PUBLIC or re.search(r"[#$€£]\s?$", left) else ABSTAIN,
        "1" if h >= 3.2 and len(span) >= 12 else "0" if h < 2.2 else ABSTAIN,
        "0" if len(set(re.sub(r"\W", "", span))) <= 2 else ABSTAIN,
    ])


def features(t: str, s: int, e: int, kind: str, v: str) -> list[int]:
    """Hashed features of a candidate: kind, votes, length, shape, and the words around it."""
    span, left, right = t[s:e], t[max(0, s - 30) : s], t[e : e + 12]
    shape = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]+", "0", span)))[:12]
    words = [w.lower() for w in WORD.findall(left)[-2:]]
    named = [f"k={kind}", f"l={min(len(span) // 4, 12)}", f"s={shape}", f"b={left[-1:]}", f"a={right[:1]}", f"h={round(entropy(span))}"]
    named += [f"v{j}={x}" for j, x in enumerate(v)] + [f"w={w}" for w in words if w in GAZETTEER or w in PUBLIC]
    return sorted({zlib.crc32(x.encode()) % FEATURES for x in named})


def candidates(t: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Proposed spans that touch no base span and no proposal of an earlier kind. Spans are kept
    in order with the furthest end so far, so a match is tested by one binary search."""
    out: list[tuple[int, int, str]] = []
    for kind, pattern in CANDIDATES.items():
        if MAY_BE[kind].search(t):
            spans = sorted((s, e) for s, e, _ in taken + out)
            starts, ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
            for m in pattern.finditer(t):
                k = bisect_left(starts, m.end())  # so many spans start before the match ends
                if not k or ends[k - 1] <= m.start():
                    out.append((m.start(), m.end(), kind))
    return out


@dataclass
class Model:
    reliability: dict[str, tuple[float, float]]  # labeler: P(votes 1 | private), P(votes 0 | not)
    weights: np.ndarray
    bias: float

    def probability(self, f: list[int]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(self.weights[f].sum())))))


def em(patterns: dict[str, int], rounds: int = 40) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """Probability of ``private`` per vote pattern, and the labelers' reliabilities: independent
    labelers given the truth, with each answer's chance (1, 0, abstain) under either truth."""
    letters = "10" + ABSTAIN
    p = {v: (1 + 2 * v.count("1")) / (2 + 2 * v.count("1") + 2 * v.count("0")) for v in patterns}
    total = sum(patterns.values())
    chance: list[dict[str, list[float]]] = []
    for _ in range(rounds):
        on = sum(n * p[v] for v, n in patterns.items())
        prior = min(max((on + 1) / (total + 2), 0.01), 0.99)
        chance = []
        for j in range(len(LABELERS)):
            table = {x: [0.5, 0.5] for x in letters}
            for v, n in patterns.items():
                table[v[j]][0] += n * p[v]
                table[v[j]][1] += n * (1 - p[v])
            sums = [sum(table[x][k] for x in letters) for k in (0, 1)]
            chance.append({x: [table[x][k] / sums[k] for k in (0, 1)] for x in letters})
        for v in patterns:
            a = math.log(prior) + sum(math.log(chance[j][x][0]) for j, x in enumerate(v))
            b = math.log(1 - prior) + sum(math.log(chance[j][x][1]) for j, x in enumerate(v))
            p[v] = 1 / (1 + math.exp(min(60.0, b - a)))
    return p, {name: (c["1"][0], c["0"][1]) for name, c in zip(LABELERS, chance, strict=False)}


def train(rows: list[tuple[list[int], float]], rounds: int = 200, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilities as targets, full-batch gradient steps."""
    x = np.zeros((len(rows), FEATURES), dtype=np.float32)
    for i, (f, _) in enumerate(rows):
        x[i, f] = 1
    y = np.array([p for _, p in rows], dtype=np.float32)
    w, b = np.zeros(FEATURES, dtype=np.float32), 0.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        w -= rate * (x.T @ g / len(rows) + l2 * w)
        b -= rate * float(g.mean())
    return w.astype(float), b


def fit(docs: DataFrame, sample: int = 5_000) -> Model | None:
    """The labelers' reliabilities from all candidates, the classifier from ``sample`` of them;
    None if there are no candidates at all."""

    def propose(batches):
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                t = t or ""
                for s, e, kind in candidates(t, base_spans(t)):
                    v = votes(t, s, e)
                    rows.append((v, features(t, s, e, kind, v), zlib.crc32(t[max(0, s - 50) : e + 50].encode())))
            v, f, h = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()), pa.array(f, pa.list_(pa.int32())), pa.array(h, pa.int64())], ["votes", "features", "h"])

    found = written(documents(docs).mapInArrow(propose, "votes string, features array<int>, h long"), "candidates")
    patterns = {r["votes"]: r["n"] for r in found.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    if not patterns:
        return None
    p, reliability = em(patterns)
    rows = [(r["features"], p[r["votes"]]) for r in found.orderBy("h", "votes", "features").limit(sample).collect()]
    return Model(reliability, *train(rows))


def all_spans(t: str, model: Model | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and base and added spans together, both in order."""
    base = base_spans(t)
    more = [x for x in (candidates(t, base) if model else []) if model.probability(features(t, *x, votes(t, x[0], x[1]))) >= 0.5]
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, base array<struct>, spans array<struct>) of whole texts."""
    item = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        for b in batches:
            found = [all_spans(t or "", model) for t in b.column("text").to_pylist()]
            cols = [pa.array([[dict(zip(("start", "end", "kind"), x, strict=True)) for x in f[k]] for f in found], item) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "base", "spans"])

    span = "array<struct<start:int,end:int,kind:string>>"
    return documents(docs).mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def redact(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs``, all columns kept, with every span of ``text`` replaced by its kind in angle
    brackets; of spans that overlap the union goes, under the first one's kind."""

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for s, e, kind in all_spans(t, model)[1]:
            if s >= at:
                out += [t[at:s], f"<{kind}>"]
            at = max(at, e)
        return "".join([*out, t[at:]])

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index(text)
            yield b.set_column(k, b.schema.field(k), pa.array([clean(t) for t in b.column(k).to_pylist()], b.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def op10_pii(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"),
    )
