"""BPE encoding and decoding (operator 5): per-prefix dynamic programming.

A pre-token's encoding is found from its bytes left to right. For every prefix exactly one
vocabulary token can be last in the prefix's own encoding. The candidates are the tokens that are
suffixes of the prefix; an automaton over the vocabulary (goto edges of the token trie plus
suffix links, so that each state knows its longest token suffix and the next shorter one) lists
them, longest first. A candidate is right if it may follow the token that is last in the
remaining shorter prefix, which a pair test decides by unwinding both tokens' merges along the
border. The chosen last tokens are back-pointers; following them from the end emits the ids.
The work per byte depends on the vocabulary only, never on the length of the pre-token.

Texts are encoded in Spark tasks in Arrow batches; the encodings of short pre-tokens are kept in
a bounded table per worker. The vocabulary (about 1 MB) is read by each worker from ``path``,
which must exist on every node, as any installed package does.

Edge cases: null texts count as empty (no ids, empty text); repeated rows and ties are encoded row
by row; an empty table gives an empty result; extra columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from grantloom.llm.common import documents, read

#: The pre-token pattern of the byte-level vocabularies (a fixed value of their format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters and numbers of Unicode 17 and 18, which the regex module knows and the
#: tokenizers library (Unicode 16) takes for symbols.
NEWER = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9"
    "\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    "\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: White space of Unicode, as both libraries' \\s takes it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A pre-token has white space at its front only, and none looks past a visible character before
#: white space: so texts fall apart into these chunks whose pre-tokens are found one by one.
CHUNK = f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
#: Sizes of the tables of encodings met, per worker, and the longest texts kept in them.
KEEP, KEEP_CHARS = 250_000, 48
assert sys.byteorder == "little" and array("I").itemsize == 4
NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabulary files write bytes: printable ones stand for
    themselves, the others follow from code point 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary of the ``tokenizers`` library's file format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        self.bytes_of: dict[int, bytes] = {i: bytes(letter[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        ids = {b: i for i, b in self.bytes_of.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # merge order of each token (bytes come first), its two parts, and the order of each pair
        self.order = dict.fromkeys(self.bytes_of, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = (ids[bytes(letter[c] for c in x)] for x in (m.split(" ") if isinstance(m, str) else m))
            whole = ids[self.bytes_of[a] + self.bytes_of[b]]
            self.pair.setdefault((a, b), n)
            if whole not in self.parts:
                self.parts[whole], self.order[whole] = (a, b), n
        self.known: dict[int, bool] = {}
        usable = {t for t, b in self.bytes_of.items() if len(b) == 1}
        for t, (a, b) in sorted(self.parts.items(), key=lambda x: self.order[x[0]]):
            if a in usable and b in usable and self.meet(a, b, self.order[t]):
                usable.add(t)  # the token is the encoding of its own bytes
        self.build({self.bytes_of[t]: t for t in usable})
        self.short: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pieces_kept: dict[str, list[int]] = {}
        self.pieces_before: dict[str, list[int]] = {}
        self.leaves_kept: dict[str, int] = {}
        self.leaves_before: dict[str, int] = {}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.pieces = regex.compile(PATTERN).findall
        older = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{NEWER}]]").replace(r" ?\p{L}+", rf" ?[\p{{L}}--[{NEWER}]]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{NEWER}]]+")
        self.older_pieces = regex.compile("(?V1)" + older).findall
        self.match, self.older_match = regex.compile(PATTERN).match, regex.compile("(?V1)" + older).match
        self.has_newer = re.compile(f"[{NEWER}]").search
        self.may_have_newer = re.compile(f"[{min(set(NEWER) - {'-'})}-\U0010ffff]").search  # far cheaper, for most texts
        self.chunks = re.compile(CHUNK).findall
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]

    def build(self, words: dict[bytes, int]) -> None:
        """The automaton: step (edges per state), token (that ends here), shorter (state of the
        longest proper token suffix), depth of each state's token."""
        step: list[dict[int, int]] = [{}]
        token = [-1]
        for w, t in words.items():
            at = 0
            for c in w:
                if c not in step[at]:
                    step[at][c] = len(step)
                    step.append({})
                    token.append(-1)
                at = step[at][c]
            token[at] = t
        link, hit = [0] * len(step), [0] * len(step)  # suffix link; nearest state with a token, itself included
        queue = [0]
        for at in queue:
            for c, to in step[at].items():
                k = link[at]
                while k and c not in step[k]:
                    k = link[k]
                link[to] = step[k][c] if at and c in step[k] else 0
                hit[to] = to if token[to] >= 0 else hit[link[to]]
                queue.append(to)
        self.step, self.link, self.token = step, link, token
        # per state: its suffix tokens, longest first, as (token, length)
        size = {t: len(w) for w, t in words.items()}
        self.suffixes: list[tuple] = [()] * len(step)
        for at in queue[1:]:
            up = self.suffixes[link[at]]
            self.suffixes[at] = ((token[at], size[token[at]]), *up) if token[at] >= 0 else up

    def meet(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether BPE, given a's and b's bytes side by side, ends with exactly a and b: no merge
        across the border may come before one of the merges that make a or b. ``until``: only
        merges before this one count. The pair at the border is unwound from the last merge to
        the first; each pair existed until the earlier of its two sides' next merges."""
        x, y, x_until, y_until, good = a, b, until, until, True
        while True:
            across = self.pair.get((x, y), NEVER)
            # of two merges of one rank the left one goes first
            if across < x_until and (across <= y_until if y_until != until else across < y_until):
                good = False
                break
            ox, oy = self.order[x], self.order[y]
            if ox < 0 and oy < 0:
                break
            if ox > oy:  # the left side's merge was the later one
                x, x_until = self.parts[x][1], ox
            elif oy > ox:
                y, y_until = self.parts[y][0], oy
            else:  # the same merge on both sides: the left one was first, so undo the right one
                y, y_until = self.parts[y][0], oy
        if until == NEVER:
            if len(self.known) > 2_000_000:
                self.known.clear()
            self.known[a << 20 | b] = good
        return good

    def encode_bytes(self, w: bytes) -> list[int]:
        """Ids of one pre-token."""
        step, link, suffixes, meet, known = self.step, self.link, self.suffixes, self.meet, self.known.get
        last, size, at = [-1], [0], 0
        for end, c in enumerate(w, 1):
            while at and c not in step[at]:
                at = link[at]
            at = step[at].get(c, 0)
            for t, n in suffixes[at]:
                if end == n:
                    fits = True
                elif (fits := known((before := last[end - n]) << 20 | t)) is None:
                    fits = before >= 0 and meet(before, t)
                if fits:
                    last.append(t)
                    size.append(n)
                    break
            else:
                last.append(-1)  # cannot happen while all single bytes are tokens
                size.append(1)
        out, end = [], len(w)
        while end:
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def pre_tokens(self, text: str) -> list[str]:
        return self.older_pieces(text) if self.may_have_newer(text) and self.has_newer(text) else self.pieces(text)

    def next_piece(self, text: str, at: int) -> str:
        """The pre-token that starts at ``at``."""
        got = self.match(text, at)[0]
        if self.has_newer(text, at, at + len(got) + 1):
            got = self.older_match(text, at)[0]
        return got

    def piece(self, p: str) -> list[int]:
        got = self.pieces_kept.get(p)
        if got is None:
            got = self.pieces_kept[p] = self.pieces_before.get(p) or self.encode_bytes(p.encode())
            if len(self.pieces_kept) >= KEEP:
                self.pieces_before, self.pieces_kept = self.pieces_kept, {}
        return got

    def chunk(self, c: str) -> bytes:
        """A chunk's ids as little-endian 32-bit integers. Of the chunks and pre-tokens met, two
        generations of KEEP each are kept: a full one becomes the older one."""
        got = self.before.get(c)
        if got is None:
            ids: list[int] = []
            for p in self.pre_tokens(c):
                ids += self.piece(p) if len(p) <= KEEP_CHARS else self.encode_bytes(p.encode())
            got = array("I", ids).tobytes()
        if len(c) <= KEEP_CHARS:
            if len(self.short) >= KEEP:
                self.before = dict(self.short)
                self.short.clear()
            self.short[c] = got
        return got

    def ids(self, text: str, special: bool = True) -> bytes:
        """A text's ids as little-endian 32-bit integers; ``special``: the special tokens'
        strings inside the text stand for those tokens, else they are ordinary text."""
        short, chunk, out = self.short.get, self.chunk, []
        for part in self.split(text) if special else [text]:
            if special and part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out += [short(c) or chunk(c) for c in self.chunks(part)]
        return b"".join(out)

    def text(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; broken UTF-8 becomes U+FFFD."""
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, special: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids binary): ids are little-endian unsigned 32-bit integers."""
    path = path or default_path()

    def run(batches):
        bpe = load(path)
        for b in batches:
            ids = [bpe.ids(t or "", special) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids binary); null ids give an empty text."""
    path = path or default_path()

    def run(batches):
        bpe = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.text(x or b"") for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ``keep_ids`` also ids: each text is
    encoded and its ids are decoded again in the same pass over the data."""
    path = path or default_path()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches):
        bpe = load(path)
        for b in batches:
            ids = [bpe.ids(t or "") for t in b.column("text").to_pylist()]
            cols = [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.text(x).encode()).hexdigest() for x in ids], pa.string()),
            ] + [pa.array(ids, pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names)

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)


def op5_bpe(spark, sf_dir):
    return round_trip(read(spark, sf_dir, "documents"))
