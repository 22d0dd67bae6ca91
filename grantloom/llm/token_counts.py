"""Token counts under edits (operator 7): a tree of pre-tokens per document.

The leaves of a document's tree are its pre-tokens, each with its characters and tokens. Runs of up to
``2 * HALF`` leaves form blocks, which hold their piece of the text; a segment tree over the
blocks sums characters and tokens. An edit (replace ``n_del`` characters at ``start`` by a text) finds
the leaves it touches by descending the tree, re-splits only that region with a boundary context,
encodes the new pre-tokens, puts them into the region's place as leaves of their own, splits blocks
that got too long, and updates the sums on the way up. Edits apply one after another, each to the
text the earlier ones left; neither the rest of the text nor its encoding is touched.

*Context.* Pre-tokens are found from left to right, each from its own start, and none looks more
than two characters past its end. So the region begins at the last pre-token boundary at least two
characters before the edit, and ends at the first old boundary at which a new pre-token ends too.

*Kept trees.* :func:`trees` gives the leaves as columns, :func:`apply` takes such columns, applies edits
and gives the edited text with its new leaves, so that a later run starts where this one ended and
encodes nothing but what its own edits touch. :func:`recount` builds trees on the way for texts that
have none.

Special tokens' strings are ordinary text here, while operator 5 takes them for tokens. Documents
are independent; an edit table is joined by doc_id after its edits are gathered per document, which
belong together by nature.

Edge cases: null texts and null inserts count as empty; starts and lengths outside the text are
clamped to it; edits of one document are ordered by ``seq``, ties by start, length and text; edits of
unknown documents (or of null ids) are ignored; repeated document rows each get the edits; null
leaves are built anew; empty tables give an empty result or unchanged counts; extra columns are
neither read nor returned.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.llm.bpe import KEEP_CHARS, Bpe, default_path, load
from grantloom.llm.common import documents, read

LOOK, HALF = 2, 128
#: Leaves of so many pre-tokens met make a generation; two are kept per vocabulary and worker.
LEAVES = 500_000
#: A leaf or a sum of leaves is one number: characters * ONE + tokens.
ONE = 1 << 32


def leaf(piece: str, bpe: Bpe) -> int:
    """Of one pre-token. A full generation becomes the older one, what is met again moves to the new one."""
    got = bpe.leaves_kept.get(piece)
    if got is None:
        got = bpe.leaves_before.get(piece) or len(piece) * ONE + len(bpe.encode_bytes(piece.encode()))
        if len(piece) <= KEEP_CHARS:
            bpe.leaves_kept[piece] = got
            if len(bpe.leaves_kept) >= LEAVES:
                bpe.leaves_before, bpe.leaves_kept = bpe.leaves_kept, {}
    return got


def leaves_of(text: str, bpe: Bpe) -> list[int]:
    pieces = bpe.pre_tokens(text)
    got = list(map(bpe.leaves_kept.get, pieces))
    if None in got:
        got = [leaf(p, bpe) if x is None else x for p, x in zip(pieces, got, strict=True)]
    return got


class CountTree:
    """Characters and tokens of a text's pre-tokens, under edits."""

    def __init__(self, text: str, bpe: Bpe, leaves: list[int] | None = None):
        self.bpe, self.encoded = bpe, 0
        self.fill(text, leaves_of(text, bpe) if leaves is None else leaves)

    def fill(self, text: str, leaves: list[int]) -> None:
        self.blocks, self.texts = self.cut(leaves, text)
        self.totals = [sum(b) for b in self.blocks]
        self.grow()

    @staticmethod
    def cut(leaves: list[int], text: str) -> tuple[list[list[int]], list[str]]:
        """Blocks of HALF leaves and their texts; one block as long as 2 * HALF will do."""
        if len(leaves) <= 2 * HALF:
            return [leaves], [text]
        blocks, texts, at = [leaves[k : k + HALF] for k in range(0, len(leaves), HALF)], [], 0
        for b in blocks:
            n = sum(b) // ONE
            texts.append(text[at : at + n])
            at += n
        return blocks, texts

    def grow(self) -> None:
        """The sums above the blocks; node k has the children 2k and 2k + 1."""
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = [0] * self.size + self.totals + [0] * (self.size - len(self.totals))
        for k in range(self.size - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1] % ONE

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def leaves(self) -> list[int]:
        return [x for b in self.blocks for x in b]

    def find(self, pos: int) -> tuple[int, int, int, int]:
        """The leaf that holds character ``pos``, as block and place, its start and its block's."""
        k, start = 1, 0
        while k < self.size:
            k, left = 2 * k, self.sums[2 * k] // ONE
            if pos >= start + left:
                k, start = k + 1, start + left
        ends = list(accumulate(self.blocks[k - self.size]))
        i = min(bisect_right(ends, (pos - start) * ONE + ONE - 1), len(ends) - 1)
        return k - self.size, i, start + (ends[i - 1] // ONE if i else 0), start

    def edit(self, start: int, n_del: int, insert: str) -> None:
        n = self.sums[1] // ONE
        start = min(max(start, 0), n)
        end = min(start + max(n_del, 0), n)
        if not n:
            leaves = leaves_of(insert, self.bpe)
            self.encoded += len(leaves)
            self.fill(insert, leaves)
            return
        b, i, at, front = self.find(min(max(start - LOOK, 0), n - 1))
        # (c, j) is the first old leaf that may stay, ``old`` where it starts
        c, j, old, _ = self.find(min(max(end, at), n - 1))
        if old < end:
            old += self.blocks[c][j] // ONE
            j += 1
        upto = c  # the region's text reaches to the end of this block
        held = "".join(self.texts[b : upto + 1])
        text = held[at - front : start - front] + insert + held[end - front :]
        shift, after = len(insert) - (end - start) - at, start + len(insert) - at
        pos, fresh, match = 0, [], self.bpe.next_piece
        while True:
            while old + shift < pos and old < n:
                if j == len(self.blocks[c]):
                    c, j = c + 1, 0
                old += self.blocks[c][j] // ONE
                j += 1
            if pos > after and pos == old + shift or pos == len(text) and upto == len(self.blocks) - 1:
                break
            piece = match(text, pos) if pos < len(text) else ""
            if pos + len(piece) > len(text) - LOOK - 1 and upto < len(self.blocks) - 1:
                upto += 1  # the next block's text may change the piece's end
                text += self.texts[upto]
                continue
            fresh.append(leaf(piece, self.bpe))
            pos += len(piece)
        self.encoded += len(fresh)
        if pos == len(text) and upto == len(self.blocks) - 1:
            c, j = upto, len(self.blocks[upto])
        # blocks b to c make way for the leaves before the region, the new ones, and those after it
        until = len(text) - sum(len(t) for t in self.texts[c + 1 : upto + 1])
        leaves = self.blocks[b][:i] + fresh + self.blocks[c][j:]
        blocks, texts = self.cut(leaves, self.texts[b][: at - front] + text[:until])
        if len(self.blocks) > 1 and not leaves:
            blocks, texts = [], []
        self.texts[b : c + 1], self.blocks[b : c + 1] = texts, blocks
        totals = [sum(x) for x in blocks]
        if len(blocks) == c - b + 1 == 1:
            k, more = b + self.size, totals[0] - self.totals[b]
            self.totals[b] = totals[0]
            while k:
                self.sums[k] += more
                k //= 2
        else:
            self.totals[b : c + 1] = totals
            self.grow()


def gathered(edits: DataFrame) -> DataFrame:
    """(doc_id, edits): each document's edits in order."""
    own = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("seq", "start", "n_del", F.coalesce("insert", F.lit("")).alias("insert")).alias("e"))
    return own.groupBy("doc_id").agg(F.sort_array(F.collect_list("e")).alias("edits"))


def trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens): each text with its leaves, to be stored."""
    empty = documents(docs).withColumn("edits", F.lit(None).cast("array<struct<seq:int,start:int,n_del:int,insert:string>>"))
    return _applied(empty, path or default_path(), True).select("doc_id", "text", "leaf_chars", "leaf_tokens")


def apply(kept: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """Stored trees under edits: (doc_id, text, leaf_chars, leaf_tokens) after them, with n_tokens
    before, n_tokens_edited, n_edits, and n_encoded, the pre-tokens that had to be encoded."""
    docs = documents(kept.select("doc_id", "text")) if "leaf_chars" not in kept.columns else kept.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "leaf_chars", "leaf_tokens")
    return _applied(docs.join(gathered(edits), "doc_id", "left"), path or default_path(), True)


def recount(docs: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_edited, n_edits, n_encoded): token counts before and after the
    document's edits (doc_id, seq, start, n_del, insert), and the pre-tokens encoded for them."""
    return _applied(documents(docs).join(gathered(edits), "doc_id", "left"), path or default_path(), False)


def _applied(joined: DataFrame, path: str, keep: bool) -> DataFrame:
    stored = "leaf_chars" in joined.columns

    def run(batches):
        bpe = load(path)
        for b in batches:
            texts, edits = b.column("text").to_pylist(), b.column("edits").to_pylist()
            have = zip(*(b.column(c).to_pylist() for c in ("leaf_chars", "leaf_tokens")), strict=True) if stored else [(None, None)] * len(texts)
            rows, kept = [], []
            for t, own, (chars, tokens) in zip(texts, edits, have, strict=True):
                leaves = leaves_of(t, bpe) if chars is None or tokens is None else [x * ONE + y for x, y in zip(chars, tokens, strict=True)]
                before, after, encoded = sum(leaves) % ONE, None, 0
                if own:
                    tree = CountTree(t, bpe, leaves)
                    for e in own:
                        tree.edit(e["start"] or 0, e["n_del"] or 0, e["insert"] or "")
                    after, encoded = tree.tokens, tree.encoded
                    if keep:
                        t, leaves = tree.text, tree.leaves()
                rows.append((before, before if after is None else after, len(own or []), encoded))
                if keep:
                    kept.append((t, [x // ONE for x in leaves], [x % ONE for x in leaves]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            cols = [pa.array(c, pa.int64()) for c in cols]
            if keep:
                t, c, k = zip(*kept, strict=True) if kept else ((), (), ())
                cols += [pa.array(t, pa.string()), pa.array(c, pa.list_(pa.int32())), pa.array(k, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names)

    names = ["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_encoded", *(["text", "leaf_chars", "leaf_tokens"] if keep else [])]
    schema = "doc_id long, n_tokens long, n_tokens_edited long, n_edits long, n_encoded long" + (", text string, leaf_chars array<int>, leaf_tokens array<int>" if keep else "")
    return joined.select("doc_id", "text", "edits", *(["leaf_chars", "leaf_tokens"] if stored else [])).mapInArrow(run, schema)


def op7_token_counts(spark, sf_dir):
    """Every document with three edits made from its own text: a replaced middle, a removed
    stretch, an appended end. They are columns of the document's row, so nothing is shuffled."""
    docs = documents(read(spark, sf_dir, "documents"))
    n = F.length("text")
    edit = lambda seq, start, cut, insert: F.struct(F.lit(seq).alias("seq"), start.cast("int").alias("start"), cut.cast("int").alias("n_del"), insert.alias("insert"))
    edits = F.array(
        edit(1, F.floor(n / 2), F.lit(7), F.concat(F.lit("edited "), F.substring("text", 1, 9))),
        edit(2, F.floor(n / 4), F.lit(25), F.lit("")),
        edit(3, n, F.lit(0), F.concat(F.lit(" "), F.reverse(F.substring("text", 1, 12)))),
    )
    return _applied(docs.withColumn("edits", edits), default_path(), False)
