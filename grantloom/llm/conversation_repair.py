r"""Conversation structure repair (operator 12): Viterbi with coalescing survivors.

*Damage* drops, empties, strips, repeats or reroles rows by the checksum of their place. *Repair*
finds the cheapest edits (Keep, Rerole, Delete, Insert) after which the roles' initials read
``(s?(ua)+)?``; of equal costs the ASCII-least string of edits.

1. *Rows.* Equal rows of a turn become one with a count. A narrow grouping (ids and digests, no
   texts) finds the first place of each role and text; it joins the rows as a marker of its own
   that sorts just before the row it marks, so no join moves texts.
2. *One sorted pass.* Rows are cut into ranges by conversation and place, so a long conversation is
   split over tasks, each of which reads its range in order. Four states (nothing yet, after
   ``s``, after ``u``, after ``a``) keep one survivor each: a leaf of a tree of edits whose nodes count
   what hangs on them. Where all survivors share an ancestor, the edits up to it are settled, leave
   the tree, and their rows go into the running hash; only the unsettled tail stays in memory.
   Ties compare the whole unsettled edits; as all survivors have read the same rows, none is the
   beginning of another, so their order is carried along as a rank.
3. *Joints.* A task can't know whether its first and last conversation go on elsewhere. For these it
   returns the cheapest edits from every state to every state instead, and their rows. The parts
   of a conversation are then composed in order, and one last pass over those rows alone reads the
   settled edits and hashes. Very long conversations go the same way wherever they lie.

A SHA-256 is sequential, so that last pass reads a conversation in one task, row by row, whatever its
length; its edits are one string, as the result's ``audit`` is.

Edge cases: null role, text, conv_id and turn read as one space in the checksum's input and in
the row (a null conv_id stays a conversation of its own, a null turn comes first and has no part in
gaps); rows of one turn are ordered by role, then by their text's SHA-256; a conversation without
rows after damage has zeros, an empty audit and the empty string's hash; roles other than those of
initials s, u, a are deleted or reroled; an empty table gives an empty result; extra columns are
left behind.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.llm.common import read, written

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. What may be added next, and what that leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ("u", "u", "a", "u")
TO = (USER, USER, ASSISTANT, USER)
ROLES = {"u": "user", "a": "assistant"}
FINAL = (START, ASSISTANT)
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
LEGAL = {"su", "ua", "au"}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage; ``n`` is 0 for dropped rows and 2 for
    repeated ones."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    role = F.when(kind == 4, "user").otherwise(told("role"))
    n = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), n.cast("long").alias("n"))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, first, text, n): equal rows of a turn as one, and before the
    first row of each role and text a marker (``first``)."""
    rows = rows.withColumn("key", F.unhex(F.sha2("text", 256)))
    place = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    firsts = rows.filter("n > 0").groupBy("conv_id", "role", "key").agg(F.min(place).alias("place"))
    firsts = firsts.select("conv_id", "place.turn", "role", "key", F.lit(True).alias("first"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"))
    same = rows.groupBy("conv_id", "turn", "role", "key", "text").agg(F.sum("n").alias("n"))
    return same.select("conv_id", "turn", "role", "key", F.lit(False).alias("first"), "text", "n").union(firsts)


class Survivors:
    """The cheapest edits from one state to each state, over rows that come one by one."""

    __slots__ = ("live", "root", "settled")

    def __init__(self, start: int, settled):
        self.root = [None, "", 1, {}]  # parent, letters, what hangs on it, children
        self.live: list = [None] * 4  # by state: cost, rank among the survivors' strings, leaf
        self.live[start] = (0, 0, self.root)
        self.settled = settled  # is given settled letters, in order

    def closed(self) -> list:
        """By state: cost, (rank, letters) and leaf, where up to two inserts may have been added."""
        out = [x and (x[0], (x[1], ""), x[2]) for x in self.live]
        for state in (START, SYSTEM, ASSISTANT, USER):  # inserts follow each other in this order
            if x := out[state]:
                y = (x[0] + INSERT, (x[1][0], x[1][1] + "I"), x[2])
                if out[TO[state]] is None or y[:2] < out[TO[state]][:2]:
                    out[TO[state]] = y
        return out

    def deleted(self, n: int) -> None:
        """``n`` rows that must go."""
        self.move([x and (x[0] + n * DELETE, (x[1], "D" * n), x[2]) for x in self.live])

    def row(self, initial: str, truncated: bool) -> None:
        before, fee = self.closed(), TRUNCATED if truncated else 0
        after = [x and (x[0] + DELETE, (x[1][0], x[1][1] + "D"), x[2]) for x in before]
        for state, x in enumerate(before):
            if x:
                keeps = initial == NEXT[state]
                steps = [(TO[state], 0 if keeps else REROLE, "K" if keeps else "R")]
                if state == START and initial == "s":
                    steps.append((SYSTEM, 0, "K"))
                for to, cost, letter in steps:
                    y = (x[0] + cost + fee, (x[1][0], x[1][1] + letter), x[2])
                    if after[to] is None or y[:2] < after[to][:2]:
                        after[to] = y
        self.move(after)

    def move(self, after: list) -> None:
        # what may follow START or SYSTEM may follow ASSISTANT too, at worst without an ``s`` row, and
        # USER after an insert; survivors that cost more than that can't win and go
        bound = min((x[0] + more for x, more in ((after[ASSISTANT], 0), (after[USER], INSERT)) if x), default=math.inf)
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            if after[state] and after[state][0] > bound + more:
                after[state] = None
        rank = {x[1]: k for k, x in enumerate(sorted((x for x in after if x), key=lambda x: x[1]))}
        old, self.live = [x[2] for x in self.live if x], [None] * 4
        for state, x in enumerate(after):
            if x:
                cost, order, parent = x
                leaf = [parent, order[1], 1, {}]
                parent[2] += 1
                parent[3][id(leaf)] = leaf
                self.live[state] = (cost, rank[order], leaf)
        for leaf in old:
            self.drop(leaf)
        while self.root[2] == 1 and self.root[3]:  # one child and no survivor of its own
            ((_, self.root),) = self.root[3].items()
            self.root[0] = None
            self.settled(self.root[1])

    def drop(self, node) -> None:
        node[2] -= 1
        while not node[2] and node[0] is not None:
            parent = node[0]
            del parent[3][id(node)]
            parent[2] -= 1
            node = parent

    @staticmethod
    def letters(leaf, end: str = "") -> str:
        """The unsettled letters up to a leaf."""
        out = [end]
        while leaf[0] is not None:
            out.append(leaf[1])
            leaf = leaf[0]
        return "".join(reversed(out))

    def best(self) -> tuple[int, str]:
        """The least cost with which a conversation can end here, and the unsettled letters."""
        cost, order, leaf = min((x for state, x in enumerate(self.closed()) if x and state in FINAL), key=lambda x: x[:2])
        return cost, self.letters(leaf, order[1])

    def ends(self) -> list[tuple[int, int, str]]:
        """(state, cost, unsettled letters) of the survivors."""
        return [(state, x[0], self.letters(x[2])) for state, x in enumerate(self.live) if x]


class Repaired:
    """Reads edits and rows in order and hashes what is left."""

    def __init__(self):
        self.rows, self.state, self.letters = deque(), START, []
        self.hash, self.some = hashlib.sha256(), False

    def add(self, role: str, text: str, n: int) -> None:
        self.rows.append([role, text, n])

    def settle(self, letters: str) -> None:
        self.letters.append(letters)
        for x in letters:
            role, text = "", ""
            if x != "I":
                row = self.rows[0]
                role, text = row[0], row[1]
                row[2] -= 1
                if not row[2]:
                    self.rows.popleft()
            if x != "D":
                if x == "K" and self.state == START and role[:1] == "s":
                    self.state = SYSTEM
                else:
                    role, self.state = role if x == "K" else ROLES[NEXT[self.state]], TO[self.state]
                self.hash.update((("\n" if self.some else "") + f"{role}:{text}").encode())
                self.some = True


class Counted:
    """What is counted over a conversation's rows as they stand, by part."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first = self.last = None

    def add(self, turn, initial: str, n: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.illegal += n - 1  # two equal initials are never legal
        self.last = initial

    def result(self) -> dict:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {"gaps": gaps} | {c: getattr(self, c) for c in COUNTS[1:]}

    def join(self, other: dict) -> None:
        """The counts of the next part of the same conversation."""
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, k, getattr(self, k) + other[k])
        if other["first_turn"] is not None:
            self.turns -= self.last_turn == other["first_turn"]
            self.last_turn = other["last_turn"]
            self.first_turn = other["first_turn"] if self.first_turn is None else self.first_turn
        if other["first"] is not None:
            self.illegal += self.last is not None and self.last + other["first"] not in LEGAL
            self.first = other["first"] if self.last is None else self.first
            self.last = other["last"]


LONG, STRING = pa.int64(), pa.string()
PART = pa.struct([*[(c, LONG) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")], ("first", STRING), ("last", STRING),
                  ("ways", pa.list_(pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", LONG), ("letters", STRING)])))])
PART_SQL = "struct<blank:long,duplicate:long,truncated:long,illegal:long,turns:long,first_turn:long,last_turn:long,first:string,last:string,ways:array<struct<start:int,state:int,cost:long,letters:string>>>"
RESULT = [*[(c, LONG) for c in ["conv_id", *COUNTS, "cost"]], ("audit", STRING), ("repaired_sha256", STRING)]
RESULT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PASS = pa.schema([*RESULT, ("task", pa.int32()), ("seq", LONG), ("role", STRING), ("text", STRING), ("n", LONG), ("part", PART)])
PASS_SQL = RESULT_SQL + f", task int, seq long, role string, text string, n long, part {PART_SQL}"

SPACE = " \t\n\v\f\r"
#: Conversations up to so many rows and letters are held until their last row is known.
WHOLE, CHARS = 1000, 1 << 20


def whole_rows(batches):
    """(conv_id, turn, role, text, n, first) from sorted rows and markers."""
    marker = None
    for b in batches:
        for c, turn, role, key, first, text, n in zip(*(col.to_pylist() for col in b.columns), strict=True):
            if first:
                marker = (c, turn, role, key)
            else:
                yield c, turn, role, text, n, marker == (c, turn, role, key)


def read_row(row: tuple, counted: Counted, paths: list[Survivors]) -> None:
    """A row, ``n`` times, for the counts and for all paths: at most the first of them may stay."""
    _, turn, role, text, n, first = row
    last = text.rstrip(SPACE)[-1:]
    gone = n - 1 if first and last else n
    broken = gone < n and last not in ".!?"
    if last:
        counted.duplicate += gone
    else:
        counted.blank += n
    counted.truncated += broken
    counted.add(turn, role[:1], n)
    for p in paths:
        if gone < n:
            p.row(role[:1], broken)
        if gone:
            p.deleted(gone)


def one_pass(batches, whole: int, chars: int):
    """Results of the conversations that begin and end inside a task's range. The first and the
    last one, and those of more than ``whole`` rows or ``chars`` letters, come as parts instead
    (``part``, with seq -1) together with their rows."""
    task = TaskContext.get().partitionId()
    out = {c: [] for c in PASS.names}

    def put(**row):
        for c in PASS.names:
            out[c].append(row.get(c))

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(out[c], PASS.field(c).type) for c in PASS.names], schema=PASS)
        for c in out:
            out[c].clear()
        return batch

    ahead = groupby(whole_rows(batches), key=lambda r: r[0])
    inner, here = False, next(ahead, None)
    while here is not None:
        conv, rows = here
        rows = (r for r in rows if r[4])
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += len(r[3])
            if len(held) > whole or size > chars:
                break
        more = next(rows, None)
        if more is None:
            here = next(ahead, None)
        if inner and more is None and here is not None:
            counted, done = Counted(), Repaired()
            path = Survivors(START, done.settle)
            for r in held:
                done.add(r[2], r[3], r[4])
                read_row(r, counted, [path])
            cost, letters = path.best()
            done.settle(letters)
            put(conv_id=conv, **counted.result(), cost=cost, audit="".join(done.letters), repaired_sha256=done.hash.hexdigest())
        else:
            counted, told = Counted(), [[] for _ in range(4)]
            paths = [Survivors(state, told[state].append) for state in range(4)]
            for k, r in enumerate(chain(held, [] if more is None else [more], rows)):
                read_row(r, counted, paths)
                put(conv_id=conv, task=task, seq=k, role=r[2], text=r[3], n=r[4])
                if len(out["n"]) >= 1024:
                    yield flush()
            ways = [dict(start=s, state=state, cost=cost, letters="".join(told[s]) + letters) for s, p in enumerate(paths) for state, cost, letters in p.ends()]
            put(conv_id=conv, task=task, seq=-1, part=vars(counted) | {"ways": ways})
            if more is not None:
                here = next(ahead, None)
        inner = True
        if len(out["n"]) >= 1024:
            yield flush()
    if out["n"]:
        yield flush()


def composed(key, table):
    """The parts of one conversation, one a task, put together: counts, cost and audit."""
    total, best = Counted(), {START: (0, "")}
    for r in sorted(table.to_pylist(), key=lambda r: r["task"]):
        total.join(r["part"])
        after: dict[int, tuple[int, str]] = {}
        for w in r["part"]["ways"]:
            if (x := best.get(w["start"])) is not None:
                y = (x[0] + w["cost"], x[1] + w["letters"])
                after[w["state"]] = min(after.get(w["state"], y), y)
        best = after
    tail = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
    cost, audit = min((x[0] + tail[s][0], x[1] + tail[s][1]) for s, x in best.items())
    values = [key[0].as_py(), *total.result().values(), cost, audit, None]
    return pa.table({name: pa.array([v], kind) for (name, kind), v in zip(RESULT, values, strict=True)})


def hashed(batches):
    """Hashes of whole conversations from their rows in order, the result without hash (seq -1,
    before all tasks) ahead of them."""
    result, done, at = None, None, 0

    def closed():
        done.settle(result["audit"][at:])
        values = [*[result[c] for c, _ in RESULT[:-1]], done.hash.hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for (_, kind), v in zip(RESULT, values, strict=True)], [c for c, _ in RESULT])

    for b in batches:
        for r in b.to_pylist():
            if r["seq"] < 0:
                if result:
                    yield closed()
                result, done, at = r, Repaired(), 0
            else:
                done.add(r["role"], r["text"], r["n"])
                end, left = at, r["n"]
                while left:  # the row's own letters, and inserts before it
                    left -= result["audit"][end] != "I"
                    end += 1
                done.settle(result["audit"][at:end])
                at = end
    if result:
        yield closed()


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, least cost, edits, hash of the repaired rows."""
    rows = marked(damaged(conversations))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "key", F.desc("first")]
    rows = rows.select("conv_id", "turn", "role", "key", "first", "text", "n").repartitionByRange(*order[:4]).sortWithinPartitions(*order)
    whole, chars = WHOLE, CHARS
    passed = written(rows.mapInArrow(lambda batches: one_pass(batches, whole, chars), PASS_SQL), "repaired")
    names = [c for c, _ in RESULT]
    parts = passed.filter("seq = -1").select("conv_id", "task", "part")  # at most two a task
    open_ones = written(parts.groupBy("conv_id").applyInArrow(composed, RESULT_SQL), "composed")
    told = passed.filter("seq >= 0").select(*[F.col(c) if c == "conv_id" else F.lit(None).cast(t.split()[1]).alias(c) for c, t in zip(names, RESULT_SQL.split(", "), strict=True)], "task", "seq", "role", "text", "n")
    heads = open_ones.select(*names, F.lit(-1).alias("task"), F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("n"))
    again = heads.union(told).repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq").mapInArrow(hashed, RESULT_SQL)
    return passed.filter("seq is null").select(names).union(again)


def op12_conversation_repair(spark, sf_dir):
    return repair(read(spark, sf_dir, "conversations"))


def added(x: str, cost: str, letter: str) -> str:
    """SQL of a path (ten digits of cost, then its edits) with one edit more; null if there is none."""
    return f"(lpad(cast(cast(substr({x}, 1, 10) as bigint) + {cost} as varchar), 10, '0') || substr({x}, 11) || {letter})"


def onward(x: str, initial: str) -> str:
    return added(x, f"fee + if(initial = '{initial}', 0, 1)", f"if(initial = '{initial}', 'K', 'R')")


INSERTED = [added(x, str(INSERT), "'I'") for x in ("s0", "s1", "s3")]
OP12_SQL = rf"""
with recursive o as materialized (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')) as place from conversations),
crc as (select distinct conv_id, turn, xor(4294967295, list_reduce(list_prepend(4294967295, flatten([[ascii(x), 0, 0, 0, 0, 0, 0, 0] for x in string_split(decode(place), '')])),
    lambda c, b: xor(xor(c, b) // 2, if(xor(c, b) % 2 = 1, 3988292384, 0)))) % 20 as kind from o),
damaged as (select o.conv_id, o.turn, if(kind = 4, 'user', role) as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(if(kind = 3, [0, 1], [0])) as twin
  from o join crc on o.conv_id is not distinct from crc.conv_id and o.turn is not distinct from crc.turn where kind <> 0),
r as materialized (select *, row_number() over w as k, left(role, 1) as initial, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) as last_sign,
    row_number() over (partition by conv_id, role, text order by turn nulls first, twin) as nth, lag(left(role, 1)) over w as before
  from damaged window w as (partition by conv_id order by turn nulls first, role, sha256(text), twin)),
f as materialized (select *, last_sign = '' as blank, last_sign <> '' and nth > 1 as duplicate, last_sign <> '' and nth = 1 and last_sign not in ('.', '!', '?') as truncated from r),
v(conv_id, k, s0, s1, s2, s3) as (select distinct conv_id, cast(0 as bigint), '0000000000', cast(null as varchar), cast(null as varchar), cast(null as varchar) from o
  union all select conv_id, k, if(gone, {added("s0", "2", "'D'")}, {added("s0", "2", "'D'")}), if(gone, {added("s1", "2", "'D'")}, least({added("s1", "2", "'D'")}, if(initial = 's', {added("s0", "fee", "'K'")}, null))),
    if(gone, {added("s2", "2", "'D'")}, least({added("u", "2", "'D'")}, {onward("s0", "u")}, {onward("s1", "u")}, {onward("a", "u")})), if(gone, {added("s3", "2", "'D'")}, least({added("a", "2", "'D'")}, {onward("u", "a")}))
  from (select *, least(s3, {added("u", str(INSERT), "'I'")}) as a from (
    select f.conv_id, f.k, s0, s1, s2, s3, blank or duplicate as gone, initial, if(truncated, {TRUNCATED}, 0) as fee, least(s2, {", ".join(INSERTED)}) as u
    from v join f on v.conv_id is not distinct from f.conv_id and f.k = v.k + 1))),
ends as (select conv_id, least(s0, s3, {added("least(s2, " + ", ".join(INSERTED) + ")", str(INSERT), "'I'")}) as path from v qualify row_number() over (partition by conv_id order by k desc) = 1),
letters as (select conv_id, unnest(string_split(substr(path, 11), '')) as letter, generate_subscripts(string_split(substr(path, 11), ''), 1) as pos from ends where length(path) > 10),
placed as (select *, if(letter = 'I', null, count(*) filter (letter <> 'I') over w) as k, if(letter = 'D', null, count(*) filter (letter <> 'D') over w) as nth from letters window w as (partition by conv_id order by pos)),
joined as (select p.*, f.role, f.initial, f.text, bool_or(p.nth = 1 and p.letter = 'K' and f.initial = 's') over (partition by p.conv_id) as led
  from placed p left join f on p.conv_id is not distinct from f.conv_id and p.k = f.k),
texts as (select conv_id, string_agg(if(letter = 'K', role, if((nth - if(led, 1, 0)) % 2 = 1, 'user', 'assistant')) || ':' || if(letter = 'I', '', text), chr(10) order by pos) as repaired from joined where letter <> 'D' group by conv_id),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (before || initial not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(substr(path, 1, 10) as bigint) as cost, substr(path, 11) as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from ends e left join counts c on e.conv_id is not distinct from c.conv_id left join texts t on e.conv_id is not distinct from t.conv_id
"""
