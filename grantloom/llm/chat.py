"""Chat formatting (operator 4, DataFrame functions only).

A declarative template gives the marks around each turn, which roles are trained on, the allowed
order of roles as a finite-state machine, and the control strings that texts must not contain.
Each conversation becomes an array of segments (text, loss): mark, escaped text, mark per turn.
The joined segments are the formatted conversation, and :func:`read_back` gets turns and trained
text from it again. Escapes are percent codes, also for the percent sign, so any text survives.

The turns of one conversation are gathered by a grouped ``collect_list`` with partial arrays per
task; nothing else is shuffled. One conversation's text is one row, as its digest demands.

Edge cases: null texts count as empty and null roles as an empty role; rows with a null turn come
first; rows of the same turn are ordered by role and text, repeated rows stay; rows with a null
conv_id make one conversation of their own; invalid turn orders are formatted too and told by
``valid``; an empty table gives an empty result; extra columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantloom.llm.common import read

TEMPLATE = {
    "open": ("<|im:", "|>"),  # around the role
    "close": "<|im|>",
    "loss": ["assistant"],
    # control characters of texts and roles, and their codes: the percent sign is first escaped, last restored
    "escape": [("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("|", "%7C")],
    # state machine: (state, role) -> state; a missing pair rejects; all of ``accept`` may end
    "start": "start",
    "order": {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    "accept": ["user", "assistant"],
}


def escaped(c: Column, t: dict) -> Column:
    for plain, code in t["escape"]:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, t: dict) -> Column:
    for plain, code in reversed(t["escape"]):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def accepted(roles: Column, t: dict) -> Column:
    """Whether the state machine accepts a conversation's roles."""
    edges = F.create_map(*[F.lit(x) for (state, role), to in t["order"].items() for x in (f"{state}|{role}", to)])
    end = F.aggregate(roles, F.lit(t["start"]), lambda s, r: F.coalesce(F.try_element_at(edges, F.concat(s, F.lit("|"), r)), F.lit("reject")))
    return end.isin(t["accept"])


def format_chats(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """(conv_id, valid, segments array<struct<text, loss>>) of (conv_id, turn, role, text)."""
    t = template
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))

    def pieces(x: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        mark = F.concat(F.lit(t["open"][0]), escaped(x["role"], t), F.lit(t["open"][1]))
        return F.array(part(mark, F.lit(False)), part(escaped(x["text"], t), x["role"].isin(t["loss"])), part(F.lit(t["close"]), F.lit(False)))

    return convs.select("conv_id", accepted(F.transform("turns", lambda x: x["role"]), t).alias("valid"), F.flatten(F.transform("turns", pieces)).alias("segments"))


def formatted(segments: str = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(chats: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """(conv_id, valid, output, turns array<struct<role, text>>, loss_text), got from the formatted
    text (turns) and from the segments under the loss mask (loss_text)."""
    t, quote = template, lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
    out = chats.select("*", formatted().alias("output"))
    cut = F.split("output", quote(t["close"]))  # after the last mark there is nothing
    start, end = t["open"]
    body = lambda x: F.struct(
        unescaped(F.substring_index(F.substring(x, len(start) + 1, 1 << 30), end, 1), t).alias("role"),
        unescaped(F.substring(x, F.instr(x, end) + len(end), F.length(x)), t).alias("text"),
    )
    turns = F.transform(F.filter(cut, lambda x: x != ""), body)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
    return out.select("conv_id", "valid", "output", turns.alias("turns"), loss.alias("loss_text"))


def op4_chat(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = read_back(format_chats(turns))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("output").cast("long").alias("formatted_chars"), "valid",
    )


OP4_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, replace(replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B'), '|', '%7C') as t2,
        replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'), '|', '%7C') as r2,
        coalesce(lag(role) over (partition by conv_id order by turn, role, text), 'start') as before,
        lead(role) over (partition by conv_id order by turn, role, text) is null as final from c)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(t2) + length(r2) + 13)::bigint as formatted_chars,
  bool_and((before, role) in (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))
    and (not final or role in ('user', 'assistant'))) as valid
from e group by conv_id
"""
