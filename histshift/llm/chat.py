r"""Chat formatting with a role automaton and a declarative template (operator 8), native.

A template names, for every role, the strings that open and close a turn and whether its text
counts in the loss, and which role may follow which. The automaton's state is the last role
(``START`` before the first turn): a turn is valid if its role may follow the state before it,
and a conversation if all its turns are and it ends in an accepting role. Turns are formatted
whether valid or not, so that nothing is dropped; the flags say what to keep.

Texts are escaped so that none can pass for a turn mark: a backslash is doubled and one is put
behind the first character of every control string (``[INST]`` becomes ``[\INST]``); taking
each escaping backslash away restores the text. ``parse_formatted`` reads turns and loss texts
back from the formatted string and its mask alone.

Only DataFrame functions are used. Turns are formatted row by row; the automaton needs one
sort per conversation, and one formatted conversation is one value, as it has to be.

Defined cases: turns are ordered by (turn, role, text), nulls first, and equal rows are
separate turns; null texts are empty; a null role is the role ``""``; roles the template
doesn't know are written with ``other`` marks, hold no loss and may not follow any role; a
null ``conv_id`` is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = "START"


@dataclass(frozen=True)
class Template:
    """``roles``: role -> (opening mark, closing mark, in the loss); ``other``: marks of any other
    role, whose escaped name stands between the first two; ``follows``: state -> roles."""
    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>", False),
        "user": ("[INST]", "[/INST]", False),
        "assistant": ("<s>", "</s>", True)})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepting: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({m for o, c, _ in self.roles.values() for m in (o, c)} | set(self.other), key=lambda m: (-len(m), m))


def escape(text: Column, t: Template) -> Column:
    r"""``text`` without control strings; ``unescape`` is its inverse."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in t.controls():
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _pick(role: Column, t: Template, k: int, other) -> Column:
    out = F.lit(other)
    for name, marks in t.roles.items():
        out = F.when(role == name, F.lit(marks[k])).otherwise(out)
    return out


def format_turns(conversations: DataFrame, t: Template = Template()) -> DataFrame:
    """One row per turn: conv_id, place (from 1), role, valid, and its segments: an array of
    (text, loss), where only the escaped text of a turn can be in the loss."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    allowed = F.lit(False)
    for state, roles in t.follows.items():
        allowed = allowed | ((F.col("_state") == state) & F.col("_role").isin(*roles))
    opening = F.when(role.isin(*t.roles), _pick(role, t, 0, "")).otherwise(
        F.concat(F.lit(t.other[0]), escape(role, t), F.lit(t.other[1])))
    segments = F.array(_segment(opening, F.lit(False)), _segment(escape(text, t), _pick(role, t, 2, False)),
                       _segment(_pick(role, t, 1, t.other[2]), F.lit(False)))
    return (conversations.select("conv_id", "turn", "role", "text", role.alias("_role"), segments.alias("segments"))
            .withColumn("place", F.row_number().over(by_turn))
            .withColumn("_state", F.lag("_role", 1, START).over(by_turn))
            .select("conv_id", "place", F.col("_role").alias("role"), allowed.alias("valid"), "segments"))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_conversations(conversations: DataFrame, t: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, segments (array of text and loss flag, in order),
    valid, and first_invalid (the place of the first turn out of order, or null)."""
    turns = format_turns(conversations, t)
    whole = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "segments"))).alias("turns"),
        F.max_by("role", "place").alias("last"), F.min(F.when(~F.col("valid"), F.col("place"))).alias("first_invalid"))
    return whole.select("conv_id", F.flatten(F.col("turns.segments")).alias("segments"),
                        (F.col("first_invalid").isNull() & F.col("last").isin(*t.accepting)).alias("valid"), "first_invalid")


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))


def parse_formatted(text: Column, t: Template = Template()) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    def quoted(marks):
        return "|".join("".join(c if c.isalnum() else "\\" + c for c in m) for m in marks)
    opening = quoted(o for o, _, _ in t.roles.values())
    closing = quoted([c for _, c, _ in t.roles.values()] + [t.other[2]])
    pattern = F.lit(f"(?s)({opening}|{quoted(t.other[:1])}(.*?){quoted(t.other[1:2])})(.*?)({closing})")

    def turn(mark_name: Column, body: Column) -> Column:
        role = unescape(mark_name["1"])
        for name, (o, _, _) in t.roles.items():
            role = F.when(mark_name["0"] == o, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    marks = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("0"), F.regexp_extract_all(text, pattern, 2).alias("1"))
    return F.zip_with(marks, F.regexp_extract_all(text, pattern, 3), turn)


def chat_digest(conversations: DataFrame, t: Template = Template()) -> DataFrame:
    """Digests per conversation, read back from the formatted text and its loss mask."""
    out = format_conversations(conversations, t).select(
        "conv_id", "valid", formatted_text(F.col("segments")).alias("formatted"), loss_text(F.col("segments")).alias("loss"))
    back = out.withColumn("turns", parse_formatted(F.col("formatted"), t))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "valid")
