r"""Chat formatting: a machine over roles checks turn order, a declarative template emits segments with loss flags.

A Template names the control strings and which roles bear loss; TRANSITIONS say which role may follow in
which state. Each turn gives three segments: head, text, tail; the text of a loss role is under the loss mask.
Inside texts and roles every control string is broken up, so that it can't be read as one: a backslash goes after
its first character, and each backslash is doubled. Both are one regular expression; one more undoes them.
Control strings hold no backslash, hence a single backslash is always ours and the way back is exact.

The shuffle only puts a conversation's turns in order, as they came; they are escaped after it. A conversation is one value of the result, so its turns meet in one row by contract (a row
holds 2 GB at most).

Defined results: null text or role counts as empty; unknown roles are formatted like any other, make the
conversation invalid and bear no loss; turns of equal number are ordered by role, then text; null turns come
first; a null conv_id is a conversation of its own; an empty table gives no conversations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """head is opened + role + closed; a turn is head, text, tail."""

    opened: str = "### "
    closed: str = ":\n"
    tail: str = "</turn>\n"
    #: Strings that a text must not hold: markers of this template and of others that a model may know.
    control: tuple[str, ...] = ("### ", "</turn>", ":\n", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("answered",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "primed",
            ("start", "user"): "asked",
            ("primed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )

    def __post_init__(self):
        if any("\\" in c or len(c) < 2 for c in self.control):
            raise ValueError("a control string has two characters or more, and no backslash")
        if self.opened not in self.control or self.closed not in self.control or self.tail.rstrip("\n") not in self.control:
            raise ValueError("the template's own markers are control strings")


DEFAULT = Template()


def _pattern(t: Template) -> str:
    return "(\\\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in t.control) + ")"


def escaped(text: Column, t: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, F.lit(_pattern(t)), F.lit("$1\\\\"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("\\\\(\\\\?)"), F.lit("$1"))


def _machine(roles: Column, t: Template) -> Column:
    """struct(state, bad): the state after all roles, and the first turn (from 0) that no transition allows, or null."""
    table = F.create_map(*(F.lit(x) for (state, role), to in t.transitions.items() for x in (f"{state}\0{role}", to)))
    zero = F.struct(F.lit(t.start).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n"))

    def step(acc: Column, role: Column) -> Column:
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("\0"), role))
        bad = F.coalesce(acc["bad"], F.when(to.isNull(), acc["n"]))
        return F.struct(F.coalesce(to, F.lit("rejected")).alias("state"), bad.alias("bad"), (acc["n"] + 1).alias("n"))

    return F.aggregate(roles, zero, step)


def format_chats(rows: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text): conv_id, n_turns, formatted, segments (text, loss), valid, bad_turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    chats = rows.select("conv_id", turn.alias("__mw_turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("__mw_turn")).alias("turns"))
    segment = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))

    def emit(x: Column) -> Column:
        head = F.concat(F.lit(t.opened), escaped(x["role"], t), F.lit(t.closed))
        return F.array(segment(head, F.lit(False)), segment(escaped(x["text"], t), x["role"].isin(*t.loss_roles)), segment(F.lit(t.tail), F.lit(False)))

    chats = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", emit)).alias("segments"), _machine(F.transform("turns", lambda x: x["role"]), t).alias("end"))
    return chats.select("conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", (F.col("end.bad").isNull() & F.col("end.state").isin(*t.accept)).alias("valid"), F.col("end.bad").alias("bad_turn"))


def read_turns(formatted: Column, t: Template = DEFAULT) -> Column:
    """array of struct(role, text), read back from formatted text alone: no text or role holds a marker."""
    pieces = F.split(formatted, re.escape(t.tail), -1)
    bodies = F.slice(pieces, 1, F.size(pieces) - 1)

    def read(p: Column) -> Column:
        at = F.instr(p, t.closed)
        role = F.substring(p, F.lit(len(t.opened) + 1), at - len(t.opened) - 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(p, at + len(t.closed), F.length(p))).alias("text"))

    return F.transform(bodies, read)


def digests(chats: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """The contract's digests, of what the output says: turns from the formatted text, loss from the segments under the mask."""
    told = F.array_join(F.transform(read_turns(F.col("formatted"), t), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    rows = chats.select("conv_id", F.size(read_turns(F.col("formatted"), t)).cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn")
    return rows.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid", "bad_turn")
