"""Chat formatting with DataFrame functions only.

A declarative :class:`Template` says how a turn opens and closes and which roles are learned.  A
finite-state machine over the roles validates the order of turns.  The output is a list of text
segments with a loss flag each; joined, they are the training text.

Control strings inside texts are escaped reversibly: every ``<``, backslashes, ``|`` in a row gets
one more backslash, so no text can hold ``<|``; reading back takes one backslash away.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written and learned, and the machine that says which order is valid."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    #: A line break inside a role, so that the first one ends it.
    role_break: str = "<|br|>"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) -> state; what is missing leads to "invalid", which no role leaves.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accepting: tuple[str, ...] = ("assistant",)


CHAT = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def final_state(roles: Column, template: Template = CHAT) -> Column:
    """The state of the machine after the roles, in order."""
    moves = F.create_map(*[x for (state, role), to in template.moves.items() for x in (F.lit(f"{state}\n{role}"), F.lit(to))])

    def step(state: Column, role: Column) -> Column:
        return F.coalesce(F.element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit("invalid"))

    return F.aggregate(roles, F.lit(template.start), step)


def segments(turns: Column, template: Template = CHAT) -> Column:
    """Array of (text, loss) for ordered (role, text) structs: per turn the opening, the text, the closing."""

    def of(turn: Column) -> Column:
        role = F.replace(escape(turn["role"]), F.lit("\n"), F.lit(template.role_break))
        head = F.concat(F.lit(template.open), role, F.lit(template.after_role))
        tail = F.lit(template.close + template.after_turn)
        learned = turn["role"].isin(*template.learned)
        no = F.lit(False)
        return F.array(
            F.struct(head.alias("text"), no.alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), learned.alias("loss")),
            F.struct(tail.alias("text"), no.alias("loss")),
        )

    return F.flatten(F.transform(turns, of))


def format_conversations(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation: conv_id, segments, formatted, state, valid.

    ``rows`` has conv_id, turn, role, text.  Turns go by turn number, null first, ties by role and
    text; null roles and texts are empty; rows with a null conv_id form one conversation; repeated
    rows are turns of their own.  Invalid orders are formatted too and say so in ``valid``.  A
    conversation is one output row, so its turns are gathered in one task; a key that held a large
    part of the table would be one such text.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    made = grouped.select("conv_id", segments(F.col("turns"), template).alias("segments"), final_state(F.col("turns.role"), template).alias("state"))
    return made.select(
        "conv_id", "segments", F.array_join("segments.text", "").alias("formatted"), "state", F.col("state").isin(*template.accepting).alias("valid")
    )


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """The (role, text) turns of a formatted text, by its marks alone."""
    tail = len(template.close + template.after_turn)
    bodies = F.slice(F.split(formatted, _quoted(template.open), -1), 2, 1 << 30)

    def of(body: Column) -> Column:
        at = F.instr(body, template.after_role)
        role = F.replace(F.substring(body, F.lit(1), at - 1), F.lit(template.role_break), F.lit("\n"))
        start = at + len(template.after_role)
        text = F.substring(body, start, F.greatest(F.lit(0), F.char_length(body) - tail - start + 1))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, of)


def loss_text(parts: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"
