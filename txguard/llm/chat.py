"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names, for each role, the strings around a turn's text, whether the
text counts for the loss, and which roles may follow. Control strings inside
texts are escaped by one more backslash after their first character, which
``unescape`` takes back. All of it is DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How turns of one role are written, and the roles that may follow."""

    before: str
    after: str
    loss: bool
    next: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    """Turns by role, the strings around turns of any other role, and the roles that may start and end."""

    turns: dict[str, Turn]
    start: tuple[str, ...]
    final: tuple[str, ...]
    other_before: tuple[str, str] = ("<<TURN ", ">>\n")
    other_after: str = "\n<</TURN>>"
    null_role: str = "<<TURN>>\n"

    def controls(self) -> list[str]:
        """The control strings, without the white space that stands beside them."""
        marks = [m.strip() for t in self.turns.values() for m in (t.before, t.after)]
        marks += [self.other_before[0].strip(), self.other_after.strip()]
        return sorted(set(marks), key=lambda m: (-len(m), m))


INSTRUCT = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n", False, ("user",)),
        "user": Turn("[INST] ", " [/INST] ", False, ("assistant",)),
        "assistant": Turn("<s> ", " </s>\n", True, ("user",)),
    },
    start=("system", "user"),
    final=("assistant",),
)


def _by_first(template: Template) -> dict[str, list[str]]:
    """The control strings without their first character, by that character."""
    found: dict[str, list[str]] = {}
    for mark in template.controls():
        found.setdefault(mark[0], []).append(mark[1:])
    return found


def escape(text: Column, template: Template = INSTRUCT) -> Column:
    """Put one more backslash after the first character of each control string, however many stand there."""
    for first, rests in _by_first(template).items():
        rest = "|".join(map(re.escape, rests))
        text = F.regexp_replace(text, f"({re.escape(first)})(\\\\*)(?={rest})", "$1\\\\$2")
    return text


def unescape(text: Column, template: Template = INSTRUCT) -> Column:
    """Undo ``escape``."""
    for first, rests in _by_first(template).items():
        rest = "|".join(map(re.escape, rests))
        text = F.regexp_replace(text, f"({re.escape(first)})\\\\(\\\\*)(?={rest})", "$1$2")
    return text


def _by_role(role: Column, template: Template, of: str, other: Column) -> Column:
    chosen = other
    for name, turn in template.turns.items():
        chosen = F.when(role.eqNullSafe(F.lit(name)), F.lit(getattr(turn, of))).otherwise(chosen)
    return chosen


def segments(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Each turn's ``before``, escaped ``body`` and ``after``, and whether the body counts for the loss.

    One row per turn, with no rows brought together. A null text is empty. A role
    that the template does not know is written with its name; a null role has none.
    """
    role, text = F.col("role"), F.coalesce(F.col("text"), F.lit(""))
    opened, closed = template.other_before
    other = F.when(role.isNull(), F.lit(template.null_role)).otherwise(
        F.concat(F.lit(opened), escape(F.regexp_replace(role, "[\\\\>\n]", "\\\\$0"), template), F.lit(closed))
    )
    return conversations.select(
        "conv_id",
        "turn",
        "role",
        _by_role(role, template, "before", other).alias("before"),
        escape(text, template).alias("body"),
        _by_role(role, template, "after", F.lit(template.other_after)).alias("after"),
        _by_role(role, template, "loss", F.lit(False)).alias("loss"),
    )


def _machine(turns: Column, template: Template) -> Column:
    """Number of turns that the machine accepts in order; all of them if the conversation's order is valid so far."""
    steps = {f">{name}": name for name in template.start}
    steps |= {f"{name}>{after}": after for name, turn in template.turns.items() for after in turn.next}
    table = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair])

    def step(state: Column, turn: Column) -> Column:
        reached = F.try_element_at(table, F.concat(state["at"], F.lit(">"), F.coalesce(turn["role"], F.lit("?"))))
        moved = F.struct(reached.alias("at"), (state["accepted"] + 1).alias("accepted"), F.lit(False).alias("stuck"))
        stuck = F.struct(state["at"].alias("at"), state["accepted"].alias("accepted"), F.lit(True).alias("stuck"))
        return F.when(state["stuck"] | reached.isNull(), stuck).otherwise(moved)

    begin = F.struct(F.lit("").alias("at"), F.lit(0).alias("accepted"), F.lit(False).alias("stuck"))
    return F.aggregate(turns, begin, step)


def formatted(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation: ``formatted`` text, ``loss_spans`` in it, and whether the turn order is valid.

    Turns go by turn number, null last; turns with equal numbers by role and text,
    so repeated rows stay. All conversations are written; ``valid`` tells whether
    the machine accepts all turns and ends in a final role, ``accepted`` how many
    turns it takes. Spans count code points, from 0. A null ``conv_id`` is one
    conversation.
    """
    rows = segments(conversations, template)
    turn = F.struct(
        F.col("turn").isNull().alias("late"), "turn", "role", F.concat("before", "body", "after").alias("written"),
        F.length("before").alias("skip"), F.length("body").alias("chars"), "loss",
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    state = _machine(F.col("turns"), template)

    def lay(at: Column, t: Column) -> Column:
        span = F.struct((at["at"] + t["skip"]).alias("start"), t["chars"].alias("length"))
        spans = F.when(t["loss"], F.concat(at["spans"], F.array(span))).otherwise(at["spans"])
        return F.struct((at["at"] + F.length(t["written"])).alias("at"), spans.alias("spans"))

    none = F.expr("cast(array() as array<struct<start: int, length: int>>)")
    laid = F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("spans")), lay, lambda at: at["spans"])
    return grouped.withColumn("__state", state).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("formatted"),
        laid.alias("loss_spans"),
        F.col("__state")["accepted"].alias("accepted"),
        (~F.col("__state")["stuck"] & F.col("__state")["at"].isin(*template.final)).alias("valid"),
    )


def parsed(output: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Read ``formatted`` back: ``turns`` (role, text) and ``loss_texts``, both unescaped."""
    opened, closed = template.other_before
    whole = "(?s)" + "|".join(f"({re.escape(t.before)})(.*?){re.escape(t.after)}" for t in template.turns.values())
    n = len(template.turns)
    whole += f"|({re.escape(opened)})([^\\\\>\n]*+(?:\\\\.[^\\\\>\n]*+)*+){re.escape(closed)}(.*?){re.escape(template.other_after)}"
    whole += f"|({re.escape(template.null_role)})(.*?){re.escape(template.other_after)}"

    def group(k: int) -> Column:
        return F.regexp_extract_all("formatted", F.lit(whole), F.lit(k))

    names = list(template.turns)
    parts = F.arrays_zip(*[group(k).alias(f"g{k}") for k in range(1, 2 * n + 6)])
    rows = output.withColumn("__parts", parts)

    def turn(p: Column) -> Column:
        at = 2 * n + 1
        role = F.when(p[f"g{at}"] != "", F.regexp_replace(unescape(p[f"g{at + 1}"], template), r"(?s)\\(.)", "$1"))
        text = F.when(p[f"g{at}"] != "", p[f"g{at + 2}"]).otherwise(p[f"g{at + 4}"])
        for k, name in enumerate(names):
            role = F.when(p[f"g{2 * k + 1}"] != "", F.lit(name)).otherwise(role)
            text = F.when(p[f"g{2 * k + 1}"] != "", p[f"g{2 * k + 2}"]).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    def masked(span: Column) -> Column:
        return unescape(F.substring(F.col("formatted"), span["start"] + 1, span["length"]), template)

    return rows.withColumns(
        {"turns": F.transform("__parts", turn), "loss_texts": F.transform("loss_spans", masked)}
    ).drop("__parts")
