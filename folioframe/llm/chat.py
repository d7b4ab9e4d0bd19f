"""Chat formatting by a declarative template and a finite-state machine over roles.

A turn is written as ``before + escaped text + after``. Every control string of the template is
broken up by a backslash where it occurs inside a text, so that the output can be read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``roles``: role to (before, after); no two roles have the same two. A role that is not listed is
    written out by name with ``named``: (before name, after name, after text). ``loss``: the roles
    whose texts are under the loss mask. ``moves``: state to {role: next state}, from ``start``;
    ``accept``: the states in which a conversation may end. A template whose output could not be read
    back is a ValueError."""

    begin: str = "<s>"
    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")})
    named: tuple[str, str, str] = ("[ROLE] ", " [/ROLE]", "[/TURN]")
    loss: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
    )
    accept: tuple[str, ...] = ("user", "assistant")

    def __post_init__(self) -> None:
        starts = {self.named[0], self.named[1], *(b for b, _ in self.roles.values() if b)}
        stops = {self.named[2], *(a for _, a in self.roles.values())}
        cores = {x.strip() for x in self.marks()}
        if any(len(x) < 2 or "\\" in x for x in cores) or not all(stops) or not all(self.named):
            raise ValueError("a mark needs two characters besides white space and no backslash, and only those before a text may be empty")
        if len(set(self.roles.values())) < len(self.roles) or self.named[1:] in self.roles.values() or starts & (stops | {self.begin}):
            raise ValueError("the marks do not tell the roles apart")
        for x in cores:
            for y in {*self.marks(), *cores}:
                if any(y.startswith(x[i:]) for i in range(1, len(x))):
                    raise ValueError(f"a text before {y!r} could end in {x!r}")

    def marks(self) -> list[str]:
        found = [self.begin, *self.named, *(x for pair in self.roles.values() for x in pair)]
        return sorted({x for x in found if x}, key=lambda x: (-len(x), x))

    def mark_pattern(self) -> str:
        return "|".join(re.sub(r"([^A-Za-z0-9 ])", r"\\\1", x) for x in self.marks())


def escape(text: Column, template: Template) -> Column:
    """Reversible: a backslash is doubled, and one goes behind the first character of each control string."""
    cores = sorted({x.strip() for x in template.marks()}, key=lambda x: (-len(x), x))
    quote = lambda x: re.sub(r"([^A-Za-z0-9])", r"\\\1", x)
    pattern = "|".join(f"(?<={quote(x[0])})(?={quote(x[1:])})" for x in cores)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), pattern, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(df: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conv_id: ``n_turns``, ``end_state``, ``valid``, ``first_invalid`` (turn place from 0,
    or null), ``segments`` array<struct<text, loss>> and ``formatted``, their concatenation.

    Turns go by (turn, role, text), nulls first; equal rows are turns of their own. Null text or role
    counts as empty; null conv_id is one conversation. Invalid turn order is reported and still
    formatted. A conversation is one value, so one conversation must fit into a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    convs = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))

    def move(state: Column, turn: Column) -> Column:
        to = F.lit("invalid")
        for at, by in template.moves.items():
            for name, then in by.items():
                to = F.when((state["state"] == at) & (turn["role"] == name), F.lit(then)).otherwise(to)
        return F.struct(to.alias("state"), (state["n"] + 1).alias("n"), F.coalesce(state["bad"], F.when(to == "invalid", state["n"])).alias("bad"))

    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def segments(turn: Column) -> Column:
        before, after = F.concat(F.lit(template.named[0]), escape(turn["role"], template), F.lit(template.named[1])), F.lit(template.named[2])
        for name, (b, a) in template.roles.items():
            before, after = F.when(turn["role"] == name, F.lit(b)).otherwise(before), F.when(turn["role"] == name, F.lit(a)).otherwise(after)
        return F.array(
            F.struct(before.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"], template).alias("text"), turn["role"].isin(*template.loss).alias("loss")),
            F.struct(after.alias("text"), F.lit(False).alias("loss")),
        )

    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    return (
        convs.withColumn("run", F.aggregate("turns", start, move))
        .withColumn("segments", F.concat(begin, F.flatten(F.transform("turns", segments))))
        .select(
            "conv_id",
            F.size("turns").cast("bigint").alias("n_turns"),
            F.col("run.state").alias("end_state"),
            (F.col("run.bad").isNull() & F.col("run.state").isin(*template.accept)).alias("valid"),
            F.col("run.bad").alias("first_invalid"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> of a formatted conversation, without its segments."""
    pattern = template.mark_pattern()
    pieces = F.arrays_zip(F.split(formatted, pattern, -1).alias("text"), F.regexp_extract_all(formatted, F.lit(f"({pattern})"), F.lit(1)).alias("mark"))
    before = [template.named[1], *(b for b, _ in template.roles.values() if b)]

    def turn(held: Column, piece: Column, i: Column) -> Column:
        last = F.get(held, i - 1)
        role = F.when((piece["mark"] == template.named[2]) & (last["mark"] == template.named[1]), unescape(last["text"]))
        for name, (b, a) in template.roles.items():
            opened = last["mark"] == b if b else ~F.coalesce(last["mark"].isin(before), F.lit(False))
            role = role.when((piece["mark"] == a) & opened, F.lit(name))
        return F.struct(role.alias("role"), unescape(piece["text"]).alias("text"))

    # An array of one, so that the pieces are worked out once and not again for every turn.
    turns = F.transform(F.array(pieces), lambda held: F.filter(F.transform(held, lambda piece, i: turn(held, piece, i)), lambda x: x["role"].isNotNull()))
    return F.get(turns, 0)
