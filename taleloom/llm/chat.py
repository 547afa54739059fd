"""Chat formatting with built-in functions only: a declarative template, and a state machine over roles.

A template gives each role the strings that open and close its turns and says whether its text counts
in the loss. Inside a text, the characters that control strings begin or end with are written as escapes, so
no text can hold a control string, and reading the output back gives the texts again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


#: Escapes, in the order in which they are written; they are undone in the opposite order.
ESCAPES = (("~", "~0"), ("[", "~1"), ("<", "~2"), (">", "~3"))


@dataclass(frozen=True)
class Template:
    """roles: how the turns of each known role look. other_open holds `{role}`: the opening for any other
    role, whose name is escaped like a text. turns: the state machine, as the roles that may follow a
    state; a state is the role of the last turn, or `start`."""

    roles: dict[str, Role] = field(default_factory=lambda: {
        "system": Role("<<SYS>> ", " <</SYS>>"),
        "user": Role("[INST] ", " [/INST]"),
        "assistant": Role("<ANSWER> ", " </s>", loss=True),
    })
    other_open: str = "<ROLE:{role}> "
    other_close: str = " </ROLE>"
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    })

    def __post_init__(self):
        for role in self.roles.values():
            if role.open[0] not in "[<" or "[" not in role.close and "<" not in role.close:
                raise ValueError("control strings must begin with [ or < or hold one")


LLAMA = Template()


def _escaped(text: Column) -> Column:
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def _unescaped(text: Column) -> Column:
    for raw, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def _by_role(role: Column, known: dict[str, str], other: Column) -> Column:
    out = None
    for name, value in known.items():
        out = (F.when if out is None else out.when)(role == name, F.lit(value))
    return out.otherwise(other)


#: Turns that are folded into one list before the lists are put together: a list is copied at each step.
CHUNK = 256


def _folded(turns: Column, template: Template) -> Column:
    """The state machine over turns: struct(state, n, first_bad, out). A step looks up the state that follows, notes the
    first turn (from 1) that none allows, and emits the turn's segments."""
    steps = F.create_map(*[F.lit(x) for s, after in template.turns.items() for r in after for x in (f"{s}\n{r}", r)])
    left, right = template.other_open.split("{role}")
    known = template.roles

    def segments(t: Column) -> Column:
        role = t["role"]
        opened = _by_role(role, {k: r.open for k, r in known.items()}, F.concat(F.lit(left), _escaped(role), F.lit(right)))
        closed = _by_role(role, {k: r.close for k, r in known.items()}, F.lit(template.other_close))
        loss = role.isin([k for k, r in known.items() if r.loss])
        return F.array(
            F.struct(opened.alias("text"), F.lit(False).alias("loss")),
            F.struct(_escaped(t["text"]).alias("text"), loss.alias("loss")),
            F.struct(closed.alias("text"), F.lit(False).alias("loss")),
        )

    def state(name: Column, n: Column, bad: Column, out: Column) -> Column:
        return F.struct(name.alias("state"), n.alias("n"), bad.alias("first_bad"), out.alias("out"))

    def step(s: Column, t: Column) -> Column:
        after, n = F.try_element_at(steps, F.concat(s["state"], F.lit("\n"), t["role"])), s["n"] + 1
        return state(F.coalesce(after, F.lit("invalid")), n, F.coalesce(s["first_bad"], F.when(after.isNull(), n)), F.concat(s["out"], segments(t)))

    segment = "array<struct<text:string,loss:boolean>>"

    def chunk(s: Column, part: Column) -> Column:
        inner = F.aggregate(part, state(s["state"], s["n"], s["first_bad"], F.array().cast(segment)), step)
        # transform over one element names the inner fold, so that it runs once
        return F.element_at(F.transform(F.array(inner), lambda x: state(x["state"], x["n"], x["first_bad"], F.concat(s["out"], F.array(x["out"])))), 1)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / CHUNK)), lambda i: F.slice(turns, (i * CHUNK + 1).cast("int"), CHUNK))
    return F.aggregate(parts, state(F.lit("start"), F.lit(0).cast("long"), F.lit(None).cast("long"), F.array().cast(f"array<{segment}>")), chunk)


def formatted(conversations: DataFrame, template: Template = LLAMA) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): conv_id, valid, first_bad, formatted, segments.

    segments is an array of (text, loss) whose texts make up `formatted`; only the texts of the roles that
    count are under the loss, never control strings. valid: whether the turns pass the state machine from
    its start; first_bad is the first turn (from 1) that does not, else null; every conversation is written, valid or not. Turns go by turn, then role, then text (a null
    turn first); repeated rows are turns of their own. A null text is empty, a null role the role
    `unknown`; a null conv_id is a conversation. No rows give no rows; other columns are ignored.
    """
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    out = turns.select("conv_id", _folded(F.col("turns"), template).alias("end"))
    out = out.select("conv_id", F.col("end.first_bad").isNull().alias("valid"), F.col("end.first_bad").alias("first_bad"), F.flatten("end.out").alias("segments"))
    return out.select("conv_id", "valid", "first_bad", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(output: DataFrame, template: Template = LLAMA) -> DataFrame:
    """Of formatted()'s output: conv_id, valid, first_bad, formatted, turns (an array of (role, text) parsed from `formatted`
    alone) and loss_text (what the segments' flags mark), both unescaped."""
    left, right = template.other_open.split("{role}")
    opens = "|".join([*(re.escape(r.open) for r in template.roles.values()), re.escape(left) + r"[^\[<>]*" + re.escape(right)])
    closes = "|".join(dict.fromkeys([*(re.escape(r.close) for r in template.roles.values()), re.escape(template.other_close)]))
    pattern = rf"({opens})([^\[<]*)({closes})"

    def group(i: int) -> Column:
        return F.regexp_extract_all("formatted", F.lit(pattern), F.lit(i))

    def turn(opened: Column, text: Column) -> Column:
        other = _unescaped(opened.substr(F.lit(len(left) + 1), F.length(opened) - F.lit(len(left) + len(right))))
        role = None
        for name, r in template.roles.items():
            role = (F.when if role is None else role.when)(opened == r.open, F.lit(name))
        return F.struct(role.otherwise(other).alias("role"), _unescaped(text).alias("text"))

    marked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: _unescaped(s["text"]))
    return output.select("conv_id", "valid", "first_bad", "formatted", F.zip_with(group(1), group(2), turn).alias("turns"), F.array_join(marked, "").alias("loss_text"))
