"""Chat formatting: a finite-state machine over roles, text segments with loss flags, and a reader of the result.

Built-in column functions only.  A template is data: a header per role, a closing mark, which roles carry loss, and the allowed
transitions.  Control strings cannot occur inside texts: ``\\``, ``<`` and ``#`` are escaped, one by one, and come back exactly.

Defined results: a null text is empty; a null role is the empty role; roles that the template does not know get the header
``### =<role>: `` and make the conversation invalid; equal turn numbers are ordered by role, then text; repeated rows are turns of
their own; a null conv_id is a conversation of its own; no rows give no rows.  Extra columns are ignored.  One conversation becomes
one row (its digest needs the whole), so a conversation is bounded by the size of a row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = (("<", "l"), ("#", "h"), (":", "c"))


@dataclass(frozen=True)
class Template:
    headers: dict = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    close: str = "</turn>\n"
    loss_roles: tuple = ("assistant",)
    transitions: dict = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    final: tuple = ("assistant",)


TURNS = Template()


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column, colon: bool = False) -> Column:
    text = _replace(text, "\\", "\\\\")
    for char, letter in ESCAPES[: 3 if colon else 2]:
        text = _replace(text, char, "\\" + letter)
    return text


def unescape(text: Column) -> Column:
    """Between doubled backslashes, a backslash starts an escape; cutting there first keeps the order of reading."""

    def part(piece: Column) -> Column:
        for char, letter in ESCAPES:
            piece = _replace(piece, "\\" + letter, char)
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def _header(role: Column, template: Template) -> Column:
    out = F.concat(F.lit("### ="), escape(role, colon=True), F.lit(": "))
    for name, header in template.headers.items():
        out = F.when(role == name, F.lit(header)).otherwise(out)
    return out


def _run_machine(roles: Column, template: Template) -> Column:
    moves = F.lit("error")
    step = lambda state, role: _moves(state, role, template, moves)
    return F.aggregate(roles, F.lit("start"), step)


def _moves(state: Column, role: Column, template: Template, otherwise: Column) -> Column:
    out = otherwise
    for source, targets in template.transitions.items():
        out = F.when((state == source) & role.isin(*targets), role).otherwise(out)
    return out


def format_chats(conversations: DataFrame, template: Template = TURNS) -> DataFrame:
    """conv_id, n_turns, valid, segments array<struct<text, loss>> (header, content, closing mark of each turn), formatted."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = F.flatten(F.transform("turns", lambda t: F.array(
        segment(_header(t["role"], template), F.lit(False)),
        segment(escape(t["text"]), t["role"].isin(*template.loss_roles)),
        segment(F.lit(template.close), F.lit(False)),
    )))
    state = _run_machine(F.col("turns.role"), template)
    return grouped.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*template.final).alias("valid"), pieces.alias("segments"),
    ).withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_turns(formatted: Column, template: Template = TURNS) -> Column:
    """array<struct<role, text>> parsed back from a formatted conversation."""
    parts = F.split(formatted, template.close)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def role(part: Column) -> Column:
        out = unescape(F.regexp_extract(part, r"^### =([^:]*): ", 1))
        for name, header in template.headers.items():
            out = F.when(F.startswith(part, F.lit(header)), F.lit(name)).otherwise(out)
        return out

    content = lambda part: unescape(F.substring(part, F.instr(part, ": ") + 2, F.length(part)))
    return F.transform(parts, lambda p: F.struct(role(p).alias("role"), content(p).alias("text")))


def loss_text(segments: Column) -> Column:
    """The unescaped text of all segments that carry loss."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
