"""Chat formatting with DataFrame functions alone.

A declarative template gives each role its opening and closing control string and whether its text
bears loss, and a finite-state machine over roles says which turn may follow which. A conversation
becomes an array of segments (text, loss) whose texts joined are the training string. Control
strings inside a text are escaped, reversibly: backslashes are doubled, then ``\\!`` goes after a
control string's first character. No control string overlaps itself, so the first closing string
after an opening one always ends the turn, and the string can be read back.

Cases: a null text or role is empty; rows with a null conv_id are one conversation; turns are ordered by (turn, role, text), null first, and
repeated rows stay; a role the template lacks is marked with its name in base64 and bears no loss;
a conversation out of turn order is formatted too, with ``valid`` false. A conversation is one
output string, so its rows meet in one task: its length, not the table's, bounds that group.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role]
    other: Role
    #: (state, role) -> next state; anything else is out of order.
    moves: dict[tuple[str, str], str]
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = field(default=())

    def strings(self) -> list[str]:
        every = [x.strip() for r in [*self.roles.values(), self.other] for x in (r.opening, r.closing)]
        return sorted({*every, *self.controls}, key=lambda x: (-len(x), x))


INSTRUCT = Template(
    roles={"system": Role("<<SYS>>", "<</SYS>>"), "user": Role("[INST] ", " [/INST]"), "assistant": Role("<s>", "</s>", loss=True)},
    other=Role("<turn ", "</turn>"),
    moves={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.strings():
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\!{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|!)", "$1")


def _by_role(role: Column, template: Template, known, other: Column) -> Column:
    out = other
    for name, r in template.roles.items():
        out = F.when(role == name, known(r)).otherwise(out)
    return out


def final_state(roles: Column, template: Template) -> Column:
    """The machine's state after an array of roles; null once a turn is out of order."""

    def move(state: Column, role: Column) -> Column:
        out = F.lit(None).cast("string")
        for (a, r), b in template.moves.items():
            out = F.when((state == a) & (role == r), F.lit(b)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit(template.start), move)


def segments(turns: Column, template: Template) -> Column:
    """array<struct<text, loss>> of an array of turns."""

    def of(t: Column) -> Column:
        role, text = t["role"], escape(t["text"], template)
        opening = _by_role(role, template, lambda r: F.lit(r.opening), F.concat(F.lit(template.other.opening), F.base64(role.cast("binary")), F.lit(">")))
        closing = _by_role(role, template, lambda r: F.lit(r.closing), F.lit(template.other.closing))
        loss = _by_role(role, template, lambda r: F.lit(r.loss), F.lit(False))
        part = lambda x, y: F.struct(x.alias("text"), y.alias("loss"))
        return F.array(part(opening, F.lit(False)), part(text, loss), part(closing, F.lit(False)))

    return F.flatten(F.transform(turns, of))


def format_chats(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """rows(conv_id, turn, role, text) -> conv_id, valid, segments, formatted."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    state = final_state(F.transform("turns", lambda t: t["role"]), template)
    out = chats.select("conv_id", F.coalesce(state.isin(*template.accept), F.lit(False)).alias("valid"), segments(F.col("turns"), template).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in text)


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """array<struct<role, text>> of a formatted string."""
    known = [f"{_quoted(r.opening)}.*?{_quoted(r.closing)}" for r in template.roles.values()]
    other = f"{_quoted(template.other.opening)}[A-Za-z0-9+/=]*>.*?{_quoted(template.other.closing)}"
    turns = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join([*known, other])), F.lit(0))

    def of(t: Column) -> Column:
        head = F.locate(">", t)
        name = F.substring(t, F.lit(len(template.other.opening) + 1), head - F.lit(len(template.other.opening) + 1))
        role = F.decode(F.unbase64(name), "UTF-8")
        text = F.substring(t, head + 1, F.length(t) - head - F.lit(len(template.other.closing)))
        for n, r in template.roles.items():
            is_r = t.startswith(r.opening)
            role = F.when(is_r, F.lit(n)).otherwise(role)
            text = F.when(is_r, F.substring(t, F.lit(len(r.opening) + 1), F.length(t) - F.lit(len(r.opening) + len(r.closing)))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(turns, of)


def digest(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    read = chats.withColumn("turns", read_back(F.col("formatted"), template))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(every).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        sha(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
