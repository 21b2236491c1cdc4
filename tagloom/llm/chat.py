"""Chat records of many layouts to canonical turns, and turns to one formatted string.

A record is JSON, or a struct whose absent fields are null. Its fingerprint is a hash of its
nested field paths and their types, and selects a declarative mapping: which paths hold
roles and texts. Texts of structs never pass through JSON, so that no limit of its
parser holds for them. The formatted string
marks turns with control strings; where a text holds one, it is escaped so that reading
back gives the very text. All of it is DataFrame functions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this template and of common others; backslashes stand between
#: opener and rest where one is escaped.
_OPEN, _REST = r"(<|\[)", r"(\||/?s>|/?INST\]|/?SYS>)"
TURNS = "array<struct<role:string,text:string>>"
#: A JSON record of more bytes that can't be parsed is an error, not a record without layout:
#: the parser has limits of its own.
PARSED_BYTES = 1 << 24


@dataclass(frozen=True)
class Layout:
    """How records with certain fields become turns.

    schema: the DDL that the record is read with; a list layout names the array of turns
    and its role and text fields; a flat layout names (role, fields) pairs, whose
    non-empty fields are joined by an empty line.
    """

    name: str
    schema: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    flat: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


#: Names of roles in conversations that were shared.
SHARED = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("messages", "messages array<struct<content:string,role:string>>", "messages", "role", "content"),
    Layout("conversations", "conversations array<struct<`from`:string,value:string>>", "conversations", "from", "value", roles=SHARED),
    Layout("prompt", "completion string, prompt string", flat=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", "instruction string, output string", flat=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction+input", "input string, instruction string, output string", flat=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction+system", "instruction string, output string, system string", flat=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
)


def paths(record: Column) -> Column:
    """The nested field paths and types of a JSON string, keys in order; null if it is none."""
    return F.schema_of_variant(F.try_parse_json(record))


def fingerprint(record: Column) -> Column:
    return F.substring(F.sha2(paths(record), 256), 1, 16)


def layout_paths(layout: Layout) -> str:
    """The paths of a record of the layout, as `paths` writes them."""
    def written(kind) -> str:
        if isinstance(kind, StructType):
            return "OBJECT<" + ", ".join(f"{f.name}: {written(f.dataType)}" for f in sorted(kind, key=lambda f: f.name)) + ">"
        if isinstance(kind, ArrayType):
            return f"ARRAY<{written(kind.elementType)}>"
        return kind.simpleString().upper()

    return written(StructType.fromDDL(layout.schema))


def _turns(layout: Layout, data: Column) -> Column:
    if layout.turns:

        def turn(t: Column) -> Column:
            role = t[layout.role]
            for name, known in layout.roles:
                role = F.when(t[layout.role] == name, F.lit(known)).otherwise(role)
            return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(t[layout.text], F.lit("")).alias("text"))

        return F.transform(data[layout.turns], turn)
    turns = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *(F.nullif(data[f], F.lit("")) for f in fields)).alias("text")) for role, fields in layout.flat]
    return F.array(*turns)


def _selected(tag: Column, layouts: tuple[Layout, ...], data) -> tuple[Column, Column]:
    """The layout's name and the turns that a fingerprint selects; data(layout) is the record as a struct."""
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for one in layouts:
        known = [layout_paths(one)] + ([f"OBJECT<{one.turns}: ARRAY<VOID>>"] if one.turns else [])  # an empty list has no type
        mine = tag.isin([hashlib.sha256(x.encode()).hexdigest()[:16] for x in known])
        found = _turns(one, data(one)).cast(TURNS)
        lost = F.raise_error(F.lit(f"a record of layout {one.name} could not be read")).cast(TURNS)
        name, turns = F.when(mine, F.lit(one.name)).otherwise(name), F.when(mine, F.coalesce(found, lost)).otherwise(turns)
    return name, turns


def canonical(records: DataFrame, column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with fingerprint, layout and turns (role, text) beside its own columns,
    of which those with these names are replaced.

    A record, JSON in a string, whose fingerprint no layout has gets null layout and turns;
    it is never guessed; so does JSON that can't be parsed, or is null, but one of over
    PARSED_BYTES that can't be parsed, or one of a known layout that can't be read, is an
    error. An empty list of turns gives an empty array. Rows are independent; an empty table
    gives none.
    """
    record = F.col(column)
    long = F.raise_error(F.lit("a record is too long for the JSON parser, or is none")).cast("string")
    tag = F.when(fingerprint(record).isNull() & (F.octet_length(record) > PARSED_BYTES), long).otherwise(fingerprint(record))
    layout, turns = _selected(F.col("_tag"), layouts, lambda one: F.from_json(record, one.schema))
    mine = [c for c in records.columns if c not in ("fingerprint", "layout", "turns")]
    return records.select(*mine, tag.alias("_tag")).select(*mine, F.col("_tag").alias("fingerprint"), layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    """One backslash more inside each control string, escaped or not."""
    return F.regexp_replace(text, rf"{_OPEN}(\\*){_REST}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_OPEN}\\(\\*){_REST}", "$1$2$3")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")  # at escaped backslashes
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def formatted(turns: Column) -> Column:
    """Turns as one string: marker, role, line end, escaped text, end marker, line end."""
    one = lambda t: F.concat(F.lit(TURN), _role_out(t.role), F.lit("\n"), escape(t.text), F.lit(f"{END}\n"))
    return F.array_join(F.transform(turns, one), "")


def read_back(text: Column) -> Column:
    """The turns of a formatted string: role, text, and `runs` of code points: how many a
    loss mask skips before the escaped text, and how many the text has."""
    pieces = F.filter(F.split(text, r"<\|turn\|>"), lambda p: p != "")

    def one(p: Column) -> Column:
        head = F.instr(p, "\n")
        body = p.substr(head + 1, F.length(p) - head - (len(END) + 1))
        return F.struct(_role_in(p.substr(F.lit(1), head - 1)).alias("role"), unescape(body).alias("text"), F.struct((head + len(TURN)).alias("skip"), F.length(body).alias("take")).alias("runs"))

    return F.transform(pieces, one)


def digests(texts: DataFrame) -> DataFrame:
    """texts (conv_id, formatted) -> what reading it back gives, as counts and SHA-256."""
    sha = lambda parts: F.sha2(F.array_join(parts, "").cast("binary"), 256)
    read = texts.withColumn("turns", read_back(F.col("formatted")))
    read = read.withColumn("loss", F.transform(F.filter("turns", lambda t: t.role == "assistant"), lambda t: t.text))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))).alias("turns_sha256"),
        F.length(F.array_join("loss", "")).cast("long").alias("loss_chars"),
        sha(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def records(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, data: a struct, one a conversation.

    Turns are in order of turn, role and text; null text and role are empty, a null turn
    is first, and rows with a null conv_id are one conversation. A conversation of user
    and assistant, after a system text or not, is written in the flat layout for it, any
    other as messages; the fields of other layouts are null.
    """
    rows = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))))
    grouped = conversations.groupBy("conv_id").agg(rows.alias("t"))
    shape = F.array_join(F.transform(F.slice("t", 1, 4), lambda t: t.role), ",")
    pair, triple = (F.size("t") == 2) & (shape == "user,assistant"), (F.size("t") == 3) & (shape == "system,user,assistant")
    text = lambda when, i: F.when(when, F.get("t", F.lit(i))["content"])
    messages = F.when(~pair & ~triple, F.transform("t", lambda t: F.struct(t.content.alias("content"), t.role.alias("role"))))
    fields = {"completion": text(pair, 1), "prompt": text(pair, 0), "instruction": text(triple, 1), "output": text(triple, 2), "system": text(triple, 0), "messages": messages}
    return grouped.select("conv_id", F.struct(*(c.alias(name) for name, c in fields.items())).alias("data"))


def outline(data: Column) -> Column:
    """A record struct as JSON with the same paths and types, but with empty texts, and lists of one element."""
    empty = lambda name: F.when(data[name].isNotNull(), F.lit("")).alias(name)
    one = F.transform(F.slice(data["messages"], 1, 1), lambda _: F.struct(F.lit("").alias("content"), F.lit("").alias("role")))
    return F.to_json(F.struct(*map(empty, ("completion", "prompt", "instruction", "output", "system")), one.alias("messages")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, layout, fingerprint, formatted; an empty table gives none.

    A conversation is one group: its turns, however many, meet in one row, which holds the
    formatted string anyhow; it may have 2 GB, and a task needs several times that of heap.
    """
    have = ("messages", "prompt", "instruction+system")
    tagged = records(conversations).withColumn("fingerprint", fingerprint(outline(F.col("data"))))
    layout, turns = _selected(F.col("fingerprint"), tuple(one for one in LAYOUTS if one.name in have), lambda one: F.col("data"))
    return tagged.select("conv_id", layout.alias("layout"), "fingerprint", formatted(turns).alias("formatted"))
