"""Chat formatting: tables of any known layout to canonical turns, to one training text a conversation.

The nested field paths of a table's schema with their kinds (number, text, or the type's name) are hashed; the hash selects
the declarative mapping (SQL expressions) to canonical turns (conv_id, turn, role, text). A table whose hash is no layout's
may have more columns or fields than a layout: then, layout by layout and those of most paths first, its paths that the
layout has are hashed. More columns are left out of the output. A path of another kind is another path: text ids, say, fit no
layout. `json_turns` does the same row by row for a column of JSON objects, by the names of their paths (JSON values of
another kind are null); rows without a layout, as those of invalid JSON or without any message, are not among its turns, and
`json_layout` is null for them. The template writes each turn as

    <s>[INST]role[/INST]text</s>

A control string inside a role or text gets one backslash more after its bracket (`<s>` -> `<\\s>`, `<\\s>` -> `<\\\\s>`),
which reading takes away again, so any text comes back and none can end a turn. The loss mask are the spans (in code
points of the formatted text) of the assistants' texts.

Null roles and texts count as empty. Rows without a conversation id form one conversation, with a null id. Turns of one
number are ordered by role and text; repeated rows are turns of their own. An empty table gives no rows. A conversation
is one output row by definition, so its turns meet in one group; nothing else does. Texts of any length are kept whole, and
a conversation must fit one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """Field paths with kinds that make up a layout, and how its rows become turns: id, array of (turn, role, text)."""

    name: str
    paths: tuple[str, ...]
    conv_id: str
    turns: str


def _turn(turn: str, role: str, text: str) -> str:
    return f"named_struct('turn', cast({turn} as bigint), 'role', cast({role} as string), 'text', cast({text} as string))"


LAYOUTS = (
    Layout("turn rows", ("conv_id number", "turn number", "role text", "text text"), "conv_id", f"array({_turn('turn', 'role', 'text')})"),
    Layout("messages", ("conv_id number", "messages[].role text", "messages[].content text"), "conv_id", f"transform(messages, (m, i) -> {_turn('i', 'm.role', 'm.content')})"),
    Layout("from and value", ("id number", "conversations[].from text", "conversations[].value text"), "id", f"transform(conversations, (m, i) -> {_turn('i', "decode(m.from, 'human', 'user', 'gpt', 'assistant', m.from)", 'm.value')})"),
    Layout("instruction", ("id number", "instruction text", "input text", "output text"), "id", f"""array({_turn('0', "'user'", "concat_ws(chr(10), instruction, nullif(input, ''))")}, {_turn('1', "'assistant'", 'output')})"""),
    Layout("prompt", ("id number", "prompt text", "completion text"), "id", f"""array({_turn('0', "'user'", 'prompt')}, {_turn('1', "'assistant'", 'completion')})"""),
)


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of all leaves, each with its kind: dots for fields, [] for array elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return [f"{prefix} {'number' if isinstance(kind, T.IntegralType) else 'text' if isinstance(kind, T.StringType) else kind.simpleString()}"]


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def select_layout(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    """The layout of the schema's hash; with more columns or fields, see the module."""
    by_hash, have = {fingerprint(x.paths): x for x in layouts}, field_paths(schema)
    tried = [have] + [[p for p in have if p in x.paths] for x in sorted(layouts, key=lambda x: -len(x.paths))]
    found = [by_hash[h] for h in map(fingerprint, tried) if h in by_hash]
    if not found:
        raise ValueError(f"no layout for the fields {sorted(have)}")
    return found[0]


def _names(layout: Layout) -> list[str]:
    return [p.split(" ")[0] for p in layout.paths]


def json_layout(json: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The name of the layout of each JSON object, null for none; elements of an array have the fields of the first."""
    nothing = F.expr("cast(array() as array<string>)")
    arrays = sorted({n.split("[]")[0] for x in layouts for n in _names(x) if "[]." in n})
    of_elements = lambda a: F.transform(F.json_object_keys(F.get_json_object(json, f"$.{a}[0]")), lambda k: F.concat(F.lit(f"{a}[]."), k))
    parts = [F.filter(F.json_object_keys(json), lambda k: ~k.isin(arrays)), *map(of_elements, arrays)]
    have = F.concat(*[F.coalesce(p, nothing) for p in parts])
    digest = lambda paths: F.sha2(F.array_join(F.sort_array(F.array_distinct(paths)), "\n"), 256)
    whole = [F.when(digest(have) == fingerprint(_names(x)), x.name) for x in layouts]
    within = [F.when(digest(F.array_intersect(have, F.array(*map(F.lit, _names(x))))) == fingerprint(_names(x)), x.name) for x in sorted(layouts, key=lambda x: -len(x.paths))]
    return F.coalesce(*whole, *within)


def _json_type(layouts: tuple[Layout, ...]) -> T.StructType:
    sql = {"number": T.LongType(), "text": T.StringType()}
    plain, nested = {}, {}
    for path, kind in (p.split(" ") for x in layouts for p in x.paths):
        column, _, field = path.partition("[].")
        (nested.setdefault(column, {}) if field else plain)[field or column] = sql[kind]
    struct = lambda fields: T.StructType([T.StructField(n, t) for n, t in fields.items()])
    return struct(plain | {c: T.ArrayType(struct(f)) for c, f in nested.items()})


def json_turns(rows: DataFrame, column: str = "json", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) of a column of JSON objects, each row of its own layout."""
    read = rows.select(json_layout(F.col(column), layouts).alias("layout"), F.from_json(F.col(column), _json_type(layouts)).alias("r")).select("layout", "r.*")
    pick = lambda sql: F.coalesce(*[F.when(F.col("layout") == x.name, F.expr(sql(x))) for x in layouts])
    return _turns(read.filter("layout is not null"), pick(lambda x: f"cast({x.conv_id} as bigint)"), pick(lambda x: x.turns))


def canonical_turns(rows: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) of a table of any known layout."""
    layout = select_layout(rows.schema, layouts)
    return _turns(rows, F.expr(f"cast({layout.conv_id} as bigint)"), F.expr(layout.turns))


def _turns(rows: DataFrame, conv_id: Column, turns: Column) -> DataFrame:
    out = rows.select(conv_id.alias("conv_id"), F.explode(turns).alias("t"))
    return out.select("conv_id", "t.turn", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = r"(s>|INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[]/?)(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[]/?)\\(\\*)" + _CONTROL, r"$1$2$3")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one text a conversation, and where the assistants' texts are in it."""
    cut = turns.select("conv_id", F.struct("turn", "role", "text", escape("role").alias("r"), escape("text").alias("x")).alias("t"))
    whole = cut.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    formatted = F.array_join(F.transform("ts", lambda t: F.concat(F.lit(OPEN), t.r, F.lit(MIDDLE), t.x, F.lit(CLOSE))), "")
    around = len(OPEN) + len(MIDDLE)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc.at + around + F.length(t.r)
        own = F.struct(start.cast("long").alias("start"), F.length(t.x).cast("long").alias("length"))
        return F.struct((start + F.length(t.x) + len(CLOSE)).cast("long").alias("at"), F.when(t.role == "assistant", F.concat(acc.spans, F.array(own))).otherwise(acc.spans).alias("spans"))

    return whole.select("conv_id", formatted.alias("formatted"), F.aggregate("ts", zero, step, lambda acc: acc.spans).alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): the turns as (role, text), and all text under the mask, from the formatted text."""
    parts = F.filter(F.split("formatted", CLOSE, -1), lambda p: p != "")
    turns = F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(p.substr(F.lit(len(OPEN) + 1), F.length(p)), MIDDLE, 1)).alias("role"),
        unescape(F.substring_index(p, MIDDLE, -1)).alias("text"),
    ))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s.start + 1).cast("int"), s.length.cast("int")))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def chat_digests(tables: list[DataFrame]) -> DataFrame:
    """Digests of all conversations of the tables, each of its own layout, read back from the formatted texts."""
    turns = None
    for t in tables:
        own = canonical_turns(t)
        turns = own if turns is None else turns.union(own)
    read = read_chats(format_chats(turns))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
