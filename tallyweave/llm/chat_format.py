"""Chat formatting by schema fingerprints, in DataFrame functions only.

The nested field paths of a layout are hashed; the hash selects a declarative mapping, which names where
the turns lie and which field is their role and text. Two entrances share the mappings: DataFrames, whose
schema has one fingerprint, and columns of JSON documents, where each row has its own, over the fields of
all its messages, and unknown layouts are reported, not dropped. Both give canonical turns, an array of
(role, text). Sources of several layouts become one table of conversations by ``format_sources``.

Documents are walked ``LEVELS`` deep by their types, so a text that looks like JSON stays a text; what lies
deeper is not told apart. Of a schema only paths that some mapping names are hashed, so ids and other fields
beside a layout don't matter, at any level. Where those left fit no mapping as a whole, the widest mapping
within them is taken; two of equal width are refused: with an error for a table, with a null layout for a
document. A list without elements is a conversation without turns. In a list of messages, a bare string is a
turn without a role, and any other element that is no object a turn of its text. Parts of a text are joined
by lines, those without a text are left out.

The template writes each turn as ``<s>[INST]role[/INST]text</s>``. Where a role or text holds a control
string, or an escaped one, a backslash is put after its first bracket, so no control string is left inside
and one backslash taken away gives the original. ``parse`` reads turns back from the formatted string.

Null texts and roles are empty ones. Turns of a conversation are ordered by turn number, then role, then
text, so ties and repeated rows have one result; a null turn comes first. Rows with a null conversation id
are one conversation. Extra columns are not read. An empty table gives no conversation. Very long texts are
kept whole. One conversation is one value of the result, so its turns meet in one row; different
conversations never do.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import named, source

#: Fixed values of the template.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
ESCAPE = r"([<\[])(\\*)(/?s>|/?INST\])"
UNESCAPE = r"([<\[])\\(\\*)(/?s>|/?INST\])"
TURN = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns: a list of messages, or fields that are one turn each."""

    name: str
    paths: tuple[str, ...]
    messages: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    """The hash of the sorted nested field paths; ``[]`` stands for any element of an array."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


HUMAN = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("prompter", "user"))
MAPPINGS = (
    Mapping("turn rows", ("conv_id", "turn", "role", "text")),
    Mapping("messages", ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Mapping("message texts", ("messages[].role", "messages[].text"), "messages", "role", "text"),
    Mapping("mixed messages", ("messages[].role", "messages[].content", "messages[].text"), "messages", "role", "content\ntext"),
    Mapping("messages of speakers", ("messages[].from", "messages[].content"), "messages", "from", "content", roles=HUMAN),
    Mapping("named messages", ("messages[].role", "messages[].name", "messages[].content"), "messages", "role", "content"),
    Mapping("message parts", ("messages[].role", "messages[].content[].text"), "messages", "role", "content[].text"),
    Mapping("typed message parts", ("messages[].role", "messages[].content[].text", "messages[].content[].type"), "messages", "role", "content[].text"),
    Mapping("messages of texts and parts", ("messages[].role", "messages[].content", "messages[].content[].text"), "messages", "role", "content\ncontent[].text"),
    Mapping("messages of texts and typed parts", ("messages[].role", "messages[].content", "messages[].content[].text", "messages[].content[].type"), "messages", "role", "content\ncontent[].text"),
    Mapping("from and value", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=HUMAN),
    Mapping("prompt and response", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt and completion", ("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response texts", ("prompt.text", "response.text"), turns=(("user", "prompt.text"), ("assistant", "response.text"))),
    Mapping("prompt and completion texts", ("prompt.text", "completion.text"), turns=(("user", "prompt.text"), ("assistant", "completion.text"))),
    Mapping("system and prompt", ("system", "prompt", "response"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction and input", ("instruction", "input", "output"), turns=(("user", "instruction\ninput"), ("assistant", "output"))),
    Mapping("question and answer", ("question", "answer"), turns=(("user", "question"), ("assistant", "answer"))),
    Mapping("text", ("text",), turns=(("assistant", "text"),)),
)
BY_FINGERPRINT = {m.fingerprint: m for m in MAPPINGS}
#: All paths that mappings name: others of a schema are not part of its fingerprint.
KNOWN = frozenset(p for m in MAPPINGS for p in m.paths)
#: Lists that hold no message: the layout that they would be of.
EMPTY = {"messages[]": "messages", "conversations[]": "from and value"}
LEVELS = 5


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths; a dot within a field's name is written as two."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name.replace('.', '..')}" if at else f.name.replace(".", ".."))]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def select_mapping(schema: T.StructType) -> Mapping:
    """The mapping that the fingerprint of a DataFrame's known paths selects."""
    paths = KNOWN.intersection(schema_paths(schema))
    chosen = BY_FINGERPRINT.get(fingerprint(list(paths)))
    if chosen:
        return chosen
    within = sorted((m for m in MAPPINGS if paths.issuperset(m.paths)), key=lambda m: -len(m.paths))
    if not within:
        raise ValueError(f"no mapping for the layout {sorted(schema_paths(schema))}")
    if len(within) > 1 and len(within[1].paths) == len(within[0].paths):
        raise ValueError(f"both {within[0].name!r} and {within[1].name!r} fit the layout {sorted(paths)}")
    return within[0]


def turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def renamed(role: Column, roles: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in roles for x in pair)), role), role) if roles else role


def joined(field: str, value) -> Column:
    """The texts of the fields of one turn, those not empty, by a line each."""
    return F.concat_ws("\n", *(F.when(value(f) != "", value(f)) for f in field.split("\n")))


def field_of(value: Column, path: str) -> Column:
    """The text at a path of a struct: ``a``, ``a.b``, or ``a[].b`` for the parts of a list, by lines."""
    name, _, rest = path.partition(".")
    if name.endswith("[]"):
        return F.array_join(F.transform(value[name[:-2]], lambda x: x[rest]), "\n")
    return field_of(value[name], rest) if rest else value[name]


def mapped(m: Mapping, value) -> Column:
    """Canonical turns of a table, where ``value(name)`` is a field's column."""
    if m.messages:
        return F.coalesce(F.transform(value(m.messages), lambda x: turn(renamed(x[m.role], m.roles), joined(m.text, lambda f: field_of(x, f)))), F.array().cast(TURN))

    def of(path: str) -> Column:
        name, _, rest = path.partition(".")
        return field_of(value(name), rest) if rest else value(name)

    return F.array(*(turn(F.lit(role), joined(field, of)) for role, field in m.turns))


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """``conv_id`` and ``turns`` of a DataFrame in any of the known layouts."""
    m = select_mapping(df.schema)
    if m.name == "turn rows":
        key = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        rows = df.groupBy(F.col("conv_id").alias("conv_id")).agg(F.sort_array(F.collect_list(key)).alias("turns"))
        return rows.select("conv_id", F.transform("turns", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("turns"))
    return df.select(source(df, conv_id).alias("conv_id"), mapped(m, named).alias("turns"))


# Expressions over JSON values are SQL text: a plan of thousands of nodes is then one call.


def fields(value: str) -> str:
    """The fields of an object of any types, or null."""
    return f"try_variant_get({value}, '$', 'map<string, variant>')"


def elements(value: str) -> str:
    """The elements of a list of any types, or null."""
    return f"try_variant_get({value}, '$', 'array<variant>')"


def text_in(value: str) -> str:
    """What a JSON value says: itself, the ``text`` of an object, or those of a list's elements by lines."""
    one = lambda v: f"if({fields(v)} is not null, try_variant_get({v}, '$.text', 'string'), try_variant_get({v}, '$', 'string'))"
    return f"if({elements(value)} is not null, array_join(transform({elements(value)}, part -> {one('part')}), '\\n'), {one(value)})"


def paths_below(value: str, at: str = "", levels: int = LEVELS, in_list: bool = False) -> str:
    """Nested field paths of a JSON value, as ``schema_paths`` has them; ``[]`` alone ends that of a list of values, or of none.

    A document is an object, and a list within a list is not walked.
    """
    end = f"array({at or repr('')})"
    if not levels:
        return end
    entry, element = f"entry{levels}", f"element{levels}"
    key = f"replace({entry}.key, '.', '..')"
    member = paths_below(f"{entry}.value", f"concat({at}, '.', {key})" if at else key, levels - 1)
    own = f"flatten(transform(map_entries({fields(value)}), {entry} -> {member}))"
    if not at or in_list:
        return f"coalesce({own}, {end})"
    inside = f"concat({at}, '[]')"
    listed = f"array_distinct(flatten(transform({elements(value)}, {element} -> {paths_below(element, inside, levels - 1, True)})))"
    return f"coalesce({own}, if(size({elements(value)}) = 0, array({inside}), {listed}), {end})"


def json_turns(m: Mapping, document: str) -> str:
    """Canonical turns of a document of the mapping's layout."""
    inner = lambda v, path: text_in(f"try_variant_get({v}, '$.{path.split('[]')[0].split('.')[0]}', 'variant')")
    struct = lambda role, text: f"named_struct('role', coalesce({role}, ''), 'text', coalesce({text}, ''))"
    lines = lambda v, paths: f"concat_ws('\\n', {', '.join(f'nullif({inner(v, x)}, {repr(str())})' for x in paths)})"
    if not m.messages:
        return f"array({', '.join(struct(repr(role), lines(document, field.split(chr(10)))) for role, field in m.turns)})"
    role = inner("message", m.role)
    for theirs, ours in reversed(m.roles):
        role = f"if({inner('message', m.role)} = '{theirs}', '{ours}', {role})"
    names = list(dict.fromkeys(f.split("[]")[0] for f in m.text.split("\n")))
    turns = f"if({fields('message')} is not null, {struct(role, lines('message', names))}, {struct(repr(''), text_in('message'))})"
    return f"transform(try_variant_get({document}, '$.{m.messages}', 'array<variant>'), message -> {turns})"


def canonical_turns_from_json(df: DataFrame, document: str, conv_id: str = "conv_id") -> DataFrame:
    """``conv_id``, ``layout`` (null if no mapping fits) and ``turns`` (then null) of each row."""
    read = df.select(source(df, conv_id).alias("conv_id"), F.try_parse_json(source(df, document)).alias("document"))
    listed = lambda names: f"array({', '.join(map(repr, sorted(names)))})"
    found = read.withColumn("paths", F.expr(f"array_distinct({paths_below('document')})")).withColumn("known", F.expr(f"array_intersect(paths, {listed(KNOWN)})"))
    marked = found.withColumn("fingerprint", F.sha2(F.array_join(F.array_sort("known"), "\n"), 256))
    mappings = [m for m in MAPPINGS if m.name != "turn rows"]
    whole = "case fingerprint " + " ".join(f"when '{m.fingerprint}' then '{m.name}'" for m in mappings) + " end"
    held = ", ".join(f"if(size(array_intersect(known, {listed(m.paths)})) = {len(m.paths)}, named_struct('n', {len(m.paths)}, 'name', '{m.name}'), null)" for m in mappings)
    widest = marked.withColumn("held", F.expr(f"sort_array(array_compact(array({held})), false)"))
    alone = "if(size(held) = 1 or get(held, 0).n > get(held, 1).n, get(held, 0).name, null)"
    empty = "case " + " ".join(f"when size(known) = 0 and array_contains(paths, '{path}') then '{name}'" for path, name in EMPTY.items()) + " end"
    chosen = widest.select("conv_id", "document", F.expr(f"coalesce({whole}, {alone}, {empty})").alias("layout"))
    turns = "case layout " + " ".join(f"when '{m.name}' then {json_turns(m, 'document')}" for m in mappings) + " end"
    return chosen.select("conv_id", "layout", F.expr(turns).cast(TURN).alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def formatted(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(BEGIN + OPEN), escaped(x.role), F.lit(CLOSE), escaped(x.text), F.lit(END))), "")


def parse(text: Column) -> Column:
    """The turns of a formatted conversation."""
    pieces = F.filter(F.split(text, re.escape(END)), lambda x: x != "")

    def read(piece):
        head = F.substring_index(piece, CLOSE, 1)
        return F.struct(unescaped(F.substr(head, F.lit(len(BEGIN + OPEN) + 1))).alias("role"), unescaped(F.substr(piece, F.length(head) + len(CLOSE) + 1)).alias("text"))

    return F.transform(pieces, read)


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: that of assistant turns."""
    return F.array_join(F.transform(F.filter(turns, lambda x: x.role == "assistant"), lambda x: x.text), "")


def format_conversations(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """``conv_id`` and ``formatted`` for each conversation."""
    return canonical_turns(df, conv_id).select("conv_id", formatted(F.col("turns")).alias("formatted"))


def format_sources(tables: list[DataFrame], documents: list[tuple[DataFrame, str]], conv_id: str = "conv_id") -> DataFrame:
    """``conv_id``, ``layout`` and ``formatted`` of all conversations of tables, each of one layout, and of tables with a
    column of JSON documents. A document of an unknown layout has null for both."""
    found = [canonical_turns(t, conv_id).select("conv_id", F.lit(select_mapping(t.schema).name).alias("layout"), "turns") for t in tables]
    found += [canonical_turns_from_json(t, column, conv_id) for t, column in documents]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select("conv_id", "layout", formatted(F.col("turns")).alias("formatted"))


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from each ``formatted``: its turns and its text under the loss mask."""
    read = chats.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", loss_text(F.col("turns")))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    layout = ["layout"] if "layout" in chats.columns else []
    return read.select("conv_id", *layout, F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
