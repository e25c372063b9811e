"""Chat formatting: records of several layouts become turns, and turns become training text.

A record is a struct column whose fields may be missing (null), as Spark reads JSON or Parquet
of mixed origin. The paths of the fields that a record fills, nested ones included, are hashed
to a fingerprint; the fingerprint selects a declarative mapping, and the mapping says where
each turn's role and text lie. Everything here is DataFrame functions.

The template puts each turn between control strings. A control string inside a text or a role
gets a backslash after its first character, and backslashes are doubled, so that formatted text
can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control strings of the template.
BEGIN, END = "<s>", "</s>"
OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "[OUT]"}
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": END}
ROLE_OPEN, ROLE_CLOSE = "[ROLE]", "[/ROLE]"
TURNS = "array<struct<role: string, text: string>>"
CONTROL = [BEGIN, END, *OPEN.values(), "[/SYS]", "[/INST]", "[/OUT]", ROLE_OPEN, ROLE_CLOSE]
_START = "([<\\[])(?=" + "|".join(re.escape(x[1:]) for x in CONTROL) + ")"
_TURN = "(?s)\\[(?:SYS|INST|OUT|ROLE)\\].*?(?:\\[/SYS\\]|\\[/INST\\]|</s>)"


@dataclass(frozen=True)
class Mapping:
    """Where the turns of one layout lie.

    ``turns``: (role, path of the text) for each turn, or (path of the role, path of the text)
    below one array, as ``thread.messages[].author.role``. Optional paths may be missing: no turn
    then, or no role. ``roles``: names that a layout has for roles, in lower case, and what they stand for.
    """

    name: str
    turns: tuple[tuple[str, str], ...]
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> set[str]:
        return {x for turn in self.turns for x in turn if x not in OPEN}


MAPPINGS = (
    Mapping("messages", (("messages[].role", "messages[].content"),), ("messages[].role",)),
    Mapping("instruction", (("system", "instruction"), ("user", "input"), ("assistant", "output")), ("input",)),
    Mapping("prompt", (("user", "prompt"), ("assistant", "response")), ("response",)),
    Mapping("completion", (("user", "prompt"), ("assistant", "completion"))),
    Mapping("exchange", (("system", "exchange.context"), ("user", "exchange.question"), ("assistant", "exchange.answer")), ("exchange.context", "exchange.answer")),
    Mapping("shared", (("conversations[].from", "conversations[].value"),), ("conversations[].from",), (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))),
    Mapping("thread", (("thread.messages[].author.role", "thread.messages[].body"),), ("thread.messages[].author.role",)),
)

#: The type of a record that may have any of these layouts, as ``from_json`` takes it.
RECORD = (
    "prompt string, response string, completion string, instruction string, input string, output string,"
    "messages array<struct<role: string, content: string>>,"
    "exchange struct<context: string, question: string, answer: string>,"
    "conversations array<struct<from: string, value: string>>,"
    "thread struct<messages: array<struct<author: struct<role: string>, body: string>>>"
)


def resolves(path: str, fields: T.DataType) -> bool:
    """Whether a type has a path, with a plain value at its end."""
    for step in path.split("."):
        name = step.removesuffix("[]")
        if not isinstance(fields, T.StructType) or name not in fields.names:
            return False
        fields = fields[name].dataType
        if name != step:
            if not isinstance(fields, T.ArrayType):
                return False
            fields = fields.elementType
    return not isinstance(fields, (T.StructType, T.ArrayType, T.MapType))


def _at(value: Column, path: str) -> Column:
    for name in path.split("."):
        value = value.getField(name)
    return value


def filled(record: str, path: str, fields: T.StructType) -> Column:
    """Whether a record fills a path; false for paths that its type lacks."""
    if not resolves(path, fields):
        return F.lit(False)
    whole, _, leaf = path.partition("[].")
    column = _at(F.col(record), whole)
    return F.coalesce(F.exists(column, lambda x: _at(x, leaf).isNotNull()), F.lit(False)) if leaf else column.isNotNull()


def fingerprint(record: str, fields: T.StructType, mappings: Sequence[Mapping] = MAPPINGS) -> Column:
    """The hash of the sorted paths that a record fills, of those that any mapping knows."""
    known = sorted({p for m in mappings for p in m.paths})
    return F.sha2(F.concat_ws("\n", *(F.when(filled(record, p, fields), F.lit(p)) for p in known)), 256)


def fingerprints(mapping: Mapping) -> list[str]:
    """The fingerprints that select a mapping: with any of its optional paths, or without."""
    must = mapping.paths - set(mapping.optional)
    return [hashlib.sha256("\n".join(sorted(must | set(extra))).encode()).hexdigest() for k in range(len(mapping.optional) + 1) for extra in combinations(mapping.optional, k)]


def _role(role: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    out = role
    for alias, name in aliases:
        out = F.when(F.lower(role) == alias, name).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _listed(mapping: Mapping, role: str | None, text: str) -> Callable[[Column], Column]:
    return lambda x: _turn(_role(_at(x, role), mapping.roles) if role else F.lit(None), _at(x, text))


def _mapped(record: str, mapping: Mapping, fields: T.StructType) -> Column:
    parts = []
    for role, path in mapping.turns:
        whole, _, leaf = path.partition("[].")
        if leaf:
            named = role.partition("[].")[2] if resolves(role, fields) else None
            parts.append(F.transform(_at(F.col(record), whole), _listed(mapping, named, leaf)))
        elif resolves(path, fields):
            column = _at(F.col(record), path)
            parts.append(F.when(column.isNotNull(), F.array(_turn(F.lit(role), column))).otherwise(F.array().cast(TURNS)))
    return F.concat(*parts)


def canonical_turns(records: DataFrame, record: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Adds ``layout`` (null where no mapping fits) and ``turns`` (array of role, text; then empty).

    Null roles and texts become empty strings. A null record or an empty array of messages
    fits no mapping.
    """
    fields = records.schema[record].dataType
    usable = [m for m in mappings if all(resolves(p, fields) for p in m.paths - set(m.optional))]
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    marked = records.withColumn("layout_print", fingerprint(record, fields, mappings))
    for m in usable:
        hit = F.col("layout_print").isin(fingerprints(m))
        layout = F.when(hit, F.lit(m.name)).otherwise(layout)
        turns = F.when(hit, _mapped(record, m, fields)).otherwise(turns)
    return marked.withColumns({"layout": layout, "turns": turns})


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _START, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "\\\\(\\\\?)", "$1")


def _case(role: Column, named: dict[str, Column], other: Column) -> Column:
    out = other
    for name, value in named.items():
        out = F.when(role == name, value).otherwise(out)
    return out


def render(turns: Column) -> Column:
    """The formatted text of an array of turns."""

    def one(turn: Column) -> Column:
        text = escape(turn["text"])
        named = {r: F.concat(F.lit(OPEN[r]), text, F.lit(CLOSE[r])) for r in OPEN}
        return _case(turn["role"], named, F.concat(F.lit(ROLE_OPEN), escape(turn["role"]), F.lit(ROLE_CLOSE), text, F.lit(END)))

    return F.concat(F.lit(BEGIN), F.array_join(F.transform(turns, one), ""))


def loss_spans(turns: Column) -> Column:
    """Where the formatted text of an array of turns is trained on: (start, length) in code
    points of each assistant text as it stands there, without its control strings."""
    start = T.StructType([T.StructField("at", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))])

    sizes = F.transform(turns, lambda t: F.struct(
        F.length(escape(t["text"])).cast("long").alias("length"),
        _case(t["role"], {r: F.lit(len(OPEN[r])).cast("long") for r in OPEN}, F.length(escape(t["role"])).cast("long") + len(ROLE_OPEN + ROLE_CLOSE)).alias("before"),
        _case(t["role"], {r: F.lit(len(CLOSE[r])).cast("long") for r in OPEN}, F.lit(len(END)).cast("long")).alias("after"),
        (t["role"] == "assistant").alias("trained"),
    ))
    ends = F.aggregate(sizes, F.struct(F.lit(len(BEGIN)).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")).cast(start), lambda acc, x: F.struct(
        (acc["at"] + x["before"] + x["length"] + x["after"]).alias("at"),
        F.when(x["trained"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["before"]).alias("start"), x["length"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    ))
    return ends["spans"]


def format_chats(records: DataFrame, record: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Adds ``layout``, ``formatted`` and ``loss_spans`` to every record; other columns stay.

    A record that fits no mapping gets a null layout and a formatted text of no turns.
    """
    turns = canonical_turns(records, record, mappings)
    return turns.withColumns({"formatted": render(F.col("turns")), "loss_spans": loss_spans(F.col("turns"))}).drop("turns", "layout_print")


def read_back(formatted: Column) -> Column:
    """The array of turns (role, text) of a formatted text."""

    def one(turn: Column) -> Column:
        other = turn.startswith(ROLE_OPEN)
        role = _case(F.substring_index(turn, "]", 1), {OPEN[r][:-1]: F.lit(r) for r in OPEN}, unescape(F.substring_index(F.substr(turn, F.lit(len(ROLE_OPEN) + 1)), ROLE_CLOSE, 1)))
        body = F.regexp_replace(turn, "(?s)^\\[(?:ROLE\\].*?\\[/ROLE\\]|(?:SYS|INST|OUT)\\])|(?:\\[/SYS\\]|\\[/INST\\]|</s>)$", "")
        return F.struct(role.alias("role"), unescape(body).alias("text"), other.alias("other"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask.

    Cut from UTF-32, where code points have a fixed width, so that long texts take linear time.
    """
    wide = F.encode(formatted, "UTF-32")
    pieces = F.transform(F.array(wide), lambda w: F.transform(spans, lambda s: unescape(F.decode(F.substr(w, (s["start"] * 4 + 1).cast("int"), (s["length"] * 4).cast("int")), "UTF-32"))))
    return F.array_join(pieces[0], "")


def records_of_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One record per key out of rows by turn, laid out by shape.

    A user's text and its answer become prompt and response; with a system text before them,
    instruction, input and output; anything else, messages. Null texts and roles become empty
    strings; rows of one turn number are ordered by role and text; a null turn comes first;
    null keys form one conversation.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.select(F.col(key), one.alias("t")).groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("t"))
    roles, text = F.transform("t", lambda x: x["role"]), lambda k: F.col("t")[k]["content"]
    shape = F.when(roles == F.array(F.lit("user"), F.lit("assistant")), "prompt").when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), "instruction").otherwise("messages")
    shaped = grouped.withColumn("shape", shape)
    pick = lambda name, value, out: F.when(F.col("shape") == name, value).alias(out)
    return shaped.select(key, F.struct(
        pick("prompt", text(0), "prompt"), F.when(F.col("shape") == "prompt", F.get("t", F.lit(1))["content"]).alias("response"),
        pick("instruction", text(0), "instruction"), F.when(F.col("shape") == "instruction", F.get("t", F.lit(1))["content"]).alias("input"),
        F.when(F.col("shape") == "instruction", F.get("t", F.lit(2))["content"]).alias("output"),
        pick("messages", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))), "messages"),
    ).alias("record"))
