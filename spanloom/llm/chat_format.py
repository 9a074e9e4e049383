"""Chat formatting in DataFrame functions only.

``canonical_turns`` reads tables of several layouts. A row's schema fingerprint
is a hash of the nested field paths that are set in it. Which mapping a
fingerprint selects is worked out beforehand for every set of paths that the
table's columns allow: the mapping that shares most paths with the set, then the
one that lacks fewest, then the first. A mapping is a list of (role, path), a
path to a list of messages, or the columns of a row that is one turn itself.

``format_chats`` writes one string per conversation. Turn by turn:
``<|role|>``, the text, ``<|end|>``. Inside roles and texts every control
character is escaped (see ``ESCAPES``), so no text can hold a control string
and parsing gives back exactly what went in. The loss mask is a list of spans
(start, end; code points of the formatted string) over assistant texts.

Defined results: null text and null role count as empty; turns are ordered by
(turn, role, text) with null turns first, so ties and repeated rows have one
order and are all kept; rows of a null conv_id form one conversation; an empty
table gives no rows; other columns are ignored. A conversation is one output
value, so one conversation must fit in a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (character, its escape). No escape holds a control character other than the leading backslash.
ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), (">", "\\3")]
END = "<|end|>"
#: Roles whose texts are learned.
LEARNED = ("assistant",)


def escape(value: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, value)


def unescape(value: Column) -> Column:
    """Escapes go in reverse: a backslash comes back last, so it can't form an escape with what follows."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), value)


# --- layouts --------------------------------------------------------------------

#: name -> its fields, and turns: ("turn", role, path), ("messages", path, role field, text field) or ("row", turn, role, text).
MAPPINGS: dict[str, dict] = {
    "prompt_response": {"fields": ["prompt", "response"], "turns": [("turn", "user", "prompt"), ("turn", "assistant", "response")]},
    "prompt_completion": {"fields": ["prompt", "completion"], "turns": [("turn", "user", "prompt"), ("turn", "assistant", "completion")]},
    "instruction_output": {"fields": ["instruction", "output"], "turns": [("turn", "user", "instruction"), ("turn", "assistant", "output")]},
    "instruction_input_output": {"fields": ["instruction", "input", "output"], "turns": [("turn", "system", "instruction"), ("turn", "user", "input"), ("turn", "assistant", "output")]},
    "messages": {"fields": ["messages.role", "messages.content"], "turns": [("messages", "messages", "role", "content")]},
    "conversations": {"fields": ["conversations.from", "conversations.value"], "turns": [("messages", "conversations", "from", "value")]},
    "turn_rows": {"fields": ["role", "text", "turn"], "turns": [("row", "turn", "role", "text")]},
}
#: Names that some layouts give to roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint_of(fields: Sequence[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(fields))))


def _paths(schema: T.StructType) -> list[tuple[str, str]]:
    """(top column, nested field path) of all leaves; a list's element fields hang below the list."""
    out = []
    for f in schema.fields:
        kind = f.dataType
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            out += [(f.name, f"{f.name}.{sub}") for _, sub in _paths(kind)]
        else:
            out.append((f.name, f.name))
    return out


def _units(df: DataFrame, key: str) -> list[tuple[list[str], Column]]:
    """Sets of known paths that are set together in a row, with the condition that they are: the fields of a
    list hang on the list; role, text and turn of a turn row on any of them, as each may be null."""
    known = {p for m in MAPPINGS.values() for p in m["fields"]}
    tops: dict[str, list[str]] = {}
    for top, path in _paths(df.schema):
        if top != key and path in known:
            tops.setdefault(top, []).append(path)
    row = MAPPINGS["turn_rows"]["fields"]
    units = [(sorted(paths), F.col(f"`{top}`").isNotNull()) for top, paths in sorted(tops.items()) if top not in row]
    if set(row) <= set(tops):
        any_set = reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in row])
        others = reduce(lambda a, b: a | b, [c for _, c in units], F.lit(False))
        units.append((sorted(row), any_set | ~others))
    return sorted(units, key=lambda u: u[0])


def schema_fingerprint(df: DataFrame, key: str) -> Column:
    """Hash of the sorted field paths, besides ``key``, that some mapping names and this row has set."""
    units = _units(df, key)
    if not units:
        return fingerprint_of([])
    return F.xxhash64(F.array_join(F.flatten(F.array_compact(F.array(*[F.when(is_set, F.array(*map(F.lit, paths))) for paths, is_set in units]))), "\n"))


def best_mapping(paths: Sequence[str], names: Sequence[str]) -> str | None:
    """Of the mappings ``names``, the one for a row with these paths set; None if it names none of them."""
    score = {n: (len(set(paths) & set(MAPPINGS[n]["fields"])), -len(set(MAPPINGS[n]["fields"]) - set(paths))) for n in names}
    best = max(names, key=lambda n: score[n], default=None)  # the first of equals
    return best if best is not None and score[best][0] else None


def mapping_number(df: DataFrame, key: str, names: Sequence[str]) -> Column:
    """Place in ``names`` of the mapping that a row's fingerprint selects; null for none."""
    units = [paths for paths, _ in _units(df, key)]
    table = []
    for bits in range(1 << len(units)):  # at most 9 units
        paths = [p for k, unit in enumerate(units) if bits >> k & 1 for p in unit]
        found = best_mapping(paths, names)
        if found is not None:
            table += [fingerprint_of(paths), F.lit(names.index(found))]
    return F.create_map(*table)[schema_fingerprint(df, key)] if table else F.lit(None).cast("int")


def canonical_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turn long, role, text) from any mix of the known layouts."""
    columns = {p for _, p in _paths(df.schema)}
    names = [n for n, m in MAPPINGS.items() if set(m["fields"]) <= columns]
    number, turns = mapping_number(df, key, names), None
    for k, name in enumerate(names):
        made = _apply(MAPPINGS[name]["turns"])
        turns = F.when(number == k, made) if turns is None else turns.when(number == k, made)
    none = F.lit(None).cast("array<struct<turn: long, role: string, text: string>>")
    rows = df.select(F.col(key).alias("conv_id"), F.explode_outer(none if turns is None else turns).alias("t"))
    return rows.select("conv_id", "t.turn", "t.role", "t.text")


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(names[role], role.cast("string"))


def _apply(turns: list[tuple]) -> Column:
    if turns[0][0] == "row":
        _, turn, role, text = turns[0]
        return F.array(F.struct(F.col(turn).cast("long").alias("turn"), _role(F.col(role)).alias("role"), F.col(text).cast("string").alias("text")))
    if turns[0][0] == "messages":
        _, path, role, text = turns[0]
        return F.transform(F.col(path), lambda x, i: F.struct(i.cast("long").alias("turn"), _role(x[role]).alias("role"), x[text].cast("string").alias("text")))
    return F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.col(path).cast("string").alias("text")) for i, (_, role, path) in enumerate(turns)])


# --- formatting and reading back ------------------------------------------------


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask array of (start, end)) of rows (conv_id, turn, role, text)."""
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>")).alias("head"),
            escape(t["text"]).alias("body"),
            t["role"].isin(*LEARNED).alias("learned"),
        ),
    )
    chats = chats.select("conv_id", pieces.alias("pieces"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(p["learned"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return chats.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("pieces", start, step, lambda s: s["spans"]).alias("loss_mask"),
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Adds to rows of ``format_chats``: turns, array of (role, text), and loss_text, both read back from the string."""
    parts = F.filter(F.split("formatted", "<\\|end\\|>"), lambda x: x != "")
    turns = F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(3)), "|>", 1)).alias("role"),
            unescape(F.substr(x, F.instr(x, "|>") + 2)).alias("text"),
        ),
    )
    loss = F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(loss, "")})


def chat_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, from the string read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parsed = parse_chats(format_chats(turns))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def hard_case(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant row, both saying control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
