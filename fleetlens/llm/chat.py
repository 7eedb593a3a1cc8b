"""Chat records of different layouts as canonical turns, a marked-up text and a loss mask.

A record is JSON. The hash of its nested field paths (names and nesting, without value types) picks
a declarative mapping from ``LAYOUTS``; a record whose fingerprint is unknown has null turns. The
formatted text marks each turn as ``<|im_start|>role``, line feed, text, ``<|im_end|>``, line feed.
Texts and roles are escaped reversibly: backslash becomes ``\\b``, ``<|`` becomes ``\\p``, and in roles
a line feed becomes ``\\n``; so no text can forge a mark. The loss mask holds the place of every
assistant text in characters of the formatted text.

Native. Null texts and roles are empty. Rows of a conversation are ordered by turn, then role and
text; repeated rows are turns of their own. A conversation is one record, so it must fit a row.
A null conv_id is a conversation. An empty table gives no rows. Extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, ASSISTANT = "<|im_start|>", "<|im_end|>\n", "assistant"
_CHAT = "array<struct<role:string,content:string>>"
_SHARED = "array<struct<from:string,value:string>>"


def _got(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else F.coalesce(role, F.lit(""))).alias("role"),
                    F.coalesce(text, F.lit("")).alias("text"))


def _messages() -> Column:
    return F.transform(_got("$.messages", _CHAT), lambda t: _turn(t["role"], t["content"]))


def _shared() -> Column:
    names = F.create_map(*map(F.lit, ("human", "user", "gpt", ASSISTANT)))
    return F.transform(_got("$.conversations", _SHARED), lambda t: _turn(
        F.coalesce(F.try_element_at(names, t["from"]), t["from"]), t["value"]))


def _pair(answer: str) -> Column:
    return F.array(_turn("user", _got("$.prompt")), _turn(ASSISTANT, _got(f"$.{answer}")))


def _instruction(with_input: bool) -> Column:
    text = F.coalesce(_got("$.instruction"), F.lit(""))
    if with_input:
        more = F.coalesce(_got("$.input"), F.lit(""))
        text = F.when(more == "", text).otherwise(F.concat(text, F.lit("\n\n"), more))
    return F.array(_turn("user", text), _turn(ASSISTANT, _got("$.output")))


#: Field paths of a layout and what its turns are.
LAYOUTS = {
    "OBJECT<messages: ARRAY<OBJECT<content, role>>>": _messages,
    "OBJECT<messages: ARRAY>": _messages,
    "OBJECT<conversations: ARRAY<OBJECT<from, value>>>": _shared,
    "OBJECT<completion, prompt>": lambda: _pair("completion"),
    "OBJECT<prompt, response>": lambda: _pair("response"),
    "OBJECT<input, instruction, output>": lambda: _instruction(True),
    "OBJECT<instruction, output>": lambda: _instruction(False),
}


def field_paths(variant: Column) -> Column:
    """Nested field names of a JSON value, sorted, without the types of plain values."""
    kinds = r"(?<=ARRAY)<(?!OBJECT|ARRAY)[A-Z_]+(\([^)]*\))?>|: (?!OBJECT|ARRAY)[A-Z_]+(\([^)]*\))?"
    return F.regexp_replace(F.schema_of_variant(variant), kinds, "")


def canonical_turns(records: DataFrame) -> DataFrame:
    """Replace ``record`` by fingerprint and turns (null where no mapping fits)."""
    kept = [c for c in records.columns if c != "record"]
    rows = records.withColumn("v", F.try_parse_json("record"))
    rows = rows.withColumn("fingerprint", F.xxhash64(field_paths(F.col("v"))))
    turns = F.lit(None)
    for paths, mapping in LAYOUTS.items():
        turns = F.when(F.col("fingerprint") == F.xxhash64(F.lit(paths)), mapping()).otherwise(turns)
    return rows.select(*kept, "fingerprint", turns.alias("turns"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\p"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def formatted(rows: DataFrame) -> DataFrame:
    """Add ``formatted`` and ``loss_mask``, an array of (start, length), start counted from 1."""
    role = lambda t: F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\n"))
    head = lambda t: F.concat(F.lit(START), role(t), F.lit("\n"))
    marked = F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), escaped(t["text"]).alias("text"), (t["role"] == ASSISTANT).alias("learn")))
    rows = rows.withColumn("_marked", marked)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state, t):
        begin = state["at"] + F.length(t["head"])
        span = F.struct(begin.alias("start"), F.length(t["text"]).alias("length"))
        return F.struct(
            (begin + F.length(t["text"]) + len(END)).alias("at"),
            F.when(t["learn"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    text = F.array_join(F.transform("_marked", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")
    return rows.withColumn("formatted", text).withColumn("loss_mask", F.aggregate("_marked", start, step)["spans"]).drop("_marked")


def read_turns(text: Column) -> Column:
    """Turns read back from a formatted text."""
    parts = F.split(text, r"<\|im_start\|>")

    def turn(part):
        head = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(head) + 2, F.length(part) - F.length(head) - 1 - len(END))
        return F.struct(unescaped(F.replace(head, F.lit("\\n"), F.lit("\n"))).alias("role"), unescaped(body).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn)


def learned_text(text: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substr(text, s["start"], s["length"]))), "")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): a lone question and answer as prompt and response, all else as messages."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct("turn", empty("role").alias("role"), empty("text").alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    pair = F.to_json(F.struct(F.col("t")[0]["text"].alias("prompt"), F.try_element_at("t", F.lit(2))["text"].alias("response")))
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(
        x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    return rows.select("conv_id", F.when(roles == F.array(F.lit("user"), F.lit(ASSISTANT)), pair).otherwise(messages).alias("record"))


def chat_digest(records: DataFrame) -> DataFrame:
    """conv_id with counts and digests of what the formatted text and its mask give back, and the fingerprint."""
    rows = formatted(canonical_turns(records))
    rows = rows.withColumn("back", read_turns(F.col("formatted"))).withColumn(
        "loss", learned_text(F.col("formatted"), F.col("loss_mask")))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "fingerprint")
