"""Chat formatting: schema fingerprints select declarative mappings.

A record is JSON text of any known layout. Of its nested field paths those that
some mapping needs are hashed; the first mapping all of whose paths' hashes are among them says where
the turns, their roles and their texts are, whatever other fields there are. Canonical turns are then
written in one template, with control strings inside texts escaped reversibly, and a loss mask. Column
expressions only.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import table

# Control strings of the template, and of others in common use.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: A control string, with any number of backslashes after its first character.
CONTROL = r"(<|\[)(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\])"
ESCAPED = r"(<|\[)\\(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\])"
TRAINED = "assistant"


@dataclass(frozen=True)
class Mapping:
    """A layout: the field paths that a record of it has (those of a list's elements behind []), and
    where its turns are: either ``fixed``, a (turn number, role, text) for each turn, or ``listed``, the
    path of a list and those of role and text in its elements, and of what stands in for a missing text. What starts
    with $ is a path, anything else a constant. A turn whose path is ``optional`` comes first, if it is there."""

    name: str
    needs: tuple[str, ...]
    fixed: tuple[tuple[str, str, str], ...] = ()
    listed: tuple[str, str, str, str] | None = None
    optional: tuple[str, str] = ("system", "$.system")


#: Role names in lists of messages.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant", "function_call": "assistant", "observation": "tool", "function_response": "tool"}

#: Those that need more come before those that need a part of that.
MAPPINGS = (
    Mapping("turn row", ("turn", "role", "text"), fixed=(("$.turn", "$.role", "$.text"),), optional=("", "")),
    Mapping("messages", ("messages", "messages[].role", "messages[].content"), listed=("$.messages", "$.role", "$.content", "$.tool_calls")),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), listed=("$.conversations", "$.from", "$.value", "$.value")),
    Mapping("conversations of roles", ("conversations", "conversations[].role", "conversations[].content"), listed=("$.conversations", "$.role", "$.content", "$.tool_calls")),
    Mapping("dialog", ("dialog", "dialog[].speaker", "dialog[].text"), listed=("$.dialog", "$.speaker", "$.text", "$.text")),
    Mapping("instruction with input", ("instruction", "input", "output"), fixed=(("0", "system", "$.instruction"), ("1", "user", "$.input"), ("2", "assistant", "$.output"))),
    Mapping("instruction", ("instruction", "output"), fixed=(("0", "user", "$.instruction"), ("1", "assistant", "$.output"))),
    Mapping("instruction and response", ("instruction", "response"), fixed=(("0", "user", "$.instruction"), ("1", "assistant", "$.response"))),
    Mapping("chosen answer", ("prompt", "chosen"), fixed=(("0", "user", "$.prompt"), ("1", "assistant", "$.chosen"))),
    Mapping("prompt and response", ("prompt", "response"), fixed=(("0", "user", "$.prompt"), ("1", "assistant", "$.response"))),
    Mapping("prompt and completion", ("prompt", "completion"), fixed=(("0", "user", "$.prompt"), ("1", "assistant", "$.completion"))),
    Mapping("question and answer", ("question", "answer"), fixed=(("0", "user", "$.question"), ("1", "assistant", "$.answer"))),
)
KNOWN = sorted({p for m in MAPPINGS for p in m.needs})
LISTS = sorted({m.listed[0].removeprefix("$.") for m in MAPPINGS if m.listed})


def fingerprint(record: Column, value: Column) -> Column:
    """Hashes of the known field paths that a record has (``value``: the same as a VARIANT); those of the elements of a list
    are all that any of them has. Null for a null record, or one that isn't a JSON object."""
    own = F.json_object_keys(record)
    below = lambda name: F.flatten(F.transform(F.try_variant_get(value, f"$.{name}", "array<variant>"), lambda x: F.coalesce(F.json_object_keys(F.to_json(x)), F.array().cast("array<string>"))))
    nested = [F.when(F.array_contains(own, name), F.transform(F.array_distinct(below(name)), lambda k: F.concat(F.lit(f"{name}[]."), k))) for name in LISTS]  # noqa: B023
    empty = F.array().cast("array<string>")
    paths = F.array_intersect(F.concat(own, *[F.coalesce(n, empty) for n in nested]), F.array(*map(F.lit, KNOWN)))
    return F.transform(paths, lambda p: F.xxhash64(p))


def canonical_turns(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """(conv_id, turn, place, role, text), one row for each turn of each record.

    turn is the layout's own number or the place in the record, place the place
    in the record. Null roles and texts are ''. A record that has the paths of no mapping
    (an empty list of turns too) gives one row of role null, text the
    record, so that nothing vanishes unseen; a null record gives none. Repeated records give
    their turns each; records that tie in their id are one conversation to ``format_chat``.
    """
    read = records.select(F.col(id_col).alias("conv_id"), F.col(record_col).alias("record")).where("record IS NOT NULL").withColumn("v", F.try_parse_json("record"))
    read = read.withColumn("paths", fingerprint(F.col("record"), F.col("v")))

    def get(v: Column, path: str, kind: str = "string") -> Column:
        return F.try_variant_get(v, path, kind) if path.startswith("$") else F.lit(path).cast(kind)

    def role(c: Column) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[c], c, F.lit(""))

    def struct(turn: Column, place: Column, who: Column, text: Column) -> Column:
        return F.struct(turn.cast("long").alias("turn"), place.cast("int").alias("place"), who.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    raw = F.array(struct(F.lit(0), F.lit(0), F.lit(None).cast("string"), F.col("record")))
    turns = None
    for m in MAPPINGS:
        who, path = m.optional
        first = get(F.col("v"), path) if path else F.lit(None).cast("string")
        shift = F.when(first.isNotNull(), 1).otherwise(0)
        if m.listed:
            root, of, what, instead = m.listed
            found = F.transform(F.try_variant_get("v", root, "array<variant>"), lambda t, k: struct(k + shift, k + shift, role(get(t, of)), F.coalesce(get(t, what), get(t, instead))))  # noqa: B023
        else:
            found = F.array(*[struct(get(F.col("v"), n, "long") + shift, F.lit(k) + shift, F.coalesce(get(F.col("v"), by), F.lit("")), get(F.col("v"), what)) for k, (n, by, what) in enumerate(m.fixed)])
        if path:
            found = F.when(first.isNotNull(), F.concat(F.array(struct(F.lit(0), F.lit(0), F.lit(who), first)), found)).otherwise(found)
        has = F.size(F.array_except(F.array(*[F.xxhash64(F.lit(p)) for p in m.needs]), "paths")) == 0
        turns = F.when(has, found) if turns is None else turns.when(has, found)
    return read.select("conv_id", F.explode(turns.otherwise(raw)).alias("t")).select("conv_id", "t.*")


def escape(text: Column) -> Column:
    """One more backslash into each control string, escaped ones included."""
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of canonical turns, one row a conversation.

    Each turn is START role MIDDLE text END. loss_mask has a struct (start, end) in
    code points of ``formatted`` for each assistant text, escapes included, in
    order. Turns go by number, then place, role and text, so ties and repeated
    rows keep a defined order; a null turn number comes first, null roles and
    texts are ''. Null ids form one conversation. An empty table gives no rows.
    A conversation is one string, so its turns meet in one row; nothing else is
    gathered.
    """
    who, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    out = F.concat(F.lit(START), escape(who), F.lit(MIDDLE), escape(text), F.lit(END))
    ordered = turns.select("conv_id", F.struct("turn", "place", who.alias("role"), text.alias("text")).alias("key"), out.alias("out"), F.char_length(escape(text)).alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ordered.select("conv_id", F.sum(F.char_length("out")).over(upto).alias("at"), "out", "n", (F.col("key.role") == TRAINED).alias("trained"))
    stop = F.col("at") - len(END)
    pieces = F.sort_array(F.collect_list(F.struct("at", "out")))
    mask = F.sort_array(F.collect_list(F.when(F.col("trained"), F.struct((stop - F.col("n")).alias("start"), stop.alias("end")))))
    return run.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda p: p["out"]), "").alias("formatted"), mask.alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns read back from a formatted text."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    return F.transform(turns, lambda x: F.struct(unescape(F.substring_index(x, MIDDLE, 1)).alias("role"), unescape(F.substring_index(F.substring_index(x, MIDDLE, -1), END, 1)).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, from formatted texts and loss masks alone."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
    return formatted.select("conv_id", parse(F.col("formatted")).alias("turns"), lost.alias("lost"), F.char_length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def turn_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): each row of a turn table as a JSON record of the layout
    "turn row"; null fields stay, as null."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.to_json(row, {"ignoreNullFields": "false"}).alias("record"))


#: The contract's extra conversation, in another layout than the table's.
EXTRA_ID, EXTRA = -7, {"messages": [{"role": r, "content": "</s>[INST] ok [/INST]"} for r in ("user", "assistant")]}


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(1).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.lit(json.dumps(EXTRA)).alias("record"))
    records = turn_records(table(spark, sf_dir, "conversations")).unionByName(extra)
    return digests(format_chat(canonical_turns(records)))


def oracle() -> str:
    """DuckDB SQL of op4_chat_format."""
    esc = lambda e: f"regexp_replace({e}, '{CONTROL}', '\\1\\\\\\2\\3', 'g')"
    whole = f"'{START}' || {esc('role')} || '{MIDDLE}' || {esc('text')} || '{END}'"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
  CAST(sum(length({whole})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
