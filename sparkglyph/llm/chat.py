"""Chat formatting by schema fingerprints, with DataFrame functions alone.

Records come as JSON in many layouts: a prompt with a response, an instruction with
an input and an output, a list of messages under several names.  ``fingerprint``
hashes the nested field paths of a record; ``MAPPINGS`` declares, for the paths that
a layout must have, how its turns are read.  A record that matches no mapping gets
null turns, and its fingerprint tells which layout is missing.

``formatted`` writes turns in a marked template.  A control string inside a text is
broken by a backslash after its first character, one more than it had, so no text
can open or close a turn; ``unescaped`` takes exactly that one out again.

Spark's JSON reader gives up on texts of over 20,000,000 characters and its variants on
128 MB.  A table of turns isn't bound by that: its turns stay rows of an array, and only
a record with one empty turn is read, for the layout.  A record that is JSON itself and
too large for the reader is an error.

Roles of records follow ``ROLE_NAMES``; those of a table of turns are kept as they are.

Defined cases: a null text or role is empty; rows of a conversation are ordered by
turn (nulls first), then role, then text; a record that isn't JSON has fingerprint
null, or is an error from 20,000,000 characters on, where the reader can't tell; repeated rows are turns of their own; rows of a conversation -1 in the table join the one that ``report`` adds; columns other than those named are not
read, so clashing names don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"

#: The template's marks, and the control strings that are escaped inside texts.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTROLS = r"\|im_start\|>|\|im_end\|>|/?s>|\|endoftext\|>|/?INST\]"
ASSISTANT = "assistant"
#: Fixed value: the longest text, in characters, that Spark's JSON reader takes.
READABLE = 20_000_000
#: Names that stand for the three roles in common layouts.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns; ``needs`` are the field paths that it must have.

    With ``items`` (path of a list), ``role`` and ``text`` name fields of its items; else
    ``fields`` gives (role, path) in order, where texts of one role in a row are joined by
    a blank line and missing or empty ones left out.
    """

    name: str
    needs: tuple[str, ...]
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), "messages", "role", "content"),
    Mapping("turns", ("turns[].role", "turns[].text"), "turns", "role", "text"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Mapping("instruction", ("instruction", "output"), fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction_response", ("instruction", "response"), fields=(("system", "system"), ("user", "instruction"), ("user", "context"), ("assistant", "response"))),
    Mapping("prompt_response", ("prompt", "response"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", ("question", "answer"), fields=(("user", "question"), ("assistant", "answer"))),
)


def field_paths(record: Column) -> Column:
    """The nested field paths of a JSON record, sorted: ``a``, ``a[].b``, ``a.b``.

    Spark gives the schema of a parsed record as text with sorted names; brackets there
    tell the nesting, so the paths come from one fold over its tokens.
    """
    schema = F.schema_of_variant(F.try_parse_json(record))
    tokens = F.regexp_extract_all(schema, F.lit(r"(`(?:[^`]|``)*`|OBJECT<|ARRAY<|[^<>,:`\s]+(?=:)|>)"), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit("").alias("at"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, token: Column) -> Column:
        stack, at, paths = acc["stack"], acc["at"], acc["paths"]
        prefix = F.when(F.size(stack) > 0, F.element_at(stack, -1)).otherwise("")
        name = F.concat(prefix, F.regexp_replace(token, "^`|`$", ""))
        opened = F.when(token == "OBJECT<", F.when(at == "", "").otherwise(F.concat(at, F.lit(".")))).otherwise("")
        return (
            F.when(token == "OBJECT<", F.struct(F.concat(stack, F.array(opened)).alias("stack"), at.alias("at"), paths.alias("paths")))
            .when(token == "ARRAY<", F.struct(F.concat(stack, F.array(prefix)).alias("stack"), F.concat(at, F.lit("[]")).alias("at"), paths.alias("paths")))
            .when(token == ">", F.struct(F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))).alias("stack"), at.alias("at"), paths.alias("paths")))
            .otherwise(F.struct(stack.alias("stack"), name.alias("at"), F.concat(paths, F.array(name)).alias("paths")))
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda acc: acc["paths"])))


def fingerprint(record: Column) -> Column:
    """A hash of the record's field paths; the same for all records of a layout."""
    return F.substring(F.sha2(F.array_join(field_paths(record), "\n"), 256), 1, 16)


def _role(c: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), ROLE_NAMES.items(), F.when(c.isNull(), "")).otherwise(c)


def _checked(found: Column, record: Column) -> Column:
    """What was read of a record; an error if that is nothing and the record is too large for the reader."""
    failed = F.raise_error(F.concat(F.lit("cannot read a record of this many characters: "), F.length(record)))
    return F.when(found.isNull() & (F.length(record) >= READABLE), failed).otherwise(found)


def _read(record: Column, m: Mapping, items: Column | None = None) -> Column:
    if m.items:
        own = items is not None
        if not own:
            items = _checked(F.from_json(F.get_json_object(record, f"$.{m.items}"), f"array<struct<`{m.role}`:string,`{m.text}`:string>>"), record)
        return F.transform(items, lambda x: F.struct((F.coalesce(x[m.role], F.lit("")) if own else _role(x[m.role])).alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text")))
    turns = []
    for role in dict.fromkeys(r for r, _ in m.fields):
        texts = [F.get_json_object(record, f"$.{p}") for r, p in m.fields if r == role]
        texts = [F.when(t != "", t) for t in texts]
        present = reduce(lambda a, b: a | b, [t.isNotNull() for t in texts])
        turns.append(F.when(present | F.lit(role == ASSISTANT), F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *texts).alias("text"))))
    return F.filter(F.array(*turns), lambda x: x.isNotNull())


def layouts(records: DataFrame, record: str = "record") -> DataFrame:
    """Each distinct layout: its fingerprint, its paths and the mapping that reads it (null: none)."""
    found = records.select(field_paths(F.col(record)).alias("paths")).where("paths is not null").groupBy("paths").count()
    return found.select(F.substring(F.sha2(F.array_join("paths", "\n"), 256), 1, 16).alias("fingerprint"), "paths", mapping_of(F.col("paths")).alias("mapping"), "count")


def mapping_of(paths: Column, mappings: Sequence[Mapping] = MAPPINGS) -> Column:
    """Name of the first mapping whose paths are all there; null if there is none."""
    out = F.lit(None).cast("string")
    for m in reversed(mappings):
        out = F.when(F.size(F.array_except(F.array(*map(F.lit, m.needs)), paths)) == 0, m.name).otherwise(out)
    return out


def canonical(records: DataFrame, record: str = "record", mappings: Sequence[Mapping] = MAPPINGS, items: str | None = None) -> DataFrame:
    """``records`` with ``fingerprint``, ``mapping`` and ``turns`` (role and text of each turn).

    With ``items`` (a column of the records' lists, whose items have the fields that the
    mappings name), ``record`` is only read for the layout.
    """
    paths = records.withColumn("_paths", _checked(field_paths(F.col(record)), F.col(record)))
    named = paths.withColumns({"fingerprint": F.substring(F.sha2(F.array_join("_paths", "\n"), 256), 1, 16), "mapping": mapping_of(F.col("_paths"), mappings)})
    turns = F.lit(None).cast(TURNS)
    fields = None if items is None else set(records.schema[items].dataType.elementType.names)
    for m in mappings:
        if fields is None or m.items and {m.role, m.text} <= fields:
            turns = F.when(F.col("mapping") == m.name, _read(F.col(record), m, None if items is None else F.col(items))).otherwise(turns)
    return named.withColumn("turns", turns).drop("_paths")


def escaped(text: Column) -> Column:
    """The text with a backslash more after the first character of every control string."""
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={CONTROLS})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={CONTROLS})", "$1$2")


def _role_out(role: Column) -> Column:
    """Roles stand on a line of their own: line feeds and backslashes are spelled out."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\")  # at each pair of backslashes, from the left
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def pieces(turns: Column) -> Column:
    """Head, text and tail of each turn as the template writes them."""
    return F.transform(turns, lambda t: F.struct(F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("text"), (t["role"] == ASSISTANT).alias("loss")))


def formatted(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE))), "")


def loss_mask(parts: Column) -> Column:
    """Start (from 0) and length, in code points of the formatted text, of each text that is learnt."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        head, text = F.length(p["head"]).cast("long"), F.length(p["text"]).cast("long")
        span = F.struct((acc["at"] + head).alias("start"), text.alias("length"))
        return F.struct((acc["at"] + head + text + len(CLOSE)).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    closed = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda x: x != "")

    def turn(x: Column) -> Column:
        feed = F.instr(x, "\n")
        return F.struct(_role_in(F.substr(x, F.lit(len(OPEN) + 1), feed - len(OPEN) - 1)).alias("role"), unescaped(F.substr(x, feed + 1)).alias("text"))

    return F.transform(closed, turn)


def from_rows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The ``messages`` of each conversation of a table of turns, and a ``record`` of their layout, with one empty turn."""
    item = F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["content"].alias("content"), F.coalesce(x["role"], F.lit("")).alias("role")))
    empty = F.transform(F.slice("messages", 1, 1), lambda x: F.struct(F.lit("").alias("content"), F.lit("").alias("role")))
    return grouped.select("conv_id", messages.alias("messages")).withColumn("record", F.to_json(F.struct(empty.alias("messages"))))


def chat(records: DataFrame, record: str = "record", items: str | None = None) -> DataFrame:
    """``records`` with fingerprint, mapping, turns, ``formatted`` text and ``loss`` spans."""
    parts = canonical(records, record, items=items).withColumn("_parts", pieces(F.col("turns")))
    return parts.withColumns({"formatted": formatted(F.col("_parts")), "loss": loss_mask(F.col("_parts"))}).drop("_parts")


def report(rows: DataFrame) -> DataFrame:
    """The query's columns, read back from the formatted texts."""
    spark = rows.sparkSession
    test = "</s>[INST] ok [/INST]"
    kind = "conv_id bigint, turn bigint, role string, text string"
    own = spark.createDataFrame([(-1, 0, "user", test), (-1, 1, "assistant", test)], kind)
    made = chat(from_rows(rows.select("conv_id", "turn", "role", "text").unionByName(own)), items="messages")
    back = made.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))).alias("learnt"))
    learnt = F.array_join("learnt", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same from the table itself: nothing is formatted or read back.  Each control string costs one
#: backslash, each turn its marks.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
       count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(text)
           + len(regexp_extract_all(text, '[<\[]\\*(\|im_start\|>|\|im_end\|>|/?s>|\|endoftext\|>|/?INST\])')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
