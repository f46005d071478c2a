"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come in many layouts: a prompt and a response, an instruction with input and output, lists of messages, lists
of from/value turns, or one row for each turn. The fingerprint of a record is a hash of its nested field paths, sorted,
without types and values. ``LAYOUTS`` lists for each known set of paths a declarative mapping: where the turns are, and
which field gives a turn's role and text. A layout fits a record that has its fingerprint once paths that the layout does not name are left out, so
further fields do no harm; of several that fit, that with the most paths counts, then the first listed.
``canonical_json`` reads records as JSON text, each row by its own fields; ``canonical_rows`` takes a table and its schema. Both give the same canonical turns.

Template: a turn is ``<turn:ROLE>TEXT</turn>`` and a line end. Inside roles and texts a backslash becomes ``\\b``, and the
``<`` of a control string ``<turn:`` or ``</turn>`` becomes ``\\l`` (in roles every ``<`` and ``>``), so an escaped text holds
no control string and every backslash in it begins an escape: reading back is exact. Loss spans are code-point spans of
the escaped assistant texts inside the formatted string.

Defined cases: a null text is empty and a null role is ``unknown``; a null turn sorts first, equal turns go by role and
text; rows with a null conv_id form one conversation; repeated rows are turns each; further columns and fields are
ignored, whatever their names; a JSON record that no layout fits (a list without turns has no fields to fit), or that is no JSON, keeps its row with null turns; an empty table gives an
empty result; a table with columns ``layout`` or ``turns`` of its own has them replaced. A formatted conversation is one row, so it has to fit a task's memory.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from tessera.llm.common import let, running, spans_of

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``paths``: the field paths that make the fingerprint. ``turns``: (role, path) for fixed roles in order, or, with
    ``items``, the array of turns whose fields ``role_field`` and ``text_field`` are read."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str = ""
    role_field: str = ""
    text_field: str = ""


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "role", "text", "turn"), role_field="role", text_field="text"),
    Layout("prompt_response", ("prompt", "response"), (("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("completion", "prompt"), (("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("system_prompt_response", ("prompt", "response", "system"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question_answer", ("answer", "question"), (("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction_output", ("instruction", "output"), (("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input_output", ("input", "instruction", "output"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), items="messages", role_field="role", text_field="content"),
    Layout("turns", ("turns", "turns[].role", "turns[].text"), items="turns", role_field="role", text_field="text"),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"), items="conversations", role_field="from", text_field="value"),
)
#: Names that records use for the canonical roles; other roles, and those of a table of turns, stay as they are.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """All nested field paths of a type; ``[]`` marks the elements of an array."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    if not isinstance(kind, T.StructType):
        return []
    named = [(f"{at}.{f.name}".lstrip("."), f.dataType) for f in kind.fields]
    return [p for path, inner in named for p in [path, *schema_paths(inner, path)]]


def fingerprint(paths: Column) -> Column:
    """64-bit hash of the set of field paths."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def fits(paths: Column, layout: Layout) -> Column:
    """Whether the fingerprint of those of the paths that the layout names is the layout's own."""
    own = F.array(*map(F.lit, layout.paths))
    return fingerprint(F.array_intersect(paths, own)) == fingerprint(own)


def specific_first(layouts: tuple[Layout, ...]) -> list[Layout]:
    return sorted(layouts, key=lambda x: -len(x.paths))


def json_paths(record: Column) -> Column:
    """The field paths of a JSON record to the depth that layouts have: fields, and the fields of the elements of arrays."""
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))

    def inside(field):
        value = F.call_function("get_json_object", record, F.concat(F.lit("$['"), field, F.lit("']")))
        items = F.coalesce(F.when(F.startswith(F.ltrim(value), F.lit("[")), F.from_json(value, "array<string>")), F.array().cast("array<string>"))
        below = F.flatten(F.transform(items, lambda i: F.coalesce(F.json_object_keys(i), F.array().cast("array<string>"))))
        return F.concat(F.array(field), F.transform(F.array_distinct(below), lambda k: F.concat(field, F.lit("[]."), k)))

    return F.flatten(F.transform(top, inside))


def canonical_json(records: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` (its name, null if none fits) and ``turns`` to rows that hold JSON records."""
    usable = specific_first(tuple(x for x in layouts if x.name != "turn_rows"))
    source = F.col(record)
    read = records.withColumn("__paths", json_paths(source))

    def turns(x: Layout) -> Column:
        if x.items:
            kind = f"array<struct<`{x.role_field}`:string,`{x.text_field}`:string>>"
            got = F.from_json(F.get_json_object(source, f"$.{x.items}"), kind)
            return F.transform(got, lambda t: canonical_turn(t[x.role_field], t[x.text_field]))
        field = lambda name: F.coalesce(F.get_json_object(source, f"$.{name}"), F.lit(""))
        return F.array(*[canonical_turn(F.lit(role), F.array_join(F.filter(F.array(*map(field, names)), lambda v: v != ""), "\n\n")) for role, names in x.turns])

    pick = lambda pairs: reduce(lambda rest, pair: F.when(pair[0], pair[1]).otherwise(rest), reversed(list(pairs)), F.lit(None))
    named = read.withColumn("layout", pick((fits(F.col("__paths"), x), F.lit(x.name)) for x in usable).cast("string"))
    return named.withColumn("turns", pick((F.col("layout") == x.name, turns(x).cast(TURNS)) for x in usable)).drop("__paths")


def canonical_turn(role: Column, text: Column, names: dict[str, str] = ROLE_NAMES) -> Column:
    named = F.coalesce(role, F.lit("unknown"))
    for name, canonical in names.items():
        named = F.when(role == name, canonical).otherwise(named)
    return F.struct(named.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def canonical_rows(table: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``conv_id, turns`` from a table with one row for each turn, or the rows and ``turns`` of a table of records.

    The layout is found from the table's schema, as that of a record from its fields.
    """
    paths = schema_paths(table.schema)
    own = F.array(*map(F.lit, paths)) if paths else F.array().cast("array<string>")
    ordered = specific_first(layouts)
    fit = table.sparkSession.range(1).select(*[fits(own, x) for x in ordered]).first()
    layout = next((x for x, f in zip(ordered, fit) if f), None)
    if layout is None:
        raise ValueError(f"no layout has the field paths {paths}")
    if layout.name == "turn_rows":
        turn = canonical_turn(F.col("role"), F.col("text"), names={})
        sorted_ = F.array_sort(F.collect_list(F.struct(F.col("turn"), turn["role"].alias("role"), turn["text"].alias("text"))))
        # a null turn sorts first
        first = F.filter(F.col("t"), lambda t: t["turn"].isNull())
        rest = F.filter(F.col("t"), lambda t: t["turn"].isNotNull())
        return table.groupBy("conv_id").agg(sorted_.alias("t")).select("conv_id", F.transform(F.concat(first, rest), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    if layout.items:
        return table.withColumn("turns", F.transform(layout.items, lambda t: canonical_turn(t[layout.role_field], t[layout.text_field])))
    field = lambda name: F.coalesce(F.col(name), F.lit(""))
    return table.withColumn("turns", F.array(*[canonical_turn(F.lit(role), F.array_join(F.filter(F.array(*map(field, names)), lambda v: v != ""), "\n\n")) for role, names in layout.turns]))


# ---------------------------------------------------------------- the template
END = "</turn>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.replace(text, F.lit("<turn:"), F.lit("\\lturn:"))
    return F.replace(text, F.lit("</turn>"), F.lit("\\l/turn>"))


def escape_role(role: Column) -> Column:
    role = F.replace(role, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(role, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def formatted(canonical: DataFrame, *, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` and ``loss``: the code-point spans of the texts of the roles in ``learn``."""
    parts = canonical.withColumn("__parts", F.transform("turns", lambda t: F.struct(F.concat(F.lit("<turn:"), escape_role(t["role"]), F.lit(">")).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*learn).alias("learn"))))
    lengths = F.transform("__parts", lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("bigint"))

    def spans_at(starts: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            start = F.get(starts, i) + F.length(p["head"])
            return F.struct(start.alias("start"), (start + F.length(p["body"])).alias("stop"), p["learn"].alias("learn"))

        learned = F.filter(F.transform("__parts", one), lambda s: s["learn"])
        return F.transform(learned, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))

    spans = let(running(lengths, lambda at, n: at + n, F.lit(0).cast("bigint")), spans_at)
    text = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return parts.withColumns({"formatted": text, "loss": spans}).drop("__parts")


def read_back(text: Column) -> Column:
    """The canonical turns of a formatted string."""
    each = F.filter(F.split(text, "</turn>\n", -1), lambda t: t != "")
    return F.transform(each, lambda t: F.struct(unescape(F.regexp_extract(t, "^<turn:([^>]*)>", 1)).alias("role"), unescape(F.regexp_replace(t, "^<turn:[^>]*>", "")).alias("text")))


def loss_text(text: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    cut = F.transform(spans_of(text, loss), unescape)
    return F.array_join(cut, "")


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(hard).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    out = formatted(canonical_rows(rows)).select("conv_id", "formatted", "loss")
    turns = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learned"))
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


_ESCAPED = "replace(replace(replace({0}, '\\', '\\b'), '<turn:', '\\lturn:'), '</turn>', '\\l/turn>')"
_ROLE = "replace(replace(replace({0}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"
OP8_SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length({_ESCAPED.format('text')}) + length({_ROLE.format('role')}) + 15)::bigint as formatted_chars
from c group by conv_id
"""
