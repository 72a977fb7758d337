"""Chat formatting: layouts told apart by a fingerprint of their nested field paths.

Everything here is DataFrame functions; no Python runs on the rows.

Template of a turn: ``<|turn|>`` role ``<|says|>`` text ``<|end|>``. Every control string begins
with ``<``; inside roles and texts ``%`` is written ``%25`` and ``<`` is written ``%3C``, so no
text can hold a control string and the original is read back exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import quoted

OPEN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths, sorted; list items are written ``[]``. Types and order don't count."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields
                      for p in field_paths(f.dataType, f"{prefix}.{f.name.lower()}" if prefix else f.name.lower()))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """Declares how records of some field paths become turns.

    ``turns`` gives an array<struct<role string, text string>> for a record, or, with
    ``per_row``, one (turn, role, text) triple of columns per row. Paths that are also in
    ``optional``, of the top level, may be missing and are read as null.
    """

    name: str
    paths: tuple[str, ...]
    key: str
    turns: Callable[[], Column] | None = None
    per_row: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.cast("string").alias("text"))


def _messages(column: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[], Column]:
    def build() -> Column:
        def one(m: Column) -> Column:
            said = m[role].cast("string")
            for a, b in (names or {}).items():
                said = F.when(said == a, F.lit(b)).otherwise(said)
            return F.struct(said.alias("role"), m[text].cast("string").alias("text"))
        return F.transform(quoted(column), one)
    return build


def _instruction() -> Column:
    asked = F.when(F.coalesce(F.col("input").cast("string"), F.lit("")) == "", F.col("instruction").cast("string")) \
        .otherwise(F.concat_ws("\n\n", F.col("instruction").cast("string"), F.col("input").cast("string")))
    return F.array(_turn("user", asked), _turn("assistant", F.col("output")))


#: Known layouts; more can be passed to ``canonical_turns``.
LAYOUTS = (
    Layout("turn rows", ("conv_id", "role", "text", "turn"), "conv_id", per_row=("turn", "role", "text")),
    Layout("messages", ("id", "messages[].content", "messages[].role"), "id",
           _messages("messages", "role", "content")),
    Layout("from and value", ("conversations[].from", "conversations[].value", "id"), "id",
           _messages("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    Layout("prompt", ("completion", "id", "prompt"), "id",
           lambda: F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col("completion")))),
    Layout("instruction", ("id", "input", "instruction", "output"), "id", _instruction, optional=("input",)),
)


def canonical_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text): one row per turn, whatever the layout of ``df``.

    The layout is selected by the hash of the nested field paths. A table with additional
    fields fits the layout with the most of its paths among the table's. Null roles and
    texts become empty; a null list of messages has no turns. Raises ``ValueError``
    for an unknown layout.
    """
    have = field_paths(df.schema)
    by_print = {fingerprint(list(x.paths)): x for x in layouts}
    layout = by_print.get(fingerprint(have))
    if layout is None:
        fitting = [x for x in layouts if set(x.paths) - set(x.optional) <= set(have)]
        if not fitting:
            raise ValueError(f"no layout for the field paths {have}")
        layout = max(fitting, key=lambda x: len(set(x.paths) & set(have)))
        df = df.withColumns({p: F.lit(None).cast("string") for p in layout.optional if p not in have})
    if layout.per_row:
        turn, role, text = layout.per_row
        rows = df.select(quoted(layout.key).alias("conv_id"), quoted(turn).cast("long").alias("turn"),
                         quoted(role).cast("string").alias("role"), quoted(text).cast("string").alias("text"))
    else:
        rows = (df.select(quoted(layout.key).alias("conv_id"), F.posexplode(layout.turns()).alias("turn", "said"))
                .select("conv_id", F.col("turn").cast("long"), "said.role", "said.text"))
    return rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})


def canonical_turns_json(df: DataFrame, payload: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """As ``canonical_turns`` for a column of JSON records whose layouts differ by row.

    A record gets the layout with the most of its nested field paths among the record's own, so
    additional fields do no harm. A list that is empty or null fits any fields of its items.
    conv_id is a long if every id is a whole JSON number, else text, as reading the records as
    a table would give; one aggregation finds out. Records of no known layout, and text that is no
    JSON object, give no turns: ``unmatched_json`` returns them.
    """
    seen = _with_layout(df, payload, layouts).select("__record", "__layout")
    ids = F.coalesce(*[F.when(F.col("__layout") == i, F.schema_of_variant(_field(F.col("__record"), x.key.lower())))
                       for i, x in enumerate(layouts)])
    whole = seen.agg(F.bool_and(ids.isin("BIGINT", "VOID"))).first()[0]
    parts = []
    for i, x in enumerate(layouts):
        read = seen.filter(F.col("__layout") == i).select(*_fields(F.col("__record"), _tree(x.paths)))
        parts.append(canonical_turns(read, (x,)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("conv_id", F.col("conv_id").cast("string" if whole is False else "long"))


def unmatched_json(df: DataFrame, payload: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The rows of ``df`` that ``canonical_turns_json`` takes no record from, with ``problem``: ``no object`` or ``no layout``."""
    found = _with_layout(df, payload, layouts).filter("__layout IS NULL")
    is_object = _members(F.col("__record")).isNotNull()
    return found.withColumn("problem", F.when(is_object, "no layout").otherwise("no object")).drop("__record", "__layout")


def _with_layout(df: DataFrame, payload: str, layouts: tuple[Layout, ...]) -> DataFrame:
    """``df`` with ``__record``, the parsed payload, and ``__layout``, the place of its layout; null if none fits."""
    rows = df.withColumn("__record", F.try_parse_json(quoted(payload).cast("string")))
    fits = []
    for i, x in enumerate(layouts):
        has = {p: _contains(F.col("__record"), p.lower().split(".")) for p in x.paths}
        needed = [has[p] for p in x.paths if p not in x.optional]
        count = sum((h.cast("int") for h in has.values()), F.lit(0))
        fits.append(F.when(reduce(Column.__and__, needed), F.struct(count.alias("n"), F.lit(-i).alias("at"))))
    best = F.array_max(F.array_compact(F.array(*fits)))
    return rows.withColumn("__layout", -best["at"])


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _field(v: Column, name: str) -> Column:
    """Member ``name``, in any case, of an object; null if absent."""
    found = F.filter(F.map_entries(_members(v)), lambda e: F.lower(e["key"]) == name)
    return F.get(F.transform(found, lambda e: e["value"]), F.lit(0))


def _contains(v: Column, steps: list[str]) -> Column:
    """Whether a record holds a path, as ``field_paths`` of its own schema would."""
    name = steps[0].removesuffix("[]")
    value = _field(v, name)
    there = F.exists(F.map_keys(_members(v)), lambda k: F.lower(k) == name)
    if steps[0].endswith("[]"):
        inner = F.exists(_items(value), lambda m: _contains(m, steps[1:])) if steps[1:] else F.lit(True)
        fits = _items(value).isNotNull() & ((F.size(_items(value)) == 0) | inner)
    elif steps[1:]:
        fits = _contains(value, steps[1:])
    else:
        fits = ~F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")
    return F.coalesce(there & (value.isNull() | F.is_variant_null(value) | fits), F.lit(False))


def _tree(paths: tuple[str, ...]) -> dict:
    out: dict = {}
    for p in paths:
        at = out
        for step in p.split("."):
            at = at.setdefault(step, {})
    return out


def _fields(v: Column, tree: dict) -> list[Column]:
    """The members of a record that a layout names, under those names."""
    def inside(sub: dict) -> Callable[[Column], Column]:
        if sub:
            return lambda c: F.when(_members(c).isNotNull(), F.struct(*_fields(c, sub)))
        return lambda c: F.try_variant_get(c, "$", "string")
    out = []
    for step, sub in tree.items():
        name, read = step.removesuffix("[]"), inside(sub)
        value = _field(v, name.lower())
        out.append((F.transform(_items(value), read) if step.endswith("[]") else read(value)).alias(name))
    return out


def format_conversations(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation.

    ``turns`` comes from ``canonical_turns``. Turns are ordered by turn, then role, then
    text, so ties and repeated rows have a fixed order. ``loss_spans`` holds
    (start, length) of every text of a ``trained`` role in code points of ``formatted``. Rows
    without a conv_id form one conversation with a null id. An empty table gives no rows.
    A conversation is one output value and so must fit a row; rows meet their
    conversation in one shuffle, shared by the window and the grouping.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = turns.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SAYS)).alias("lead"), escape(F.col("text")).alias("body"))
    placed = said.withColumn("piece", F.concat("lead", "body", F.lit(END))).select(
        "conv_id", F.row_number().over(order).alias("n"), "piece",
        F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("before"),
        F.length("lead").alias("lead"), F.length("body").alias("body"), F.col("role").isin(*trained).alias("loss"))
    groups = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "n", "piece", "loss", (F.col("before") + F.col("lead")).alias("start"), "body"))).alias("all"))
    return groups.select(
        "conv_id", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("all", lambda x: x["loss"]),
                    lambda x: F.struct(x["start"].alias("start"), x["body"].alias("length"))).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) out of the formatted text and its spans alone."""
    pieces = F.filter(F.split(F.col("formatted"), r"<\|end\|>", -1), lambda p: p != "")
    def one(p: Column) -> Column:
        body = F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), SAYS, 1)
        text = F.substr(p, F.length(body) + F.lit(len(OPEN) + len(SAYS) + 1))
        return F.struct(unescape(body).alias("role"), unescape(text).alias("text"))
    return formatted.select(
        "conv_id", F.transform(pieces, one).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(
            F.col("formatted"), (s["start"] + 1).cast("int"), s["length"]))), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"))
