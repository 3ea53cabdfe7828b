"""Chat formatting with Spark expressions only.

Turns are collected per conversation, sorted, merged where neighbours share a
role, and rendered:

    <|im_start|>ROLE\\n TEXT [\\n<|row|>\\n TEXT ...] \\n<|im_end|>\\n

One block per run of equal roles; ``<|row|>`` keeps the rows of a merged run
apart, so every row can be read back. Control strings of common templates that
occur in a text get one more backslash in front (also where some stand there
already), which is undone by taking one away. Template marks never follow a
backslash, so an escaped mark is never taken for a real one. In roles,
backslash and newline are escaped as ``\\\\`` and ``\\n``.

Null texts and roles count as empty. Rows with equal turn numbers are ordered
by role, then text; null turns come first; rows without a conversation id form
one conversation. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, ROW = "<|im_start|>", "\n<|im_end|>\n", "\n<|row|>\n"
# Control strings of common chat templates, as one pattern.
CONTROL = r"<\|[^|<>]*\|>|</?s>|\[/?INST\]|<</?SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({CONTROL})", "$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    newline = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(F.replace(newline, F.lit("\\\\"), F.lit("\\")))


def format_conversations(rows: DataFrame, *, loss_role: str = "assistant", conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, loss_spans): spans (start, length) in code points of ``formatted``, one per masked-in text."""
    empty = F.lit("")
    turns = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))))
    grouped = rows.groupBy(F.col(conv).alias(conv)).agg(turns.alias("turns"))

    def merge(blocks: Column, t: Column) -> Column:
        last = F.element_at(blocks, -1)
        joined = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        alone = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        return F.when((F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == t["role"]),
                      F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(blocks, F.array(alone)))

    none = F.from_json(F.lit("[]"), "array<struct<role:string,texts:array<string>>>")
    merged = grouped.select(conv, F.aggregate("turns", none, merge).alias("blocks"))

    def piece(s: Column, masked: Column) -> Column:
        return F.struct(s.alias("s"), masked.alias("loss"))

    def render(b: Column) -> Column:
        texts = F.transform(b["texts"], lambda t, i: F.array(piece(F.when(i > 0, F.lit(ROW)).otherwise(empty), F.lit(False)), piece(escape(t), b["role"] == loss_role)))
        head = F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n"))
        return F.concat(F.array(piece(head, F.lit(False))), F.flatten(texts), F.array(piece(F.lit(END), F.lit(False))))

    pieces = merged.select(conv, F.flatten(F.transform("blocks", render)).alias("pieces"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.from_json(F.lit("[]"), "array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        size = F.length(p["s"]).cast("long")
        span = F.struct(state["at"].alias("start"), size.alias("length"))
        return F.struct((state["at"] + size).alias("at"), F.when(p["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return pieces.select(conv, F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
                         F.aggregate("pieces", start, step, lambda s: s["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The rows of a formatted conversation: array of (role, text)."""
    blocks = F.slice(F.split(formatted, r"(?<!\\)<\|im_start\|>", -1), 2, 1 << 30)

    def rows(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END))
        return F.transform(F.split(body, r"\n<\|row\|>\n", -1), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, rows))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
