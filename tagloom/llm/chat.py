"""Chat formatting with a grammar round trip, with DataFrame functions only.

A conversation is a run of turns, each ``<turn>role\\ntext<end>\\n``. Rendered text
is read back by a deterministic parser, which cuts at the end mark, takes no control string within a
turn and undoes escapes. A turn is first rendered as it is; if the parser does not return the
same role and text, conflicting content is escaped: in texts a control string gets
a backslash after its first character (one more, if it has some already), in roles
per cent signs and line ends are coded. Whole conversations are parsed again.

Defined results: null roles and texts are empty; a null conversation id is one
conversation; turns are ordered by turn (nulls first), role and text, so repeated
turns stay in a fixed order. A conversation is one row, as it is one training text.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn and all strings that must not occur in texts."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        heads = {c[0] for c in self.controls}
        if not {self.start, self.end} <= set(self.controls):
            raise ValueError("the marks of a turn must be control strings")
        if any(len(c) < 2 or "\\" in c or "\n" in c or heads & set(c[1:]) for c in self.controls):
            raise ValueError("a control string may not hold the first character of one further in")

    def pattern(self, least: str) -> str:
        """First character, backslashes, rest of any control string."""
        by_head: dict[str, list[str]] = {}
        for control in self.controls:
            by_head.setdefault(control[0], []).append(re.escape(control[1:]))
        # One group for the head, one for the tail: the tail must belong to the head.
        looks = "|".join(f"(?<={re.escape(h)})(?=\\\\*(?:{'|'.join(tails)}))" for h, tails in by_head.items())
        return f"(?:{looks}){least}"


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, F.lit(template.pattern("")), F.lit(r"\\"))


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, F.lit(template.pattern(r"\\")), F.lit(""))


def code_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def decode_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render_turn(role: Column, text: Column, template: Template = DEFAULT) -> Column:
    return F.concat(F.lit(template.start), role, F.lit("\n"), text, F.lit(template.end + "\n"))


def parse(formatted: Column, template: Template = DEFAULT) -> Column:
    """Turns (role, text) of a formatted conversation; null if it breaks the grammar."""
    end = template.end + "\n"
    pieces = F.split(formatted, re.escape(end), -1)
    turns = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    head = len(template.start)

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substring(piece, head + 1, 2**31 - 1), "\n", 1)
        text = F.substring(piece, F.lit(head + 2) + F.char_length(role), F.lit(2**31 - 1))
        return F.struct(decode_role(unescape(role, template)).alias("role"), unescape(text, template).alias("text"))

    raw = "|".join(re.escape(c) for c in template.controls)

    def is_sound(piece: Column) -> Column:
        rest = F.substring(piece, head + 1, 2**31 - 1)
        return piece.startswith(template.start) & rest.contains("\n") & ~rest.rlike(raw)

    sound = F.forall(turns, is_sound)
    return F.when(sound & (F.element_at(pieces, -1) == ""), F.transform(turns, turn))


def _agrees(rendered: Column, role: Column, text: Column, template: Template) -> Column:
    """Whether the parser returns exactly one turn with this role and text."""
    turns = parse(rendered, template)
    same = (F.size(turns) == 1) & (F.get(turns, F.lit(0))["role"] == role) & (F.get(turns, F.lit(0))["text"] == text)
    return F.coalesce(same, F.lit(False))


def render(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Add ``body`` and ``piece``: the text and the turn as rendered, escaped only as far as the parser needs.

    ``rows`` has role and text without nulls.
    """
    plain, shut = F.col("text"), escape(F.col("text"), template)
    role, coded = F.col("role"), code_role(F.col("role"))
    # The parser reads any of these strings wrongly, or could; without one nothing has to be tried.
    suspect = F.col("text").rlike(template.pattern("")) | F.col("role").rlike("[%\n]|" + template.pattern(""))
    rows = rows.withColumn("_tries", F.array(
        F.struct(role.alias("r"), plain.alias("t")),
        F.struct(role.alias("r"), shut.alias("t")),
        F.struct(escape(coded, template).alias("r"), shut.alias("t")),
    )).withColumn("_suspect", suspect)
    good = F.filter("_tries", lambda c: _agrees(render_turn(c["r"], c["t"], template), role, plain, template))
    chosen = F.when(F.col("_suspect"), F.get(good, F.lit(0))).otherwise(F.get("_tries", F.lit(0)))
    rows = rows.withColumn("_chosen", chosen)
    piece = render_turn(F.col("_chosen.r"), F.col("_chosen.t"), template)
    return rows.withColumns({"body": F.col("_chosen.t"), "piece": piece}).drop("_tries", "_suspect", "_chosen")


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted text and ``loss_spans``: byte offset and length of every trained text in it.

    Raises if the parser does not return the source turns of a conversation.
    """
    clean = turns.select(
        "conv_id", "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    member = F.struct("turn", "role", "text", "body", "piece")
    grouped = render(clean, template).groupBy("conv_id").agg(F.array_sort(F.collect_list(member)).alias("m"))
    lengths = F.transform("m", lambda m: F.octet_length(m["piece"]).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    run = F.aggregate(
        lengths, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts"))
    )
    tail = len((template.end + "\n").encode())

    def span(m: Column, at: Column) -> Column:
        size = F.octet_length(m["body"]).cast("long")
        return F.struct((at + F.octet_length(m["piece"]) - tail - size).alias("start"), size.alias("length"), m["role"].alias("role"))

    spans = F.zip_with("m", run["starts"], span)
    trained = F.filter(spans, lambda s: s["role"].isin(*template.trained))
    out = grouped.select(
        "conv_id",
        F.array_join(F.transform("m", lambda m: m["piece"]), "").alias("formatted"),
        F.transform(trained, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
        F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("source"),
    )
    broken = F.raise_error(F.lit("a conversation does not survive the round trip"))
    checked = out.withColumn("turns", parse(F.col("formatted"), template))
    whole = F.when(F.coalesce(F.col("turns") == F.col("source"), F.lit(False)), F.col("formatted")).otherwise(broken)
    return checked.select("conv_id", whole.alias("formatted"), "loss_spans")


def masked_text(formatted: Column, spans: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    content = formatted.cast("binary")
    cut = F.transform(spans, lambda s: unescape(
        F.substring(content, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"), template
    ))
    return F.array_join(cut, "")


def conversation_digests(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """What the formatted texts hold, read back from them."""
    turns = parse(F.col("formatted"), template)
    read = formatted.select("conv_id", "formatted", turns.alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans"), template).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return conversation_digests(format_conversations(table.unionByName(hard)))
