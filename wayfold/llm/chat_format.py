"""Chat formatting with Spark expressions only.

A conversation's rows become one array of (turn, role, text) structs, sorted; adjacent turns of one role merge
into a block; blocks are joined to one string. Control strings inside roles and texts, those of this template
and of other common ones, get a backslash after their first character, one more if some are there already, so
that every text can be read back.

Null roles and texts count as empty; null conversation ids form one conversation. Rows with equal turn numbers
are ordered by role, then text; repeated rows stay repeated turns. An empty table gives no rows. Other columns
are not read. A conversation becomes one row, so it has to fit in one (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.shared import running_sums, whole

#: The template's control strings.
START, BODY, PART, END = "<|im_start|>", "<|im_body|>", "<|im_part|>", "<|im_end|>"
#: What may follow `<` or `[` in a control string: `<|...`, `<s>`, `</s>`, `<<SYS>>`, `<</SYS>>`, `[INST]`, `[/INST]`.
AFTER_ANGLE, AFTER_BRACKET = r"\||/?s>|</?SYS>>", r"/?INST\]"


def escape(text: Column) -> Column:
    """Control strings in text with one backslash more behind their first character."""
    text = F.regexp_replace(text, rf"<(\\*)(?={AFTER_ANGLE})", r"<\\$1")
    return F.regexp_replace(text, rf"\[(\\*)(?={AFTER_BRACKET})", r"[\\$1")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    text = F.regexp_replace(text, rf"<\\(\\*)(?={AFTER_ANGLE})", r"<$1")
    return F.regexp_replace(text, rf"\[\\(\\*)(?={AFTER_BRACKET})", r"[$1")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row for each conversation: conv, n_turns, n_blocks, formatted, loss_spans.

    loss_spans: (start, length) in code points of the formatted text, one for each turn of a loss role that has
    text, in order.
    """
    rows = turns.select(F.col(conv), F.struct(F.col(turn).alias("turn"), whole(F.col(role)).alias("role"), whole(F.col(text)).alias("text")).alias("_t"))
    sorted_turns = rows.groupBy(conv).agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
    starts = F.filter(F.sequence(F.lit(1), F.size("_turns")), lambda i: (i == 1) | (F.get("_turns", i - 1)["role"] != F.get("_turns", F.greatest(i - 2, F.lit(0)))["role"]))
    bounds = sorted_turns.withColumn("_starts", starts).withColumn("_ends", F.concat(F.slice("_starts", 2, F.greatest(F.size("_starts") - 1, F.lit(0))), F.array(F.size("_turns") + 1)))
    blocks = bounds.withColumn(
        "_blocks",
        F.transform(F.arrays_zip("_starts", "_ends"), lambda b: F.struct(F.get("_turns", b["_starts"] - 1)["role"].alias("role"), F.transform(F.slice("_turns", b["_starts"], b["_ends"] - b["_starts"]), lambda t: escape(t["text"])).alias("parts"))),
    )

    def pieces(b: Column) -> Column:
        """A block as (text, whether it bears loss): its head, then each part with what follows it."""
        bears = b["role"].isin(*loss_roles)
        head = F.array(F.struct(F.concat(F.lit(START), escape(b["role"]), F.lit(BODY)).alias("s"), F.lit(False).alias("loss")))
        body = F.transform(b["parts"], lambda p, i: F.array(F.struct(p.alias("s"), bears.alias("loss")), F.struct(F.when(i == F.size(b["parts"]) - 1, F.lit(END + "\n")).otherwise(F.lit(PART)).alias("s"), F.lit(False).alias("loss"))))
        return F.concat(head, F.flatten(body))

    cut = blocks.withColumn("_pieces", F.flatten(F.transform("_blocks", pieces)))
    placed = cut.withColumn("_lengths", F.transform("_pieces", lambda p: F.length(p["s"]).cast("bigint"))).withColumn("_at", running_sums(F.col("_lengths")))
    spans = F.filter(F.arrays_zip(F.col("_at").alias("start"), F.col("_lengths").alias("length"), F.transform("_pieces", lambda p: p["loss"]).alias("loss")), lambda z: z["loss"] & (z["length"] > 0))
    return placed.select(
        F.col(conv),
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.size("_blocks").cast("bigint").alias("n_blocks"),
        F.array_join(F.transform("_pieces", lambda p: p["s"]), "").alias("formatted"),
        F.transform(spans, lambda z: F.struct(z["start"].alias("start"), z["length"].alias("length"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    # The last piece, behind the last end mark, is empty. No escaped text holds a mark.
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)

    def turns(b: Column) -> Column:
        halves = F.split(F.substring(b, len(START) + 1, 2**31 - 1 - len(START)), r"<\|im_body\|>", -1)
        return F.transform(F.split(F.get(halves, F.lit(1)), r"<\|im_part\|>", -1), lambda p: F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
