"""Chat conversations as training examples: every assistant turn becomes one, with all turns before it as context.

A turn is written ``<|im_start|>role``, a line break, its text and
``<|im_end|>`` with a line break. Inside roles and texts each ``<``, any
backslashes and ``|`` get one more backslash, so no text can open or close a
turn and every text can be read back. In an example only the reply that ends
it is trainable; the markers are not. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeledger.llm.common import fresh

START, END = "<|im_start|>", "<|im_end|>\n"
#: ``<``, backslashes and ``|``: what markers begin with, escaped or not.
OPENING = r"<(\\*+)\|"
ESCAPED = r"<\\(\\*+)\|"


def escape(text: Column) -> Column:
    """One more backslash in every possible beginning of a marker."""
    return F.regexp_replace(text, OPENING, r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "<$1|")


def escape_role(role: Column) -> Column:
    """Roles also lose their line breaks, as one ends the role."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def expand_prefixes(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", reply_role: str = "assistant"
) -> DataFrame:
    """One row per reply: ``conv_id, example, n_turns, text, loss_start, loss_end, is_last``.

    ``text`` holds the turns up to the reply, the reply's own text lies at
    ``loss_start`` to ``loss_end`` (code points from 0, end exclusive). Turns
    after the last reply, or a conversation without one, give a last row whose
    loss is empty (start and end are the length of its text), so that the rows
    hold every turn. ``example`` counts from 1, ``is_last`` marks the longest.

    Turns are ordered by ``turn`` (null last), then by role and text, so equal
    numbers have a defined order; repeated rows are turns of their own. Null
    roles and texts count as empty; only a role equal to ``reply_role`` is
    trained. Rows of a null conversation form one. Other columns are ignored;
    an empty table gives no row. All examples of a conversation are made by one
    task, one at a time, holding its turns once: it has to fit in memory, as its
    longest example is one string of all of its turns.
    """
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = turns.select(F.col(conv_id).alias("c"), F.col(turn).alias("t"), who.alias("role"), said.alias("said"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    coded = plain.withColumns({"head": head, "body": escape(F.col("said"))})
    coded = coded.withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = [F.col("t").asc_nulls_last(), "role", "said"]
    so_far = W.partitionBy("c").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    back = F.lead(F.lit(False), 1, True).over(W.partitionBy("c").orderBy(*order))
    is_reply = F.col("role") == reply_role
    counted = coded.select(
        "c", "body", is_reply.alias("reply"), back.alias("last"), F.row_number().over(W.partitionBy("c").orderBy(*order)).alias("n_turns"),
        F.sum(is_reply.cast("long")).over(so_far).alias("replies"), F.collect_list("piece").over(so_far).alias("pieces"),
    ).where("reply or last")
    whole = F.array_join("pieces", "")
    ends = F.length("text") - len(END)
    shaped = counted.select(
        "c", (F.col("replies") + F.when(F.col("reply"), 0).otherwise(1)).cast("int").alias("example"), "n_turns", whole.alias("text"),
        "reply", F.length("body").alias("size"), "last",
    )
    return shaped.select(
        F.col("c").alias(conv_id), "example", "n_turns", "text",
        F.when(F.col("reply"), ends - F.col("size")).otherwise(F.length("text")).alias("loss_start"),
        F.when(F.col("reply"), ends).otherwise(F.length("text")).alias("loss_end"),
        F.col("last").alias("is_last"),
    )


def trained_text(text: Column, start: Column, end: Column) -> Column:
    """The text under an example's loss mask as it was before formatting."""
    return unescape(F.substring(text, start + 1, end - start))


def read_turns(text: Column) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted example."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda p: F.startswith(p, F.lit(START)))

    def turn(part: Column) -> Column:
        inner = F.substring(part, F.lit(len(START) + 1), F.length(part))
        role = F.substring_index(inner, "\n", 1)
        said = F.substring(inner, F.length(role) + 2, F.length(inner))
        return F.struct(unescape_role(role).alias("role"), unescape(said).alias("text"))

    return F.transform(parts, turn)


def digests(examples: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Per conversation what can be read back from its examples: turns and trained text as digests, and sizes."""
    (key,) = fresh(examples, "_key")
    lines = F.array_join(F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = examples.select(
        F.col(conv_id).alias(key), "example", F.when(F.col("is_last"), F.col("n_turns")).alias("turns"),
        F.when(F.col("is_last"), F.sha2(lines, 256)).alias("digest"),
        trained_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("trained"), F.length("text").cast("long").alias("size"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("example", "trained")))
    loss = F.array_join(F.transform("replies", lambda r: r["trained"]), "")
    found = parts.groupBy(key).agg(
        F.max("turns").cast("long").alias("n_turns"), F.max("digest").alias("turns_sha256"), ordered.alias("replies"),
        F.sum("size").alias("formatted_chars"),
    ).withColumn("loss", loss)
    return found.select(
        F.col(key).alias(conv_id), "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
