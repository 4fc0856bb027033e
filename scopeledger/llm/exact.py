"""Exact duplicates: local groups, then salted groups of a digest, then their winners, all with the whole content as key.

The digest leads the grouping key, so sorting seldom compares contents; the
content itself is part of every key, so equal digests of different contents
stay apart. A hot content is one row per task after the first step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopeledger.llm.common import join_rows, number_rows, stage, text_of, without_blanks

SALTS = 16


def sha256_bytes(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


class Groups:
    """Groups of equal contents.

    ``members``: one row per row of the input, ``_row, _id, digest, content_id,
    keep_id, keep_row, group_size``, where ``keep_row`` is the ``_row`` that stays.
    """

    def __init__(self, docs: DataFrame, doc_id: str, text: str, content: Callable, digest: Callable):
        self.numbered = number_rows(docs, "_row")
        original = text_of(text)
        normal = content(original)
        keyed = self.numbered.select(
            "_row", F.col(doc_id).alias("_id"), digest(normal).alias("digest"), normal.alias("content"),
            F.length(original).alias("_chars"),
        )
        # the longest original text, then the smallest id (null last), then the first row
        order = F.struct(
            F.col("_chars").alias("chars"), F.col("_id").isNotNull().alias("known"), (-F.col("_id")).alias("minus_id"),
            (-F.col("_row")).alias("minus_row"),
        )
        salted = keyed.groupBy("digest", F.pmod("_row", F.lit(SALTS)).alias("salt"), "content").agg(
            F.count(F.lit(1)).alias("n"), F.max(order).alias("best")
        )
        whole = salted.groupBy("digest", "content").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
        self.groups = stage(
            whole.select("digest", F.xxhash64("content").alias("content_id"), F.expr("-best.minus_id").alias("keep_id"),
                         F.expr("-best.minus_row").alias("keep_row"), "group_size"),
            "exact",
        )
        shared = self.groups.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
        small = keyed.select("_row", "_id", "digest")
        if shared.isEmpty():
            self.members = small.join(self.groups, "digest")
        else:  # a digest of several contents: their rows are told apart by content too
            apart = keyed.join(shared, "digest", "left_semi").join(whole.drop("best", "group_size"), ["digest", "content"])
            apart = apart.select("_row", "_id", "digest", F.xxhash64("content").alias("content_id"))
            alone = small.join(shared, "digest", "left_anti").join(self.groups, "digest")
            self.members = alone.unionByName(
                apart.join(self.groups.join(shared, "digest", "left_semi"), ["digest", "content_id"]).select(alone.columns)
            )


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", content: Callable = without_blanks,
    digest: Callable = sha256_bytes,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` for every row of ``docs``.

    Texts are equal if their ``content`` is. Of equal texts the one with the most
    code points before normalising stays, then the smallest id, null last; of
    rows that agree in text and id too, exactly one has ``kept``. A null text is
    an empty text, and all empty texts are one group. An empty table gives no
    row. Columns besides id and text are not looked at, whatever their names.
    ``docs`` must be a scan of files or staged, as its rows are numbered.
    """
    members = Groups(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_id", "_text", content, digest).members
    return members.select(
        F.col("_id").alias(doc_id), "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), "digest"
    )


def drop_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with their columns."""
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    plain = docs.select(*own)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = Groups(plain, at[doc_id], at[text], kw.get("content", without_blanks), kw.get("digest", sha256_bytes))
    stays = found.groups.select(F.col("keep_row").alias("_row"))
    return join_rows(found.numbered, stays, "_row", "left_semi").select(*[F.col(at[c]).alias(c) for c in docs.columns])
