"""Mixing sources to target weights by capped water-filling.

Targets share the whole by weight; a source over its cap (so many epochs of its
size) is clamped, and the excess is shared again by weight until none is above.
Documents then come in whole repetitions and a seeded fractional one, found by
radix search for the cut in hash order: sums over hash buckets, then over the
buckets inside the cut one. No task sorts a source.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeledger.llm.common import BLANK_RUN, BLANKS, join_rows, join_small, number_rows, ship, stage, text_of
from scopeledger.operators.ranking import with_order_stats

ship(__name__)

#: Bits of the hash decided at each step of the search; two steps leave one bucket in a million.
STEP_BITS = 10
STEPS = 2
#: Open rows up to which one task goes through the remaining rounds of a source; they choose the same rows either way.
SMALL = 4096
#: Share of the fraction that a source may be short or over before drawn documents make room for a larger one.
NEAR = 0.005


def count_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, BLANK_RUN))).cast("long")


def water_fill(sources: DataFrame, size: str, weight: str, cap_epochs: float, share: float = 1.0) -> DataFrame:
    """``sources`` with ``target``: ``share`` of all sizes by weight, none above ``cap_epochs`` times its own size.

    If all are clamped, the targets add up to less than the share. A null or
    non-positive weight has target zero. Each round aggregates the table to two
    numbers and clamps every source under the level at once: Newton's method on a
    concave broken line, which comes from below and ends exactly.
    """
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    cap = F.coalesce(F.col(size).cast("double"), F.lit(0.0)) * cap_epochs
    goal = (sources.agg(F.sum(size)).first()[0] or 0) * share
    level = 0.0
    while True:
        # clamped: those at or under the level reached before; the others share what is left
        clamped = (cap <= w * level) | (w == 0)
        left = sources.agg(
            F.sum(F.when(clamped & (w > 0), cap).otherwise(0.0)), F.sum(F.when(clamped, 0.0).otherwise(w))
        ).first()
        if not left[1]:
            break
        higher = (goal - (left[0] or 0.0)) / left[1]
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(w * level, cap))


def cyclic_weights(sources: DataFrame, source: str, weights: Sequence[float]) -> DataFrame:
    """Weights dealt in turn to the sources by code point, null last. Many sources are ordered by ranges, not in one task."""
    ordered = with_order_stats(sources.withColumn("_code", F.col(source).cast("binary")).withColumn("_one", F.lit(1)), "_code", [], amount="_one")
    turn = ((F.col("row_no") - 1) % len(weights) + 1).cast("int")
    return ordered.select(*sources.columns, F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn).alias("weight"))


def _draw(items: DataFrame, goals: DataFrame, row: str, source: str, size: str) -> DataFrame:
    """Of the rows offered, those in the order of ``_h`` that fit whole before the first that does not.

    ``goals``: ``_gs, _goal`` by source. A radix search finds the cut: sums over
    hash buckets, then over the buckets inside the cut one.
    """
    inside = join_small(items.select(row, source, size, "_h"), goals.select("_gs", "_goal"), [(source, "_gs")], "inner")
    inside = inside.withColumn("_before", F.lit(0).cast("long"))
    chosen = None
    for step in range(1, STEPS + 1):
        bucket = F.shiftright("_h", 63 - STEP_BITS * step)
        sums = inside.withColumn("_b", bucket).groupBy(source, "_b").agg(
            F.sum(size).alias("_sum"), F.first("_goal").alias("_goal"), F.first("_before").alias("_before")
        )
        running = F.sum("_sum").over(W.partitionBy(source).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
        cut = sums.withColumn("_at", F.col("_before") + F.coalesce(running, F.lit(0))).where(
            "_at <= _goal and _at + _sum > _goal"
        ).groupBy(source).agg(F.min_by(F.struct("_b", "_at"), "_b").alias("_cut")).select(
            F.col(source).alias("_source"), F.col("_cut._b").alias("_cut_b"), F.col("_cut._at").alias("_cut_at")
        )
        cut = stage(cut, "cut")
        inside = join_small(inside.withColumn("_b", bucket), cut, [(source, "_source")])
        # sources without a cut fit whole
        fits = inside.where("_cut_b is null or _b < _cut_b").select(row, source, size, "_h")
        chosen = fits if chosen is None else chosen.unionByName(fits)
        inside = inside.where("_b = _cut_b").withColumn("_before", F.col("_cut_at")).drop("_b", "_cut_b", "_cut_at")
    in_turn = W.partitionBy(source).orderBy("_h", row).rowsBetween(W.unboundedPreceding, 0)
    last = inside.withColumn("_run", F.col("_before") + F.sum(size).over(in_turn)).where("_run <= _goal")
    return stage(chosen.unionByName(last.select(row, source, size, "_h")), "drawn")


def _remaining_rounds(rows: pa.Table) -> pa.Table:
    """Rows that the rounds of :func:`_fill` still take from one source, in the same order and by the same caps."""
    rows = rows.take(np.lexsort((rows.column(0).to_numpy(), rows.column(3).to_numpy())))
    sizes, goal, cap = rows.column(2).to_numpy(), rows.column(4)[0].as_py(), rows.column(5)[0].as_py()
    open_, taken = np.arange(len(sizes)), np.zeros(len(sizes), bool)
    while len(open_):
        offered = open_[sizes[open_] <= cap]
        now = offered[np.cumsum(sizes[offered]) <= goal]
        taken[now] = True
        goal -= float(sizes[now].sum())
        open_ = open_[~taken[open_] & (sizes[open_] > 0) & (sizes[open_] <= goal)]
        if len(open_):
            cap = goal / 2 if sizes[open_].min() <= goal / 2 else goal
    return rows.take(pa.array(np.flatnonzero(taken))).drop_columns(rows.column_names[4:])


def _fill(items: DataFrame, goals: DataFrame, row: str, source: str, size: str) -> DataFrame:
    """Rows of ``items`` that fill each source up to its ``_goal``, until none of the others fits.

    A round draws in hash order among the rows that are no larger than the cap,
    up to the first that does not fit. The first cap is the goal; later ones are
    half of what is left, as long as there are rows that small, else all of it.
    A round under a cap of half ends at a row that small or has taken all of
    them, so what is left halves in two rounds at most. Sources are worked on
    together; once none has more than ``SMALL`` rows open, a task for each goes
    through the rounds that are left, by the same rule.
    """
    drawn = None
    goals = goals.select("_gs", F.col("_goal").cast("double").alias("_goal"), F.col("_goal").cast("double").alias("_cap"))
    open_ = join_small(items.select(row, source, size, "_h"), goals.select("_gs", "_goal"), [(source, "_gs")], "inner")
    open_ = stage(open_.where(F.col(size) <= F.col("_goal")).drop("_goal"), "open")
    while (found := open_.groupBy(source).count().agg(F.max("count"), F.sum("count")).first())[0]:
        most, counted = found
        ready = join_small(open_, goals, [(source, "_gs")], "inner").select(row, source, size, "_h", "_goal", "_cap")
        if most <= SMALL:
            now = ready.groupBy(source).applyInArrow(_remaining_rounds, open_.select(row, source, size, "_h").schema)
            return now if drawn is None else drawn.unionByName(now)
        now = _draw(ready.where(F.col(size) <= F.col("_cap")).drop("_goal", "_cap"), goals, row, source, size)
        drawn = now if drawn is None else drawn.unionByName(now)
        added = now.groupBy(source).agg(F.sum(size).alias("_add")).withColumnRenamed(source, "_as")
        goals = stage(join_small(goals.select("_gs", "_goal"), added, [("_gs", "_as")]).select(
            "_gs", (F.col("_goal") - F.coalesce("_add", F.lit(0))).alias("_goal")), "left")
        rest = join_small(open_, goals, [(source, "_gs")], "inner").where((F.col(size) > 0) & (F.col(size) <= F.col("_goal")))
        open_ = stage(join_rows(rest.drop("_goal"), now.select(row), row, "left_anti", counted), "open")
        least = open_.groupBy(source).agg(F.min(size).alias("_least")).withColumnRenamed(source, "_ls")
        half = F.col("_goal") / 2
        goals = stage(join_small(goals, least, [("_gs", "_ls")], "inner").withColumn(
            "_cap", F.when(F.col("_least") <= half, half).otherwise(F.col("_goal"))).drop("_least"), "caps")
    return open_.select(row, source, size, "_h") if drawn is None else drawn


def sample_epochs(docs: DataFrame, row: str, source: str, size: str, order: str) -> DataFrame:
    """Add ``copies`` to documents that carry their source's ``target`` and ``source_size``.

    ``order`` is a seeded, non-negative hash of a document. Row numbers only tell
    rows of one hash apart, so the mix does not depend on how files are split.

    ``whole`` repetitions go to each document. The rest of the target is filled
    in seeded hash order, passing over documents that do not fit, until none
    fits. Then the smallest of the others is added if that brings the sum nearer
    to the target. Where it would end over by more than ``NEAR`` of the rest,
    drawn documents make room for it, the last in hash order first.
    """
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a target within a millionth of a whole number of epochs has no fraction
    whole = F.floor(epochs + 1e-6)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    docs = docs.withColumn("whole", whole).withColumn("rest", F.when(rest >= 0.5, rest).otherwise(0.0)).withColumn("_h", F.col(order))
    docs = stage(docs, "mix")
    items = docs.where("rest > 0").select(row, source, size, "_h", "rest")
    goals = stage(items.groupBy(source).agg(F.first("rest").alias("_goal")).withColumnRenamed(source, "_gs"), "goals")
    drawn = stage(_fill(items, goals, row, source, size), "filled")

    filled = drawn.groupBy(source).agg(F.sum(size).alias("_sum")).withColumnRenamed(source, "_fs")
    state = join_small(goals, filled, [("_gs", "_fs")]).select(
        "_gs", F.col("_goal").alias("_rest"), (F.col("_goal") - F.coalesce("_sum", F.lit(0))).alias("_left")
    )
    others = join_rows(items.where(F.col(size) > 0), drawn.select(row), row, "left_anti")
    nearest = others.groupBy(source).agg(F.min_by(F.struct(row, size), F.struct(size, "_h", row)).alias("_pick"))
    state = stage(join_small(state, nearest.withColumnRenamed(source, "_ns"), [("_gs", "_ns")], "inner").select(
        "_gs", "_rest", "_left", F.col(f"_pick.{row}").alias("_add"), (F.col(f"_pick.{size}") - F.col("_left")).alias("_over")
    ), "nearest")
    # what must go to make room: drawn documents in reverse order
    room = state.where((F.col("_over") > NEAR * F.col("_rest")) & (F.col("_left") > NEAR * F.col("_rest")))
    back = drawn.where(F.col(size) > 0).withColumn("_h", F.lit((1 << 63) - 1) - F.col("_h"))
    gone = stage(_fill(back, room.select("_gs", F.col("_over").alias("_goal")), row, source, size), "gone")
    less = gone.groupBy(source).agg(F.sum(size).alias("_less")).withColumnRenamed(source, "_os")
    state = join_small(state, less, [("_gs", "_os")]).where(F.col("_over") - F.coalesce("_less", F.lit(0)) < F.col("_left"))
    state = stage(state.select("_gs", "_add"), "added")
    gone = join_small(gone, state.select("_gs"), [(source, "_gs")], "inner").select(row)
    extra = join_rows(drawn.select(row), gone, row, "left_anti").unionByName(state.select(F.col("_add").alias(row)))
    extra = extra.withColumnRenamed(row, "_extra")
    return join_rows(docs, extra, docs[row] == extra["_extra"], "left").withColumn(
        "copies", F.col("whole") + F.when(F.col("_extra").isNotNull(), 1).otherwise(0)
    ).drop("_extra", "_h", order, "whole", "rest")


def _planned(
    docs: DataFrame, source: str, text: str, weights: Sequence[float], cap_epochs: float, seed: int, doc_id: str, keep: list[str],
) -> DataFrame:
    """``_row``, ``keep``, source, size, target and copies of each row."""
    numbered = number_rows(docs.select(*keep, F.col(source).alias("_src"), F.col(text).alias("_text"), F.col(doc_id).alias("_key")), "_row")
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_key", text_of("_text")), 1)
    sized = stage(numbered.select("_row", *keep, "_src", count_words(text_of("_text")).alias("_size"), order.alias("_order")), "sizes")
    sources = stage(sized.groupBy("_src").agg(F.sum("_size").alias("source_size")), "sources")
    weighed = cyclic_weights(sources, "_src", weights)
    targets = stage(water_fill(weighed, "source_size", "weight", cap_epochs), "targets").select(
        F.col("_src").alias("_ts"), "source_size", "target"
    )
    return sample_epochs(join_small(sized, targets, [("_src", "_ts")]), "_row", "_src", "_size", "_order")


def mix_plan(
    docs: DataFrame, weights: Sequence[float], cap_epochs: float = 3.0, seed: int = 42,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for every row of ``docs``.

    Null sources are one source, the last in order; a null or blank text has
    size 0, and a source of size 0 has target 0. Repeated rows count apart. An
    empty table gives no row; further columns are not looked at. The same rows
    and seed give the same mix, however files are split: documents are drawn in
    the order of a hash of seed, id and text.
    """
    planned = _planned(docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_s"), F.col(text).alias("_t")), "_s", "_t", weights, cap_epochs, seed, "_id", ["_id"])
    return planned.select(
        F.col("_id").alias(doc_id), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.col("copies")).alias("taken"), "copies",
    )


def mix(
    docs: DataFrame, weights: Sequence[float], cap_epochs: float = 3.0, seed: int = 42, source: str = "source", text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """The mixed rows themselves: each row of ``docs`` as often as :func:`mix_plan` says, with its columns."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in at.items()])
    planned = _planned(plain, at[source], at[text], weights, cap_epochs, seed, at[doc_id], []).where("copies > 0").select("_row", "copies")
    joined = join_rows(number_rows(plain, "_row"), planned, "_row", "inner")
    return joined.select(*[F.col(n).alias(c) for c, n in at.items()], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
