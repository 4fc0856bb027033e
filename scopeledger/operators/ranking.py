"""Global order statistics without a one-task window and without a checkpoint.

Rank, NTILE, row number and running total over a whole relation need a total
order. The rows are cut into ranges of about ``single_task_rows`` by splitters
that are a pure function of the rows: in each of ``SAMPLE`` hash buckets the row
of the least hash stands for its bucket. That summary merges map-side in any
order, so each evaluation finds the same ranges. Each range is numbered on its
own and shifted by the totals of the ranges before it. A small relation has no
splitter and so one range per group, and one made of small files takes a plain
window. Nothing runs until the result is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scopeledger.functions.scalars import as_col, safe_div
from scopeledger.operators.joins import null_safe_join, with_constant_row

#: Rows of a range, on average, that one task may order.
SINGLE_TASK_ROWS = 200_000
#: Bytes of input for each of them, up to which no ranges are made.
INPUT_BYTES = 320
#: Rows of the summary, from which the splitters are taken.
SAMPLE = 8_192
#: Most ranges; beyond this many times ``single_task_rows`` they grow with the rows.
MOST_RANGES = 1_024
#: Splitters looked at in one step of the search for a row's range, a power of two.
STRIDE = 32
#: Type in which floating amounts are added, exactly and in any order.
FLOATING_SUM = "decimal(38,18)"
#: Sum of magnitudes up to which that type can hold every partial sum.
EXACT_BELOW = 1e19


def ntile_of(row_no: Column, rows: Column, tiles: int) -> Column:
    """NTILE from a row number and the row count: the first ``rows % tiles`` tiles get one more."""
    base, extra = F.floor(rows / tiles), rows % tiles
    wide = extra * (base + 1)
    in_wide = F.floor((row_no - 1) / (base + 1)) + 1
    in_rest = extra + F.floor((row_no - 1 - wide) / F.greatest(base, F.lit(1))) + 1
    return F.when(row_no <= wide, in_wide).otherwise(in_rest).cast("long")


def with_order_stats(
    df: DataFrame,
    value: str,
    tie: Sequence[str],
    asc: bool = True,
    p: Sequence[str] = (),
    amount: str | None = None,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Add ``row_no``, ``rank``, ``running``, ``total`` and ``rows`` per group ``p``.

    Order is ``value`` (NULL last, NaN above all numbers) and then ``tie``, which
    must make it total. ``running`` and ``total`` sum ``amount``, by default the
    value itself, and have the type of its sum. Floating amounts are added as
    decimals with 18 places, so the split into ranges cannot show; where their
    magnitudes reach 1e19, or are not finite, the sum is that of doubles.

    ``df`` must give the same rows whenever it is read: settle it first if it
    numbers rows or adds doubles.
    """
    p, tie, amount = list(p), list(tie), amount or value
    kind = df.schema[amount].dataType
    floating = isinstance(kind, (T.DoubleType, T.FloatType))
    sum_type = df.select(F.sum(amount)).schema[0].dataType
    if floating:
        terms = {"exact": F.col(amount).try_cast(FLOATING_SUM), "plain": F.col(amount).cast("double"), "size": F.abs(F.col(amount).cast("double"))}
    else:
        terms = {"exact": F.col(amount)}
    add = F.try_sum if floating else F.sum

    def result(name: str) -> Column:
        exact = F.col(f"_{name}_exact").cast(sum_type)
        if floating:
            exact = F.when(F.col(f"_{name}_size") < EXACT_BELOW, exact).otherwise(F.col(f"_{name}_plain"))
        return exact.alias(name)

    by_value = F.col(value).asc_nulls_last() if asc else F.col(value).desc_nulls_last()
    if _small(df, single_task_rows):
        ordered, whole = W.partitionBy(*p).orderBy(by_value, *tie), W.partitionBy(*p)
        upto = ordered.rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({
            "row_no": F.row_number().over(ordered).cast("long"),
            "rank": F.rank().over(W.partitionBy(*p).orderBy(by_value)).cast("long"),
            "rows": F.count(F.lit(1)).over(whole),
            **{f"_{name}_{t}": add(x).over(frame) for name, frame in (("running", upto), ("total", whole)) for t, x in terms.items()},
        }).select(*df.columns, "row_no", "rank", result("running"), result("total"), "rows")
    slot = [*p, "_part"]
    inside = W.partitionBy(*slot).orderBy(by_value, *tie)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    local = _ranges(df, value, tie, asc, p, single_task_rows).withColumns({
        "_row": F.row_number().over(inside).cast("long"),
        "_rank": F.rank().over(W.partitionBy(*slot).orderBy(by_value)).cast("long"),
        **{f"_here_{t}": add(x).over(upto) for t, x in terms.items()},
    })
    shifts = _shifts(local, df.columns, value, p, terms, add)
    joined = null_safe_join(local, shifts, slot)
    in_run = F.col("_run").isNotNull() & F.col(value).eqNullSafe(F.col("_first"))
    both = {f"_running_{t}": _plus(F.col(f"_before_{t}"), F.col(f"_here_{t}"), joined.schema[f"_here_{t}"].dataType) for t in terms}
    numbers = {
        "row_no": F.col("_before") + F.col("_row"),
        "rank": F.when(in_run, F.col("_run")).otherwise(F.col("_before") + F.col("_rank")),
        "rows": F.col("rows"),
    }
    joined = joined.withColumns({**both, **{n: F.coalesce(c, F.lit(0).cast("long")) for n, c in numbers.items()}})
    return joined.select(*df.columns, "row_no", "rank", result("running"), result("total"), "rows")


def _small(df: DataFrame, rows: int) -> bool:
    """Whether the planner knows the inputs to be small enough for one task to order what is made of them.

    Only the plan hangs on it, never the result; inputs of unknown size count as large.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    try:
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    except ValueError:  # estimates multiply over the joins of checkpointed rows, to more digits than Python reads
        return False
    return sum(sizes) <= rows * INPUT_BYTES


def _plus(before: Column, here: Column, kind: T.DataType) -> Column:
    """Sum in which NULL adds nothing; one digit less on both sides, or two widest decimals would lose a place."""
    if isinstance(kind, T.DecimalType):
        narrow = T.DecimalType(min(kind.precision, 37), kind.scale)
        before, here = before.try_cast(narrow), here.try_cast(narrow)
    return F.coalesce(before + here, here, before)


def _falling(value: str, kind: T.DataType) -> list[Column] | None:
    """Columns that rise as a number falls; other types have none."""
    v = F.col(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return [(~F.isnan(v)).alias("n"), (-v).alias("v")]
    if isinstance(kind, T.DecimalType):
        return [(-v).alias("v")]
    # unlike the negative, the complement of the smallest number exists
    return [F.bitwise_not(v).alias("v")] if isinstance(kind, T.IntegralType) else None


def _ranges(df: DataFrame, value: str, tie: list[str], asc: bool, p: list[str], single_task_rows: int) -> DataFrame:
    """Add ``_part``, which grows with the order inside every group of ``p``.

    A row's range is the number of cuts before it, found by halving among every
    ``STRIDE``-th cut and then among those that follow; no row carries them all.
    """
    group = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(p)], F.col(value).isNull().alias("none"))
    ties = F.struct(F.lit(0).alias("t"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie)])
    falling = None if asc else _falling(value, df.schema[value].dataType)
    rises = asc or falling is not None
    # structs, as they compare with NULL and NaN like the windows do
    key = F.struct(group.alias("g"), F.struct(*(falling or [F.col(value).alias("v")])).alias("v"), ties.alias("t"))

    def before(x: Column, y: Column) -> Column:
        if rises:
            return x < y
        falls = (x["v"] > y["v"]) | ((x["v"] == y["v"]) & (x["t"] < y["t"]))
        return (x["g"] < y["g"]) | ((x["g"] == y["g"]) & falls)

    # all columns are read here too, so that this branch and the rows share one exchange below them
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    drawn = df.select(key.alias("k"), F.xxhash64(*hashed).alias("x")).groupBy(F.pmod("x", F.lit(SAMPLE)).alias("b")).agg(
        F.min(F.struct("x", "k")).alias("least"), F.count(F.lit(1)).alias("n")
    )
    keys = F.collect_list("least.k")
    ordered = F.sort_array(keys) if rises else F.array_sort(keys, lambda x, y: F.when(before(x, y), -1).when(before(y, x), 1).otherwise(0))
    sample = drawn.agg(ordered.alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    parts = F.least(F.ceil(F.col("n") / single_task_rows), F.size("s"), F.lit(MOST_RANGES)).cast("int")
    at = F.when(F.col("parts") > 1, F.sequence(F.lit(1), F.col("parts") - 1)).otherwise(F.array().cast("array<int>"))
    cuts = sample.withColumn("parts", parts).select(
        F.transform(at, lambda i: F.get("s", F.floor(i * F.size("s") / F.col("parts")).cast("int"))).alias("cuts")
    )

    def preceding(x: Column) -> Column:
        """How many of the ordered cuts ``x`` are before the row; there is none beyond the last: NULL."""
        steps = F.array(*[F.lit(STRIDE >> i) for i in range(STRIDE.bit_length())])
        passed = lambda n, step: F.coalesce(before(F.get(x, n + step - 1), F.col("_key")), F.lit(False))
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(passed(n, step), n + step).otherwise(n))

    coarse = cuts.select(F.filter("cuts", lambda x, i: i % STRIDE == 0).alias("_coarse"))
    placed = with_constant_row(df.withColumn("_key", key), coarse)
    placed = placed.withColumn("_stride", F.greatest(preceding(F.col("_coarse")) - 1, F.lit(0))).drop("_coarse")
    strides = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("cuts") / STRIDE).cast("int") - 1, F.lit(0)))
    fine = cuts.select("cuts", F.explode(strides).alias("_stride")).select("_stride", F.slice("cuts", F.col("_stride") * STRIDE + 1, F.lit(STRIDE)).alias("_fine"))
    placed = placed.join(F.broadcast(fine), "_stride")
    part = F.col("_stride") * STRIDE + preceding(F.col("_fine"))
    return placed.select(*df.columns, part.cast("long").alias("_part"))


def _shifts(local: DataFrame, columns: list[str], value: str, p: list[str], terms: dict[str, Column], add) -> DataFrame:
    """What the ranges before a range hold, one row per range: sizes, sums and where a run of equal values starts."""
    slot = [*p, "_part"]
    edges = local.groupBy(*slot).agg(
        F.count(F.lit(1)).alias("_n"),
        *[add(x).alias(f"_sum_{t}") for t, x in terms.items()],
        # whole rows at the edges: no column is pruned, so the ranges are sorted once for rows and edges
        F.min_by(F.struct(*columns), "_row").alias("_lowest"),
        F.max_by(value, "_row").alias("_last"),
        F.max("_rank").alias("_last_rank"),
    ).withColumn("_first", F.col("_lowest").getField(value))
    earlier = W.partitionBy(*p).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*p)
    edges = edges.withColumns({
        "_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
        "rows": F.sum("_n").over(whole),
        **{f"_before_{t}": add(f"_sum_{t}").over(earlier) for t in terms},
        **{f"_total_{t}": add(f"_sum_{t}").over(whole) for t in terms},
    })
    # a run of equal values that crosses ranges starts in the first range ending with it
    edges = edges.withColumn("_run_start", F.min(F.col("_before") + F.col("_last_rank")).over(W.partitionBy(*p, "_last")))
    previous = F.lag(F.struct(F.col("_last").alias("v"), F.col("_run_start").alias("r"))).over(W.partitionBy(*p).orderBy("_part"))
    edges = edges.withColumn("_carried", previous)
    run = F.when(F.col("_carried").isNotNull() & F.col("_carried.v").eqNullSafe(F.col("_first")), F.col("_carried.r"))
    return edges.select(*slot, "_before", "rows", "_first", run.alias("_run"), *[f"_{k}_{t}" for k in ("before", "total") for t in terms])


def rank_quartile(
    df: DataFrame, value: str, tie: Sequence[str], asc: bool = True, n: int = 4, p: Sequence[str] = (), **kw
) -> DataFrame:
    """Rank and n-tile of every row."""
    stats = with_order_stats(df, value, tie, asc, p, **kw)
    return stats.withColumn("quartile", ntile_of(F.col("row_no"), F.col("rows"), n)).drop(
        "row_no", "running", "total", "rows"
    )


def pareto(df: DataFrame, value: str, tie: Sequence[str], p: Sequence[str] = (), **kw) -> DataFrame:
    """Rank, share of total and cumulative share in descending order of value."""
    stats = with_order_stats(df, value, tie, False, p, **kw)
    return (
        stats.withColumn("share_pct", safe_div(as_col(value).cast("double") * 100, "total"))
        .withColumn("cumulative_pct", safe_div(F.col("running").cast("double") * 100, "total"))
        .drop("row_no", "running", "total", "rows")
    )
