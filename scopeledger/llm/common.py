"""Helpers of the corpus operators: words, row numbers, staged tables and guarded joins."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeledger.session import ensure_checkpoint_dir

#: White space of the corpus: blank and the control characters 9 to 13.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Setting of the least number of splits of a scan; without it splits depend on the executors alive.
MIN_SPLITS = "spark.sql.files.minPartitionNum"
#: Rows a side may have to be broadcast; they are counted first.
BROADCAST_ROWS = 100_000


def ship(module: str) -> None:
    """Send a module's functions to Python workers by value, so executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK_RUN), "")


def without_blanks(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def pin_splits(spark: SparkSession) -> None:
    """Fix for the session how files are split, as the default would follow the executors that are alive."""
    if spark.conf.get(MIN_SPLITS, None) is None:
        alive = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
        spark.conf.set(MIN_SPLITS, str(alive))


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Row numbers that are the same at every read of the same files.

    ``df`` must be a scan of files or rows staged with :func:`stage`, without a
    shuffle in between; other inputs are to be staged first.
    """
    pin_splits(df.sparkSession)
    return df.withColumn(name, F.monotonically_increasing_id())


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: short lineage, known sizes, safe after lost executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def join_small(big: DataFrame, small: DataFrame, on: Sequence[tuple[str, str]], how: str = "left") -> DataFrame:
    """Null-safe join that broadcasts ``small`` if it is counted to be small; else both sides are shuffled."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    condition = None
    for left, right in on:
        equal = big[left].eqNullSafe(small[right])
        condition = equal if condition is None else condition & equal
    joined = big.join(small, condition, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[small[right] for _, right in on])


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names not used by the columns of ``df``."""
    used = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return tuple(found)


def join_rows(df: DataFrame, chosen: DataFrame, row: str | list[str] | Column, how: str = "inner", counted: int | None = None) -> DataFrame:
    """Join of two sides that grow with the rows, as rows with a choice of their numbers: shuffled and merged, at every size alike.

    Spark sizes a side by the bytes of its files and the columns left, so an
    exploded or well compressed one may be many times what it takes it for, and
    would be broadcast. ``counted`` rows of the sides, if few, leave it the choice.
    """
    few = counted is not None and counted <= BROADCAST_ROWS
    return df.join(chosen if few else chosen.hint("merge"), row, how)
