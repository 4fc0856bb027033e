"""Writers: Parquet tables, updates in place, CSV extracts and report downloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lets a bucketed table join on more columns than it is bucketed by without another shuffle.
BUCKET_CONF = "spark.sql.requireAllClusterKeysForCoPartition"


def with_audit(df: DataFrame) -> DataFrame:
    """Stamp rows with creation (kept when present) and update time."""
    now = F.current_timestamp()
    created = F.coalesce(F.col("created_at"), now) if "created_at" in df.columns else now
    return df.withColumn("created_at", created).withColumn("updated_at", now)


def write_table(df: DataFrame, path: str, files_per_year: int | None = None) -> None:
    """Full refresh. Facts are partitioned by year and sorted by facility inside files.

    Rows are spread by (year, facility), so one year or one site never lands in a single task's file.
    """
    if "date" not in df.columns:
        df.write.mode("overwrite").parquet(path)
        return
    dated = df.withColumn("year", F.year("date"))
    keys = ["year", "facility_id"] if "facility_id" in df.columns else ["year"]
    spread = dated.repartition(files_per_year, *keys) if files_per_year else dated.repartition(*keys)
    spread.sortWithinPartitions(*keys, "date").write.mode("overwrite").partitionBy("year").parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    """Add stamped rows to a table."""
    stamped = with_audit(df)
    writer = stamped.withColumn("year", F.year("date")).write.partitionBy("year") if "date" in df.columns else stamped.write
    writer.mode("append").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upsert_table(df: DataFrame, path: str, key: Sequence[str], staging: str | None = None) -> None:
    """Replace the stored rows that have the keys of ``df``, add the others, and leave all other months alone.

    The table is partitioned by ``month`` (yyyymm, from ``date``). Replaced rows
    keep ``created_at``; every row of ``df`` gets a new ``updated_at``. The
    touched months are first written whole to ``staging`` (by default beside the
    table) and then moved over theirs, so a run that breaks off leaves the table
    as it was or done, and may be repeated. ``date`` may not be NULL nor part of
    no key; a key repeated in ``df`` is an error.
    """
    spark, key = df.sparkSession, list(key)
    if "date" not in key:
        raise ValueError("the key must contain date, as rows are replaced within their month")
    if not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"rows share a key of {key}")
    dated = df.withColumn("month", F.year("date") * 100 + F.month("date"))
    # as many as the calendar has months
    touched = [r["month"] for r in dated.select("month").distinct().collect()]
    if None in touched:
        raise ValueError("a row has no date")
    if not touched:
        return
    old = _stored(spark, path)
    if old is None:
        merged = with_audit(dated)
    else:
        old = old.where(F.col("month").isin(touched))
        stamps = old.select(*key, "created_at")
        fresh = with_audit(dated.drop("created_at").join(stamps, key, "left"))
        merged = old.join(dated.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
    staging = staging or f"{path.rstrip('/')}-staging"
    merged.repartition("month", "facility_id" if "facility_id" in df.columns else key[0]).write.mode("overwrite").parquet(staging)
    whole = spark.read.schema(merged.schema).parquet(staging)
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int) -> None:
    """Store a fact as a catalog table in ``buckets`` by facility, sorted by facility and date.

    Two facts of equal bucket counts then join on (facility_id, date) without an
    exchange, if the session sets :data:`BUCKET_CONF` to false.
    """
    df.repartition(buckets, "facility_id").write.mode("overwrite").bucketBy(buckets, "facility_id").sortBy("facility_id", "date").saveAsTable(table)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with header; decimals and dates print as plain text."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_extract(df: DataFrame, path: str, by_year: bool = False) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy("year") if by_year else writer).csv(path)


def export_all(extracts: Mapping[str, DataFrame], out: str) -> None:
    """Write every extract below ``out``; the full fact is partitioned by year."""
    for name, df in extracts.items():
        write_extract(df, f"{out}/{name}", by_year=name == "emissions_data")
