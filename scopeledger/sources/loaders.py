"""Loaders over stored tables or DataFrames.

A ``source`` is a folder of Parquet tables or a mapping of table name to
DataFrame. Loaders return the lazy joined relation; ``ordered=True`` sorts it,
which only makes sense at the edge of a report.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeledger.functions.scalars import total_emissions
from scopeledger.model.schemas import OPERATION_COLUMNS
from scopeledger.operators.filters import apply_filters
from scopeledger.operators.joins import enrich

Source = str | Mapping[str, DataFrame]

FACILITY_COLUMNS = ["facility_id", "facility_name", "region", "facility_type"]
EMISSION_COLUMNS = [
    "scope1_tonnes", "scope2_location_tonnes", "scope2_market_tonnes", "scope3_tonnes",
    "total_emissions", "electricity_mwh", "renewable_pct",
]


def table(spark: SparkSession, source: Source, name: str) -> DataFrame:
    return spark.read.parquet(f"{source}/{name}") if isinstance(source, str) else source[name]


def _fact(
    spark: SparkSession, source: Source, name: str,
    facility_ids: Sequence | None, start: str | None, end: str | None,
) -> DataFrame:
    # filters go below the join, so they reach the scan
    return apply_filters(table(spark, source, name), facilities=facility_ids, start=start, end=end)


def _sites(spark: SparkSession, source: Source) -> DataFrame:
    return table(spark, source, "facilities").select(*FACILITY_COLUMNS)


def _edge(df: DataFrame, ordered: bool) -> DataFrame:
    return df.orderBy("date", "facility_id") if ordered else df


def load_emissions(
    spark: SparkSession, source: Source, facility_ids: Sequence | None = None,
    start: str | None = None, end: str | None = None, ordered: bool = False,
) -> DataFrame:
    """Emissions with facility attributes and the market-basis total."""
    fact = _fact(spark, source, "emissions_monthly", facility_ids, start, end)
    fact = fact.withColumn("total_emissions", total_emissions())
    out = enrich(fact, _sites(spark, source), "facility_id").select(*FACILITY_COLUMNS, "date", *EMISSION_COLUMNS)
    return _edge(out, ordered)


def load_operational(
    spark: SparkSession, source: Source, facility_ids: Sequence | None = None,
    start: str | None = None, end: str | None = None, ordered: bool = False,
) -> DataFrame:
    """Energy, water, waste and cost metrics with facility attributes."""
    fact = _fact(spark, source, "facility_operational_metrics", facility_ids, start, end)
    out = enrich(fact, _sites(spark, source), "facility_id").select(*FACILITY_COLUMNS, "date", *OPERATION_COLUMNS)
    return _edge(out, ordered)


def load_combined(
    spark: SparkSession, source: Source, facility_ids: Sequence | None = None,
    start: str | None = None, end: str | None = None, ordered: bool = False,
) -> DataFrame:
    """Emissions with their operational metrics; months without metrics keep NULLs.

    The facts meet first: they share their key and its partitioning.
    """
    emissions = _fact(spark, source, "emissions_monthly", facility_ids, start, end)
    emissions = emissions.withColumn("total_emissions", total_emissions())
    metrics = _fact(spark, source, "facility_operational_metrics", facility_ids, start, end)
    metrics = metrics.select("facility_id", "date", *OPERATION_COLUMNS)
    both = enrich(emissions, metrics, ["facility_id", "date"], "left")
    out = enrich(both, _sites(spark, source), "facility_id")
    return _edge(out.select(*FACILITY_COLUMNS, "date", *EMISSION_COLUMNS, *OPERATION_COLUMNS), ordered)


def load_facilities(spark: SparkSession, source: Source) -> DataFrame:
    sites = table(spark, source, "facilities")
    extra = [c for c in ["operational_start_date"] if c in sites.columns]
    return sites.select(*FACILITY_COLUMNS, *extra).orderBy("facility_name", "facility_id")


def load_emission_factors(spark: SparkSession, source: Source) -> DataFrame:
    factors = table(spark, source, "emission_factors")
    return factors.select(
        "factor_name", "scope", "emission_factor", "unit", "source", "geography", "year"
    ).orderBy("scope", "factor_name")


def load_targets(spark: SparkSession, source: Source) -> DataFrame:
    return table(spark, source, "emission_targets").select(
        "scope", "baseline_year", "baseline_emissions", "target_year",
        "reduction_percent", "target_emissions", "sbti_aligned",
    ).orderBy("scope")


def load_scope3_categories(spark: SparkSession, source: Source) -> DataFrame:
    return table(spark, source, "scope3_categories").select(
        "category_id", "category_name", "description", "typical_pct_of_scope3"
    ).orderBy(F.col("typical_pct_of_scope3").desc(), "category_id")


def resolve_source(spark: SparkSession, base: str) -> DataFrame:
    """Which dataset is in use: the cleaned one when it exists, else the raw one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/clean")
    cleaned = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    row = (
        cleaned,
        f"{base}/clean" if cleaned else f"{base}/raw",
        "Cleaned" if cleaned else "Raw",
        "Clean" if cleaned else "Raw (contains quality issues)",
    )
    return spark.createDataFrame(
        [row], "using_cleaned BOOLEAN, dataset_path STRING, dataset_name STRING, status STRING"
    )
