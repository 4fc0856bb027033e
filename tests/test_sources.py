from __future__ import annotations

import csv
import glob
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from scopeledger import session
from scopeledger.model import lookups as L
from scopeledger.operators.joins import literal_dim
from scopeledger.plans import reports as R
from scopeledger.sources import loaders as Ld
from scopeledger.sources import sinks
from scopeledger.sources.binding import Bound


@pytest.fixture(scope="module")
def bound(spark):
    return Bound(spark, SF_DIR)


@pytest.fixture(scope="module")
def stored(bound, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    for name, df in bound.tables().items():
        sinks.write_table(df, f"{root}/{name}")
    return root


def test_stored_tables_load_like_bound_ones(spark, bound, stored):
    got = Ld.load_combined(spark, stored)
    want = Ld.load_combined(spark, bound.tables())
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_filters_reach_the_scan(spark, stored):
    df = Ld.load_emissions(spark, stored, [1, 2], "1998-01-01", "1998-12-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date" in plan
    assert "In(facility_id, [1,2])" in plan
    assert Ld.load_emissions(spark, stored, []).count() == Ld.load_emissions(spark, stored).count()


def test_year_filter_prunes_partitions(spark, stored):
    report = R.q06_subtotals(Ld.table(spark, stored, "facilities"), Ld.table(spark, stored, "emissions_monthly"), 1998)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_source_resolution(spark, tmp_path):
    assert Ld.resolve_source(spark, str(tmp_path)).first()["dataset_name"] == "Raw"
    (tmp_path / "clean").mkdir()
    got = Ld.resolve_source(spark, str(tmp_path)).first()
    assert got["using_cleaned"] and got["dataset_path"].endswith("/clean")


def test_reference_tables(spark):
    factors = literal_dim(spark, L.FACTOR_ROWS, "factor_name STRING, scope STRING, emission_factor DOUBLE, unit STRING, source STRING, geography STRING, year INT, last_updated DATE")
    got = Ld.load_emission_factors(spark, {"emission_factors": factors}).collect()
    assert [r["factor_name"] for r in got[:2]] == ["Natural Gas", "APAC Grid"] and len(got) == 6


def test_categories_ordered_by_share(spark, bound):
    got = [r["category_id"] for r in Ld.load_scope3_categories(spark, bound.tables()).collect()]
    assert got == [2, 1, 3, 11, 4, 6, 7, 15]


def test_exports(spark, bound, tmp_path):
    extracts = R.all_extracts(bound.facilities(), bound.emissions(), bound.business(), bound.targets(), bound.categories())
    sinks.export_all(extracts, str(tmp_path))
    assert len(glob.glob(f"{tmp_path}/*")) == 7
    assert len(glob.glob(f"{tmp_path}/emissions_data/year=*")) == 7
    lines = list(csv.DictReader(open(sorted(glob.glob(f"{tmp_path}/scope3_categories/*.csv"))[0])))
    assert set(lines[0]) == {"category_id", "category_name", "description", "typical_pct_of_scope3"}


def test_audit_columns_and_append(spark, tmp_path):
    df = spark.createDataFrame([("a", date(2020, 1, 1), 1.0)], "facility_id STRING, date DATE, v DOUBLE")
    path = str(tmp_path / "t")
    sinks.append_table(df, path)
    sinks.append_table(df, path)
    got = spark.read.parquet(path)
    assert got.count() == 2 and {"created_at", "updated_at", "year"} <= set(got.columns)
    again = sinks.with_audit(got.limit(1).withColumn("created_at", F.lit("2000-01-01").cast("timestamp")))
    assert again.first()["created_at"].year == 2000


def test_report_download(spark, tmp_path):
    sinks.write_report(spark.range(3), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 3


def test_checkpoint_folder_named_by_cluster_is_required(spark, monkeypatch):
    class Context:
        master = "spark://head:7077"

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session)
    Session.conf["spark.checkpoint.dir"] = "/shared/points"
    session.ensure_checkpoint_dir(Session)
    assert Session.sparkContext.folder == "/shared/points"


def test_upsert_replaces_only_touched_months(spark, tmp_path):
    path = str(tmp_path / "fact")
    schema = "facility_id STRING, date DATE, v DOUBLE"

    def rows(*some):
        return spark.createDataFrame([(f, date(2020, m, 1), v) for f, m, v in some], schema)

    def stored():
        return {(r["facility_id"], r["date"].month): r for r in spark.read.parquet(path).collect()}

    key = ["facility_id", "date"]
    sinks.upsert_table(rows(("a", 1, 1.0), ("b", 1, 2.0), ("a", 2, 3.0)), path, key)
    first, files = stored(), {p.name for p in (tmp_path / "fact" / "month=202001").glob("*.parquet")}
    sinks.upsert_table(rows(("a", 2, 30.0), ("c", 2, 4.0), ("a", 3, 5.0)), path, key)
    second = stored()
    assert {k: r["v"] for k, r in second.items()} == {("a", 1): 1.0, ("b", 1): 2.0, ("a", 2): 30.0, ("c", 2): 4.0, ("a", 3): 5.0}
    assert {p.name for p in (tmp_path / "fact" / "month=202001").glob("*.parquet")} == files
    assert second["a", 2]["created_at"] == first["a", 2]["created_at"] and second["a", 2]["updated_at"] > first["a", 2]["updated_at"]
    assert second["a", 1]["updated_at"] == first["a", 1]["updated_at"]
    sinks.upsert_table(rows(("a", 2, 30.0), ("c", 2, 4.0), ("a", 3, 5.0)), path, key)
    assert {k: r["v"] for k, r in stored().items()} == {k: r["v"] for k, r in second.items()}
    sinks.upsert_table(rows(), path, key)
    for wrong in (rows(("a", 1, 1.0), ("a", 1, 2.0)), rows().union(spark.createDataFrame([("a", None, 1.0)], schema))):
        with pytest.raises(ValueError):
            sinks.upsert_table(wrong, path, key)


def test_upsert_that_breaks_off_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "fact")
    df = spark.createDataFrame([("a", date(2020, 1, 1), 1.0)], "facility_id STRING, date DATE, v DOUBLE")
    sinks.upsert_table(df, path, ["facility_id", "date"])
    broken = df.withColumn("v", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sinks.upsert_table(broken, path, ["facility_id", "date"])
    assert spark.read.parquet(path).first()["v"] == 1.0
    sinks.upsert_table(df.withColumn("v", F.lit(2.0)), path, ["facility_id", "date"])
    assert [r["v"] for r in spark.read.parquet(path).collect()] == [2.0]


def test_bucketed_facts_join_without_an_exchange(spark, bound, tmp_path):
    spark.sql(f"create database facts location '{tmp_path / 'facts.db'}'")
    before = spark.conf.get(sinks.BUCKET_CONF)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for name, df in (("emissions", bound.emissions()), ("operations", bound.operations())):
            sinks.write_bucketed(df, f"facts.{name}", 4)
        spark.conf.set(sinks.BUCKET_CONF, "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        left, right = spark.table("facts.emissions"), spark.table("facts.operations")
        for how in ("inner", "left"):
            joined = left.join(right, ["facility_id", "date"], how)
            assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
            assert joined.count() == bound.emissions().count()
    finally:
        spark.conf.set(sinks.BUCKET_CONF, before)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("drop database facts cascade")
