from __future__ import annotations

import re

from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import by, month
from scopeledger.operators import aggregates as A
from scopeledger.operators import joins as J
from scopeledger.operators import ranking as Rk
from scopeledger.operators import reshape as Rs
from scopeledger.operators import topk as Tk
from scopeledger.operators import windows as Wn
from scopeledger.operators.calendar import future_months, missing_months, month_spine, resample_monthly
from scopeledger.operators.filters import apply_filters, keep_values, year_range


def series(spark, values, skip=(), key=None):
    rows = [(key, month(i), float(v)) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "k STRING, date DATE, v DOUBLE")


def test_month_spine_covers_seventy_months(spark):
    got = [r["date"] for r in month_spine(spark, "2020-01-01", "2025-10-31").orderBy("date").collect()]
    assert len(got) == 70 and got[0] == date(2020, 1, 1) and got[-1] == date(2025, 10, 1)


def test_resample_fills_gaps(spark):
    rows = [("a", date(2020, 1, 5), 1.0), ("a", date(2020, 1, 20), 3.0), ("a", date(2020, 4, 2), 5.0), ("b", date(2020, 2, 1), 7.0)]
    df = spark.createDataFrame(rows, "k STRING, date DATE, v DOUBLE")
    got = by(resample_monthly(df, "date", {"s": ("sum", "v"), "m": ("mean", "v")}, ["k"]), "k", "date")
    assert len(got) == 5
    assert (got["a", date(2020, 1, 1)]["s"], got["a", date(2020, 1, 1)]["m"]) == (4.0, 2.0)
    assert (got["a", date(2020, 3, 1)]["s"], got["a", date(2020, 3, 1)]["m"]) == (0.0, None)
    assert got["b", date(2020, 2, 1)]["s"] == 7.0


def test_missing_month_found(spark):
    got = missing_months(series(spark, range(69), skip={1}), "date").collect()
    assert [r["date"] for r in got] == [date(2020, 2, 1)]


def test_future_months_are_month_ends(spark):
    got = future_months(series(spark, range(2)), "date", 3).orderBy("step").collect()
    assert [(r["step"], r["date"]) for r in got] == [(0, date(2020, 3, 31)), (1, date(2020, 4, 30)), (2, date(2020, 5, 31))]


def test_rows_and_calendar_lag_differ_on_gaps(spark):
    df = series(spark, range(100, 126), skip={1})
    rows = by(Wn.period_change(df, "v", "date", 12, mode="rows"), "date")
    calendar = by(Wn.period_change(df, "v", "date", 12), "date")
    at = date(2021, 2, 1)
    assert calendar[at]["prior_v"] is None
    assert rows[at]["prior_v"] == 100.0
    assert calendar[date(2021, 3, 1)]["prior_v"] == 102.0
    assert calendar[date(2021, 3, 1)]["pct_change"] == pytest.approx(12 / 102 * 100)


def test_moving_average_partial_and_strict(spark):
    df = series(spark, [1, 2, 6, 9])
    assert [r["v_ma"] for r in Wn.moving_average(df, "v", "date", 2).orderBy("date").collect()] == [1.0, 1.5, 3.0, pytest.approx(17 / 3)]
    strict = Wn.moving_average(df, "v", "date", 2, strict=True).orderBy("date").collect()
    assert [r["v_ma"] for r in strict[:3]] == [None, None, 3.0]


def test_decomposition_adds_up(spark):
    df = series(spark, [100 + i + (10 if i % 12 == 6 else 0) for i in range(48)])
    for r in Wn.decompose(df, "v", "date").collect():
        assert r["trend"] + r["seasonal"] + r["residual"] == pytest.approx(r["v"])


def test_direction_starts_stable(spark):
    got = Wn.direction(series(spark, [1, 2, 2, 1]), "v", "date").orderBy("date").collect()
    assert [r["direction"] for r in got] == ["Stable", "Increasing", "Stable", "Decreasing"]


@pytest.mark.parametrize("n,prior", [(12, None), (13, 0.0), (24, 11.0)])
def test_thirteenth_from_last(spark, n, prior):
    got = Wn.year_ago_of_last(series(spark, range(n)), "v", "date").first()
    assert got["prior_v"] == prior


def test_head_tail_needs_enough_periods(spark):
    assert A.head_tail(series(spark, range(11)), {"v": "sum"}, "date").count() == 0
    got = A.head_tail(series(spark, range(24)), {"v": "mean"}, "date").first()
    assert (got["first_v"], got["last_v"]) == (5.5, 17.5)


def test_rollup_labels_by_grouping_not_by_null(spark):
    rows = [("EU", "Office", 1.0), ("EU", "Data Center", 2.0), (None, "Office", 4.0)]
    df = spark.createDataFrame(rows, "region STRING, facility_type STRING, v DOUBLE")
    report = A.rollup_report(df, ["region", "facility_type"], [F.sum("v").alias("v")])
    got = {(r["region"], r["facility_type"], r["level"]): r["v"] for r in report.collect()}
    assert got["TOTAL", "All Types", 2] == 7.0
    assert got[None, "All Types", 1] == 4.0 and got[None, "Office", 0] == 4.0
    order = [(r["region"], r["facility_type"]) for r in A.totals_last(report, ["region", "facility_type"]).collect()]
    assert order[-1] == ("TOTAL", "All Types")
    assert order.index(("EU", "All Types")) > order.index(("EU", "Office"))


def test_extremes_break_ties_by_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 3.0), ("d", None)], "name STRING, v DOUBLE")
    assert A.arg_extreme(df, "v", ["name"], "min").first()["name"] == "a"
    assert A.arg_extreme(df, "v", ["name"], "max").first()["name"] == "c"


def test_linear_trend_on_index(spark):
    got = A.linear_trend(series(spark, [3, 5, 7, 9]), "v", order="date").first()
    assert got["slope"] == pytest.approx(2.0) and got["intercept"] == pytest.approx(3.0)


def test_shares_sum_to_hundred_and_keep_null_groups(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), (None, 5.0)], "g STRING, v DOUBLE")
    got = Wn.share_of_total(df, "v", ["g"]).collect()
    assert sorted(r["share_pct"] for r in got) == [25.0, 75.0, 100.0]
    assert sum(r["share_pct"] for r in Wn.share_of_total(df, "v").collect()) == pytest.approx(100)


def test_group_size_attached(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,)], "g STRING")
    assert sorted(r["group_size"] for r in A.with_group_size(df, ["g"]).collect()) == [1, 2, 2]


def brute_order(values):
    """row_no, rank, running total by (value, id) ascending with NULL last."""
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, values[i] or 0, i))
    out, run, rank = {}, 0, 0
    for pos, i in enumerate(order, 1):
        if pos == 1 or values[i] != values[order[pos - 2]]:
            rank = pos
        run += values[i] or 0
        out[i] = (pos, rank, run)
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 6)), min_size=30, max_size=120))
def test_ranged_order_equals_brute_force(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id INT, v LONG")
    got = Rk.with_order_stats(df, "v", ["id"], single_task_rows=9)
    want = brute_order(values)
    for r in got.collect():
        assert (r["row_no"], r["rank"], r["running"] or 0) == want[r["id"]], r
        assert r["rows"] == len(values)


def test_both_paths_agree_with_hot_value_and_groups(spark):
    rows = [(i, "hot" if i % 3 else None, 7 if i % 3 else i % 50) for i in range(600)]
    df = spark.createDataFrame(rows, "id INT, g STRING, v LONG")
    cols = ["id", "row_no", "rank", "running", "total", "rows"]
    one = Rk.with_order_stats(df, "v", ["id"], False, ["g"]).select(cols)
    many = Rk.with_order_stats(df, "v", ["id"], False, ["g"], single_task_rows=40).select(cols)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


@pytest.mark.parametrize("kind", ["double", "decimal(24,4)", "decimal(38,4)", "long"])
def test_both_paths_agree_in_values_and_types(spark, kind):
    rows = [(i, "a" if i % 3 else None, i * 0.1 + (i % 7) / 3 if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id INT, g STRING, d DOUBLE").select("id", "g", F.col("d").cast(kind).alias("v"))
    for p in ([], ["g"]):
        one = Rk.with_order_stats(df, "v", ["id"], True, p)
        many = Rk.with_order_stats(df, "v", ["id"], True, p, single_task_rows=30)
        assert one.schema == many.schema
        assert sorted(one.collect(), key=lambda r: r["id"]) == sorted(many.collect(), key=lambda r: r["id"])


@pytest.mark.parametrize("rows,tiles", [(10, 4), (3, 4), (8, 4), (1, 7), (100, 7)])
def test_ntile_formula(spark, rows, tiles):
    from pyspark.sql import Window as W

    df = spark.range(rows).withColumn("n", F.row_number().over(W.orderBy("id"))).withColumn("rows", F.lit(rows).cast("long"))
    got = df.select(Rk.ntile_of(F.col("n"), F.col("rows"), tiles).alias("t"), F.ntile(tiles).over(W.orderBy("id")).alias("w"))
    assert all(r["t"] == r["w"] for r in got.collect())


def test_pareto_ties_and_cumulative(spark):
    df = spark.createDataFrame([(1, 30.0), (2, 40.0), (7, 1.0), (15, 1.0)], "id INT, v DOUBLE")
    got = Rk.pareto(df, "v", ["id"]).orderBy("rank", "id").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 3]
    cumulative = [r["cumulative_pct"] for r in got]
    assert cumulative == sorted(cumulative) and cumulative[-1] == pytest.approx(100)


def test_top_k_by_group(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0), ("b", 4, 2.0)], "g STRING, id INT, v DOUBLE")
    assert sorted(r["id"] for r in Tk.top_k(df, "v", ["id"], 1, ["g"]).collect()) == [1, 4]
    assert Tk.top_share(df, "v", ["id"], 2).first()["top_share_pct"] == pytest.approx(1000 / 13)


def test_filters(spark, emissions):
    rows = [(f"f{i}", month(i), 1.0, 2.0, 1.0, 1.0, 1.0, 50.0) for i in range(30)]
    df = emissions(rows).withColumn("region", F.lit("EU"))
    assert apply_filters(df, facilities=[]).count() == 30
    assert apply_filters(df, start="2020-03-01", end="2020-05-01").count() == 3
    assert apply_filters(df, years=[2020, 2022]).count() == 18
    assert year_range(df, 2021, 2021).count() == 12
    long_list = [f"f{i}" for i in range(0, 1000, 2)]
    assert keep_values(df, "facility_id", long_list).count() == 15


def test_orphans_and_checked_join(spark):
    fact = spark.createDataFrame([("a", 1), ("a", 2), ("z", 3)], "k STRING, n INT")
    dim = spark.createDataFrame([("a", "x")], "k STRING, label STRING")
    assert [(r["k"], r["rows"]) for r in J.orphans(fact, dim, "k").collect()] == [("z", 1)]
    for limit in (0, 10):
        got = J.checked_join(fact, dim, ["k"], max_rows=limit).orderBy("n").collect()
        assert [r["label"] for r in got] == ["x", "x", None]


def test_lookup_default_and_empty_cross(spark):
    df = spark.createDataFrame([("EU",), ("Mars",)], "region STRING")
    dim = spark.createDataFrame([("EU", 120.0)], "region STRING, price DOUBLE")
    assert {r["region"]: r["price"] for r in J.lookup(df, dim, "region", "price", 70.0).collect()} == {"EU": 120.0, "Mars": 70.0}
    assert J.with_constant_row(df, dim.filter("price < 0").select("price")).count() == 0


def test_number_grid_is_evenly_spaced(spark):
    got = [r["p"] for r in J.number_grid(spark, "p", 40.0, 120.0, 20).orderBy("p").collect()]
    assert len(got) == 20 and got[0] == 40 and got[-1] == pytest.approx(120)


def test_matrix_and_unpivot(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "r STRING, c STRING, v DOUBLE")
    assert tuple(Rs.matrix(df, "r", "c", "v", ["x", "y"]).first()) == ("a", 1.0, 2.0)
    wide = spark.createDataFrame([(1, 2.0, 3)], "id INT, p DOUBLE, q INT")
    got = Rs.unpivot_report(wide, ["id"], {"p": "P", "q": "Q"}, "name", "value").collect()
    assert sorted((r["name"], r["value"]) for r in got) == [("P", 2.0), ("Q", 3.0)]


def test_long_list_keeps_columns_and_rows(spark):
    from scopeledger.operators.filters import keep_values

    df = spark.createDataFrame([("EU", 1), ("US", 250), ("US", None), ("EU", 900)], "region string, facility_id long")
    short, long_ = keep_values(df, "facility_id", [1, 250]), keep_values(df, "facility_id", [1, 250, *range(1000, 1300)])
    assert short.schema == long_.schema and sorted(short.collect()) == sorted(long_.collect())


def test_distinct_sketches_merge_within_their_bound(spark):
    from scopeledger.functions.aggregates import SKETCH_ERROR
    from scopeledger.operators.aggregates import sketched_by_level

    rows = spark.range(60_000).selectExpr("id % 20000 as site", "id % 3 as year", "id % 7 as month").unionByName(
        spark.createDataFrame([(None, 0, 0)], "site long, year long, month long"))
    got = {(r["level"], r["year"], r["month"]): r for r in sketched_by_level(rows, "site", ["year", "month"]).collect()}
    assert len(got) == 1 + 3 + 21 and got[2, None, None]["row_count"] == 60_001
    for level, where in (((2, None, None), "true"), ((1, 1, None), "year = 1"), ((0, 2, 5), "year = 2 and month = 5")):
        exact = rows.where(where).select("site").where("site is not null").distinct().count()
        assert abs(got[level]["estimate"] - exact) <= exact * SKETCH_ERROR + 1


@pytest.mark.parametrize("asc", [True, False])
def test_ranges_follow_ties_nulls_and_groups(spark, asc):
    """Every cut of the order, also inside a hot value, numbers rows as one window does."""
    rows = [(i, "hot" if i % 3 else None, f"t{i * 7919 % 1000:03}", None if i % 13 == 0 else 7.5 if i % 2 else float(i % 40)) for i in range(900)]
    df = spark.createDataFrame(rows, "id INT, g STRING, t STRING, v DOUBLE")
    order = lambda r: (r[3] is None, (r[3] or 0.0) * (1 if asc else -1), r[2], r[0])
    for p in ([], ["g"]):
        groups = {}
        for r in sorted(rows, key=order):
            groups.setdefault(r[1] if p else 0, []).append(r)
        want = {r[0]: (n, 1 + next(i for i, o in enumerate(g) if o[3] == r[3]), len(g)) for g in groups.values() for n, r in enumerate(g, 1)}
        got = Rk.with_order_stats(df, "v", ["t", "id"], asc, p, single_task_rows=25).collect()
        assert {r["id"]: (r["row_no"], r["rank"], r["rows"]) for r in got} == want


def test_amounts_that_decimals_cannot_hold(spark):
    """Beyond 1e19, infinite or not a number: sums of doubles, in one range and in many."""
    values = [1.5, None, 2.25, 3e19, 4e25, float("inf"), float("nan"), 0.5]
    df = spark.createDataFrame(list(enumerate(values)), "id INT, v DOUBLE")
    for size in (2, 100):
        got = {r["id"]: r for r in Rk.with_order_stats(df, "id", [], amount="v", single_task_rows=size).collect()}
        assert [got[i]["running"] for i in range(6)] == [1.5, 1.5, 3.75, 3.75 + 3e19, 3.75 + 3e19 + 4e25, float("inf")]
        assert got[7]["running"] != got[7]["running"] and got[0]["total"] != got[0]["total"]
        top = Rk.with_order_stats(df, "v", ["id"], asc=False, single_task_rows=size).orderBy("row_no").collect()
        assert [r["id"] for r in top] == [6, 5, 4, 3, 2, 0, 7, 1]
    assert Rk.with_order_stats(df.limit(0), "v", ["id"]).collect() == []


@pytest.mark.parametrize("kind", ["double", "decimal(24,4)", "long", "string", "date"])
def test_a_thousand_ranges_are_searched_in_small_steps(spark, kind):
    """No row carries all cuts while its range is searched, and every range is found, falling and rising."""
    v = F.when(F.col("id") % 17 != 0, (F.col("id") * 7919) % 1013 - 500)
    v = F.date_add(F.lit("2020-01-01").cast("date"), v.cast("int")) if kind == "date" else v.cast(kind)
    df = spark.range(3000).select("id", v.alias("v"), F.lit(1).alias("one"))
    assert Rk.MOST_RANGES == 1024
    for asc in (True, False):
        one = Rk.with_order_stats(df, "v", ["id"], asc, amount="one")
        many = Rk.with_order_stats(df, "v", ["id"], asc, amount="one", single_task_rows=2)
        assert sorted(one.collect()) == sorted(many.collect())
    placed = Rk._ranges(df, "v", ["id"], False, [], 2)
    assert placed.select("_part").distinct().count() > 900
    # each side that is sent to the rows holds a stride of cuts: the splitters appear in slices only
    sent = [n for n in placed._jdf.queryExecution().optimizedPlan().toString().split("\n") if re.search(r"AS (_cuts|_coarse|_fine)#", n)]
    assert sent and all(re.search(r"(filter|slice)\(", n) for n in sent)


def test_sizes_of_thousands_of_digits_count_as_large(spark):
    from scopeledger.session import settle

    df = spark.createDataFrame([(1, 2.0)], "id INT, v DOUBLE")
    for _ in range(12):  # each round squares the estimate that a checkpoint keeps
        df = settle(df.join(df.select("id"), "id"))
    got = Rk.with_order_stats(df, "v", ["id"]).first()
    assert (got["row_no"], got["rank"], got["running"]) == (1, 1, 2.0)
