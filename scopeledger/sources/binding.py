"""The accounting tables expressed over the order tables of the test data.

Line items play the meter readings: one pass rolls them up to facility and
month. Integer sums (cents, percent points) make the result independent of row
order; DECIMAL columns keep later sums exact.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scopeledger.functions.scalars import total_emissions
from scopeledger.model import lookups as L
from scopeledger.model.schemas import CATEGORIES, INITIATIVES, OPERATION_COLUMNS
from scopeledger.operators.joins import literal_dim
from scopeledger.sources.loaders import EMISSION_COLUMNS, FACILITY_COLUMNS

AMOUNT = "decimal(24,4)"
SHARE = "decimal(14,6)"

MILLI = Decimal("0.001")

#: Analysis dates of the bound data.
YEAR = 1998
FROM_YEAR = 1998
BASELINE_YEAR = 1995
TARGET_YEAR = 2001
LAST_FULL_YEAR = 2000
AS_OF = date(2001, 10, 31)

REGION_NAMES = [("AMERICA", "US-East"), ("AFRICA", "US-Central"), ("EUROPE", "EU"), ("ASIA", "APAC")]


def _cell() -> list[Column]:
    """Facility and month of a line item."""
    return [F.col("l_suppkey").alias("facility_id"), F.trunc("l_shipdate", "month").alias("date")]


def _units() -> dict[str, Column]:
    """Measures of a line item as whole numbers: cents, percent points, cents x percent."""
    price = F.rint(F.col("l_extendedprice") * 100).cast("long")
    discount = F.rint(F.col("l_discount") * 100).cast("long")
    tax = F.rint(F.col("l_tax") * 100).cast("long")
    return {
        "qty": F.rint("l_quantity").cast("long"), "price": price, "discount": discount, "tax": tax,
        "net": price * (100 - discount), "gross": price * (100 + tax),
    }


#: Bits of the lower part of amounts that are summed in two parts.
LOW_BITS = 20


def _wide_sum(units: Column) -> Column:
    """Sum of whole numbers as DECIMAL; both parts stay whole-number sums, which cannot overflow at any size of data."""
    high, low = F.sum(F.shiftright(units, LOW_BITS)), F.sum(units.bitwiseAND(F.lit(2**LOW_BITS - 1)))
    return high.cast("decimal(20,0)") * F.lit(Decimal(2**LOW_BITS)) + low.cast("decimal(20,0)")


def _scaled(units: Column, places: int, kind: str = AMOUNT) -> Column:
    """Integer count of 10^-places units as DECIMAL."""
    return (units.cast("decimal(24,0)") * F.lit(Decimal(1).scaleb(-places))).cast(kind)


def _micro_mean(total: Column, n: Column, per_unit: int) -> Column:
    """Integer mean in millionths, truncated."""
    return F.call_function("div", total * per_unit, n)


_SCHEMAS: dict[str, T.StructType] = {}


class Bound:
    """Lazily built canonical tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        """Table by name; its schema is inferred once per path, not by a job per use."""
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    # -- dimensions -------------------------------------------------------

    def facilities(self) -> DataFrame:
        nations = self.read("nation").join(
            F.broadcast(self.read("region")), F.col("n_regionkey") == F.col("r_regionkey")
        )
        region = F.col("r_name")
        named = F.when(region == REGION_NAMES[0][0], REGION_NAMES[0][1])
        for raw, shown in REGION_NAMES[1:]:
            named = named.when(region == raw, shown)
        slot = F.col("s_suppkey") % 20
        kind = F.when(slot < 9, "Data Center").when(slot < 16, "Office").otherwise("Manufacturing")
        # nation and region have a fixed number of rows at every scale
        return (
            self.read("supplier")
            .join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("facility_id"), F.col("s_name").alias("facility_name"),
                named.otherwise(region).alias("region"), kind.alias("facility_type"),
            )
        )

    def categories(self) -> DataFrame:
        return literal_dim(self.spark, L.CATEGORY_ROWS, CATEGORIES)

    def initiatives(self) -> DataFrame:
        return literal_dim(self.spark, L.INITIATIVE_ROWS, INITIATIVES)

    def regional_prices(self) -> DataFrame:
        return literal_dim(self.spark, L.REGION_ROWS, L.REGION_SCHEMA)

    # -- facts ------------------------------------------------------------

    def lines(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """Line items of the months from ``start`` to ``end``, filtered in the scan."""
        lines = self.read("lineitem")
        if start is not None:
            lines = lines.filter(F.col("l_shipdate") >= F.lit(str(start)).cast("timestamp_ntz"))
        if end is not None:
            following = date(end.year + end.month // 12, end.month % 12 + 1, 1)
            lines = lines.filter(F.col("l_shipdate") < F.lit(str(following)).cast("timestamp_ntz"))
        return lines

    def readings(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """Every monthly measure from a single aggregation of the line items."""
        m = _units()
        return (
            self.lines(start, end).groupBy(*_cell())
            .agg(
                F.count(F.lit(1)).alias("n"),
                *[F.sum(m[c]).alias(c) for c in ("qty", "price", "net", "gross", "discount", "tax")],
                F.sum(F.when(F.col("l_returnflag") != "R", m["qty"]).otherwise(0)).alias("kept"),
            )
        )

    def meters(
        self, start: date | None = None, end: date | None = None, facility: bool = False, unit: str | None = "month"
    ) -> DataFrame:
        """Emissions summed no finer than a report needs: by month or year, with or without facility.

        Sums over months, regions or years equal those of the monthly fact; the whole-number
        sums combine map-side, so hardly anything is left to shuffle.
        """
        site, _ = _cell()
        keys = ([site] if facility else []) + ([F.trunc("l_shipdate", unit).alias("date")] if unit else [])
        m = _units()
        sums = self.lines(start, end).groupBy(*keys).agg(
            F.sum(m["qty"]).alias("qty"), *[_wide_sum(m[c]).alias(c) for c in ("price", "net", "gross")]
        )
        return sums.select(
            *[c for c in sums.columns if c in ("facility_id", "date")],
            F.col("qty").cast(AMOUNT).alias("scope1_tonnes"),
            _scaled(F.col("price"), 2).alias("scope2_location_tonnes"),
            _scaled(F.col("net"), 4).alias("scope2_market_tonnes"),
            _scaled(F.col("gross"), 4).alias("scope3_tonnes"),
        )

    def emissions(self, start: date | None = None, end: date | None = None) -> DataFrame:
        return self._emissions(self.readings(start, end))

    def operations(self, start: date | None = None, end: date | None = None) -> DataFrame:
        measured = self._operations(self.readings(start, end))
        return self._with_costs(measured, self.facilities()).select("facility_id", "date", *OPERATION_COLUMNS)

    def business(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """Only months with booked lines, so the left joins meet gaps."""
        booked = self.lines(start, end).filter(F.col("l_linestatus") == "F").groupBy(*_cell())
        rows = F.col("n")
        return booked.agg(F.sum(_units()["price"]).alias("price"), F.count(F.lit(1)).alias("n")).select(
            "facility_id", "date",
            _scaled(F.col("price"), 8, "decimal(28,8)").alias("revenue_millions"),
            rows.alias("headcount"), (rows * 150).alias("square_feet"), (rows * 20).alias("server_count"),
        )

    def combined(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """Emissions and operations of every facility-month from one pass over the readings."""
        wide = self._operations(self._emissions(self.readings(start, end), keep=True))
        wide = self._with_costs(wide.withColumn("total_emissions", total_emissions()), self.facilities())
        return wide.select(*FACILITY_COLUMNS, "date", *EMISSION_COLUMNS, *OPERATION_COLUMNS)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "facilities": self.facilities(),
            "emissions_monthly": self.emissions(),
            "facility_operational_metrics": self.operations(),
            "business_metrics": self.business(),
            "emission_targets": self.targets(),
            "scope3_categories": self.categories(),
        }

    def targets(self) -> DataFrame:
        """Targets cut from the totals of the baseline year."""
        from scopeledger.plans.allocation import make_targets

        base = self.meters(date(BASELINE_YEAR, 1, 1), date(BASELINE_YEAR, 12, 1), unit="year")
        annual = base.groupBy(F.year("date").alias("year")).agg(
            F.sum("scope1_tonnes").cast("double").alias("scope1"),
            F.sum("scope2_market_tonnes").cast("double").alias("scope2_market"),
            F.sum("scope3_tonnes").cast("double").alias("scope3"),
        )
        return make_targets(annual, BASELINE_YEAR, L.TARGET_CUTS, TARGET_YEAR - BASELINE_YEAR)

    # -- column sets ------------------------------------------------------

    @staticmethod
    def _emissions(readings: DataFrame, keep: bool = False) -> DataFrame:
        columns = [
            F.col("qty").cast(AMOUNT).alias("scope1_tonnes"),
            _scaled(F.col("price"), 2).alias("scope2_location_tonnes"),
            _scaled(F.col("net"), 4).alias("scope2_market_tonnes"),
            _scaled(F.col("gross"), 4).alias("scope3_tonnes"),
            (F.col("qty") * 10).cast(AMOUNT).alias("electricity_mwh"),
            _scaled(_micro_mean(F.col("discount"), F.col("n"), 10_000_000), 6, SHARE).alias("renewable_pct"),
        ]
        if keep:
            return readings.select("*", *columns)
        return readings.select("facility_id", "date", *columns)

    @staticmethod
    def _operations(readings: DataFrame) -> DataFrame:
        water = (F.col("qty") * 100).cast(AMOUNT)
        is_site = F.col("facility_id") % 20 < 9
        pue = _scaled(F.lit(1_050_000) + _micro_mean(F.col("discount"), F.col("n"), 10_000), 6, SHARE)
        cfe = _scaled(F.lit(1_000_000) - _micro_mean(F.col("tax"), F.col("n"), 50_000), 6, SHARE)
        # carbon cost needs scope 1 + 2 (market), in ten-thousandths
        priced = (F.col("qty") * 10_000 + F.col("net"))
        return readings.select(
            "*",
            (F.col("qty") * 5).cast(AMOUNT).alias("fuel_consumption_mwh"),
            (F.col("qty") * 9).cast(AMOUNT).alias("renewable_electricity_mwh"),
            cfe.alias("cfe_pct"),
            F.when(is_site, pue).alias("pue"),
            (F.col("qty") * 135).cast(AMOUNT).alias("water_withdrawal_gallons"),
            (F.col("qty") * 35).cast(AMOUNT).alias("water_discharge_gallons"),
            water.alias("water_consumption_gallons"),
            _scaled(_micro_mean(F.col("discount"), F.col("n"), 100_000), 6, SHARE).alias("water_replenishment_pct"),
            F.col("qty").cast(AMOUNT).alias("waste_generated_tons"),
            F.col("kept").cast(AMOUNT).alias("waste_diverted_tons"),
            _scaled(_micro_mean(F.col("kept"), F.col("qty"), 1_000_000), 6, SHARE).alias("waste_diversion_pct"),
            _scaled(priced, 4).alias("_priced_tonnes"),
        )

    def _with_costs(self, measured: DataFrame, facilities: DataFrame) -> DataFrame:
        """Regional price times quantity, in thousands."""
        prices = F.broadcast(self.regional_prices().select("region", "energy_price", "water_price", "carbon_price"))
        sites = facilities.join(prices, "region", "left")

        def price(name: str) -> Column:
            return F.coalesce(F.col(name), F.lit(L.REGION_DEFAULTS[name]).cast("decimal(6,2)"))

        def cost(units: Column, name: str) -> Column:
            return (units.cast("decimal(20,0)") * price(name) * F.lit(MILLI)).cast("decimal(28,6)")

        sites = sites.select(*FACILITY_COLUMNS, *[price(n).alias(n) for n in ("energy_price", "water_price", "carbon_price")])
        joined = measured.join(sites, "facility_id")
        carbon = F.col("_priced_tonnes") * F.col("carbon_price") * F.lit(MILLI)
        return joined.select(
            "*",
            cost(F.col("qty") * 10, "energy_price").alias("energy_cost_usd"),
            cost(F.col("qty") * 100, "water_price").alias("water_cost_usd"),
            carbon.cast("decimal(32,9)").alias("carbon_cost_usd"),
        )

