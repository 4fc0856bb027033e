from __future__ import annotations

import os
import sys
from datetime import date

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scopeledger.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def month(i: int, start_year: int = 2020) -> date:
    return date(start_year + i // 12, i % 12 + 1, 1)


EMISSION_FIELDS = (
    "facility_id STRING, date DATE, scope1_tonnes DOUBLE, scope2_location_tonnes DOUBLE, "
    "scope2_market_tonnes DOUBLE, scope3_tonnes DOUBLE, electricity_mwh DOUBLE, renewable_pct DOUBLE"
)


@pytest.fixture()
def emissions(spark):
    def build(rows):
        return spark.createDataFrame(rows, EMISSION_FIELDS)

    return build


def by(df, *keys):
    """Collected rows keyed by the given columns."""
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}
