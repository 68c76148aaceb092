import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from almanac.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "almanac-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def daily(spark):
    """Builds a daily panel from {series: [values]} with consecutive dates; None keeps a NULL."""

    def build(series, start=dt.date(2020, 1, 1)):
        rows = [
            (s, start + dt.timedelta(days=i), None if v is None else float(v))
            for s, values in series.items()
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, "series_id string, date date, value double")

    return build


@pytest.fixture
def monthly(spark):
    """Builds a monthly panel from {series: {(year, month): value}} or {series: [values]} from 2000-01."""

    def build(series):
        rows = []
        for s, values in series.items():
            if not isinstance(values, dict):
                values = {(2000 + i // 12, i % 12 + 1): v for i, v in enumerate(values)}
            rows += [(s, y, m, None if v is None else float(v)) for (y, m), v in values.items()]
        return spark.createDataFrame(rows, "series_id string, year int, month int, value double")

    return build
