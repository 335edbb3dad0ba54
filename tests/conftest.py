import os
import sys
from datetime import timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from grids import START  # noqa: E402
from gridloom.schema import GRID  # noqa: E402
from gridloom.session import build_session  # noqa: E402

SF_DIR = os.environ.get("GRIDLOOM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "gridloom-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.maxMetadataStringLength": "2000",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def make_grid(spark):
    """Grid from a function of (day, latitude, longitude); None leaves the value missing."""

    def build(lats, lons, days, value, drop=lambda d, y, x: False):
        rows = [
            (START + timedelta(days=d), float(y), float(x), value(d, y, x))
            for d in range(days)
            for y in lats
            for x in lons
            if not drop(d, y, x)
        ]
        return spark.createDataFrame(rows, GRID)

    return build


def values(df, column="t2m"):
    return {(r["time"], round(r["latitude"], 5), round(r["longitude"], 5)): r[column] for r in df.collect()}


@pytest.fixture(scope="session")
def as_values():
    return values
