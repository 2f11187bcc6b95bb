from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from claimlens.session import build_session, clear_work

    session = build_session(
        "local[8]", "tests", spark_ui_enabled="false", spark_sql_shuffle_partitions="4",
        spark_driver_memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_work(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF_DIR


@pytest.fixture
def one(spark):
    """Evaluate a column on one row of named values."""
    from pyspark.sql import functions as F

    def run(column, **values):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
        return row.select(column.alias("r")).first()["r"]

    return run
