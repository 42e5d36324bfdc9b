import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    """DuckDB with the tables as views."""
    import duckdb

    db = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


@pytest.fixture(scope="session")
def same():
    """Asserts that two pandas frames have the same columns and rows in any order."""

    def check(a, b):
        columns = sorted(a.columns)
        assert columns == sorted(b.columns)

        def rows(frame):
            frame = frame[columns].astype(object)
            return sorted(map(str, frame.where(frame.notna(), None).values.tolist()))

        assert rows(a) == rows(b)

    return check
