import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = os.environ.get("TARN_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for p in Path(data).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def same(got, wanted):
    """Equal rows in any order, NULL equal to NULL."""
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    assert len(got) == len(wanted)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, wanted))
    for c in columns:
        off = (a[c] != b[c]) & ~(a[c].isna() & b[c].isna())
        assert not off.any(), (c, a[c][off].head(3).tolist(), b[c][off].head(3).tolist())


@pytest.fixture(scope="session")
def compare():
    return same
