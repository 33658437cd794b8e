"""One Spark session for all tests."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    return float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def _key(row):
    return tuple((v is not None, f"{v:.6f}" if isinstance(v, float) else str(v)) for v in row)


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame with rows of DuckDB, whatever their order."""

    def check(df, relation):
        columns = sorted(df.columns)
        assert columns == sorted(relation.columns)
        got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=_key)
        at = [relation.columns.index(c) for c in columns]
        want = sorted((tuple(_plain(r[i]) for i in at) for r in relation.fetchall()), key=_key)
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            for a, b in zip(g, w, strict=True):
                assert a == b or (isinstance(a, float) and b is not None and abs(a - b) <= 1e-7 * max(1, abs(a))), (g, w)

    return check
