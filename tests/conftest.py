import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "6")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


@pytest.fixture(scope="session")
def same(spark, sf_dir, duck):
    """Runs a query and its SQL and compares all rows, in any order."""

    def rows(df):
        df = df[sorted(df.columns)]
        return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))

    def check(query, sql):
        ours, theirs = query(spark, sf_dir).toPandas(), duck.execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        for c in theirs.columns:  # whole numbers with nulls: pandas has two forms of them
            if str(theirs[c].dtype) == "Int64" and str(ours[c].dtype) == "float64":
                ours[c] = ours[c].astype("Int64")
        assert rows(ours) == rows(theirs)

    return check
