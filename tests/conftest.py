import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(tables):
    import duckdb

    con = duckdb.connect()
    for path in Path(tables).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and value != value:
        return None
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value


@pytest.fixture(scope="session")
def same():
    """Compares a Spark result with a DuckDB one, whatever the order of rows and columns."""

    def check(df, con, sql):
        got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
        rel = con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        at = [rel.columns.index(c) for c in sorted(df.columns)]
        want = [tuple(plain(r[k]) for k in at) for r in rel.fetchall()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))

    return check
