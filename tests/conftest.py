from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Whether a query gives the rows of its SQL."""

    def rows(columns, values):
        return sorted(repr(tuple(v[c] for c in columns)) for v in values)

    def check(query, sql) -> None:
        df = query(spark, SF)
        got = [r.asDict() for r in df.collect()]
        found = duck.sql(sql)
        assert sorted(df.columns) == sorted(found.columns)
        want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
        assert rows(sorted(df.columns), got) == rows(sorted(df.columns), want)

    return check
