"""Scratch tables in the shared folder."""

from pathlib import Path

from ringwork.runtime import clean, shared_dir, written


def test_written_and_cleaned(spark):
    df = written(spark.range(5), "test")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    assert df.count() == 5 and list(folder.glob("ringwork-test-*"))
    clean(spark)
    assert not list(folder.glob("ringwork-*"))
