"""What every operator needs from the session: shipped code, a shared scratch folder, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session's executors, wherever they are.

    Arrow batches are bounded to 8 MB unless the session says otherwise: texts are long, and a batch is held by the JVM and by the worker at once.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if not sc.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, "8m")
    folder = tempfile.mkdtemp(prefix="ringwork-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "ringwork.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, str(p.relative_to(ROOT.parent)))
    sc.addPyFile(target)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one for a local master, which has one machine; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ringwork-shared-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/ringwork-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove the tables that operators have written to the shared folder; results that are not yet computed need them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "ringwork-*")) or ():
        fs.delete(found.getPath(), True)


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns called c0, c1 and so on, and their names; what an operator adds in between can't have the name of a column."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), df.columns


def place(names: list[str], name: str) -> str:
    """The numbered column of a name, which is found as Spark finds it: as it is written, else in any case."""
    if name not in names:
        name = next((x for x in names if x.lower() == name.lower()), name)
    return f"c{names.index(name)}"
