"""Session settings that the operators rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows handed to a Python worker at once; texts are long, so the default of 10,000 holds too much memory.
BATCH_ROWS = 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in the workers and keep their batches small. Safe to call again."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share.

    Only where the setting is absent, as in tests on one machine, a temporary folder is made and set.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    A compressed columnar table is several times smaller than an RDD checkpoint, whose rows are stored unpacked.
    All tables of an application lie in one folder, which `clean` removes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Remove the table of a DataFrame that `cut` returned, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rsplit("/", 1)[0])


def standing(df: DataFrame) -> bool:
    """Are the files that a DataFrame reads still there?"""
    spark = df.sparkSession
    for file in df.inputFiles():
        where = spark._jvm.org.apache.hadoop.fs.Path(file)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return False
    return True


def clean(spark: SparkSession) -> None:
    """Remove all tables that `cut` wrote for this application."""
    _delete(spark, f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}")
