"""The folder that driver and executors share, and what stands in it for a while."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: All that a session writes for itself stands under one folder, which clean() deletes.
_RUN = f"vigil-run-{uuid.uuid4().hex}"


#: By application: the folder that stands for the shared one in local mode, where none is set.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Unset, a temporary folder, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="vigil-")
        found = _OWN[app]
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes what stands at path, in any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{_RUN}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: worked out once, however often it is read; outlives any executor."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes all that this session wrote for itself; results not yet read are lost with it."""
    delete(spark, run_dir(spark))
