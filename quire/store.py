"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a single file that a task has at most, about.
TASK_BYTES = 16 * 2**20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a temporary folder if all runs on this machine, as in tests, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/quire-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write df as Parquet, with these options, and read it again: nothing before it runs twice, and a lost executor costs only what it was doing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, read from files; if that is a single one, which may be one piece to read, over as many tasks as run at once, and more where they would have over TASK_BYTES of the file each."""
    files, spark = df.inputFiles(), df.sparkSession
    if len(files) != 1:
        return df
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(files[0]))
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def release() -> None:
    """Delete all that cut() wrote; results that were not read by then are gone."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


atexit.register(release)
