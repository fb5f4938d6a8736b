"""Tables kept between steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

WRITTEN: dict[int, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only where it names none and all runs in one process, as in
    tests, a folder of this machine serves; on a cluster a missing setting is an error, as others would not see the files."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if id(spark.sparkContext) not in WRITTEN:
        WRITTEN[id(spark.sparkContext)] = []
        atexit.register(delete_written, spark)
    WRITTEN[id(spark.sparkContext)].append(path)
    return path


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lost executors recompute nothing that lies before. The files are deleted
    when the driver ends, as results that are read later may need them until then."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_written(spark: SparkSession) -> None:
    """Deletes what cut() wrote in this session; call it where a session outlives its results."""
    paths = WRITTEN.pop(id(spark.sparkContext), [])
    with contextlib.suppress(Exception):  # a session that has ended keeps its files
        conf = spark._jsc.hadoopConfiguration()
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
