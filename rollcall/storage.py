"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each application, by its id.
FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, which is deleted when the application ends.

    Where that setting is missing, a local session gets a temporary folder; on a cluster, whose executors couldn't see it, this is an error.
    """
    sc = spark.sparkContext
    if sc.applicationId not in FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{(base or 'file://' + tempfile.mkdtemp(prefix='rollcall-')).rstrip('/')}/rollcall-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        FOLDERS[sc.applicationId] = folder
    return FOLDERS[sc.applicationId]


def settle(df: DataFrame) -> DataFrame:
    """Write a table that several steps read to the shared folder, and read it back: it is computed once, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows that are small but dear to compare over as many tasks as shuffles have; Spark would join them in few, as it goes by bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
