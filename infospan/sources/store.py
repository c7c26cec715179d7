"""Places in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in local mode in a local folder where the session names none, on a cluster an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="infospan-"))
        folder = context.getCheckpointDir()
    return f"{folder.rstrip('/')}/infospan-{name}-{uuid.uuid4().hex}"


def shuffle_parts(spark: SparkSession) -> int:
    """The tasks of a shuffle as the session sets them; what a table is dealt into where ranges must be known."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder, or to `path`, and read again: its lineage ends here."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filed(spark: SparkSession, path: str):
    """Hadoop's path and file system: whatever Spark itself reads and writes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to this path was committed."""
    place, system = _filed(spark, f"{path}/_SUCCESS")
    return system.exists(place)


def deleted(spark: SparkSession, path: str) -> None:
    place, system = _filed(spark, path)
    system.delete(place, True)
