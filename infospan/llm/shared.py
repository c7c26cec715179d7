"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that count as space in every word rule here: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"
BROADCAST_ROWS = 50_000
NOT_SPACE = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; in local mode a local folder where the session names none, on a cluster an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="infospan-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


#: Scratch paths of this driver that are not yet deleted.
_PATHS: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _PATHS.append(f"{shared_dir(spark)}/infospan-{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def clear(first: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the scratch paths made since there were `first` of them; tables that read them can't be used any more."""
    for path in [p for p in _PATHS[first:] if p not in keep]:
        delete(path)


def delete(path: str) -> None:
    """Deletes one scratch path."""
    _PATHS.remove(path)
    store, inner = open_store(path)
    if store.get_file_info(inner).type.name == "Directory":
        store.delete_dir(inner)


@contextmanager
def cleared(keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Deletes at its end the scratch paths made inside, but for those to keep."""
    first = len(_PATHS)
    try:
        yield
    finally:
        clear(first, keep)


def written(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Writes df to the shared folder, or to `path`, and reads it again: lineage ends here and lost executors cost nothing."""
    path = path or scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's rows; sent to every executor up to BROADCAST_ROWS rows, else joined by a shuffle."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


#: Rows of a key from which on it may be dealt over several partitions.
HOT_ROWS = 1_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: Column, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined to right, which has a row for each key at most; the commonest keys of left are dealt over salts by the hash `by`.

    Commonest: the 4 times shuffle partitions with the most rows, so that any other key has under a quarter of a mean partition.
    counts: the rows of left for each key (keys, rows), where they are known.
    """
    n = shuffle_partitions(left.sparkSession)
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count("*").alias("rows"))
    salts = F.least(F.lit(n), F.ceil(F.col("rows") / HOT_ROWS)).cast("int")
    hot = counts.where(F.col("rows") >= HOT_ROWS).orderBy(F.desc("rows")).limit(4 * n).select(*keys, salts.alias("_salts"))
    hot = F.broadcast(written(hot, "hot-keys"))
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(by, F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    copies = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


#: What a Python worker keeps from task to task: one object, that of the operator that runs there.
_HELD: dict = {}


def release() -> None:
    """Lets go of what the worker holds for another operator."""
    import gc

    import pyarrow as pa

    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def held(key, make):
    """The worker's object for this key; another operator's is let go first, so tables don't add up over a pipeline."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def whole_groups(batches: Iterator, column: str, rows: int = 0) -> Iterator:
    """Tables of `rows` rows or more, the last one less, each with whole runs of equal values in `column`."""
    import numpy as np
    import pyarrow as pa

    parts: list = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        parts.append(batch)
        n += len(batch)
        last = batch.column(column).to_numpy()
        if n < rows or (last[0] == last[-1] and len(parts) > 1 and parts[0].column(column)[0].as_py() == last[-1]):
            continue
        table = pa.Table.from_batches(parts)
        keys = table[column].to_numpy()
        cut = n - int(np.argmax(keys[::-1] != keys[-1])) if (keys != keys[-1]).any() else 0  # the last group may go on in the next batch
        if cut:
            yield table.slice(0, cut)
            parts = table.slice(cut).to_batches()
            n -= cut
    if n:
        yield pa.Table.from_batches(parts)


def open_store(uri: str):
    """The pyarrow file system of a place in the shared folder, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)
