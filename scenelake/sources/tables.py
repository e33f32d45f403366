"""Tables written between steps, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process and not yet removed, in order.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only on local[*]."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = f"file://{tempfile.gettempdir()}/checkpoints"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the application ends, unless ``release`` was earlier."""
    where, fs = _at(spark, path)
    fs.deleteOnExit(where)
    _made.append(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there,
    and a lost executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    gone_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def mark() -> int:
    return len(_made)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Remove the folders written since a ``mark`` but those of ``keep``, when
    nothing will read them again."""
    kept = {df._folder for df in keep}
    for path in [p for p in _made[since:] if p not in kept]:
        where, fs = _at(spark, path)
        fs.delete(where, True)
        _made.remove(path)
