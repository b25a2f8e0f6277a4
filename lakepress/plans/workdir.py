"""Where intermediate tables go: always the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: folders that this process's sessions have spilled to
_SPILLED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only where that setting is absent and everything runs in one process (tests,
    single-machine sessions) is a folder made here, and the session's checkpoint
    directory pointed at it. On a cluster a machine's own folder would lose
    data, so a missing setting raises there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="lakepress-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def spill(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-run of
    everything upstream, and the table can be scanned several times. The folder
    stays until ``release``, as results read from it when they are asked for.
    ``schema`` reads the columns back as types that are stored alike.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _SPILLED.append(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Delete what ``spill`` has written so far; for when the results that read from it are done with."""
    n = len(_SPILLED)
    while _SPILLED:
        delete(spark, _SPILLED.pop())
    return n
