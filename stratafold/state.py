"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder, with a warning off local mode, only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            warnings.warn("spark.checkpoint.dir is not set: tables between jobs go to a folder that executors may not share", stacklevel=2)
        found = os.path.join(tempfile.gettempdir(), "stratafold-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor costs at most the tasks that read the table, never the work before it. The tables go when the driver's process ends
    (``clear``), so results that read them stay valid as long as the session.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stratafold/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Delete all tables that ``settle`` wrote; nothing that reads them may be used afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # noqa: BLE001  the session may have gone first; the folder's owner sweeps what is left
            continue


atexit.register(clear)
