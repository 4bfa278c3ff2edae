"""Tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it; where it is unset and the master is local (tests on one machine) a temporary folder."""
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found and set_already.isDefined():
        found = set_already.get()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not set_already.isDefined():
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage is cut, and a lost executor takes nothing with it."""
    path = os.path.join(shared_dir(df.sparkSession), f"pairloom-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def free(*tables: DataFrame | None) -> None:
    """Deletes the files of ``stored`` tables that no plan reads any more; other frames and None are left alone."""
    for df in tables:
        if (path := getattr(df, "stored_at", None)) is not None:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
            df.stored_at = None
