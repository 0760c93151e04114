"""Cutting lineage by tables written to the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset
(single-machine sessions, tests) a temporary folder is made and set.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strataweave.plans.session import ship

_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, as the session names it."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        root = getattr(spark, "_strataweave_root", None) or tempfile.mkdtemp(prefix="strataweave-")
        spark._strataweave_root = root
    return root.rstrip("/")


@dataclass
class Stage:
    """A written table: ``df`` reads it, ``drop`` deletes it."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        jvm, spark = self.df.sparkSession._jvm, self.df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_stage(df: DataFrame, tag: str, folders: list[str] | None = None) -> Stage:
    """Write ``df`` to the shared folder and read it back: a lineage cut that
    survives the loss of any executor. An empty input gives an empty table. Rows of
    different values of ``folders`` are kept in folders of their own."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_root(spark)}/strataweave/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    return Stage(spark.read.schema(df.schema).parquet(path), path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``write_stage`` where the table is read by the returned result."""
    return write_stage(df, tag).df
