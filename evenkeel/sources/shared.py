"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can read: ``spark.checkpoint.dir``, or else the
    folder given to ``SparkContext.setCheckpointDir``. Only a session whose executors are threads
    of the driver may leave both out; it uses its warehouse folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and (context.master == "local" or context.master.startswith("local[")):
        folder = spark.conf.get("spark.sql.warehouse.dir")
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return folder.rstrip("/")


def materialise(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and return a reader of the written table.

    The lineage is cut, so a lost executor costs a re-read and not the plan
    above. The reader also knows the true size on disk, so Catalyst's own size
    check decides whether a join with it is broadcast.

    Files go to a fresh folder below ``folder`` (default: the shared folder)
    and live as long as the caller keeps that folder; see ``scratch``.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/evenkeel/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, folder: str | None = None) -> Iterator[str]:
    """A fresh folder for the intermediate tables of a step, to be handed in as
    ``folder=``. It is deleted at the end, so results have to be stored before."""
    path = f"{folder or shared_folder(spark)}/evenkeel-step-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(here, True)
