"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_test_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _test_folders:
        _test_folders[app] = tempfile.mkdtemp(prefix="threadloom-")
        atexit.register(shutil.rmtree, _test_folders[app], ignore_errors=True)
    return _test_folders[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of this application, which may go when the application has ended."""
    return f"{shared_folder(spark)}/threadloom-{spark.sparkContext.applicationId}/{label}-{uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts lineage in a way that outlives executors, pins values that depend on the
    partitioning (range bounds, partition ids), and gives the optimizer a real size.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
