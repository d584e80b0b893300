"""What the operators need of the session."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, once for each application: they needn't have it installed, nor share
    the driver's module path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("turnloom", os.path.relpath(path, root)))
    path = os.path.join(tempfile.mkdtemp(prefix="turnloom-"), "turnloom.zip")  # the driver serves it to the executors
    with open(path, "wb") as f:
        f.write(body.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def ship_to_active() -> None:
    """The same for the session in use, where there is one; for functions that only make columns."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder of ``spark.checkpoint.dir``.  Where that is unset a folder of the driver's machine serves,
    if the executors are on it; on a cluster they could not read it, so there it is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="turnloom-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder: lineage ends there, and a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, for files that a query writes and reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
