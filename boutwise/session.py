"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def build_session(app: str = "boutwise", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in spark.checkpoint.dir.

    Only a local session, where there is no other machine, may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def letting_go(spark: SparkSession):
    """While a stage is written under this, its shuffle files go as soon as it is written; nothing reads them again."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write a stage result to the shared folder and read it back, which cuts its lineage and lets its shuffle files go."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with letting_go(df.sparkSession):
        writer.parquet(path)
    if getattr(_passing, "paths", None) is not None:
        _passing.paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


_passing = threading.local()


@contextmanager
def passing(spark: SparkSession):
    """Stages stored under this are deleted at its end, for steps of which only figures on the driver are left."""
    outer, _passing.paths = getattr(_passing, "paths", None), []
    try:
        yield
    finally:
        paths, _passing.paths = _passing.paths, outer
        for path in paths:
            delete_folder(spark, path)


def discard(*frames: DataFrame) -> None:
    """Delete stored stages that later ones have been stored from."""
    for df in frames:
        delete_folder(df.sparkSession, df.stored_at)


class Stages:
    """Named stages of one job in a folder of their own, which are deleted when later ones have been stored from them."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        with letting_go(self.spark):
            (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.folder}/{name}")
        return self.read(df.schema, name)

    def read(self, schema: StructType, *names: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name}" for name in names])

    def drop(self, name: str) -> None:
        delete_folder(self.spark, f"{self.folder}/{name}")


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, on any file system; nothing if it is not there."""
    system, place = _place(spark, path)
    return [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.delete(place, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    system, place = _place(spark, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    if system.exists(target) or not system.rename(place, target):
        raise FileExistsError(to)
