"""Sessions, table access and shared intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessellon", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Only Spark opens the path, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master (tests, one-machine runs) may do without: a temporary folder is
    made there. A cluster without the setting is an error, since its executors would
    each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessellon-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder below the shared one that holds this application's intermediate tables."""
    return f"{shared_dir(spark)}/tessellon/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are deleted as each query ends; the session's setting comes back after.

    Otherwise they stay until the driver happens to collect garbage, so the disks of a
    long job hold the shuffles of all its steps. A query that is lost on the way still
    has its own.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, scratch: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts lineage in a way that outlives executors: each row is computed once,
    whereas ``checkpoint()`` computes the plan for its count and again for its files.
    ``scratch`` takes the path, for a caller that drops what it no longer needs.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, scratch: list[str]) -> None:
    """Delete the intermediate tables of ``scratch``."""
    while scratch:
        drop_path(spark, scratch.pop())


def cleanup(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results that still read them must have been stored before."""
    drop_path(spark, own_dir(spark))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
