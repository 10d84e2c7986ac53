"""Session settings, the shared scratch folder and sizes of inputs."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "chainloom", cores: int | None = None) -> SparkSession:
    """A local session with the settings that the engine is written for."""
    return (
        SparkSession.builder.master(f"local[{cores or '*'}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores or 8))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset, as in tests on one machine, a local one is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="chainloom-"))
            atexit.register(_remove, _own[0])
        folder = _own[0]
    return folder


def _remove(folder: str) -> None:
    import shutil

    shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table written to the shared folder and read again.

    Cuts the lineage: an executor that is lost later costs no more than the
    tasks that read the table. It stays until it is discarded or the folder is
    cleared.
    """
    spark = df.sparkSession
    path = os.path.join(scratch(spark), f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that written made and that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
