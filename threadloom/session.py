"""Session, table access and lineage cutting."""

from __future__ import annotations

import atexit
import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("threadloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's; a local session without one gets a folder of our own.

    On a cluster a machine's own folder would be lost with it, so there the
    setting has to be given.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    own = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not own and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not own:
        own = os.path.join(tempfile.gettempdir(), "threadloom-checkpoints")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written once, as a table in the shared checkpoint folder.

    A table is compressed and keeps its columns apart, so later steps read only
    what they use; a lost executor costs a read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _made:
        atexit.register(_sweep, spark)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_made: list[str] = []


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder; a failure to look is an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [x.getPath().getName() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Renames a file or folder; what stood under the new name is replaced."""
    p, q = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(to)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(q, True)
    if not fs.rename(p, q):
        raise OSError(f"cannot rename {path}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    f = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode()
    finally:
        f.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that appears under its name only once it is whole."""
    p, part = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part-{uuid.uuid4().hex}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    f = fs.create(part, True)
    try:
        f.write(bytearray(text.encode()))
    finally:
        f.close()
    fs.delete(p, False)  # a replayed batch: until the rename the batch before is the last one
    if not fs.rename(part, p):
        raise OSError(f"cannot publish {path}")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep(spark: SparkSession) -> None:
    """Deletes the tables that this process cut, when it ends."""
    for path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended before
            return


def release(df: DataFrame) -> None:
    """Deletes a table made by :func:`cut` that no later step reads."""
    spark = df.sparkSession
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        if os.path.basename(f).startswith("cut-"):
            _delete(spark, f)


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    """Number of partitions so that each holds about ``per_partition`` rows."""
    return max(least, math.ceil(rows / per_partition))
