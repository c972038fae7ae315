"""Reading the Parquet tables and cutting lineage through the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; a file or a folder of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where that is unset, a session on one machine (``local[...]``) gets a temporary folder of its own; on a cluster, whose
    executors do not share such a folder, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: With it Spark deletes the shuffle files of a SQL execution when that ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, *columns: str, lean: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors.

    ``lean`` is for tables that are large beside the input: what is written is packed closely, and the shuffle files that
    writing it took are deleted at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/filigraph-{uuid.uuid4().hex}"
    writer = (df.select(*columns) if columns else df).write
    before = spark.conf.get(_CLEANUP, None)
    if lean:
        writer = writer.option("compression", "zstd")
        spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        if lean and before is None:
            spark.conf.unset(_CLEANUP)
        elif lean:
            spark.conf.set(_CLEANUP, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # it goes when the application ends
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    read = spark.read.schema(df.select(*columns).schema if columns else df.schema).parquet(path)
    read._filigraph_path = path
    return read


def drop_cut(df: DataFrame) -> None:
    """Delete what :func:`cut` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_filigraph_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must to tell."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all shuffle partitions, for rows that are small but cost much to work on, so that no task gets them all."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_filigraph_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = f"{tempfile.mkdtemp(prefix='spark-')}/filigraph.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for part in sorted(here.rglob("*.py")):
            file.write(part, part.relative_to(here.parent))
    context.addPyFile(archive)
    context._filigraph_shipped = True
