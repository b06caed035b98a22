"""Driver tables, written stage tables, and small shared pieces of the plans."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from imagora.operators import sizing
from imagora.session import shared_dir

_WRITTEN: set[str] = set()


# tables whose rows cost real work
_HEAVY = ("documents", "embeddings", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return sizing.spread(df) if name in _HEAVY else df


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Digest of paths, sizes and times of the files under a folder of tables."""
    jvm = spark._jvm
    seen = []
    for pattern in ("*.parquet", "*.parquet/*"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{pattern}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.globStatus(path) or ():
            seen.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()[:10]


def _complete(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def stage_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where a stage of these tables, as their files are now, is written."""
    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:10]
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{fingerprint(spark, sf_dir)}/{name}"


def staged(spark: SparkSession, sf_dir: str, name: str,
           build: Callable[[], DataFrame]) -> DataFrame:
    """A table written once per application to the shared folder and read back.

    This is the boundary between stages of an experiment: retrieval writes its
    run, and everything downstream starts from the written rows, so a lost
    executor costs a read and not a second retrieval. Changed input files have
    another path, and a folder that is gone is written again.
    """
    path = stage_path(spark, sf_dir, name)
    if path not in _WRITTEN or not _complete(spark, path):
        build().write.mode("overwrite").parquet(path)
        _WRITTEN.add(path)
    return spark.read.parquet(path)


def once(path: str, write: Callable[[], object]) -> None:
    """Run a writer the first time a path is asked for in this application."""
    if path not in _WRITTEN:
        write()
        _WRITTEN.add(path)
