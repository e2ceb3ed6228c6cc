"""Session-level helpers: table access and reliable materialisation.

Intermediate tables are written to the folder every executor shares, the one the
session names in ``spark.checkpoint.dir``.  A table on shared storage outlives a
lost executor and cuts the lineage, which a locally kept block does not.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
_KEPT: list[tuple[SparkSession, str]] = []  # whatever scope they were written in


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The named Parquet table below ``folder``."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of fewer files than there are cores, dealt out to all of them; any other table as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder.

    Where none is set, a temporary one serves a local session; on a cluster that is an
    error, as other machines couldn't read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDER:
            warnings.warn("spark.checkpoint.dir isn't set: a temporary folder of this machine holds the intermediate tables", stacklevel=3)
            _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="lexifold-")
        folder = _OWN_FOLDER[app]
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted with its scope or at the end of the process."""
    path = f"{shared_folder(spark)}/lexifold-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has the same rows and schema, a plan that is a plain Parquet scan,
    and no dependence on executors' local blocks.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Intermediate tables written inside are deleted at its end; results drawn from them must be used or written before."""
    first = len(_WRITTEN)
    try:
        yield
    finally:
        _delete(_WRITTEN[first:])
        del _WRITTEN[first:]


@contextmanager
def kept() -> Iterator[None]:
    """Intermediate tables written inside outlive any scope, as a session's shared ones must."""
    first = len(_WRITTEN)
    try:
        yield
    finally:
        _KEPT.extend(_WRITTEN[first:])
        del _WRITTEN[first:]


@atexit.register
def _tidy() -> None:
    _delete(_WRITTEN + _KEPT)


def _delete(written: list[tuple[SparkSession, str]]) -> None:
    for spark, path in written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone by now; the folder is scratch space
            return
