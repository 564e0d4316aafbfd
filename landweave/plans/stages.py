"""Intermediate tables on the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import logging
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Paths made inside each open ``scope``, the innermost last.
_scopes: list[set[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where none is set and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='landweave-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session ended before
        return
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except (Py4JError, ConnectionError) as e:  # scratch data, so a failure mustn't end the job
        logging.getLogger(__name__).warning("could not remove %s: %s", path, e)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path on the shared folder, removed when the innermost open ``scope`` ends, or else as the interpreter does."""
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    if _scopes:
        _scopes[-1].add(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table on the shared folder: its lineage is cut, and it outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._landweave_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a written table that nothing reads any more."""
    _remove(df.sparkSession, df._landweave_path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go when it ends, but for those that ``keep`` hands on: a driver that lives long, or a
    cluster's shared folder, isn't filled. What was computed inside has to be written, or collected, before."""
    _scopes.append(set())
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """A written table that outlives the innermost open scope and belongs to the next one outside."""
    if _scopes and df._landweave_path in _scopes[-1]:
        _scopes[-1].discard(df._landweave_path)
        if len(_scopes) > 1:
            _scopes[-2].add(df._landweave_path)
    return df
