"""Frames written to the cluster's shared folder: lineage is cut there, so a lost executor costs only its own tasks."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs on one machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="docloom-"))
        path = _own_dir[0]
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Removes what materialize() wrote for this frame; nothing may read it any more."""
    path = getattr(df, "_docloom_path", None)
    if path:
        remove(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def materialize(df: DataFrame) -> DataFrame:
    """Writes the frame to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._docloom_path = path
    return back


@contextlib.contextmanager
def only_kept() -> Iterator[list[DataFrame]]:
    """Inside, frames may be written as helpers of others; on leaving, those that aren't in the given list are removed. What
    is kept must itself be written, not read from the others."""
    before, kept = {path for _, path in _written}, []
    yield kept
    stay = {getattr(df, "_docloom_path", None) for df in kept}
    for spark, path in [x for x in _written if x[1] not in before and x[1] not in stay]:
        remove(spark, path)
        _written.remove((spark, path))


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session is gone; the folder belongs to the cluster
            return
