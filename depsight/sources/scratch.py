"""The folder that driver and executors share: checkpoints, and results that several queries read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Paths of what kept() has written, by application, name and the state of the files it was made from.
KEPT: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local run gets a folder of its own, which goes with the process; on a
    cluster no machine-local folder would do, so that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="depsight-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Files, bytes and last change of a path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = fs.getContentSummary(at)
    return whole.getFileCount(), whole.getLength(), fs.getFileStatus(at).getModificationTime()


def kept(spark: SparkSession, name: str, sources: list[str], write: Callable[[str], None]) -> str:
    """The path of a result that is written once for each application and state of its sources, and read by all who ask."""
    key = (spark.sparkContext.applicationId, name, *((s, _state(spark, s)) for s in sources))
    if key not in KEPT:
        path = scratch_path(spark, name)
        write(path)
        KEPT[key] = path
    return KEPT[key]
