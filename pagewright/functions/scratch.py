"""Tables written between the steps of an operator, in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a session whose executors are threads of this
    process (master local) gets one of its own; on a cluster, whose executors share no local disk, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share: steps between operators are written there")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="pagewright-")
    return _LOCAL[sc.applicationId]


def _delete(path: str) -> None:
    try:
        sc = _WRITTEN.pop(path).sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; its folder goes with it, or is the cluster's to clear
        pass


def release() -> None:
    """Deletes the steps written so far. For a long session, once the results of its queries have been read: a
    DataFrame that still rests on a step can't be read afterwards. The rest goes when the process ends."""
    for path in list(_WRITTEN):
        _delete(path)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and
    survives the loss of executors. See `release` for when the files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.unregister(release)
        atexit.register(release)
    _WRITTEN[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
