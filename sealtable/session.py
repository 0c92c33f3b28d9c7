"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings that matter for every job of this package.  Shuffle and spill files
# hold decrypted rows, so they are encrypted at rest.
DEFAULTS = {
    "spark.io.encryption.enabled": "true",
    "spark.io.encryption.keySizeBits": "128",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}

# Added on a cluster.  The secret itself comes from the resource manager or from
# spark-submit, never from code.
CLUSTER = {
    "spark.authenticate": "true",
    "spark.network.crypto.enabled": "true",
    "spark.ssl.enabled": "true",
}


def builder(app_name: str, on_cluster: bool = False) -> SparkSession.Builder:
    """A session builder carrying this package's settings."""
    b = SparkSession.builder.appName(app_name)
    for key, value in (DEFAULTS | (CLUSTER if on_cluster else {})).items():
        b = b.config(key, value)
    return b


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster
    session without it is an error, because a machine-local folder would be
    invisible to the other executors.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = sc.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="sealtable-")
    return _local_folders[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


_held: dict[str, list[DataFrame]] = {}


def held(df: DataFrame) -> DataFrame:
    """Rows that an operator looks at twice, kept on the executors' disks, where Spark encrypts
    them like its shuffle files, until :func:`release`."""
    _held.setdefault(df.sparkSession.sparkContext.applicationId, []).append(df.persist(StorageLevel.DISK_ONLY))
    return df


def release(spark: SparkSession) -> int:
    """Give up what operators hold for results that are no longer needed; a result that is read
    afterwards is computed again.  Long sessions call this between jobs."""
    kept = _held.pop(spark.sparkContext.applicationId, [])
    for df in kept:
        df.unpersist()
    return len(kept)
