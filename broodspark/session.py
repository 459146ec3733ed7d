"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the cluster's own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("broodspark")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # A study generates several hundred classes; the default keeps 100 and recompiles.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # Call-site capture costs several round trips to the JVM for every column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the shared folder of the cluster (``spark.checkpoint.dir``).

    A local temporary folder is made only when the setting is missing and the session
    is local; on a cluster a machine-local folder would not be seen by the executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base().name
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@functools.cache
def _local_base() -> tempfile.TemporaryDirectory:
    """One folder per process, gone when the process ends."""
    return tempfile.TemporaryDirectory(prefix="broodspark-", ignore_cleanup_errors=True)
