"""Spark settings for a run, and the shared folder it may write to."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Aim for shuffle partitions of this size, so that one fits easily in a task's memory.
SHUFFLE_PARTITION_BYTES = 128 * 1024 * 1024

# The JVM never compiles a method of more bytecodes than this.
COMPILED_METHOD_LIMIT = 8000


def shuffle_settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings sized to the input: enough shuffle partitions, which AQE then merges as needed.

    The method limit has Spark split generated code that the JVM would only interpret, which matters
    when tables are wide.
    """
    partitions = max(cores, -(-input_bytes // SHUFFLE_PARTITION_BYTES))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_PARTITION_BYTES),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(SHUFFLE_PARTITION_BYTES),
        "spark.sql.codegen.hugeMethodLimit": str(COMPILED_METHOD_LIMIT),
    }


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared one named in ``spark.checkpoint.dir``.

    Only a local session, whose tasks all see the same disk, may fall back to a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="twinledger-")
    return f"{shared.rstrip('/')}/twinledger-{uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, wherever it lies; nothing there is fine."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def in_parallel(spark: SparkSession, *actions: Callable) -> list:
    """Run independent Spark actions at the same time; small ones then share the cluster."""
    with ThreadPoolExecutor(len(actions)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(a)) for a in actions]]
