"""Makes this package importable in the session's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to all executors, once per application (``addPyFile``)."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="assaykit-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".tsv"):
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    _sent.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a temporary one; a cluster has none, which is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="assaykit-shared-")
