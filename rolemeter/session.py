"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, as `--py-files` would.

    Tasks that run Python import it; where it is installed on every machine this changes nothing.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for file in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, file)
                out.write(path, os.path.join(name, os.path.relpath(path, root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def build_session(app: str = "rolemeter", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. On a cluster the submitter's settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@functools.cache
def _local_folder(application: str) -> tempfile.TemporaryDirectory:
    """A temporary folder of a local session; gone when the process ends."""
    return tempfile.TemporaryDirectory(prefix="rolemeter-", ignore_cleanup_errors=True)


def scratch_root(spark: SparkSession, shared: str | None = None) -> str:
    """The folder this application keeps intermediate tables in.

    It lies under `shared` or `spark.checkpoint.dir`, storage that every executor can reach. A
    session whose executors are other processes has to name one; only a local session, where
    there is one process, may do without.
    """
    context = spark.sparkContext
    shared = shared or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _local_folder(context.applicationId).name
    return f"{shared.rstrip('/')}/rolemeter-{context.applicationId}"


def scratch_dir(spark: SparkSession, purpose: str, shared: str | None = None) -> str:
    """A fresh folder for one intermediate table."""
    return f"{scratch_root(spark, shared)}/{purpose}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, shared: str | None = None) -> None:
    """Delete the intermediate tables of this application, once no plan reads them any more."""
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark, shared))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
