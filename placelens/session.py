"""What jobs need from the session: the package on the workers, and a folder all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

SHARED = "spark.checkpoint.dir"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context.

    Functions of modules reach a worker by name, so the package must be importable there; the
    driver's own search path does not reach them.
    """
    context = spark.sparkContext
    if getattr(context, "_placelens_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="placelens-"), "placelens_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)  # served by the driver, so the executors need no shared disk
    context._placelens_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all machines see, from ``spark.checkpoint.dir``.

    Where it is unset, a local session takes a temporary folder; on a cluster that would leave
    each executor with its own files, so there the setting is required.
    """
    folder = spark.conf.get(SHARED, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"set {SHARED} to a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_placelens_folder", None)
    if made is None:
        made = spark.sparkContext._placelens_folder = tempfile.mkdtemp(prefix="placelens-shared-")
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_folder(spark)}/placelens-{name}-{uuid.uuid4().hex}"


def written(df, name: str, compression: str = "snappy"):
    """The rows of ``df`` from a table in the shared folder: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
