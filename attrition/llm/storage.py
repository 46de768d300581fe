"""Intermediate tables in the folder that all executors share.

``stage`` writes a frame once as Parquet below the session's checkpoint folder
and reads it back: lineage is cut, a lost executor costs nothing but a re-read,
and later passes prune columns.  ``discard`` removes a table that no later plan
reads; what a returned (lazy) result still reads stays until the folder is
cleaned by its owner, like checkpoint files.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table."""
    return stage_at(df, scratch_path(df.sparkSession, name))


def stage_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table (any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the library to the executors, unless their Python path already has it."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    app = spark.sparkContext.applicationId
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or root in [os.path.abspath(p) for p in known if p]:
        return
    path = os.path.join(tempfile.mkdtemp(), "attrition.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.relpath(file, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
