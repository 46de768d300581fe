"""Intermediate tables in the shared folder: written once as Parquet, then read with pruning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the session's checkpoint folder and return the stored table.

    Cuts the lineage, survives lost executors, and lets later passes read only
    the columns they use.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
