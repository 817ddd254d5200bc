"""Shared state between executors: the library's folder, checkpoints and components, and written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..operators.shared import checkpoint, components, shared_dir

__all__ = ["checkpoint", "components", "shared_dir", "written"]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: later readers take only the columns they need."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
