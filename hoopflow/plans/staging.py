"""Round trips through storage for reader and writer queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hoopflow.session import checkpoint_root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/stage-{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, fmt: str, name: str, **options) -> str:
    path = fresh_path(df.sparkSession, name)
    df.write.format(fmt).options(**options).save(path)
    return path
