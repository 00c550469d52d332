"""Connected components of an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopflow.session import checkpoint_root


def stored(df: DataFrame) -> DataFrame:
    """Written compressed to the shared checkpoint folder and read again.

    Unlike a checkpoint, empty partitions leave no file and small files are read together.
    """
    path = f"{checkpoint_root(df.sparkSession)}/near-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): component is the smallest id reachable.

    Alternating large-star and small-star steps; each is one partially aggregated minimum per
    node and one join, so a node of very many edges is pre-aggregated, and its edges are split by
    the skew join. Each round is stored in the shared checkpoint folder. Ends when a
    round changes nothing. Nodes without edges do not appear.
    """
    e = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
                 .select("x.*").where("u <> v").distinct())
        nxt = stored(small)
        state = tuple(nxt.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if state == seen or state[0] == 0:
            break
        e, seen = nxt, state
    stars = nxt.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
