"""Training-data pipeline: from documents to packed sequences.

Each stage gets what the one before kept, as written Parquet. All but the last return the
columns of documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoopflow.llm import decontam, lines, minhash, packing, quality
from hoopflow.session import checkpoint_root, ship

ROW = "_row_key"
#: The columns that stages read; all others go through unread.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def plainly(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that keeps the columns of its input, run with plain names for the others, so that no name of theirs clashes or needs quoting."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        out = stage(spark, docs.toDF(*[c if c in KNOWN else f"extra{i}" for i, c in enumerate(docs.columns)]), sf_dir)
        return out.toDF(*docs.columns)
    return run


@plainly
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels that are not held out, rejects go.

    Null and empty texts have the frequency of label 1 as score; repeated rows are judged one by one; an empty table stays empty.
    """
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@plainly
def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source are cut, where copies of a text are one page; n_chars follows the text.

    Rows stay, repeated ones too; a null source is one of its own; a null text stays null with null n_chars; an empty table stays empty.
    """
    ship(spark)
    out = lines.drop_boilerplate(docs).drop("_n_lines", "_n_removed")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row in ``ROW``, stored so that it stays the same. Ids may be null or repeated."""
    return minhash.stored(docs.withColumn(ROW, F.monotonically_increasing_id()))


@plainly
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id.

    Every row is a document of its own. Of rows with the smallest id one stays; a null id
    counts as larger than any other. Texts without words link with nothing and stay.
    """
    ship(spark)
    rows = keyed(docs)
    found = minhash.near_duplicates(rows, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first")
    kept = found.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(first).select(F.col("first").getField(ROW).alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(docs.columns)


@plainly
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Every row is a document of its own, whatever its id."""
    ship(spark)
    rows = keyed(docs)
    bad = decontam.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW).where("contaminated").select(F.col("doc_id").alias(ROW))
    return rows.join(bad, ROW, "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 tokens; an empty table gives none."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_stage), ("line_dedup", lines_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("best_fit_packing", packing_stage)]

#: Fitted scores and packing aren't expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{checkpoint_root(spark)}/pipeline-{name}-{uuid.uuid4().hex[:12]}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
