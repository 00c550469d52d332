"""Session helpers. On a cluster the caller's settings win; defaults are for local runs."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, app: str = "hoopflow") -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.driver.memory", os.environ.get("HOOPFLOW_DRIVER_MEMORY", "8g"))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


#: Folders of local sessions that name none; the setting itself can't be changed once a session runs.
_LOCAL: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; local sessions may go without and get a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _LOCAL[spark.sparkContext.applicationId] = path
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to the reliable checkpoint folder."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Workers import it by name, wherever the driver was started.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "hoopflow")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "hoopflow"))
