"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.showConsoleProgress": "false",
}

# Work folders of applications whose session names none.
_LOCAL_ROOTS: dict[str, str] = {}

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "loomlog", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings the jobs assume; `master` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written tables.

    A cluster names it in `spark.checkpoint.dir`, and must: executors cannot see each other's
    local folders. Only a session with a local master gets a local folder, once per application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="loomlog-")
        root = _LOCAL_ROOTS[app]
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """New folder name below the shared work folder."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """`df` written to a table in the work folder and read back: computed once, its lineage
    cut, and safe when executors are lost."""
    spark = df.sparkSession
    folder = fresh_folder(spark, name)
    df.write.parquet(folder, compression=compression)
    return spark.read.schema(df.schema).parquet(folder)
