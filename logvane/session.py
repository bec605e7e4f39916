"""Session defaults and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# HotSpot never compiles a method longer than this; beyond it Spark's split, per-operator
# code is faster than one fused but interpreted method
HOTSPOT_METHOD_LIMIT = "8000"
#: The store that streams with state of their own need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "logvane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; on a cluster leave `master` unset."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", HOTSPOT_METHOD_LIMIT)
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results and parsing speed depend on in a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", HOTSPOT_METHOD_LIMIT)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, as named by the cluster in `spark.checkpoint.dir`.

    Only where the cluster names none and Spark runs in one local process does a
    local folder serve.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="logvane-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, **options: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    For results several branches of a plan read: they are computed once, survive lost
    executors, and the readers still prune columns and push filters. `options` go to the writer.
    """
    spark = df.sparkSession
    path = f"{shared_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
