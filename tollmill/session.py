"""Session settings for tests and the bench, and cutting of long lineages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tollmill", master: str = "local[*]", **conf) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        # the JIT skips methods over 8000 bytes: keep generated code below that, and let it try the rest
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in ``spark.checkpoint.dir``.

    A local session that names none gets a folder beside its warehouse; on a cluster that is an error, because
    other machines would not see the files.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def freeze(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and read back from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables that a job writes and reads back."""
    return f"{shared_folder(spark)}/tollmill-{uuid.uuid4().hex}/{name}"
