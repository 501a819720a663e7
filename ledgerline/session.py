"""Session settings and the shared folder that intermediate tables go to."""

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "ledgerline", **conf) -> SparkSession:
    """A session with the settings the library is tuned for.

    Nothing in the library depends on them for right results: a session the
    caller made works too.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if master.startswith("local"):
        settings |= {
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": "8",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
            "spark.ui.enabled": "false",
        }
    settings |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset, a folder in the warehouse, which is shared like the tables in it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a frame that is read more than once to the shared folder and read it back; `options` are the writer's.

    It cuts the lineage like a checkpoint, survives lost executors, stays
    columnar, and gives later joins a true size to plan with.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of frames that are no longer used: Spark deletes them once the driver's JVM has
    collected what refers to them, which a job of many steps can't wait for."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
