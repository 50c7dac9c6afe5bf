"""Session defaults for local runs. On a cluster the caller's own session is used as it is."""
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores="*", app="studyloom", shuffle_partitions=8, extra=None):
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "12g")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("studyloom.spread", "true")
         .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-wh-", dir="/tmp")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel(os.environ.get("STUDYLOOM_LOG", "ERROR"))
    return spark


def checkpoint_dir(spark):
    """Shared folder for checkpoints: the one the session names; a local one only where none is set and all runs in one JVM (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    path = named or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df):
    """Cut the lineage: write the rows once as a table in the shared checkpoint folder and go on from there.

    Unlike an eager checkpoint this computes the rows once, and readers of the table read only the columns they need.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(spark):
    """Into how many files :func:`bucketed` deals rows: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df, key):
    """As :func:`materialize`, with rows dealt by ``key``: joins and groups by it leave the table where it is, only their other side is shuffled."""
    spark, name = df.sparkSession, f"table_{uuid.uuid4().hex}"
    n = buckets(spark)
    df.repartition(n, key).write.format("parquet").option("compression", "zstd").bucketBy(n, key).option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files of a table with a path stay
    return table
