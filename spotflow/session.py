"""Session factory and the shared staging area for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "spotflow", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one. Only a local
    master may go without: it gets a temporary folder of this machine. On a cluster that would scatter
    tables over the nodes, so that it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"no folder that all executors share: set spark.checkpoint.dir (master {master})")
    own = "file://" + tempfile.mkdtemp(prefix="spotflow-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def staging_folder(spark: SparkSession) -> str:
    """Where the tables of this application lie."""
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and never a recomputation of the
    whole chain, and lets the planner see the true size of what follows.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staging(spark: SparkSession) -> None:
    """Delete the tables that this application has written. Results that still read them are lost, so
    write those first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
