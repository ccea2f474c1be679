"""Session helpers shared by all plans."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


#: Tables up to this size are dealt out to all cores where they come in fewer splits. The
#: shuffle this takes is bounded by it; larger tables are read as they are split.
SPREAD_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables as a DataFrame.

    A small file comes in fewer splits than there are cores, as its row groups are not
    split. Only tables under ``SPREAD_BYTES`` are dealt out; no large table is shuffled here.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, which all
    executors share. Only a local master without that setting (tests, a laptop) gets a
    folder under the warehouse directory; a cluster without it is refused, as a folder of
    one machine would be lost with that machine.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(df.sparkSession.conf.get("spark.sql.warehouse.dir"), "_checkpoints"))
    return df.checkpoint(eager=eager)


def local_session(name: str = "paperloom", cpus: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
