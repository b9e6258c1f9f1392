"""What every query needs from the session: tables, the shared folder and code on the workers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    On clusters without a common file system, submit the package with --py-files instead."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables; columns are pruned and filters pushed by Catalyst."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Compressed bytes of files up to which an input counts as small.
SMALL = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are small and give fewer partitions than there are cores, as one file of one row
    group does; else df.

    So that costly narrow operators don't run in one task. Never shuffles more than SMALL bytes of files, whatever the
    cluster: Catalyst's own estimate of the scan decides, which is the size of the files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where it is unset, a temporary one if all runs on one machine, as in tests; on a cluster an error, for what one
    machine writes in its own folder the others can't read."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = getattr(spark.sparkContext, "_foliospark_dir", None)
        if where is None:
            where = tempfile.mkdtemp(prefix="foliospark-")
            spark.sparkContext._foliospark_dir = where
    return where.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and later reads share one computation. The
    table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, key: str) -> DataFrame:
    """df, a selection of a table's columns, with the first delivered row of each key; rows with a null key all stay.

    Only keys and places in the files are grouped, so no text is shuffled: the keys that came more than once are written
    and joined back, by broadcast where their table is below Spark's own bound for that, else by key."""
    placed = df.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias("_at"))
    repeated = placed.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).where("_n > 1").drop("_n")
    both = placed.join(stage(repeated, "repeated"), key, "left")
    return both.where("_first is null or _first = _at").select(*df.columns)
