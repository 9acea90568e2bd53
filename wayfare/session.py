"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts may be long, and a worker and its JVM hold a batch each.
ARROW_ROWS = 2000
#: Bytes of a written lookup side up to which it may be broadcast.
BROADCAST_BYTES = 64 << 20


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-node session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder in spark.checkpoint.dir.

    Where none is set, a temporary folder does for a local master; on a cluster it would scatter the intermediate
    tables over the executors' own disks, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="wayfare")
        sc.setCheckpointDir(folder)
    return f"{sc.getCheckpointDir()}/tables"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows as a table in the shared folder and read them back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task where `task_count` deals them.
TASK_ROWS = 1_000_000


def task_count(df: DataFrame) -> int:
    """So many tasks that none has much more than TASK_ROWS rows of df (a scan, so cheap to count), at least the shuffle partitions.

    Given to a repartition, it holds where sizes in bytes would put many small rows into one task.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def bucketed(df: DataFrame, key: str, name: str | None = None, parts: tuple[str, ...] = ()) -> str:
    """Writes (or, with the name of such a table, adds) the rows to a table in as many buckets of `key` as there are shuffle partitions.

    Joins and groups by the key then read it without a shuffle. The table is one of the session's catalog, its files
    lie in the shared folder. Gives the name.
    """
    spark = df.sparkSession
    known, name = name is not None, name or f"wayfare_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).mode("append")
    if parts:
        writer = writer.partitionBy(*parts)
    if not known:
        writer = writer.option("path", f"{shared_dir(spark)}/{name}")
    writer.saveAsTable(name)
    return name


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables; only for when the results that read them have been written."""
    for found in spark.catalog.listTables(pattern="wayfare_*"):
        if not found.isTemporary:  # views of table functions stay
            spark.sql(f"DROP TABLE IF EXISTS {found.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def weight(df: DataFrame):
    """About the bytes of a row: what its strings, binaries and lists hold, and a fixed part."""
    total = F.lit(32).cast("long")
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind == "array" and field.dataType.elementType.typeName() in ("long", "integer", "double", "float"):
            total = total + 8 * F.greatest(F.size(column), F.lit(0))
        elif kind in ("array", "map", "struct", "variant"):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            total = total + 8
    return total


def broadcast_if_light(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint, given only after the bytes of all rows have been summed; beyond `limit` the join shuffles.

    df is read twice, so it should be a written table or cheap to make.
    """
    return F.broadcast(df) if (df.agg(F.sum(weight(df))).first()[0] or 0) <= limit else df
