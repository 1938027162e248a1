"""Intermediate tables in the cluster's shared folder, callers' columns under reserved names, and distributed ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset on a local master (tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fieldbook-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: its lineage ends there and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/fieldbook/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this application's written tables; call it once their results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/fieldbook/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: str) -> DataFrame:
    """df without the columns of these names in any case, as Spark tells columns apart by letters alone."""
    gone = {n.lower() for n in names.split()}
    return df.select([quoted(c) for c in df.columns if c.lower() not in gone])


def packed(df: DataFrame, **roles: str) -> DataFrame:
    """What an operator reads of df under the operator's own names (roles), and all other columns in the struct _fb_row.

    So no column of the caller can clash with one that is added, and names that need quotes pass through Python.
    """
    rest = [quoted(c) for c in df.columns if c not in roles.values()]
    return df.select(F.struct(*(rest or [F.lit(None).cast("int").alias("none")])).alias("_fb_row"), *[quoted(c).alias(role) for role, c in roles.items()])


def unpacked(df: DataFrame, columns: list[str], roles: dict[str, str], added: str = "", **new: Column) -> DataFrame:
    """The columns packed before, in their order, and added ones; new values for some of them are given by name."""
    own = {c: F.col(role) for role, c in roles.items()} | new
    return df.select([(own[c] if c in own else F.col("_fb_row").getField(c)).alias(c) for c in columns] + added.split())


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its 1-based rank in the given order.

    Rows are range-partitioned, numbered inside each partition, and moved up by the rows of the
    partitions before it, so no task sees more than its range. Full ties get ranks in any order.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = written(df.repartitionByRange(n, *order).withColumn("_fb_part", F.spark_partition_id()))
    sizes = parts.groupBy("_fb_part").agg(F.count("*").alias("_fb_n"))
    # one row for each partition, so a broadcast of n small rows
    before = sizes.select("_fb_part", (F.sum("_fb_n").over(Window.orderBy("_fb_part")) - F.col("_fb_n")).alias("_fb_before"))
    inside = F.row_number().over(Window.partitionBy("_fb_part").orderBy(*order))
    return (
        parts.withColumn("_fb_inside", inside)
        .join(F.broadcast(before), "_fb_part")
        .withColumn(name, F.col("_fb_inside") + F.col("_fb_before"))
        .drop("_fb_part", "_fb_inside", "_fb_before")
    )
