"""Session helpers: shared working tables, small literal tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a table of names or keys that goes to every task, at most.
NAMED = 10_000


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors reach.  Where it is unset a temporary folder serves a local session; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            return given.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        found = tempfile.mkdtemp(prefix="skeinwork-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and a lost executor loses nothing.  The files go with the application."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/skeinwork-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def many(df: DataFrame) -> DataFrame:
    """df for a join by sorted keys.  Files that settle wrote can be a hundredth of their rows in memory, and by their size alone such a table would be collected by the driver."""
    return df.hint("merge")


def dealt(df: DataFrame) -> DataFrame:
    """The rows of df for Python tasks on all cores: a small file of many records is otherwise read by one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def numbered(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """df, written, with the place of each row in this order, from 0: a sort by range, and each range's start from the sizes of those before."""
    at = F.monotonically_increasing_id()
    rows = settle(df.orderBy(*order).withColumn(name, at), "numbered")
    part, start, starts = F.shiftright(name, 33), 0, []
    for r in sorted(rows.groupBy(part.alias("part")).count().collect()):  # one row for each range
        starts.append((r["part"], start))
        start += r["count"]
    before = F.broadcast(literal_table(df.sparkSession, starts, "part long, start long"))
    within = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("part", part).join(before, "part").withColumn(name, F.col("start") + within).drop("part", "start")


def literal_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A small table of given values."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def lookup(mapping: dict[str, object], key: Column, default: object = None) -> Column:
    """The mapping as an expression."""
    out = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out
