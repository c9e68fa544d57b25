"""Repository files and change history."""

from __future__ import annotations

import subprocess
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork import schemas as S
from skeinwork.tables import lookup, settle, work_dir


def language_of(path: Column) -> Column:
    """By the last extension, letter case aside; null if unknown."""
    return lookup(S.LANGUAGES, F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)))


def ignored(path: Column, dirs: tuple[str, ...] = S.IGNORED_DIRS) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, dirs)))


def scanned(files: DataFrame, dirs: tuple[str, ...] = S.IGNORED_DIRS) -> DataFrame:
    """S1 on rows (path, content): known languages outside ignored folders, with size and digest, by path component."""
    named = files.withColumn("language", language_of(F.col("path"))).filter(F.col("language").isNotNull() & ~ignored(F.col("path"), dirs))
    out = named.select("path", "language", F.octet_length("content").cast("long").alias("size"), F.sha2(F.col("content").cast("binary"), 256).alias("hash"), F.decode(F.col("content").cast("binary"), "UTF-8").alias("source"))
    return out.orderBy(F.split("path", "/"))


def opened(uri: str):
    """The file system and path of a uri, for executors."""
    from pyarrow import fs as arrow_fs

    return arrow_fs.FileSystem.from_uri(uri if not uri.startswith("file:") else "/" + uri.removeprefix("file:").lstrip("/"))


def read_repository(spark: SparkSession, root: str, dirs: tuple[str, ...] = S.IGNORED_DIRS) -> DataFrame:
    """The files below a folder; ignored folders are not entered.

    Spark's file sources pass over names that begin with an underscore, and so over __init__.py.  Executors therefore list the folders
    themselves, all folders of a level at once, and read the contents; no name comes to the driver.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        for b in batches:
            for prefix, uri in zip(b.column("path").to_pylist(), b.column("uri").to_pylist(), strict=True):
                where, path = opened(uri)
                inside = where.get_file_info(arrow_fs.FileSelector(path))
                kept = [f for f in inside if (f.type == arrow_fs.FileType.Directory and f.base_name not in dirs) or (f.type == arrow_fs.FileType.File and f.base_name.lower().endswith(tuple(S.LANGUAGES)))]
                cols = [[prefix + f.base_name for f in kept], [f"{uri.rstrip('/')}/{f.base_name}" for f in kept], [f.type == arrow_fs.FileType.Directory for f in kept]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_())], ["path", "uri", "folder"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = []
            for uri in b.column("uri").to_pylist():
                where, path = opened(uri)
                with where.open_input_stream(path) as f:
                    bodies.append(f.read())
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(bodies, pa.binary())], ["path", "content"])

    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString()
    folders, found = spark.createDataFrame([("", uri)], "path string, uri string"), None
    while not folders.isEmpty():
        level = settle(folders.mapInArrow(listed, "path string, uri string, folder boolean"), "listing")
        here = level.filter("not folder").select("path", "uri")
        found = here if found is None else found.unionByName(here)
        folders = level.filter("folder").select(F.concat("path", F.lit("/")).alias("path"), "uri").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return scanned(found.repartition("path").mapInArrow(read, "path string, content binary"), dirs)


def churn(lines: DataFrame) -> DataFrame:
    """S3: (path, churn) from the lines of a name-only log."""
    path = F.trim("value")
    return lines.select(path.alias("path")).filter("path <> ''").groupBy("path").agg(F.count("*").alias("churn"))


def git_churn(spark: SparkSession, root: str, timeout: int = 30) -> DataFrame:
    """S3: from the history of a checkout; any failure means no churn.  The log goes through a file of the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = path(f"{work_dir(spark)}/log-{uuid.uuid4().hex}.txt")
    with tempfile.NamedTemporaryFile("w+b") as log:
        try:
            subprocess.run(["git", "-C", root, "log", "--name-only", "--pretty=format:"], stdout=log, stderr=subprocess.DEVNULL, timeout=timeout, check=True)
        except (OSError, subprocess.SubprocessError):
            return null_churn(spark)
        log.flush()
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.copyFromLocalFile(path(f"file://{log.name}"), at)
        fs.deleteOnExit(at)
    return churn(spark.read.text(str(at)))


def null_churn(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "path string, churn bigint")


