"""The record store (S4-S8, K1-K10): a folder with one Parquet folder for each version of a collection.

A write goes to a new version folder and is then published by the next numbered entry of the collection's log, which names the version.
Only one writer can create an entry, so of two that start from one version the second is refused: a reader is told the version's number, and
a writer hands it back.  An entry without content is not there for readers, so they see the old or the new version and never a half.  Versions
stay for a while after the next, so what was read from one can still be worked with.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skeinwork import schemas as S
from skeinwork.operators.records import first_of_each
from skeinwork.sources import blocks, bundles


#: Seconds after which an entry without content counts as left behind by a writer that failed.
ABANDONED = 3600
#: Seconds that a version stays after the next one, and writes of one change that are tried before a conflict is passed on.
KEPT, TRIES = 86_400, 5
#: Records in a file of a snapshot, at most: a compressed file is read by one task.
SNAPSHOT_ROWS = 1_000_000
#: The version of a collection that was cleared.
GONE = "-"


class Conflict(RuntimeError):
    """Another writer has published a version meanwhile."""


class Store:
    def __init__(self, spark: SparkSession, root: str, kept: float = KEPT):
        self.spark, self.root, self.kept = spark, root.rstrip("/"), kept
        self.fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- versions

    def _names(self, path: str, folders: bool) -> list[str]:
        p = self.fs_path(path)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(p) if f.isDirectory() == folders) if self.fs.exists(p) else []

    def _log(self, name: str) -> list[tuple[int, bool, float]]:
        """Number, whether it is written, and age in seconds of each entry of the log, the last one first."""
        p = self.fs_path(f"{self.root}/{name}/log")
        found = self.fs.listStatus(p) if self.fs.exists(p) else []
        return sorted(((int(f.getPath().getName()), f.getLen() > 0, time.time() - f.getModificationTime() / 1000) for f in found), reverse=True)

    def _version(self, name: str, number: int) -> str:
        stream = self.fs.open(self.fs_path(f"{self.root}/{name}/log/{number:020d}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _head(self, name: str) -> tuple[int, str | None]:
        """Number and version of the last written entry of the log."""
        last = next((n for n, written, _ in self._log(name) if written), None)
        return (0, None) if last is None else (last, self._version(name, last))

    def _publish(self, name: str, base: int, version: str) -> int:
        """The entry after base; only one writer can create it.  Entries that a writer left empty long ago are passed over."""
        number = base + 1
        for n, written, age in self._log(name):
            if n > base and (written or age < ABANDONED):
                raise Conflict(f"{name} has a version {n} already")
            number = max(number, n + 1)
        try:
            stream = self.fs.create(self.fs_path(f"{self.root}/{name}/log/{number:020d}"), False)
        except Py4JJavaError as e:
            raise Conflict(f"{name} has a version {number} already") from e
        try:
            stream.write(bytearray(version.encode()))
        finally:
            stream.close()
        return number

    def path(self, name: str) -> str | None:
        return self._path(name, self._head(name)[1])

    def _path(self, name: str, version: str | None) -> str | None:
        return f"{self.root}/{name}/{version}" if version and version != GONE else None

    def _write_text(self, path: str, text: str) -> None:
        stream = self.fs.create(self.fs_path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    # ---- S4-S7

    def read(self, name: str) -> tuple[DataFrame, int]:
        """All records, and the number of their version, which replace asks for; 0 if there never was one."""
        number, version = self._head(name)
        at = self._path(name, version)
        return (self.spark.createDataFrame([], S.COLLECTIONS[name]) if at is None else self.spark.read.parquet(at)), number

    def scan(self, name: str) -> DataFrame:
        """All records; by id where order matters to the caller."""
        return self.read(name)[0]

    def get(self, name: str, id_: str, key: str = "id") -> DataFrame:
        """The filter reaches the Parquet reader."""
        return self.scan(name).filter(F.col(key) == id_)

    def collections(self) -> list[str]:
        """S6"""
        return [n for n in self._names(self.root, folders=True) if n != "schema" and self.path(n)]

    def raw_items(self, name: str, key: str = "id") -> DataFrame:
        """(id, data) with the record as JSON."""
        df = self.scan(name)
        return df.select(F.col(key).alias("id"), F.to_json(F.struct(*df.columns)).alias("data"))

    # ---- K1-K6

    def replace(self, name: str, rows: DataFrame, base: int) -> int:
        """A new version of the whole collection, made from version base as read gave it; refused if there is a later one.  Its number."""
        version = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.root}/{name}/{version}")
        try:
            number = self._publish(name, base, version)
        except Conflict:
            self.fs.delete(self.fs_path(f"{self.root}/{name}/{version}"), True)
            raise
        self._drop_old(name)
        return number

    def _drop_old(self, name: str) -> None:
        """Versions whose successor is older than kept seconds go."""
        after = None
        for n, written, age in self._log(name):
            if written and after is not None and after >= self.kept:
                if at := self._path(name, self._version(name, n)):
                    self.fs.delete(self.fs_path(at), True)
                self.fs.delete(self.fs_path(f"{self.root}/{name}/log/{n:020d}"), False)
            elif written:
                after = age

    def change(self, name: str, make: Callable[[DataFrame], DataFrame]) -> int:
        """A new version made from the last one; made anew from the next if another writer was faster."""

        def once() -> int:
            rows, base = self.read(name)
            return self.replace(name, make(rows), base)

        return self._tried(once)

    def overwrite(self, name: str, rows: DataFrame) -> int:
        """A new version whatever there was."""
        return self._tried(lambda: self.replace(name, rows, self._head(name)[0]))

    def _tried(self, write: Callable[[], int]) -> int:
        for _ in range(TRIES - 1):
            try:
                return write()
            except Conflict:
                continue
        return write()

    def upsert(self, name: str, rows: DataFrame, key: str = "id", order: Sequence[str] = (), now: Column | None = None) -> None:
        """K1: rows replace those of their key."""
        self.change(name, lambda old: upserted(old, rows, key, order, now))

    def delete(self, name: str, ids: DataFrame, key: str = "id") -> None:
        """K2: a key that is not there changes nothing."""
        self.change(name, lambda old: old.join(ids.select(key).distinct(), key, "left_anti"))

    def clear(self) -> None:
        """K3: every collection has no records from its next version on; the schema's version stays."""
        for name in self.collections():
            self._publish(name, self._head(name)[0], GONE)

    def write_snapshots(self, folder: str, names: Sequence[str] | None = None) -> None:
        """K4: each collection as lines of JSON in gzip files, every line a YAML document; the snapshot of an empty collection is removed."""
        for name in self.collections() if names is None else names:
            rows, at = self.scan(name), self.fs_path(f"{folder}/{name}.jsonl")
            if rows.isEmpty():
                self.fs.delete(at, True)
            else:
                rows.write.mode("overwrite").options(ignoreNullFields="false", compression="gzip", maxRecordsPerFile=SNAPSHOT_ROWS).json(str(at))

    def rebuild(self, folder: str) -> list[str]:
        """K5: every collection as its snapshot has it; the snapshots win."""
        found = read_snapshots(self.spark, folder)
        for name, rows in found.items():
            self.overwrite(name, rows)
        return sorted(found)

    def views(self, prefix: str = "") -> list[str]:
        """Views over the current versions."""
        names = self.collections()
        for n in names:
            self.scan(n).createOrReplaceTempView(prefix + n)
        return names

    def reconcile(self, name: str, rows: DataFrame, key: str = "id") -> dict[str, int]:
        """K6: make the collection equal to rows; how many keys were added, removed and kept."""
        old, base = self.read(name)
        counts = {r["status"]: r["n"] for r in reconciled(old, rows, key).groupBy("status").agg(F.count("*").alias("n")).collect()}
        self.replace(name, rows, base)
        return {k: counts.get(k, 0) for k in ("added", "removed", "kept")}

    # ---- K7-K10

    def schema_version(self) -> int:
        return int(self._head("schema")[1] or 0)

    def migrate(self, steps: dict[int, Callable[[Store], None]] | None = None, target: int = S.SCHEMA_VERSION) -> int:
        """K7: forward only: the steps of the versions above the store's, in order, each recorded when it is done."""
        at = self.schema_version()
        if at > target:
            raise ValueError(f"schema version {at} is newer than {target}")
        for version in range(at + 1, target + 1):
            base, done = self._head("schema")
            if int(done or 0) >= version:
                raise Conflict(f"another writer has taken the store to schema version {done}")
            if step := (steps or {}).get(version):
                step(self)
            self._publish("schema", base, str(version))
        return target

    def export_bundle(self, dest: str) -> dict:
        """K8: a folder with every collection's files in archives, and a manifest (bundles.py)."""
        return bundles.export(self, dest)

    def import_bundle(self, src: str) -> dict:
        """K9"""
        return bundles.load(self, src)

    def backup(self, folder: str, keep: int = 10) -> list[str]:
        """A bundle named by time; only the newest stay, all of them if keep is not positive."""
        self.export_bundle(f"{folder}/backup-{time.time_ns():020d}")
        have = [n for n in self._names(folder, folders=True) if n.startswith("backup-")]
        for name in have[:-keep] if keep > 0 else []:
            self.fs.delete(self.fs_path(f"{folder}/{name}"), True)
        return have[-keep:] if keep > 0 else have


def upserted(base: DataFrame, rows: DataFrame, key: str = "id", order: Sequence[str] = (), now: Column | None = None) -> DataFrame:
    """K1 as a DataFrame: one record for each key.  Of several rows with one key the last by order counts, then that of the largest JSON text; now stamps updated_at."""
    last = first_of_each(rows, [key], [*map(F.desc, order), F.desc(F.to_json(F.struct(*rows.columns)))])
    if now is not None and "updated_at" in rows.columns:
        last = last.withColumn("updated_at", now)
    return base.join(last.select(key), key, "left_anti").unionByName(last)


def reconciled(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """K6: every key with status added, removed or kept."""
    a = old.select(key).distinct().withColumn("__old", F.lit(True))
    b = new.select(key).distinct().withColumn("__new", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").otherwise("kept").alias("status"))


def retained(backups: DataFrame, keep: int = 10) -> DataFrame:
    """(name, keep) of backups: the newest stay."""
    if keep <= 0:
        return backups.select("name", F.lit(True).alias("keep"))
    newest = backups.select("name").orderBy(F.desc("name")).limit(keep).withColumn("keep", F.lit(True))
    return backups.select("name").join(newest, "name", "left").select("name", F.coalesce("keep", F.lit(False)).alias("keep"))


def reader_columns(name: str) -> list[str]:
    return StructType.fromDDL(S.COLLECTIONS[name]).names


def read_snapshots(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The snapshots below a folder by collection: lines of JSON or Parquet, a file or a folder; or one YAML file with a list of records.

    YAML is a mapping of ids to records or a list of records, read in ranges of bytes (blocks.py); a record without its own id has its key's.
    """
    store = Store(spark, folder)
    out = {}
    for at in [*store._names(folder, folders=False), *store._names(folder, folders=True)]:
        name, _, kind = at.partition(".")
        if name not in S.COLLECTIONS or kind not in ("jsonl", "json", "parquet", "yaml", "yml", ""):
            continue
        reader = spark.read.schema(S.COLLECTIONS[name])
        if kind in ("yaml", "yml"):
            blocks.register(spark)
            found = spark.read.format("records_yaml").load(f"{folder}/{at}").select("id", F.from_json("data", S.COLLECTIONS[name]).alias("x")).filter("x is not null")
            out[name] = found.select(*[F.coalesce("x.id", "id").alias(c) if c == "id" else f"x.{c}" for c in reader_columns(name)])
        else:
            out[name] = reader.parquet(f"{folder}/{at}") if kind in ("parquet", "") else reader.json(f"{folder}/{at}")
    return out
