"""Bundles of a store (K8, K9): a folder that executors write and read; no table bytes go through the driver.

segments/*.tar are whole archives, one for each writing task, whose members are the files of the collections; index/ holds for each member its
segment, the offset of its header, its length and its SHA-256; manifest.json holds the schema's version, the names of the collections, the
number of members and a digest of the index.  The manifest is written last: a folder without one is no bundle.
"""

from __future__ import annotations

import hashlib
import json
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork import schemas as S
from skeinwork.sources.files import opened

#: Bytes of one segment, about; the number of tasks follows from it.
SEGMENT = 256 << 20
MEMBER = "member string, collection string, segment string, offset long, length long, sha256 string"


class Damaged(ValueError):
    """A bundle does not hold what its manifest says."""


class _Hashed:
    """A stream that digests what is read from it."""

    def __init__(self, stream):
        self.stream, self.sha, self.length = stream, hashlib.sha256(), 0

    def read(self, n: int = -1) -> bytes:
        data = self.stream.read(n)
        self.sha.update(data)
        self.length += len(data)
        return data


def is_safe_member(name: str) -> bool:
    """Flat names below snapshots/ only."""
    head, _, rest = name.partition("/")
    return head == "snapshots" and bool(rest) and "/" not in rest and "\\" not in rest and not rest.startswith("..")


def _digest(index: DataFrame) -> tuple[int, int]:
    """Number of members and a digest that does not depend on their order."""
    r = index.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("member", "segment", "offset", "length", "sha256")), F.lit(0)).alias("digest")).first()
    return r["n"], r["digest"]


def export(store, dest: str) -> dict:
    """K8: the current versions of all collections; the manifest.  An empty store gives a bundle without members."""
    spark, names = store.spark, store.collections()
    listed = []  # one row for each file, as a scan of the collection would list them
    for name in names:
        for f in store.fs.listStatus(store.fs_path(store.path(name))):
            if f.getPath().getName().endswith(".parquet"):
                listed.append((name, f.getPath().getName(), f.getPath().toString(), f.getLen()))
    segments = f"{store.fs.makeQualified(store.fs_path(dest)).toString()}/segments"
    tasks = max(1, min(len(listed), max(spark.sparkContext.defaultParallelism, -(-sum(r[3] for r in listed) // SEGMENT))))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, (fs, top) = [r for b in batches for r in b.to_pylist()], opened(segments)
        if not rows:
            return
        segment, out = f"{uuid.uuid4().hex}.tar", []
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/{segment}") as sink, tarfile.open(fileobj=sink, mode="w|", format=tarfile.GNU_FORMAT) as tar:
            for r in rows:
                info = tarfile.TarInfo(f"snapshots/{r['collection']}~{r['file']}")
                info.size, at, (source, path) = r["length"], tar.offset, opened(r["uri"])
                with source.open_input_stream(path) as f:
                    body = _Hashed(f)
                    tar.addfile(info, body)
                out.append((info.name, r["collection"], segment, at, body.length, body.sha.hexdigest()))
        columns = [c.split() for c in MEMBER.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if t == "long" else pa.string()) for k, (_, t) in enumerate(columns)], [n for n, _ in columns])

    files = spark.createDataFrame(listed, "collection string, file string, uri string, length long").repartition(tasks)
    files.mapInArrow(write, MEMBER).write.json(f"{dest}/index")
    index = spark.read.schema(MEMBER).json(f"{dest}/index")
    used = {r[0] for r in index.select("segment").distinct().collect()}  # as many as there were tasks
    for n in set(store._names(f"{dest}/segments", folders=False)) - used:  # of tasks that ran twice
        if n.endswith(".tar"):
            store.fs.delete(store.fs_path(f"{dest}/segments/{n}"), False)
    members, digest = _digest(index)
    manifest = {"schema_version": S.SCHEMA_VERSION, "collections": names, "members": members, "digest": digest}
    store._write_text(f"{dest}/manifest.json", json.dumps(manifest))
    return manifest


def load(store, src: str) -> dict:
    """K9: the bundle's collections become the store's next versions; others stay.

    Refused with ValueError before anything is published: a newer schema, a changed index, a member whose bytes or name are not the index's.  Only
    flat names below snapshots/ are taken.
    """
    spark = store.spark
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{src}/manifest.json", wholetext=True).collect()))  # a few names
    if manifest["schema_version"] > S.SCHEMA_VERSION:
        raise ValueError(f"bundle schema {manifest['schema_version']} is newer than {S.SCHEMA_VERSION}")
    index = spark.read.schema(MEMBER).json(f"{src}/index")
    if _digest(index) != (manifest["members"], manifest["digest"]):
        raise Damaged(f"the index of {src} is not that of its manifest")
    staged = f"{store.root}/import-{uuid.uuid4().hex}"
    segments, target = (store.fs.makeQualified(store.fs_path(p)).toString() for p in (f"{src}/segments", staged))
    names = set(manifest["collections"]) & set(S.COLLECTIONS)

    def fetched(r: dict) -> bool:
        """Whether a member's name and bytes are the index's; its file is then staged."""
        (source, top), (fs, home) = opened(segments), opened(target)
        place = f"{home}/{r['collection']}"
        fs.create_dir(place, recursive=True)
        aside = f"{place}/.{uuid.uuid4().hex}"
        try:
            with source.open_input_file(f"{top}/{r['segment']}") as f:
                f.seek(r["offset"])
                with tarfile.open(fileobj=f, mode="r|") as tar:
                    info = tar.next()
                    if info is None or info.name != r["member"] or info.size != r["length"] or not info.isfile():
                        return False
                    body = _Hashed(tar.extractfile(info))
                    with fs.open_output_stream(aside) as sink:
                        while data := body.read(1 << 20):
                            sink.write(data)
        except (tarfile.TarError, OSError, EOFError):
            return False
        if (body.length, body.sha.hexdigest()) != (r["length"], r["sha256"]):
            return False
        fs.move(aside, f"{place}/{r['member'].partition('~')[2]}")
        return True

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for r in b.to_pylist() if is_safe_member(r["member"]) and r["collection"] in names and r["member"].startswith(f"snapshots/{r['collection']}~")]
            good = [fetched(r) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in ("collection", "member")] + [pa.array(good, pa.bool_())], ["collection", "member", "good"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-(index.agg(F.sum("length")).first()[0] or 0) // SEGMENT))
    try:
        done = index.repartition(tasks, "segment", "offset").mapInArrow(read, "collection string, member string, good boolean").groupBy("collection")
        found = done.agg(F.min(F.when(~F.col("good"), F.col("member"))).alias("bad")).collect()  # one row for each collection
        if bad := [r["bad"] for r in found if r["bad"] is not None]:
            raise Damaged(f"damaged: {', '.join(sorted(bad))}")
        for r in sorted(found):
            store.overwrite(r["collection"], spark.read.parquet(f"{staged}/{r['collection']}"))
    finally:
        store.fs.delete(store.fs_path(staged), True)
    return manifest
