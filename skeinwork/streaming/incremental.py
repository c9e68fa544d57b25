"""Incremental ingest (J11) as a stream: each micro-batch of scanned files upserts the index of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from skeinwork.operators.records import first_of_each
from skeinwork.sources.store import Store


def index_stream(files: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """files is a stream of (path, hash, language, size, raw_imports, seq); the last seq of a path wins.

    A batch that is run again writes the same rows under the same keys, so a restart changes nothing.
    """
    from pyspark.sql import functions as F

    def write(batch: DataFrame, _: int) -> None:
        newest = first_of_each(batch, ["path"], [F.desc("seq")]).drop("seq")
        store.upsert("repo_index", newest, "path")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
