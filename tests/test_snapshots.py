"""Snapshots are small on disk, and no task has to read a large file of them."""

import gzip
import json
from pathlib import Path

from skeinwork.sources import store


def test_snapshots_are_compressed_files_of_bounded_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SNAPSHOT_ROWS", 400)
    s, folder = store.Store(spark, str(tmp_path / "s")), tmp_path / "snap"
    made = spark.range(1000).coalesce(1).selectExpr("concat('state:k', id) AS id", "'attr' AS kind", "if(id % 2 = 0, concat('k', id), null) AS label", "'state.py' AS file", "timestamp_seconds(id) AS created_at")
    s.overwrite("df_nodes", made)
    s.write_snapshots(str(folder))
    files = sorted(Path(folder, "df_nodes.jsonl").glob("part-*"))
    lines = [gzip.decompress(f.read_bytes()).decode().splitlines() for f in files]
    assert sorted(map(len, lines)) == [200, 400, 400]
    assert sum(f.stat().st_size for f in files) * 5 < sum(len(x) + 1 for f in lines for x in f)
    assert {"id", "kind", "label", "file", "created_at"} == set(json.loads(lines[0][1]))
    back = store.read_snapshots(spark, str(folder))["df_nodes"]
    assert back.exceptAll(made).isEmpty() and made.exceptAll(back).isEmpty()
