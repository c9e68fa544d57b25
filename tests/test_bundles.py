"""Bundles: written and read by tasks, refused where damaged."""

import json
import tarfile

import pytest

from skeinwork.sources import bundles
from skeinwork.sources.store import Store

EDGE = "id string, src_id string, dst_id string, type string, props string, created_at timestamp"


@pytest.fixture
def source(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.overwrite("nodes", spark.range(500).selectExpr("concat('n', id) id", "'File' type", "concat('é ', id) label", "string(null) props", "timestamp_seconds(id) created_at", "timestamp_seconds(id) updated_at").repartition(7))
    s.overwrite("edges", spark.createDataFrame([("e", "n1", "n2", "contains", None, None)], EDGE))
    return s


def files(spark, df):
    return sorted(map(str, df.collect()))


def test_round_trip(spark, tmp_path, source):
    at = str(tmp_path / "bundle")
    manifest = source.export_bundle(at)
    assert manifest["collections"] == ["edges", "nodes"] and manifest["members"] >= 8
    archives = sorted((tmp_path / "bundle" / "segments").glob("*.tar"))
    assert len(archives) > 1  # several tasks wrote
    index = {r.member: r for r in spark.read.schema(bundles.MEMBER).json(f"{at}/index").collect()}
    listed = {}
    for a in archives:  # each is an archive for any reader
        with tarfile.open(a) as tar:
            listed |= {m.name: (a.name, m.offset, m.size) for m in tar.getmembers()}
    assert listed == {m: (r.segment, r.offset, r.length) for m, r in index.items()}
    t = Store(spark, str(tmp_path / "t"))
    t.overwrite("df_nodes", spark.createDataFrame([("kept", None, None, None, None)], "id string, kind string, label string, file string, created_at timestamp"))
    t.overwrite("edges", spark.createDataFrame([], EDGE))
    assert t.import_bundle(at) == manifest
    for n in ("nodes", "edges"):
        assert files(spark, t.scan(n)) == files(spark, source.scan(n))
    assert t.collections() == ["df_nodes", "edges", "nodes"] and t.scan("df_nodes").count() == 1


def damage_bytes(at, index):
    r = next(r for r in index if r["collection"] == "nodes")
    path = at / "segments" / r["segment"]
    body = bytearray(path.read_bytes())
    body[r["offset"] + 512 + r["length"] // 2] ^= 1
    path.write_bytes(body)


def damage_name(at, index):
    path = at / "segments" / index[0]["segment"]
    body = path.read_bytes().replace(b"snapshots/", b"snapshotz/")
    path.write_bytes(body)


def cut_short(at, index):
    r = max(index, key=lambda r: r["offset"])
    path = at / "segments" / r["segment"]
    path.write_bytes(path.read_bytes()[: r["offset"] + 600])


def lose(at, index):
    (at / "segments" / index[0]["segment"]).unlink()


def change_index(at, index):
    part = next(p for p in (at / "index").glob("*.json") if p.stat().st_size)
    lines = part.read_text().splitlines()
    part.write_text("\n".join(lines[1:]))
    (at / "index" / f".{part.name}.crc").unlink(missing_ok=True)


@pytest.mark.parametrize("harm", [damage_bytes, damage_name, cut_short, lose, change_index])
def test_damage_is_refused(spark, tmp_path, source, harm):
    at = tmp_path / "bundle"
    source.export_bundle(str(at))
    harm(at, [json.loads(line) for p in sorted((at / "index").glob("*.json")) for line in p.read_text().splitlines()])
    t = Store(spark, str(tmp_path / "t"))
    with pytest.raises(bundles.Damaged):
        t.import_bundle(str(at))
    assert t.collections() == []
    assert not [p for p in (tmp_path / "t").glob("import-*")] if (tmp_path / "t").exists() else True


def test_newer_schema_and_empty_store(spark, tmp_path, source):
    empty = Store(spark, str(tmp_path / "none"))
    assert empty.export_bundle(str(tmp_path / "e"))["members"] == 0
    assert source.import_bundle(str(tmp_path / "e"))["collections"] == [] and source.scan("nodes").count() == 500
    head = tmp_path / "e" / "manifest.json"
    head.write_text(head.read_text().replace('"schema_version": 1', '"schema_version": 99'))
    (tmp_path / "e" / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="newer"):
        source.import_bundle(str(tmp_path / "e"))
    assert len(source.backup(str(tmp_path / "b"), 2)) == 1 and len(source.backup(str(tmp_path / "b"), 2)) == 2 and len(source.backup(str(tmp_path / "b"), 2)) == 2
