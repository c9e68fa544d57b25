"""YAML records: values of texts, ranges of files, pushed filters, writing."""

import json
import random

import pytest

from skeinwork.sources import blocks
from skeinwork.sources.blocks import loads
from skeinwork.sources.store import read_snapshots

CASES = [
    ("", None),
    ("# only a comment\n", None),
    ("a: 1\nb: -2.5\nc: true\nd: ~\ne:\nf: 1e3\ng: 0x\nh: yes", {"a": 1, "b": -2.5, "c": True, "d": None, "e": None, "f": 1000.0, "g": "0x", "h": "yes"}),
    ("---\na: x # c\nb: x#y\n...\n", {"a": "x", "b": "x#y"}),
    ("a:\n- 1\n- b: 2\n  c: 3\n-\n  - 4\n  - - 5\n    - 6\nz: []", {"a": [1, {"b": 2, "c": 3}, [4, [5, 6]]], "z": []}),
    ("a:\n  b:\n    c: d\n  e: {f: [1, 'two', \"three\"], g: h i}\n", {"a": {"b": {"c": "d"}, "e": {"f": [1, "two", "three"], "g": "h i"}}}),
    ("a: 'it''s'\nb: \"\\u00e9\\n\\x41\\\\\"\n'q k': v\n\"k:2\": w", {"a": "it's", "b": "é\nA\\", "q k": "v", "k:2": "w"}),
    ("a: one\n  two\n\n  three\nb: \"x\n  y\n\n  z\"\nc: 'p\n  q'", {"a": "one two\nthree", "b": "x y\nz", "c": "p q"}),
    ("a: |\n  x\n   y\n\n  z\n\nb: |-\n  x\nc: |+\n  x\n\nd: 1", {"a": "x\n y\n\nz\n", "b": "x", "c": "x\n\n", "d": 1}),
    ("a: >\n  x\n  y\n\n  z\n    deep\n  w\nb: >-\n  x\n  y", {"a": "x y\nz\n  deep\nw\n", "b": "x y"}),
    ("a: [1,\n  2,\n  {b: c}]\nd: e", {"a": [1, 2, {"b": "c"}], "d": "e"}),
    ("- id: a\n  n: 1\n- id: b\n", [{"id": "a", "n": 1}, {"id": "b"}]),
    ("u: http://x/y?z=1#f\nt: 2026-01-02 10:11:12\n-k: v", {"u": "http://x/y?z=1#f", "t": "2026-01-02 10:11:12", "-k": "v"}),
    ('{"a": [1, {"b": "\\ud83d\\ude00"}]}', {"a": [1, {"b": "😀"}]}),
    ("a: \"\\ud83d\\ude00\" # c", {"a": "😀"}),
    ("plain text", "plain text"),
]


@pytest.mark.parametrize("text, value", CASES)
def test_values(text, value):
    assert loads(text) == value
    assert loads(text.replace("\n", "\r\n")) == value


@pytest.mark.parametrize("text", ["a: &x 1", "a: !!str 1", "a: [1", 'a: "b', "a: 1\n   b: 2\n c: 3", "a: 'b' c", "a: [1 2] x"])
def test_what_is_not_read(text):
    with pytest.raises(ValueError):
        loads(text)


def drawn(rng, depth=0):
    pick = rng.randrange(7 if depth < 3 else 5)
    if pick < 3:
        return "".join(rng.choice("ab :#-'\"\\\n\t{}[],|>é😀\x85\u2028") for _ in range(rng.randrange(12)))
    if pick < 5:
        return rng.choice([None, True, 0, -7, 2.5, 10**20])
    if pick == 5:
        return [drawn(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {drawn(rng, 9) if rng.random() < 0.2 else f"k{k}": drawn(rng, depth + 1) for k in range(rng.randrange(4))}


def plain(v):
    if isinstance(v, dict):
        return {blocks._key(k): plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, list) else v


def block(v, indent):
    """v in block style, as a person may write it."""
    pad = " " * indent
    if isinstance(v, dict) and v:
        return "".join(f"\n{pad}{blocks._text(blocks._key(k))}:{block(x, indent + 2)}" for k, x in v.items())
    if isinstance(v, list) and v:
        return "".join(f"\n{pad}-{block(x, indent + 2)}" for x in v)
    return " " + blocks._text(v)


def test_drawn_values_in_block_and_flow_style():
    rng = random.Random(5)
    for _ in range(400):
        v = plain(drawn(rng))
        assert loads(block(v, 0).lstrip("\n")) == v
        assert loads("k: " + blocks._text(v)) == {"k": v}


def test_ranges_of_files(spark, tmp_path):
    blocks.register(spark)
    rng = random.Random(6)
    records = {f"id {k}": {"n": k, "x": plain(drawn(rng))} for k in range(60)}
    body = "".join(f"{blocks._text(k)}:{block(v, 2)}\n" for k, v in records.items())
    (tmp_path / "nodes.yaml").write_text("# head\n---\n" + body, encoding="utf-8")
    (tmp_path / "edges.yml").write_text("- id: e1\n  l:\n  - 1\n- n: 2\n\n- id: 3\n", encoding="utf-8")
    (tmp_path / "cards.json.yaml").write_text('[{"id": "c"},\n {"id": "d"}]', encoding="utf-8")
    (tmp_path / "empty.yaml").write_text("")
    (tmp_path / "_hidden.yaml").write_text("a: 1")
    for size in (1, 7, 100, 1000, 1 << 20):
        reader = blocks.RangeReader({"path": str(tmp_path), "rangeBytes": size})
        got = [r for p in reader.partitions() for r in reader.read(p)]
        if size >= 1000:
            df = spark.read.format("records_yaml").option("rangeBytes", size).load(str(tmp_path))
            got = [tuple(r) for r in df.collect()]
        assert {i: json.loads(d) for c, i, d in got if c == "nodes"} == records
        assert sorted((c, i or "") for c, i, _ in got if c != "nodes") == [("cards", "c"), ("cards", "d"), ("edges", ""), ("edges", "3"), ("edges", "e1")]
        assert len(got) == len(records) + 5
    one = df.filter("collection = 'nodes' and id in ('id 7', 'id 8', 'none') and length(data) > 0")
    assert sorted(r.id for r in one.collect()) == ["id 7", "id 8"]
    assert df.filter("collection = 'edges'").rdd.getNumPartitions() == 1


def test_pushed_filters_choose_files_and_skip_bodies(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    (tmp_path / "a.yaml").write_text("x: {v: 1}\nbroken: [\ny: 2\n")
    (tmp_path / "b.yaml").write_text("x: 3\n")
    reader, rest = blocks.RangeReader({"path": str(tmp_path)}), GreaterThan(("data",), "")
    assert list(reader.pushFilters([EqualTo(("collection",), "a"), In(("id",), ("x", "y")), rest])) == [rest]
    parts = reader.partitions()
    assert [p.collection for p in parts] == ["a"]
    assert list(reader.read(parts[0])) == [("a", "x", '{"v": 1}'), ("a", "y", "2")]  # broken is not asked for
    with pytest.raises(ValueError):
        list(blocks.RangeReader({"path": str(tmp_path)}).read(parts[0]))


def test_written_records_come_back(spark, tmp_path):
    blocks.register(spark)
    rng = random.Random(7)
    rows = [(f"c{k % 2}", f"i:{k}\n", json.dumps(plain(drawn(rng)), sort_keys=True, ensure_ascii=False)) for k in range(80)] + [("c0", "none", None)]
    at = str(tmp_path / "out")
    df = spark.createDataFrame(rows, blocks.COLUMNS)
    for mode in ("append", "overwrite"):
        df.repartition(3).write.format("records_yaml").mode(mode).save(at)
        back = spark.read.format("records_yaml").load(at).collect()
        assert sorted(tuple(r) for r in back) == sorted((c, i, d or "null") for c, i, d in rows)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["c0.yaml", "c1.yaml"]


def test_snapshots_in_block_style(spark, tmp_path):
    (tmp_path / "nodes.yaml").write_text("n1:\n  created_at: '2026-01-02T00:00:00Z'\n  label: app\n  type: Module\nn2:\n  id: own\n  label: |-\n    two\n    lines\n")
    got = read_snapshots(spark, str(tmp_path))["nodes"].collect()
    assert sorted((r.id, r.label, r.type) for r in got) == [("n1", "app", "Module"), ("own", "two\nlines", None)]
