"""The stages of the pipeline, one after the other, on a small corpus with planted cases."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    common = "the of and to in a is that for it was on with as be by this are from at".split()

    def prose(n):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnr") + rng.choice("aeiou") + rng.choice("st") for _ in range(n)) + "."

    passage = prose(70)
    texts = [prose(200) for _ in range(20)]
    near = texts[3].split()
    near[100] = "changed"
    texts += [texts[2], " ".join(near), f"{prose(80)} {passage} {prose(60)}", f"{prose(90)} {passage} {prose(70)}", f"{prose(100)} joe@mail.example.com {prose(20)}", " ".join(w.upper() + "!!" for w in prose(100).split()), "short", None]
    df = spark.createDataFrame([(k, x, "en", "s", len(x or "")) for k, x in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "PII", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["quality rules"]) == set(range(25))
    assert set(seen["n-gram Jaccard join"]) == set(range(25)) - {20, 21}
    assert passage in seen["suffix-array dedup"][22] and passage not in seen["suffix-array dedup"][23]
    assert seen["suffix-array dedup"][5] == texts[5]
    assert "[email]" in seen["PII"][24] and "joe@" not in seen["PII"][24]
    total = docs.groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in total} == set(seen["PII"])
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.drop("sequence_id", "offset").collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    rng = random.Random(12)
    common = "the of and to in a is that for it was on with as be by this are from at".split()

    def prose(n):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnr") + rng.choice("aeiou") + rng.choice("st") for _ in range(n)) + "."

    a, b, c, passage = prose(200), prose(200), prose(200), prose(70)
    d, e, f = f"{prose(80)} {passage} {prose(60)}", f"{prose(90)} {passage} {prose(70)}", f"{prose(70)} {passage} {prose(80)}"
    rows = [(k, prose(200)) for k in range(20)]
    # 30: a clean text and a bad one; 31: a row twice; 32: two texts; without an id: a new text, a copy of one with an id, a repeated passage.
    rows += [(30, a), (30, "short"), (31, b), (31, b), (32, d), (32, e), (None, c), (None, a), (None, f)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text"]
        seen.append([tuple(r) for r in docs.collect() if r.doc_id is None or r.doc_id >= 30])
    assert sorted(seen[0], key=str) == sorted([r for r in rows[20:] if r[1] != "short"], key=str)
    assert sorted(seen[1], key=str) == sorted([(30, a), (31, b), (32, d), (32, e), (None, c), (None, f)], key=str)
    assert {(30, a), (31, b), (None, c)} <= set(seen[2]) and len(seen[2]) == 6
    assert sum(passage in x for k, x in seen[2] if k == 32) == 1 and not any(passage in x for k, x in seen[2] if k is None)
