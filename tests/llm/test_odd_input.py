"""Empty tables, null and repeated ids, null, empty and very long texts, and clashing column names, for every operator on texts and the stages."""

import sys
from pathlib import Path

import pytest

from skeinwork.llm import ann, bpe, ngram_join, packing, pii, quality, suffix_dedup, token_counts

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

#: Names that the operators use themselves.
SCHEMA = "doc_id bigint, text string, row string, ids string, spans string, bucket string, n string, kept string"
LONG = "x" * 1_000_000
TEXTS = [(None, "the word of it"), (None, None), (1, ""), (2, "the word of it"), (2, "the word of it"), (3, LONG), (4, "and the " * 60_000), (5, "\n \t")]
OPS = {
    "join": lambda d: ngram_join.join(d),
    "packing": lambda d: packing.pack(d),
    "quality": lambda d: quality.judge(d),
    "dedup": lambda d: suffix_dedup.digests(d),
    "bpe": lambda d: bpe.digests(d),
    "pii": lambda d: pii.digests(d),
    "tokens": lambda d: token_counts.count(d),
}


def table(spark, rows):
    return spark.createDataFrame([(k, x, "r", "i", "s", "b", "n", "k") for k, x in rows], SCHEMA)


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    assert OPS[name](table(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPS)
def test_odd_rows(spark, name):
    got = OPS[name](table(spark, TEXTS)).collect()
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in got)
    if name == "packing":
        assert set(ids) == {-1, 1, 2, 3, 4, 5}
        # Every row is packed whole: of each id, pieces add up to its rows' tokens.
        for k, copies in ((2, 2), (3, 1), (4, 1)):
            mine = [r for r in got if r.doc_id == k]
            assert sum(r.length for r in mine) == copies * mine[0].doc_tokens
        return
    assert ids == [-1, -1, 1, 2, 2, 3, 4, 5]
    by = {r.doc_id: r for r in got}
    two = [tuple(r) for r in got if r.doc_id == 2]
    assert two[0] == two[1]
    if name == "quality":
        assert (by[1].n_words, by[3].n_words, by[3].word_chars, by[4].n_words) == (0, 1, 1_000_000, 120_000) and by[4].base_failed
    if name == "dedup":
        assert by[3].n_removed == 1_000_000 - 1 and by[4].n_removed == 480_000 - 8 and by[1].n_bytes == 0
    if name == "bpe":
        assert by[1].n_tokens == 0 and by[5].n_tokens == 0 and by[4].n_tokens == 120_000
    if name == "join":
        assert by[2].component_id == 2 and by[1].n_shingles == 0 and by[1].component_id == 1
    if name == "pii":
        assert by[3].spans == "" and by[1].n_email == 0
    if name == "tokens":
        assert by[3].n_pretokens == 1 and by[4].n_pretokens == 120_000


def test_pii_in_a_very_long_text(spark):
    text = "7" * 300_000 + " a@" + "b" * 300_000 + ".com " + "+" * 200_000 + " 1.2.3.4"
    found = pii.spans_of(text)
    assert [k for _, _, k in found] == ["email", "ip"] and found[0][0] == 300_001


def test_neighbours_of_odd_rows(spark):
    schema = "vec_id bigint, embedding array<double>, row string, rank string, score string, block string"
    assert ann.search(spark.createDataFrame([], schema)).collect() == []
    v = [[1.0, 0.0, 2.0, 1.0], [0.5, 1.0, 0.0, 1.0], None, [0.0] * 4, [1.0, None, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, 0.0, 2.0, 1.0]]
    rows = [(k, x, "r", "k", "s", "b") for k, x in zip((0, 1, 2, 3, 4, 5, None), v, strict=True)] + [(20, [0.5, 1.0, 0.0, 1.0], "r", "k", "s", "b")] * 2
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(spark.createDataFrame(rows, schema)).collect())
    # Equal vectors are tied and the smaller id comes first; rows of the query's own id are no candidates, repeated ones are candidates each.
    assert got == [(0, 1, 1), (0, 2, 20), (0, 3, 20), (20, 1, 1), (20, 2, 0)]


def test_stages_on_an_empty_table(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, row string")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == names
    assert docs.collect() == []


def test_stages_on_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, TEXTS)
    for name, stage in corpus_pipeline.STAGES:
        if name != "quality rules":
            out = stage(spark, docs, str(tmp_path))
            assert out.count() > 0 and (name == "packing" or out.columns == docs.columns)
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).count() == 0
