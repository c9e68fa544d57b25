"""Pieces with spans, phrase collocations and resampling against the library, SQL and plain counting."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skeinwork.llm import phrases, pieces, resample
from skeinwork.llm.perfect_hash import PerfectHash
from skeinwork.llm.runtime import tokenizer_path

DIR = os.environ.get("SKEINWORK_TEST_DIR", "/root/testdata/sf0.001")
ODD = ["", " ", "  ", "a", " a", "a ", "▁", "▁▁a▁", "a\nb", "<s>x</s>", "<0x0A>", "\0a", "日本語テスト" * 30, "😀́", "  a  b ", "\x0b", "\t\t x\n\n", "é é", "x" * 500, " " * 40 + "a"]


def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# ---- pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces.MODEL))


def made_up(n, seed=5):
    rng = random.Random(seed)
    letters = list("abcdeth  \n▁é日😀.,0-<>\t")
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(n)]


def test_pieces_are_the_librarys(library):
    texts = made_up(300)
    bpe = pieces.PieceBpe(tokenizer_path(pieces.MODEL))
    for x, (ids, ends) in zip(texts, bpe.encode_many(texts), strict=True):
        assert ids.tolist() == library.encode(x, add_eos=True)
        assert bpe.decode(ids) == library.decode(ids.tolist())
        assert ends.tolist() == [*(p.end for p in library.encode(x, return_type="proto").pieces), len(x.encode())]


def test_both_ways_of_merging_agree():
    bpe, rng = pieces.PieceBpe(tokenizer_path(pieces.MODEL)), random.Random(3)
    for _ in range(300):
        x = ["▁", *(rng.choice("theranio▁") for _ in range(rng.randrange(40)))]
        assert bpe._merge_short(list(x)) == bpe._merge_long(list(x))


def test_character_map_is_the_librarys():
    import sentencepiece

    whole = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    own = pieces.Normaliser(dict(pieces.fields(whole.serialized_model_proto()))[3])
    rng = random.Random(4)
    for _ in range(300):
        x = "".join(rng.choice("abＡﬁ①  é　ｶﾞ가각ﾊﾟ́e½™\t\n") for _ in range(rng.randrange(40)))
        text, align = own.normalise(x)
        assert text.replace(" ", "▁") == whole.normalize(x)
        assert len(align) == len(text.replace(" ", "▁").encode()) + 1
        assert np.all(np.diff(align) >= 0) and align[-1] <= len(x.encode())
    text, align = own.normalise("ﬁ Ａ")  # a ligature becomes two letters, a wide letter a narrow one
    assert (text, align.tolist()) == (" fi A", [0, 0, 0, 0, 0, 3, 3, 3, 4, 7])


def test_piece_rows(spark, library):
    texts = [None, *made_up(20), "a", "a"]
    rows = spark.createDataFrame([(k, x, "y", 1) for k, x in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    got = {r["doc_id"]: r for r in pieces.encode_decode(rows).collect()}
    for k, x in enumerate(texts):
        assert got[k]["ids"] == library.encode(x or "", add_eos=True)
        raw = (x or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(got[k]["starts"], got[k]["ends"], strict=True)) == raw
    for r in pieces.digests(rows).collect():
        ids = got[r["doc_id"]]["ids"]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(got[r["doc_id"]]["decoded"].encode()).hexdigest()
    assert pieces.digests(docs_of(spark, [])).count() == 0


def test_a_small_table_of_parts_changes_nothing(library):
    texts = made_up(100)
    bpe = pieces.PieceBpe(tokenizer_path(pieces.MODEL), kept=50)
    assert [i.tolist() for i, _ in bpe.encode_many(texts)] == [library.encode(x, add_eos=True) for x in texts]


# ---- phrases


def brute_phrases(rows, least, longest, first):
    found, total = {}, Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            c = found.setdefault(lang, Counter())
            c.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, c in found.items():
        often = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        inside = {p[i : i + k]: a for p, a in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if c[p[i : i + k]] == a}
        rows_ = []
        for p, a in often.items():
            if p in inside:
                continue
            score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((lang, " ".join(p), a, c[p[:k]], c[p[k:]], total[lang], score))
        rows_.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], n, *r[1:]) for n, r in enumerate(rows_[:first], 1)]
    return out


def phrase_texts(seed, n=60):
    rng = random.Random(seed)
    words = [*"abcdefgh", "Up", "ünd", "x-y"]
    return [(rng.choice(["en", "de", None]), None if k % 17 == 0 else "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ", ", "\n", ".\t"]) for _ in range(rng.randrange(200)))) for k in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"WORDS": 3, "PHRASES": 7, "CHUNK": 4, "SORTED": 10, "HELD": 50, "ARMS": 2}])
def test_phrases_are_those_of_plain_counting(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(phrases, k, v)
    rows = phrase_texts(1)
    docs = spark.createDataFrame([(a, b, "p", 3) for a, b in rows], "lang string, text string, phrase string, slot int").repartition(5)
    got = phrases.collocations(docs, least=8, first=20)
    cols = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(brute_phrases(rows, 8, 5, 20))


def test_phrases_of_nothing(spark):
    for rows in ([], [(None, None)], [("en", "once only here")]):
        assert phrases.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 40, (5000, 2)), axis=0)
    h = PerfectHash(keys[:, 0], keys[:, 1])
    slots = h.find(keys[:, 0], keys[:, 1])
    assert sorted(slots.tolist()) == list(range(len(keys)))
    order = rng.permutation(len(keys))
    assert (PerfectHash(keys[order, 0], keys[order, 1]).find(keys[:, 0], keys[:, 1]) == slots).all()
    others = rng.integers(1 << 41, 1 << 42, (5000, 2))
    assert (h.find(others[:, 0], others[:, 1]) == -1).all()
    assert PerfectHash(keys[:0, 0], keys[:0, 1]).find(keys[:5, 0], keys[:5, 1]).tolist() == [-1] * 5
    with pytest.raises(ValueError):
        PerfectHash(np.array([1, 1]), np.array([2, 2]))


# ---- resampling


def brute_resample(docs, target, percent=10, least=20, buckets=10000, longest=1):
    def feats(x):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        runs = [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
        return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]

    own, want = Counter(), Counter()
    for _, x in docs:
        own.update(feats(x)[1])
    for x in target:
        want.update(feats(x)[1])
    s_all, t_all = sum(own.values()), sum(want.values())
    rows = []
    for k, x in docs:
        n, f = feats(x)
        w = sum(math.floor(1000 * math.log((want[b] + 1) * (s_all + buckets) / ((own[b] + 1) * (t_all + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{k}".encode()).hexdigest()[:8], 16)
        rows.append((k, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: n for n, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted((r[0], r[2], r[3], r[4], rank.get(r[0])) for r in rows)


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 50), (1, 100), (1, 0)])
def test_resampling_is_that_of_plain_sorting(spark, longest, percent):
    rng = random.Random(longest)
    words = [*"abcdefghij", "Ünd", "x_y", "A1"]
    docs = [(k, None if k == 3 else " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(-50, 150)]
    target = [None, "a a b ünd", "c x y"]
    rows = spark.createDataFrame([(k, x, 0, "s") for k, x in docs], "doc_id long, text string, rank int, score string").repartition(6)
    got = resample.resample(rows, spark.createDataFrame([(x,) for x in target], "text string"), percent, longest=longest)
    assert sorted(tuple(r) for r in got.collect()) == brute_resample(docs, target, percent, longest=longest)


def test_selection_is_exact_among_ties(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(3), rng.choice([-1, 0, 1 << 40, -(1 << 63), (1 << 63) - 1]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    for k in (0, 1, 7, 250, 499, 500, 900):
        got = df.filter(resample.smallest(df, ["a", "b", "c"], k)).collect()
        assert sorted(map(tuple, got)) == sorted(rows)[:k]
    ranks = resample.ranked(df, ["a", "b", "c"]).collect()
    assert [tuple(r)[:3] for r in sorted(ranks, key=lambda r: r["rank"])] == sorted(rows)
    assert sorted(r["rank"] for r in ranks) == list(range(1, 501))


def test_resampling_of_odd_rows(spark):
    words = " ".join("abcdefghijklmnopqrstuvwxyz")
    rows = docs_of(spark, [(None, words), (5, words), (5, words), (5, None), (None, None)])
    got = resample.resample(rows, docs_of(spark, []), 100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and len(got) == 5
    assert resample.resample(docs_of(spark, []), docs_of(spark, []), 50).count() == 0


# ---- twins


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
@pytest.mark.parametrize("name", ["op12_collocations", "op13_resampling"])
def test_twin(spark, name):
    import duckdb

    from skeinwork.llm import queries as Q

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    twin, df = c.sql(Q.oracle_sql()[name]), Q.queries()[name](spark, DIR)
    assert sorted(twin.columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*twin.columns).collect()))) == sorted(map(repr, twin.fetchall()))
