"""The lexical order of packing is fitted on all documents, and its encoder's table is bounded."""

import random

import numpy as np

from skeinwork.llm import bpe, packing
from skeinwork.llm.runtime import tokenizer_path


def test_order_is_fitted_on_all_documents(spark):
    rng = random.Random(5)
    docs = [np.array([rng.randrange(40) * 3 + d % 3 for _ in range(30)] + [1], np.uint32) for d in range(5000)]
    docs[4999] = np.array([7] * 5000 + [500, 1], np.uint32)  # a term at the end of a long document only
    tokens = spark.createDataFrame([(d.tobytes(),) for d in docs], "ids binary").repartition(5)
    df, n = packing._frequencies(tokens, 3)
    assert n == 5000 and len(df) == 501
    assert df.tolist() == np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=501).tolist()

    order, at = packing._order(tokens, 3)
    flat, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    x = order.vectors(flat, sizes)
    places = order.cells_of(x) * packing.RUNS + order.runs(flat, sizes)
    want = np.bincount(places, sizes)
    assert at == {k: int(want[k]) for k in np.flatnonzero(want).tolist()}

    # The same rounds over all vectors in one piece: sums are exact, so the centroids are the same however the documents lie.
    other, _ = packing._order(tokens.repartition(2), 1)
    assert np.array_equal(order.cells, other.cells) and np.array_equal(order.coarse, other.coarse)
    cell = order.cells_of(x)
    n = np.bincount(cell, minlength=len(order.cells))
    total = np.zeros((len(n), packing.DIMS), np.int64)
    np.add.at(total, cell, x)
    order.move(n, total)
    k = int(n.argmax())
    assert np.allclose(order.cells[k], x[cell == k].mean(axis=0) / packing.UNIT)


def test_a_small_table_of_words_gives_the_same_ids():
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)) for _ in range(60)]
    small, large = (bpe.WordBpe(tokenizer_path(), words_kept=k, speculate=False) for k in (2000, 1_000_000))
    for at in range(0, 60, 3):
        assert small.encode_many(texts[at : at + 3]) == large.encode_many(texts[at : at + 3])
        assert len(small.chunks) + len(small.older) <= 2000 + 2 * 3 * 400
    assert len(large.chunks) > 10_000
