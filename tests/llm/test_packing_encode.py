"""Packing encodes texts by columns: the library's ids, and few calls for new words."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from skeinwork.llm import bpe
from skeinwork.llm.runtime import tokenizer_path


def _ids(encoder, texts):
    return [np.array(e.ids, np.uint32).tobytes() for e in encoder.lib.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_columns_give_the_librarys_ids():
    encoder = bpe.WordBpe(tokenizer_path(), speculate=False)
    odd = [None, "", " ", "a", "İx y", "A<|endoftext|>b", "don't 's 'S x's. 5th a.5,b'' 'll \x1c z", "ÀÉ ǅ ŉ ß ſ Ə", "tail's'll.", "a\x85b\xa0c", "日本語 é", "»... ###", " lead trail \n"]
    rnd = random.Random(5)
    below, common = [chr(c) for c in range(9, 0x250)], [*"abcXYZ'..,,  ''12»«é#&\n\t", "'s", "'ll"]
    odd += ["".join(rnd.choices(below if k % 3 == 0 else common, k=rnd.randrange(60))) for k in range(3000)]
    texts = pa.array(odd, pa.string())
    assert encoder.encode_column(texts) == _ids(encoder, odd)
    assert encoder.encode_column(texts.slice(3, 9)) == _ids(encoder, odd[3:12])
    assert encoder.encode_column(texts.slice(0, 0)) == []
    small = bpe.WordBpe(tokenizer_path(), words_kept=20, speculate=False)
    assert [r for k in range(0, len(odd), 100) for r in small.encode_column(texts.slice(k, 100))] == _ids(encoder, odd)


def test_new_words_are_merged_together():
    encoder, called = bpe.WordBpe(tokenizer_path(), speculate=False), Counter()
    one, many = encoder._exact_bytes, encoder._exact_many
    encoder._exact_bytes = lambda w: (called.update(one=1), one(w))[1]
    encoder._exact_many = lambda ws: (called.update(many=1, words=len(ws)), many(ws))[1]
    texts = [f"Word{chr(97 + k % 26)}{chr(97 + k // 26)}, word{chr(97 + k % 26)}{chr(97 + k // 26)}." for k in range(500)]
    encoder._encode(["plain"])
    assert encoder.encode_column(pa.array(texts)) == _ids(encoder, texts)
    # The words in one call and the marks in another, and no word by itself.
    assert called == {"many": 3, "words": 1 + 500 + 2}
