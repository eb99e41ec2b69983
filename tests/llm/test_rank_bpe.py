"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from weirflow.llm import queries, rank_bpe
from weirflow.llm.common import tokenizer_path

PATH = tokenizer_path(rank_bpe.TOKENIZER)


@pytest.fixture(scope="module")
def both():
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    return rank_bpe.RankBpe(PATH), library


def texts(seed, n):
    r = random.Random(seed)
    signs = [*"aAbBéÉßİıσΣς12٣½'!?.,-_中文あ한́̈​﻿ \u0085 \x1c\x1d\x00😀🇩🇪", "the", "ing", "'s", "'LL", " ", "\n", "\t", "\r",
             "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|"]
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 50))) for _ in range(n)]


def test_ids_and_decoded_texts_equal_the_library(both):
    own, library = both
    for t in [*texts(1, 3000), "th" * 3000 + " " + "é" * 700, "!" * 2000, "", " \n", "don't we'll"]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<i4").tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("short", [0, 8, 10**9])
def test_scans_and_queues_join_the_same_pairs(both, monkeypatch, short):
    own, library = both
    monkeypatch.setattr(rank_bpe, "SHORT", short)
    r = random.Random(2)
    for n in [*range(1, 40), 127, 128, 129, 400]:
        word = "".join(r.choice("aeinrstth") for _ in range(n))
        assert own.merged(word) == library.encode(word, add_special_tokens=False).ids


def test_cache_is_emptied(both, monkeypatch):
    own, _ = both
    monkeypatch.setattr(rank_bpe, "CACHE_WORDS", 3)
    first = own.encode("one two three four five")
    assert own.encode("six one two three four five")[-len(first):] == first and len(own.known) < 9


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        rank_bpe.RankBpe(tokenizer_path("byte_bpe_50k.json"))


def test_query_over_a_table(spark, both, tmp_path):
    _, library = both
    rows = [(i, t, "x", [1]) for i, t in enumerate(texts(5, 300))]
    rows += [(None, "no id", "x", None), (500, None, "x", None), (501, "", "x", None), (502, "long words " * 40_000, "x", None), rows[0], rows[0]]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens array<int>").write.parquet(f"{tmp_path}/documents.parquet")

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i if i is not None else -1, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = queries.QUERIES["op13_rank_bpe"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_decoding_keeps_other_columns_and_forgives_nulls(spark):
    df = spark.createDataFrame([(1, [None, 320], "old", 5), (2, None, "old", 6), (3, [10**7], None, None)], "doc_id long, ids array<int>, text string, `a b` long")
    rows = {r.doc_id: r for r in rank_bpe.decode(df, PATH).collect()}
    assert rows[1].text == Tokenizer.from_file(PATH).decode([320]) and rows[1]["a b"] == 5 and rows[2].text == "" and rows[3].text == ""
    assert rank_bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
