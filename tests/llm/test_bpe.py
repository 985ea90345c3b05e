import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from linewright.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
EDGES = [None, "", " ", "a", "aa" * 3000, " " * 2500 + "x", "\x00 é😀" * 40, "don't we'll 12345 !!??", "ñ" * 300, "\n\n \t x"]


@lru_cache
def own():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return own()


def ids_of(texts):
    vocab = bpe.vocabulary(PATH, PATTERN)
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(vocab, texts, {})]


def test_edges_match_the_library(library):
    assert ids_of(EDGES) == [library.encode_ordinary(t or "") for t in EDGES]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=5))
def test_any_text_matches_the_library(texts):
    assert ids_of(texts) == [own().encode_ordinary(t) for t in texts]


def test_long_rows_merge_alike():
    vocab = bpe.vocabulary(PATH, PATTERN)
    rng = np.random.default_rng(1)
    for n in (2, 17, 200, 256):
        piece = bytes(rng.choice(list(b"thein "), n).tolist())
        ids = vocab.byte_ids[np.frombuffer(piece, np.uint8)][None, :]
        merged, lengths = bpe.merge_matrix(vocab, ids, np.array([n]))
        assert merged[0, : lengths[0]].tolist() == bpe.merge_long(vocab, piece).tolist()


def test_query_matches_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in bpe.bpe_round_trip(docs, PATH, PATTERN).collect()}
    for d in docs.collect():
        ids = library.encode_ordinary(d["text"] or "")
        r = rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_encode_decode_keep_columns(spark):
    docs = spark.createDataFrame([(1, "ab c", "x"), (2, None, "y"), (None, "", "z"), (1, "ab c", "x")], "doc_id long, text string, n_tokens string")
    encoded = bpe.bpe_encode(docs, PATH, PATTERN)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    back = bpe.bpe_decode(encoded, PATH, PATTERN).collect()
    assert sorted(r["text"] for r in back) == ["", "", "ab c", "ab c"]
    assert bpe.bpe_round_trip(docs.where("false"), PATH, PATTERN).count() == 0
