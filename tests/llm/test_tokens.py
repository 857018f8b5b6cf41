"""Token counts and ids against the tokenizers library itself; packing and
shard output against their invariants."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tracehound.llm import packing, token_count, token_shards, tokens  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
COUNTER = token_count.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
BYTES = tokens.ByteTokens(*tokens.default_paths())

ODD = [
    "", " ", "\n\n  \t", "Hello, World! 123 don't we'll I'M", "ÉCOLE école İstanbul ΣΊΣΥΦΟΣ ΟΔΟΣ", "<|endoftext|>", "a<|endoftext|><|startoftext|>b",
    "<|ENDOFTEXT|> x <|endoftext|>", "a\x1cb\x1dc d\x85e\xa0f g　h", "日本語テキスト 漢字 ｶﾞ", "😀👨‍👩‍👧 ok", "x" * 5000, "ab" * 700 + "!" * 300, "ﬁ ǅ ß ẞ K Å",
    "ạ̈ q̇", "1234567890 ½ ² Ⅷ ٣", "'s 't're S'S", "​﻿ a­b", "\x00\x01\x7f", "don’t — “quote” …", "한국어 각", "a b c\x0bd",
]


def check(text):
    assert COUNTER.count(text) == len(WORD.encode(text, add_special_tokens=False).ids), text
    assert BYTES.ids(text).tolist() == BYTE.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the", "Thorin", "ou", "’", "'ll", " ", "\n", "É", "ñ", "12", "<|endoftext|>", "##", "zz", "\x85", "Σ"]), max_size=30))
def test_joined_parts(parts):
    check("".join(parts))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "null id"), (3, ODD[3]), (3, ODD[3])]
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, n_tokens string, copy int")


def test_counts_match_library(docs, odd):
    for df in (docs, odd):
        got = sorted(token_count.token_counts(df, public_tokenizers.path("word_bpe_49k.json")).collect(), key=str)
        want = []
        for r in df.collect():
            n = len(WORD.encode(r.text or "", add_special_tokens=False).ids)
            want.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
        assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(r)) or sorted(map(tuple, got), key=str) == sorted(want, key=str)


def reference_ids(text):
    return BYTE.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    rows = packing.pack_documents(df).collect()
    texts = [(r.doc_id, reference_ids(r.text)) for r in df.collect()]
    want = []
    for doc, ids in texts:
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for p, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc, p, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    total = sum(w[3] for w in want)
    assert len(seqs) <= total / 2048 * 1.05 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.geometric(0.004, 3000), 2048)
    cap = packing.Capacity(2048, 6, 1_500_000 + 2048**2, (1.0, 0.3, 0.3), rule)
    bins, offset = packing.pack(lengths, cap)
    for b in range(bins.max() + 1):
        here = lengths[bins == b]
        assert here.sum() <= 2048 and len(here) <= 6 and (here.astype(float) ** 2).sum() <= cap.attention
        order = np.argsort(offset[bins == b])
        assert (np.cumsum(here[order]) - here[order] == offset[bins == b][order]).all()
    assert bins.max() + 1 <= max(lengths.sum() / 2048, len(lengths) / 6) * 1.25 + 1


def test_the_default_weighs_every_dimension():
    """Limits that keep nothing out, and a choice by all three."""
    lengths = np.minimum(np.random.default_rng(5).geometric(0.002, 6000), 2048)
    cap = packing.Capacity()
    assert cap.limits().tolist() == [2048, 2048, 2048**2] and all(w > 0 for w in cap.weights)
    bins, _ = packing.pack(lengths, cap)
    tokens_only, _ = packing.pack(lengths, packing.Capacity(weights=(1.0, 0.0, 0.0)))
    assert np.bincount(bins, weights=lengths).max() <= 2048 and bins.max() <= tokens_only.max() + 2
    assert (bins != tokens_only).any()


def test_ids_beyond_two_bytes_are_refused():
    assert token_shards.two_bytes(np.array([0, 65535], np.uint32)).tolist() == [0, 65535]
    with pytest.raises(ValueError, match="70000"):
        token_shards.two_bytes(np.array([70000, 1], np.uint32))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert packing.pack_documents(none).count() == 0
    assert token_count.token_counts(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutation(n):
    got = token_shards.permute(np.arange(n), n, key=5)
    assert sorted(got) == list(range(n))
    assert (token_shards.permute(got, n, key=5, inverse=True) == np.arange(n)).all()
    if n > 60:
        assert (got != np.arange(n)).mean() > 0.9 and (got != token_shards.permute(np.arange(n), n, key=6)).mean() > 0.9


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_shards_round_trip(spark, request, which, tmp_path):
    df = request.getfixturevalue(which)
    out = str(tmp_path / "shards")
    ledger = token_shards.materialise(df, out, stride=64).collect()
    want = []
    for r in df.collect():
        ids = reference_ids(r.text)
        want += [(r.doc_id, k, ids[at : at + 64]) for k, at in enumerate(range(0, len(ids), 64))]
    n = len(want)
    assert sorted(r.slot for r in ledger) == list(range(n))
    stored = {r.slot: r.ids for r in token_shards.read_slots(spark, out, 0, n, stride=64).collect()}
    assert sorted(stored) == list(range(n))
    got = [(r.doc_id, r.seq, stored[r.slot][: r.length]) for r in ledger]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(not any(stored[r.slot][r.length :]) for r in ledger)
    some = [r.slot for r in token_shards.read_slots(spark, out, n // 3, 10, stride=64).collect()]
    assert some == list(range(n // 3, min(n, n // 3 + 10)))
    for r in ledger:
        assert (r.block, r.byte_offset) == (r.slot // token_shards.BLOCK, r.slot % token_shards.BLOCK * 128)
        assert r.ids_crc32 == zlib.crc32(np.array(stored[r.slot][: r.length], "<u2").tobytes())


def test_shards_of_nothing(docs, tmp_path):
    assert token_shards.materialise(docs.limit(0), str(tmp_path / "none")).count() == 0
