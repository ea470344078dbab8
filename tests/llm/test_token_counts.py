from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece

from marlstone.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_parts_lose_nothing(model, words):
    assert T.splits_safely(PATH)
    texts = [" ".join(words * 3_000), "x" * 40_000, "a  b " * 9_000, "▁ ▁" * 9_000, "\n \t" * 9_000, "é " * 20_000, " " * 40_000, "<s> </s> " * 5_000, ""]
    assert all(len(T.parts(t)) > 1 for t in texts[:1])
    assert T.lengths(texts, [len(t.encode()) for t in texts], PATH) == [len(x) for x in model.encode(texts)]


def test_every_cut_gives_the_pieces_of_the_whole(model, monkeypatch):
    """Random texts of all kinds, cut at each place where a cut may fall."""
    monkeypatch.setattr(T, "PART_CHARS", 1)
    rng = random.Random(8)
    kinds = ["ab c", "x ", "a  b", "漢字 かな", "é▁ ü", "<s>  </s> ", "\n\t a", "🥰 z", "word other  "]
    for _ in range(1_000):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(60))) + rng.choice(["", " ", "  "])
        whole = len(model.encode(text))
        assert T.lengths([text], [len(text.encode())], PATH) == [whole]
        for size in (1, 7, 20):
            assert sum(len(model.encode(p)) for p in T.parts(text, size)) == whole


@pytest.mark.parametrize("text", ["x" * 16_384 + " ", "word " * 3_276 + "abcde ", "a" * 16_390 + " ", "a" * 16_390 + "  ", "漢" * 20_000 + " b", "long " * 40_000])
def test_long_texts(model, text):
    assert T.lengths([text], [len(text.encode())], PATH) == [len(model.encode(text))]


def test_batches_hold_about_as_many_bytes(monkeypatch):
    monkeypatch.setattr(T, "BATCH_BYTES", 100)
    texts = ["é" * 30, "a" * 30, "b" * 300, "", "c" * 99]
    got = list(T._batches((i, t, len(t.encode())) for i, t in enumerate(texts)))
    assert [[i for i, _ in b] for b in got] == [[0, 1], [2], [3, 4]]


def test_other_tokenizer(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in T.token_counts(odd.select("doc_id", "text").filter("doc_id < 10"), "byte_bpe_50k.json").collect()}
    for r in odd.filter("doc_id < 10").collect():
        assert got[r.doc_id] == len(t.encode(r.text or "", add_special_tokens=False).ids)


def test_odd_rows(model, odd, empty):
    got = T.token_counts(odd)
    assert set(got.columns) == set(odd.columns) | {"n_bytes", "over_limit"}
    rows = got.collect()
    assert len(rows) == odd.count() and all(r.shard == "shard" for r in rows)
    for r in rows:
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(model.encode(r.text or "")))
        assert r.over_limit == (r.n_tokens > 4096)
    assert T.token_counts(empty).count() == 0
