from __future__ import annotations

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from marlstone.llm import segmentation as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return S.load(PATH)


def _paths(text: str, sharpness: float = 1.0) -> dict[tuple, float]:
    """All segmentations of a short text, with their probabilities."""
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    table = {}
    for i in range(len(model)):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            table[model.id_to_piece(i).replace("▁", " ").encode()] = (i, -sharpness * math.log(10 + max(0.0, min(len(model), -model.get_score(i)))))
    whole, found = (" " + text).encode(), {}

    def walk(at, path, weight):
        if at == len(whole):
            found[tuple(path)] = weight
        for end in range(at + 1, len(whole) + 1):
            if whole[at:end] in table:
                i, w = table[whole[at:end]]
                walk(end, [*path, i], weight + w)

    walk(0, [], 0.0)
    total = sum(math.exp(w) for w in found.values())
    return {k: math.exp(w) / total for k, w in found.items()}


@pytest.mark.parametrize("text,sharpness", [("theat", 1.0), ("a bad", 0.5), ("  in it", 0.3)])
def test_samples_follow_the_lattice(text, sharpness):
    t, n = S.load(PATH, sharpness), 30_000
    want = _paths(text, sharpness)
    got = Counter(map(tuple, S.encode(pa.array([text] * n), np.arange(n, dtype=np.int64), t).to_pylist()))
    assert set(got) <= set(want) and len(want) > 8
    for path, p in want.items():
        assert abs(got[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_lossless(pieces, words):
    texts = [None, "", " ", "  ", "a", " a  b ", "▁", "▁ ▁▁x", "日本語 ガ ﬁ 🥰", "\x00\n\t\r\n", "<s></s><0x41>", "x" * 2_000, " ".join(words * 300), "é" * 500]
    ids = S.encode(pa.array(texts), np.arange(len(texts), dtype=np.int64), pieces)
    assert S.decode(ids, pieces).to_pylist() == [t or "" for t in texts]
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    plain = texts[-2]
    assert model.decode(ids[-2].as_py()) == plain


def test_equal_hashes_share_nothing(pieces, confused, monkeypatch):
    texts = [" ".join(confused), confused[0], confused[1], "ab cd ab"]
    keys = np.arange(len(texts), dtype=np.int64)
    want = S.encode(pa.array(texts), keys, pieces)
    assert S.decode(want, pieces).to_pylist() == texts
    monkeypatch.setattr(S, "span_hash", lambda eight, start, stop: np.zeros(len(start), np.uint64))
    got = S.encode(pa.array(texts), keys, pieces)
    assert S.decode(got, pieces).to_pylist() == texts and got.to_pylist() == want.to_pylist()


def test_long_stretch_without_spaces(pieces):
    rng = np.random.default_rng(3)
    text = "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 20_000, 30_000)) + "abc123" * 500
    ids = S.encode(pa.array([text]), np.zeros(1, np.int64), pieces)
    assert S.decode(ids, pieces).to_pylist() == [text]


def test_batches_and_keys(pieces, words):
    texts = [" ".join(words[i % 5 :]) for i in range(200)]
    keys = np.arange(200, dtype=np.int64)
    whole = S.encode(pa.array(texts), keys, pieces)
    assert S.encode(pa.array(texts).slice(50, 30), keys[50:80], pieces).to_pylist() == whole.slice(50, 30).to_pylist()
    other = S.encode(pa.array(texts), keys, pieces, seed=1)
    assert other.to_pylist() != whole.to_pylist()
    assert len({tuple(x) for x in S.encode(pa.array([texts[0]] * 50), keys[:50], pieces).to_pylist()}) > 5


def test_odd_rows(odd, empty, pieces):
    got = S.sample_pieces(odd)
    rows = got.collect()
    assert set(got.columns) == set(odd.columns) | {"n_pieces", "lossless"} and len(rows) == odd.count()
    assert all(r.lossless and r.n_pieces == len(r.pieces) for r in rows)
    assert {tuple(r.pieces) for r in rows if not r.text} == {()}
    assert len({tuple(r.pieces) for r in rows if r.doc_id == 4}) == 1
    back = S.decode_pieces(got)
    assert back.filter(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    assert S.sample_pieces(empty).count() == 0
