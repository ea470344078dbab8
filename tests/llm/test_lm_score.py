from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import lm_score as L
from marlstone.llm.common import distinct

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))


def _bytes(t):
    return b" ".join(w.encode() for w in _tokens(t)) + b"\xff"


class _Trees:
    """Context-tree weighting by its recursion, with dictionaries."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            s = b"\xff" * L.DEPTH + _bytes(t)
            for p in range(L.DEPTH, len(s)):
                q = 1
                for k in range(7, -1, -1):
                    bit = s[p] >> k & 1
                    for d in range(L.DEPTH + 1):
                        context = s[p - d : p][::-1]
                        self.counts[q, context][bit] += 1
                        if d:
                            self.children[q, context[:-1]].add(context)
                    q = 2 * q + bit
        self.memo = {}

    def own(self, q, c):
        a, b = self.counts[q, c]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, q, c):
        if (q, c) not in self.memo:
            own = self.own(q, c)
            self.memo[q, c] = own if len(c) == L.DEPTH else float(np.logaddexp(own, sum(self.weighted(q, k) for k in self.children[q, c]))) - math.log(2)
        return self.memo[q, c]

    def chance(self, q, context, d, bit):
        c = context[:d]
        if (q, c) not in self.counts:
            return 0.5
        a, b = self.counts[q, c]
        kt = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == L.DEPTH:
            return kt
        share = math.exp(self.own(q, c) - math.log(2) - self.weighted(q, c))
        return share * kt + (1 - share) * self.chance(q, context, d + 1, bit)

    def score(self, t):
        s, out = b"\xff" * L.DEPTH + _bytes(t), 0.0
        for p in range(L.DEPTH, len(s)):
            q = 1
            for k in range(7, -1, -1):
                bit = s[p] >> k & 1
                out += math.log10(self.chance(q, s[p - L.DEPTH : p][::-1], 0, bit))
                q = 2 * q + bit
        return out


@pytest.fixture(scope="module")
def rows(words):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(words[: rng.choice([4, 16])]) + rng.choice(["", "", "s", "É"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    return list(enumerate([*texts, None, "", " \n", "Ab\tAB\nab", "日本 🥰"]))


@pytest.mark.parametrize("block_bytes,slot_bytes,lot,round_bytes,tasks", [(10**6, 10**6, 10**6, 10**9, 10**5), (300, 500, 10**6, 10**9, 5), (300, 4_000, 100, 1_000, 10**5), (200, 1_000, 100, 10**9, 2)])
def test_against_brute_force(spark, rows, monkeypatch, block_bytes, slot_bytes, lot, round_bytes, tasks):
    for name, value in (("SLOT_BYTES", slot_bytes), ("LOT", lot), ("ROUND_BYTES", round_bytes), ("TASKS", tasks)):
        monkeypatch.setattr(L, name, value)
    got = {r.doc_id: r for r in L.ctw_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_bytes=block_bytes).collect()}
    learnt = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    trees, counts = _Trees(learnt), Counter()
    for t in learnt:
        counts.update(_tokens(t))
        counts[None] += 1
    total, types = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for i, t in rows:
        r, tokens = got[i], [*_tokens(t), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in tokens), rel_tol=1e-9)
        assert math.isclose(r.score, trees.score(t), rel_tol=1e-5)
        assert math.isclose(r.bits_per_byte, -r.score / math.log10(2) / len(_bytes(t)), rel_tol=1e-9)


def _model(texts):
    text, offsets = L.symbols(pa.array(texts))
    keys, counts = L.tally(L.grams(text, offsets))
    codes, sums = L.root_sums(keys, counts)
    return (keys, counts, codes, sums, L.upper_nodes(*L.nodes_of(codes, sums)[1:])), keys


def test_probabilities_sum_to_one(rows):
    model, keys = _model([t for _, t in rows])
    for known in (keys[40], np.uint64(0x7A7A_7A7A_7A7A_7A7A)):
        every = known & ~np.uint64(255) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** L.probabilities(every, *model)).sum() - 1) < 1e-9


def test_chunks_change_nothing(rows, monkeypatch):
    model, keys = _model([t for _, t in rows])
    whole = L.probabilities(keys, *model)
    monkeypatch.setattr(L, "CHUNK", 50)
    monkeypatch.setattr(L, "ASKED", 7)
    parts, _ = _model([t for _, t in rows])
    assert len(list(L.chunks(keys))) > 5 and (parts[2] == model[2]).all()
    assert np.allclose(L.probabilities(keys, *parts), whole, rtol=1e-12)
    other = distinct(keys ^ np.uint64(1 << 20))  # mostly unknown contexts
    monkeypatch.undo()
    assert np.allclose(L.probabilities(other, *model), [L.probabilities(k[None], *model)[0] for k in other], rtol=1e-12)


def test_symbols_and_words(rows):
    text, offsets = L.symbols(pa.array([t for _, t in rows]))
    assert [text[a:b].tobytes() for a, b in zip(offsets, offsets[1:])] == [_bytes(t) for _, t in rows]
    token, row = L.Tokens()(0, text, offsets)
    assert list(np.bincount(row)) == [len(_tokens(t)) + 1 for _, t in rows]
    names = {}
    for (i, t) in rows:
        for w, h in zip([*_tokens(t), None], token[row == i]):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_slices_of_long_texts_give_the_same(rows, monkeypatch):
    rng = random.Random(9)
    texts = [*(t for _, t in rows), "  \t", " " * 500, "word " * 300 + "  ", "x" * 997, " Ab " + "y" * 300 + " \n" * 200 + "z", " ".join("w" * rng.randrange(40) for _ in range(200))]
    text, offsets = L.symbols(pa.array(texts))
    one, row = L.Tokens()(0, text, offsets)
    for size in (1, 2, 5, 64):
        monkeypatch.setattr(L, "SLICE", size)
        tokens, found, bits = L.Tokens(), [[] for _ in texts], [[] for _ in texts]
        for r, part, cuts, before in L.slices(pa.array(texts)):
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                bits[r + i].append(L.grams(part, cuts, before)[a:b])
            for h, i in zip(*tokens(r, part, cuts)):
                found[i].append(h)
        assert (np.concatenate([np.concatenate(b) for b in bits]) == L.grams(text, offsets)).all()
        assert [sorted(f) for f in found] == [sorted(one[row == i]) for i in range(len(texts))]


def test_planes():
    for a in ([], [0, 0], [1, 255], [256, 0, 2**63]):
        a = np.array(a, np.uint64)
        assert (L.from_planes(L.to_planes(a)) == a).all() and len(L.from_planes(L.to_planes(a))) == len(a)


def test_words_that_a_polynomial_hash_confuses(spark, confused):
    rows = [(3, f"{confused[0]} a"), (4, f"{confused[1]} a"), (6, "a b")]  # 4 alone is held out
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    got = {r.doc_id: r for r in L.ctw_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    known = {w for i, t in rows if i not in held for w in t.split()}
    assert all(got[i].n_known == 1 + sum(w in known for w in t.split()) for i, t in rows)
    assert got[3].train_tokens == sum(len(t.split()) + 1 for i, t in rows if i not in held)


def test_large_counts_follow_the_gamma_function():
    n = np.array([0, 1, 5, 2_047, 2_048, 10**6, 10**12])
    assert np.allclose(L._log_gamma(n, True), [math.lgamma(x + 0.5) for x in n], rtol=1e-13)
    assert np.allclose(L._log_gamma(n, False), [math.lgamma(x + 1) for x in n], rtol=1e-13)


def test_odd_rows(odd, empty):
    got = L.ctw_scores(odd).collect()
    assert len(got) == odd.count() and all(r.score < 0 and r.n_tokens >= 1 for r in got)
    assert L.ctw_scores(empty).count() == 0
    alone = L.ctw_scores(odd.filter("doc_id = 9"), modulus=1, remainder=0).collect()[0]
    assert alone.held_out and alone.train_tokens == 0 and math.isclose(alone.bits_per_byte, 8.0, rel_tol=1e-6)
