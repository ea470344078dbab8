from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import quality as Q
from marlstone.llm import toxicity as X
from marlstone.llm.common import eights, mix64, span_hash


def test_terms_do_not_depend_on_neighbours():
    texts = ["Ab cdefghij", "", "cdefghij ab-ab", "naïve ab"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    found = [set() for _ in texts]
    for row, term in X.terms_of(raw, offsets):
        for r, t in zip(row, term):
            found[r].add(int(t))
    assert found[1] == set() and found[0] == found[2] and len(found[0]) == 2 + 5
    assert len(found[3]) == 2 + 3


def test_margins_are_the_pairwise_sum():
    rng = np.random.default_rng(1)
    m = X.FactorizationMachine(np.arange(6, dtype=np.uint64), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = [[0, 2, 5], [], [1, 2, 3, 4]]
    row, term = np.repeat([0, 1, 2], [3, 0, 4]), np.array(sum(rows, []))
    want = [0.3 + sum(m.weights[i] for i in r) + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(r) for b in r[i + 1 :]) for r in rows]
    assert np.allclose(X.margins(m, 3, row, term), want)


def test_machine_learns_what_linear_weights_cannot():
    """Positive if exactly one, or none, of two terms: no linear rule is better than chance."""
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(4_000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([i for i, on in ((0, a), (1, b)) if on] + [2 + rng.integers(0, 10)]))
        y.append(float(a == b))
    bias, w, v = X.train(rows, np.array(y), 12, epochs=40)
    m = X.FactorizationMachine(np.arange(12, dtype=np.uint64), bias, w, v)
    score = X.margins(m, len(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows))
    assert ((score > 0) == (np.array(y) > 0)).mean() > 0.95


def _corpus(spark, words, n=1_500):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) + rng.choice(["", "s", ",", "."]) for _ in range(rng.randint(5, 120))]
        toxic, junk = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            text[rng.randrange(len(text))] = "zork" + rng.choice("abcdefgh")
        if junk:
            text = [w + "!!" for w in text] if i % 2 else [w for w in text for _ in range(8)]
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy(spark, words, kind):
    docs, labels, truth = _corpus(spark, words)
    if kind == "toxic":
        scored = X.score_toxicity(docs, X.fit(docs, labels)).collect()
    else:
        model = Q.fit(docs, labels)
        assert 0.6 < model.prior < 0.95
        scored = Q.score_quality(docs, model).collect()
    right = [r.predicted == truth[r.doc_id][kind == "toxic"] for r in scored if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(right) > 100 and np.mean(right) > 0.97


def test_labels_of_the_held_out_fold_are_not_read(spark, words):
    docs, labels, _ = _corpus(spark, words, 400)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (X.fit(docs, t) for t in (labels, turned))
    assert (a.terms == b.terms).all() and np.allclose(a.weights, b.weights)
    a, b = (Q.fit(docs, t) for t in (labels, turned))
    assert np.allclose(a.weights, b.weights)


def test_risk_stays_non_negative_and_prior_is_found():
    rng = np.random.default_rng(4)
    p = rng.normal(1.5, 1, (2_000, 3))
    u = np.concatenate([rng.normal(1.5, 1, (2_800, 3)), rng.normal(-1.5, 1, (1_200, 3))])
    w, b = Q.minimise_risk(p, u, 0.5, steps=150)
    prior = Q.estimate_prior(p @ w + b, u @ w + b)
    assert abs(prior - 0.7) < 0.06
    w, b = Q.minimise_risk(p, u, prior)
    assert ((u @ w + b > 0) == (np.arange(4_000) < 2_800)).mean() > 0.97


@pytest.mark.parametrize("prior,negative", [(0.4, False), (0.95, True)])
def test_gradient_of_the_risk(prior, negative):
    rng = np.random.default_rng(6)
    p, u = rng.normal(1, 1, (60, 3)), rng.normal(0.9, 1, (80, 3))
    w, b = rng.normal(size=3), 0.2
    w = w + 2 if negative else w
    loss = lambda x: sum(Q.risk(p, u, x[:-1], x[-1], prior)) if not negative else -Q.risk(p, u, x[:-1], x[-1], prior)[1]
    assert (Q.risk(p, u, w, b, prior)[1] < 0) == negative
    at, step = np.append(w, b), 1e-6
    by_hand = [(loss(at + step * e) - loss(at - step * e)) / (2 * step) for e in np.eye(4)]
    assert np.allclose(Q.risk_gradient(p, u, w, b, prior), by_hand, atol=1e-4)


def _features(text):
    """The features of one text, in plain Python."""
    raw = text.encode()
    kind = lambda c: "a" if 97 <= c <= 122 or c >= 128 else "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else chr(c)
    words, n = raw.split(), max(1, len(raw.split()))
    out = np.zeros(Q.SHAPES + 12)
    for w in words:
        shape = "".join(k for i, k in enumerate(map(kind, w)) if i == 0 or k != kind(w[i - 1])).encode()
        out[int(span_hash(eights(np.frombuffer(shape, np.uint8)), np.array([0]), np.array([len(shape)]))[0]) % Q.SHAPES] += 1 / n
    low, size = [w.lower() for w in words], max(1, len(raw))
    share = lambda test: sum(map(test, raw)) / size
    symbol = share(lambda c: c > 32 and kind(c) not in "aA0")
    out[Q.SHAPES :] = [
        sum(a == b for a, b in zip(low, low[1:])) / n, (1 - len(set(low)) / n) ** 2 if words else 0, sum(len(w) == 1 and kind(w[0]) not in "aA0" for w in words) / n,
        share(lambda c: kind(c) == "A"), share(lambda c: kind(c) == "0"), symbol, share(lambda c: c == 10), share(lambda c: kind(c) == "a"),
        min(3, sum(map(len, words)) / n / 20), np.log1p(len(words)) / 10, not words, symbol**2,
    ]
    return out


def test_features_against_plain_python(words):
    rng = random.Random(9)
    texts = ["", " ", "Some words, some WORDS!!", "a a a | - a", "日本 1 2 3\n", *(" ".join(rng.choice(words).title() + rng.choice(["", "!!", "12", "\n"]) for _ in range(rng.randrange(80))) for _ in range(20))]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    got = Q.all_features(raw, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
    assert np.allclose(got, [_features(t) for t in texts], atol=1e-6)


def test_class_counts_against_plain_python(words):
    rng = random.Random(10)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(80)]
    y = [rng.randrange(2) for _ in texts]
    want = {}
    for t, label in zip(texts, y):
        found = set(t.split()) | {w[:n] + "-" for w in t.split() for n in X.PREFIXES if len(w) > n}
        for x in found:
            a, b = want.get(x, (0, 0))
            want[x] = a + 1, b + label
    (got,) = X._class_counts(iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(y)], ["text", "y"])]))
    assert sorted(zip(got.column(1).to_pylist(), got.column(2).to_pylist())) == sorted(want.values())


def test_training_follows_the_gradient():
    """One step from zero on one batch: the sign of each weight's change is that of the mean error of its rows."""
    rows, y = [np.array([0, 1]), np.array([1, 2]), np.array([2, 3])], np.array([1.0, 1.0, 0.0])
    bias, w, v = X.train(rows, y, 4, rank=2, epochs=1, steps=1, batch=3, decay=0.0)
    start = np.random.default_rng(5).normal(0, 0.01, (4, 2))
    share = np.log(2.5 / 1.5)
    error = [X.logistic(np.array([share + start[a] @ start[b]]))[0] - t for (a, b), t in zip(rows, y)]
    slope = np.array([sum(e for r, e in zip(rows, error) if i in r) / 3 for i in range(4)])
    assert (np.sign(w) == -np.sign(slope)).all() and np.sign(bias - share) == -np.sign(sum(error))
    pull = np.array([sum(e * start[(set(r.tolist()) - {i}).pop()] for r, e in zip(rows, error) if i in r) for i in range(4)]) / 3
    assert (np.sign(v - start) == -np.sign(pull)).all()


def test_features_do_not_depend_on_neighbours():
    texts = ["Some words, some WORDS!!", "", "a a a a", "日本 1 2 3 | | |", "\n\n x"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    together = Q.features(raw, offsets)
    for i, t in enumerate(texts):
        b = t.encode()
        assert np.allclose(together[i], Q.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0])


def test_odd_rows(odd, empty, labels):
    for docs in (odd, empty):
        for module, filtered in ((X, X.without_toxic), (Q, Q.without_junk)):
            score = X.score_toxicity if module is X else Q.score_quality
            rows = score(docs, module.fit(docs, labels)).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
            assert filtered(docs, labels).columns == docs.columns
    none = labels.limit(0)
    assert X.without_toxic(odd, none).count() == odd.count() == Q.without_junk(odd, none).count()
    same = {r.text: r.score for r in X.score_toxicity(odd, X.fit(odd, labels)).collect()}
    assert same[None] == same[""]


def test_mix64_is_a_bijection():
    x = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x10001)
    assert len(np.unique(mix64(x))) == len(x)
