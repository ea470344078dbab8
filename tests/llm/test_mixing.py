from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import mixing as M


def _fill(children, budget):
    """Water-filling by hand: fill the children whose supply is least for their weight, share the rest."""
    left, out = dict(children), {}
    while left:
        total = sum(w for w, _ in left.values())
        level = budget / total if total else 0.0
        full = [k for k, (w, supply) in left.items() if supply <= level * w + 1e-9]
        if not full:
            return out | {k: int(level * w + 1e-6) for k, (w, _) in left.items()}
        for k in full:
            out[k] = left[k][1]
            budget -= left.pop(k)[1]
    return out


def _brute(rows, share, epochs, seed, weights):
    tokens = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, *_ in rows}
    leaf = {i: (d, lang, s) for i, _, lang, s, d in rows}
    supply = Counter()
    for i, k in leaf.items():
        supply[k] += tokens[i]
    nodes = {(): int(share * sum(supply.values()))}
    for depth in range(3):
        below = defaultdict(Counter)
        for k, n in supply.items():
            below[k[:depth]][k[: depth + 1]] += n * epochs
        for parent, kids in below.items():
            nodes |= _fill({k: (weights[depth].get(k[-1], 100), n) for k, n in kids.items()}, nodes[parent])
    out = []
    for k, n in supply.items():
        whole, rest = divmod(nodes[k], n) if n else (0, 0)
        mine = sorted((i for i in leaf if leaf[i] == k), key=lambda i: hashlib.md5(f"{seed}:{whole}:{i}".encode()).hexdigest())
        out += [(i, e) for i in mine for e in range(whole)]
        for i in mine:
            if rest <= 0:
                break
            out.append((i, whole))
            rest -= tokens[i]
    return sorted(out), nodes


@pytest.mark.parametrize("share,epochs", [(0.5, 4), (0.9, 1), (1.7, 2), (0.05, 3), (5.0, 2)])
def test_against_brute_force(spark, words, share, epochs):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))), rng.choice(["en", "en", "en", "de", "fr"]), f"s{min(rng.randrange(9), rng.randrange(9))}") for i in range(400)]
    rows = [(*r, "xyz"[int(r[3][1]) % 3]) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, dom string").repartition(3)
    weights = [{"x": 500, "y": 300}, {"en": 200, "de": 700}, {"s1": 1_000}]
    got = M.mix(df, budget_share=share, max_epochs=epochs, seed=3, domain=F.col("dom"), domain_weights=weights[0], language_weights=weights[1], source_weights=weights[2])
    want, _ = _brute(rows, share, epochs, 3, weights)
    assert sorted((r.doc_id, r.epoch) for r in got.collect()) == want


def test_shortages_go_to_siblings_first(spark):
    rows = [("a", "en", "s1", 10), ("a", "en", "s2", 100), ("a", "de", "s3", 100), ("b", "en", "s4", 1_000)]
    df = spark.createDataFrame(rows, "d string, l string, s string, n long")
    nodes = M.leaf_budgets(df, ["d", "l", "s"], "n", 200 / 1_210 + 1e-9, 1, [F.lit(100).cast("long")] * 3).collect()
    # Halves of 100 each for a and b; en and de 50 each; s1 has only 10, so s2 takes 40; b is untouched.
    assert {r.s: r.budget for r in nodes} == {"s1": 10, "s2": 40, "s3": 50, "s4": 100}


def test_hot_leaf_is_narrowed_down(spark, monkeypatch):
    """Several rounds of digits, with and without a broadcast of the leaves."""
    df = spark.range(5_000).selectExpr("id as doc_id", "repeat('a ', int(id % 3)) as text", "'en' as lang", "if(id % 2 = 0, 's', concat('t', id % 7)) as source").repartition(3)
    rows = [(r.doc_id, r.text, r.lang, r.source, "x") for r in df.collect()]
    monkeypatch.setattr(M, "FEW", 3)
    want, _ = _brute(rows, 0.3, 4, 7, [{}, {}, {}])
    for leaves in (100, 0):
        monkeypatch.setattr(M, "LEAVES", leaves)
        got = M.mix(df, budget_share=0.3, domain=F.lit("x"), domain_weights={}, language_weights={})
        assert sorted((r.doc_id, r.epoch) for r in got.collect()) == want


def test_equal_rows_are_taken_one_by_one(spark):
    df = spark.range(3_000).selectExpr("if(id < 2990, 1, id) as doc_id", "'a b' as text", "'en' as lang", "'s' as source", "id as other")
    got = M.mix(df, budget_share=0.3, max_epochs=1).collect()
    assert len(got) in (900, 901) and len({r.other for r in got}) == len(got)


def test_odd_rows(odd, empty):
    got = M.mix(odd, budget_share=1.0, max_epochs=1, domain_weights={}, language_weights={})
    rows = got.collect()
    assert set(got.columns) == set(odd.columns) and all(r.epoch == 0 for r in rows)
    assert sum(r.n_tokens for r in rows) == odd.select(F.sum(M.n_words())).first()[0]
    assert M.mix(empty).count() == 0
    kept = M.mixed_rows(odd, budget_share=0.5)
    assert kept.columns == odd.columns and 0 < kept.count()
    assert M.mix(odd.filter("text is null or text = ''")).count() == 0
