from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import near_dedup as N

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def _brute(rows, percent=75):
    sets, parent = _sets(rows), {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    common, where = Counter(), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for ids in where.values():
        common.update(combinations(ids, 2))
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def _families(words, seed, n=40):
    rng, rows = random.Random(seed), []
    fresh = lambda k: [rng.choice(words) + str(rng.randrange(50)) for _ in range(k)]
    for _ in range(n):
        base = fresh(rng.choice([3, 5, 9, 40, 120, 300]))
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0, 0.01, 0.02, 0.03, 0.05, 0.1]))):
                copy[rng.randrange(len(copy))] = fresh(1)[0]
            rows.append("  ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def _check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_components(df).collect()}
    assert got == _brute(rows)


def test_against_brute_force(spark, words):
    _check(spark, _families(words, 1))


def test_large_group_in_small_blocks(spark, words, monkeypatch):
    """One group of near copies, many unlike each other, cut into many blocks."""
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(2)
    base = [rng.choice(words) + str(rng.randrange(50)) for _ in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(60)] = f"w{rng.randrange(9_999)}"
        rows.append((i, " ".join(copy)))
    _check(spark, rows)


def test_long_texts_in_blocks_bounded_by_bytes(spark, words, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_BYTES", 40_000)
    rng = random.Random(5)
    base = [rng.choice(words) + str(rng.randrange(5_000)) for _ in range(6_000)]
    rows = []
    for i in range(40):
        copy = list(base[: rng.choice([4_000, 5_000, 6_000])])
        for _ in range(rng.randrange(0, 300)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(99_999)}"
        rows.append((i, " ".join(copy)))
    _check(spark, rows)


def _block(n, signatures, sets, comp):
    one = np.arange(n)
    return pa.table({
        "bucket": np.zeros(n, np.int64), "low": np.zeros(n, np.int32), "high": np.ones(n, np.int32), "chunk": (one % 2).astype(np.int32), "node": one, "comp_hash": comp,
        "n_shingles": np.array([len(s) for s in sets]), "signature": pa.array([s.tobytes() for s in signatures], pa.binary()),
        "bands": pa.array([[0]] * n, pa.list_(pa.int64())), "members": pa.array([s.tobytes() for s in sets], pa.binary()),
    })


def test_unlike_members_of_one_bucket_stay_apart_by_signature():
    """Thousands in one bucket: only those that may be linked get as far as their sets."""
    rng, n = np.random.default_rng(6), 5_000
    signatures = rng.integers(0, 256, (n, 64)).astype(np.uint8)
    signatures[7] = signatures[4]
    sets = [np.sort(rng.integers(0, 1 << 60, 100).astype(np.uint64)) for _ in range(n)]
    sets[7] = sets[4]
    block = _block(n, signatures, sets, np.arange(n))
    found = N._open_in_block(75)(block.drop_columns(["bands", "members"]))
    assert sorted(found.column("node").to_pylist()) == [4, 7]
    links = N._links_in_block(75)(block.take(found.column("node")))
    assert links.to_pylist() == [{"a": 4, "b": 7}]


def test_words_that_a_polynomial_hash_confuses(spark, confused):
    tail = " b c d e f g"
    got = N.near_components(spark.createDataFrame([(1, confused[0] + tail), (2, confused[1] + tail), (3, confused[0] + tail)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {1: (1, 3), 2: (2, 3), 3: (1, 3)}


def test_components_of_chains_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(N, "LINKS", 40)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 120)] + [(500 + i, 500) for i in range(1, 90)] + [(900, 901), (901, 900), (902, 902)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 121)} | {500 + i: 500 for i in range(1, 90)} | {901: 900}
    assert {k: v for k, v in got.items() if k != v} == want


def test_estimate_is_corrected_for_chance(words):
    rng = np.random.default_rng(4)
    pool = [f"w{i}" for i in range(4_000)]
    for share in (0.0, 0.5, 0.75, 0.9):
        errors = []
        for _ in range(30):
            same = int(400 * share)
            a, b = (list(rng.choice(pool, 400 - same)) for _ in range(2))
            head = list(rng.choice(pool, same))
            texts = [" ".join(head + a), " ".join(head + b)]
            sets = list(_sets(enumerate(texts)).values())
            true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            *_, packed = N.sketch_batch(pa.array(texts))
            one, other = (np.frombuffer(p, np.uint8) for p in packed.to_pylist())
            errors.append(N.estimate(one, other) - true)
        assert abs(np.mean(errors)) < 0.03


def test_odd_rows(spark, odd, empty):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_components(odd).collect()}
    assert N.near_components(odd).count() == odd.count()
    assert {(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 2, 4, True), (5, 2, 4, False), (6, 2, 4, False), (None, 0, None, True), (None, 2, None, True)} <= rows
    assert N.near_components(empty).count() == 0
    kept = N.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 7, 8, 9]
    assert kept.filter("doc_id is null").count() == 2
    assert N.one_of_each(empty).count() == 0


def test_one_id_for_two_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "p q r s t u v"), (3, "A B c d e f g")]
    got = N.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1} and len(got) == 4


@pytest.mark.parametrize("size", [2, 8])
def test_other_shingle_sizes(size):
    text = b"a b c d e f g a b c"
    value, cuts = N.shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), size)
    w = text.split()
    assert len(value) == cuts[1] == len({tuple(w[i : i + size]) for i in range(len(w) - size + 1)})


def _rows_joined_by_node(spark, since):
    """Rows out of all inner joins by node in the SQL executions after the one numbered ``since``, and the last number."""
    store, total, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for i in range(runs.size()):
        number = runs.apply(i).executionId()
        if number <= since:
            continue
        last = max(last, number)
        found, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name() and re.search(r"\[node#\w+\], \[node#\w+\], Inner", node.desc()):
                for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if m.name() == "number of output rows" and found.contains(m.accumulatorId()):
                        total += int(found.apply(m.accumulatorId()).replace(",", ""))
    return total, last


def test_rows_joined_do_not_grow_with_the_number_of_blocks(spark, words, monkeypatch):
    """Texts mutually just below the threshold: a member of a bucket of many chunks is joined as often as in one chunk."""
    rng = random.Random(7)
    base = [rng.choice(words) + str(rng.randrange(50)) for _ in range(100)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(100)] = f"w{rng.randrange(99_999)}"
        rows.append((i, " ".join(copy)))
    joined, (_, last) = [], _rows_joined_by_node(spark, -1)
    for size in (1_024, 8):
        monkeypatch.setattr(N, "BLOCK", size)
        _check(spark, rows)
        n, last = _rows_joined_by_node(spark, last)
        joined.append(n)
    assert 0 < joined[1] <= 1.1 * joined[0]
