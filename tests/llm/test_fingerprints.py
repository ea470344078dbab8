from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from marlstone.llm import fingerprints as P
from marlstone.llm.common import eights, span_hash


def test_entropy_of_every_window():
    rng = random.Random(1)
    raw = np.array([rng.choice(b"aaaabbcd ") if i % 300 < 200 else rng.randrange(256) for i in range(1_500)] + [97] * 100, np.uint8)
    got = P.entropy_classes(raw)
    for i in range(len(raw) - 63):
        counts = Counter(raw[i : i + 64].tolist())
        assert got[i] == (P._MOST - sum(P._NLOG[n] for n in counts.values())) * 1000 // P._MOST
    assert got[-1] == 0 and P.entropy_classes(np.arange(64, dtype=np.uint8))[0] == 1000


def test_features_against_the_definition(words):
    rng = random.Random(2)
    text = " ".join(rng.choice(words) for _ in range(400)).encode()
    ranks = P.ranks_of(P.class_counts(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    own = ranks[P.entropy_classes(np.frombuffer(text, np.uint8))]
    points = Counter()
    for i in range(len(own) - 63):
        j = min(range(i, i + 64), key=lambda j: (own[j], j))
        if own[j] < P.CLASSES:
            points[j] += 1
    wanted = [j for j in sorted(points) if points[j] >= P.POINTS]
    windows = list(dict.fromkeys(text[j : j + 64] for j in wanted))
    (found,) = P.feature_lists([text], ranks)[0]
    hashes = [int(span_hash(eights(np.frombuffer(w, np.uint8)), np.array([0]), np.array([64]))[0]) for w in windows]
    assert len(windows) >= P.FEW and found.tolist() == hashes
    bits = [set() for _ in range(-(-len(hashes) // P.PER_FILTER))]
    for i, h in enumerate(hashes):
        bits[i // P.PER_FILTER] |= {(h >> 11 * j) % P.BITS for j in range(5)}
    filters = P.filters_of([found])
    assert [set(np.flatnonzero(np.unpackbits(f)).tolist()) for f in filters] == bits


def _likeness(one, other):
    """Chance-corrected overlap of bit sets, as the docstring says it."""
    if not one or not other:
        return float(len(one) == len(other))
    if one == other:
        return 1.0
    one, other = sorted((one, other), key=len)
    total = 0.0
    for a in one:
        best = 0.0
        for b in other:
            chance, most = len(a) * len(b) / P.BITS, min(len(a), len(b))
            score = min(1.0, max(0.0, (len(a & b) - chance) / max(most - chance, 1e-9)))
            best = max(best, score * (most / max(len(a), len(b))) ** 0.5)
        total += best * len(a)
    return total / sum(map(len, one))


def test_likeness_against_the_definition(words):
    rng = random.Random(6)
    ranks = P.ranks_of(np.arange(P.CLASSES)[::-1].copy())
    base = [rng.choice(words) + str(rng.randrange(500)) for _ in range(4_000)]
    texts = [" ".join(base[a:b]) for a, b in ((0, 4_000), (0, 3_000), (500, 700), (3_000, 3_040), (0, 3), (0, 0))]
    filters = [P.filters_of(f) for f in P.feature_lists([t.encode() for t in texts], ranks)]
    sets = [[frozenset(np.flatnonzero(np.unpackbits(f)).tolist()) for f in x] for x in filters]
    assert len(sets[0]) > 1
    for a, x in zip(filters, sets):
        for b, y in zip(filters, sets):
            assert abs(P.likeness(a, b) - _likeness(x, y)) < 1e-12


def test_ranges():
    heads = [(None, 5), (3, -7), (3, 2), (9, 0)]
    ranges = P._Ranges(heads)
    rows = [(None, 5), (None, 6), (1, 0), (3, -7), (3, 1), (3, 2), (3, 9), (4, 0), (9, 0), (9, 1), (99, 0)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = [max(i for i, h in enumerate(heads) if key(h) <= key(r)) for r in rows]
    at, first = ranges.find(np.array([r[0] is not None for r in rows]), np.array([r[0] or 3 for r in rows]), np.array([r[1] for r in rows]))
    assert at.tolist() == want and [r for r, f in zip(rows, first) if f] == heads


def test_shared_beginning_changes_nothing(words):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 3, 20, 60, 90, 110, 140, 200, 900, 5_000)]
    changed = [P.edited(a, b) for a, b in zip(texts, texts[1:])]
    ranks = P.ranks_of(np.arange(P.CLASSES)[::-1].copy())
    alone = [P.as_text(P.filters_of(f)) for f in P.feature_lists([t.encode() for t in texts + changed], ranks)]
    rows = P._compare(texts, ranks)
    assert [r[2] for r in rows] == alone[: len(texts) - 1] and [r[3] for r in rows] == alone[len(texts) :]
    assert all((P.from_text(a) == P.from_text(b)).all() for a, b in zip(alone, alone))


def test_likeness(words):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(999)) for _ in range(n))
    ranks = P.ranks_of(np.arange(P.CLASSES)[::-1].copy())
    digest = lambda t: P.filters_of(P.feature_lists([t.encode()], ranks)[0])
    for n in (5, 30, 70, 100, 300, 3_000):
        one = text(n)
        assert P.likeness(digest(one), digest(one)) == 1.0
        assert P.likeness(digest(one), digest(P.edited(one, text(n)))) > 0.4
        assert P.likeness(digest(one), digest(text(n))) < 0.2
    none = digest("")
    assert P.likeness(none, none) == 1.0 and P.likeness(none, digest("abc")) == 0.0


def _brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r[1] or "" for r in rows]
    return [(r[0], len(t), hashlib.sha256(P.edited(t, texts[(i + 1) % len(rows)]).encode()).hexdigest()) for i, (r, t) in enumerate(zip(rows, texts))]


def test_neighbours_over_many_parts(spark, words):
    rng = random.Random(5)
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randrange(200)))) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = P.neighbour_fingerprints(df, part_bytes=20_000).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(_brute(rows))
    one = {(r.doc_id, r.fingerprint, r.near_next) for r in got}
    by_id = {r.doc_id: r for r in got}
    digests = {i: P.from_text(r.fingerprint) for i, r in by_id.items()}
    for i, r in by_id.items():
        assert r.near_next == P.likeness(digests[i], digests[(i + 3) % 900]) and r.near_edited == P.likeness(digests[i], P.from_text(r.edited_fingerprint))
    assert one == {(r.doc_id, r.fingerprint, r.near_next) for r in P.neighbour_fingerprints(df).collect()}


def test_one_repeated_id_over_many_parts(spark, words):
    """A third of the rows share an id, others have none; many rows are equal."""
    rng = random.Random(7)
    rows = [(rng.choice([5, 5, None, i]), " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60)))) for i in range(200)]
    rows += [rows[3]] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got, whole = (P.neighbour_fingerprints(df, part_bytes=n).select("doc_id", "n_chars", "edited_sha256", "near_next").collect() for n in (3_000, 10**9))
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, whole))


def test_odd_rows(spark, odd, empty):
    got = P.neighbour_fingerprints(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(v) == 1 for k, v in by_text.items() if k[0] is not None)
    assert P.neighbour_fingerprints(empty).count() == 0
    (only,) = P.neighbour_fingerprints(odd.filter("doc_id = 7")).collect()
    assert only.near_next == 1.0
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1
