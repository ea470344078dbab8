from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pytest

from marlstone.llm import common as C


def _hash(w):
    return int(C.span_hash(C.eights(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0])


def test_span_hash_depends_on_the_bytes_alone():
    rng = random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(2_000)]
    words += [w + b"\0" for w in words[:200]] + words[:300]
    raw, cuts = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])
    found = C.span_hash(C.eights(raw), cuts[:-1], cuts[1:]).tolist()
    assert found[:40] == [_hash(w) for w in words[:40]]
    assert len(set(zip(words, found))) == len(set(words)) == len(set(found))


def test_span_hash_tells_confused_words_apart(confused):
    assert len({_hash(w.encode()) for w in confused}) == 2


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        context.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            C.shared_dir(SimpleNamespace(sparkContext=context))
    context.getConf = lambda: {"spark.checkpoint.dir": "s3a://bucket/x/"}
    assert C.shared_dir(SimpleNamespace(sparkContext=context)) == "s3a://bucket/x"


def test_stored_tables_can_be_released(spark):
    C.release(spark)
    one, other = (C.stored(spark.range(5), "x") for _ in range(2))
    assert other.count() == 5
    C.discard(one)
    assert C.release(spark) == 1 and C.release(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*exist|no such file"):
        spark.read.schema("id long").parquet(other._marlstone_path).collect()


def test_samples_have_the_wanted_size_whatever_the_table(spark):
    ids = spark.range(200_000)
    for most, n in ((2_000, 200_000), (20_000, 200_000)):
        assert abs(ids.filter(C.drawn(most, n, 3, "id")).count() - most) < 5 * most**0.5
    # 20,000 of 10**14 rows: one in 5 * 10**9, which a threshold of whole numbers must still tell from none
    assert C.DRAW * 20_000 // 10**14 == 200_000


def test_only_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(1_000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    assert C.table(spark, str(tmp_path), "t").rdd.getNumPartitions() == 4
    monkeypatch.setattr(C, "SMALL_TABLE", 10)
    assert C.table(spark, str(tmp_path), "t").rdd.getNumPartitions() == 1
