from __future__ import annotations

import random
import zlib

import pytest

import corpus_pipeline as P
from marlstone.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, words, tmp_path_factory):
    """Clean, toxic, junk and copied documents, and labels for some."""
    rng, rows, labels = random.Random(8), [], []
    for i in range(900):
        text = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randint(20, 90))]
        kind = "clean"
        if i % 9 == 1:
            kind, text[3] = "toxic", "zorkish"
        elif i % 9 == 2:
            kind, text = "junk", [w.upper() + "!!" for w in text]
        elif i % 9 == 3 and i > 3:
            kind, text = "copy", rows[i - 3][1].split() + ["end"]
        rows.append((i, " ".join(text), rng.choice(["en", "de"]), f"src{rng.randrange(5)}", 0, kind))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kind string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kinds, columns = {"clean", "toxic", "junk", "copy"}, docs.columns
    for n, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r.kind for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        after = {r.doc_id: r.kind for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        gone = {"toxicity": {"toxic"}, "quality": {"junk"}, "near_dedup": {"copy"}}.get(name)
        if gone:
            kinds -= gone
            lost = {i for i in before if before[i] in kinds} - set(after)
            assert set(after.values()) == kinds and len(lost) <= (0 if name == "near_dedup" else 0.01 * len(before)), (name, lost)
        if n < 4:
            assert docs.columns == columns
        elif name == "segmentation":
            assert set(after) == set(before) and docs.filter("not lossless").count() == 0
    assert 0 < len(after) < sum(k == "clean" for k in before.values()) + 1


def test_run_and_odd_rows(spark, folder, odd, empty):
    assert P.run(spark, folder).count() > 100
    for docs in (odd, empty):
        columns = docs.columns
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == columns
        assert set(P.STAGES[-1][1](spark, docs, folder).columns) == set(columns) | {"n_pieces", "lossless"}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries_return_their_columns(spark, name):
    wanted = {
        1: "doc_id n_bytes n_tokens over_limit", 2: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", 3: "query_id rank vec_id score",
        4: "doc_id domain lang source n_tokens epoch", 5: "doc_id held_out score predicted", 6: "doc_id n_pieces pieces lossless", 7: "doc_id n_shingles component_id kept",
        8: "doc_id held_out n_tokens n_known train_tokens base_score score", 9: "doc_id size text_crc32 law shard slot grown_shard", 10: "doc_id held_out score predicted",
    }[int(name[2:].split("_")[0])].split()
    df = Q.queries()[name](spark, SF)
    assert df.columns[: len(wanted)] == wanted
    rows = df.collect()
    if "doc_id" in wanted and name != "op4_mixing":
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    for r in rows[:50]:
        if "held_out" in wanted:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == (1 if name.startswith("op8") else 0))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_against_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    done = con.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in done.description]
    want = sorted(map(str, done.fetchall()))
    assert want == sorted(str(tuple(r)) for r in Q.queries()[name](spark, SF).select(*columns).collect())
