from __future__ import annotations

import pytest

from marlstone.errors import SqlError
from marlstone.streaming import insert_stream


def test_stream_into_table(spark, session, tmp_path):
    spark.range(20).selectExpr("cast(id as int) as a", "concat('n', id) as s").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a int, s string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    session.register("source", stream)
    session.sql("create table sink (a int, s varchar(4))")
    chosen = session.select("select a + 100 as a, s from source where a >= 15")
    query = insert_stream(session, chosen, "sink", str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert sorted(session.sql("select a, s from sink").rows()) == [(100 + i, f"n{i}") for i in range(15, 20)]


def test_a_batch_is_added_once(spark, session, tmp_path):
    spark.range(9).selectExpr("cast(id as int) as a").repartition(3).write.parquet(str(tmp_path / "in"))
    session.sql("create table sink (a int)")
    for _ in range(2):  # the second query finds nothing new
        stream = spark.readStream.schema("a int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        insert_stream(session, stream, "sink", str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(session.sql("select a from sink").rows()) == [(i,) for i in range(9)]
    last = session.catalog.get("sink").batches
    assert list(last) == [str(tmp_path / "checkpoint")]
    last[str(tmp_path / "other")] = 99  # as if the batches of this checkpoint were in the table already
    insert_stream(session, spark.readStream.schema("a int").parquet(str(tmp_path / "in")), "sink", str(tmp_path / "other")).awaitTermination(120)
    assert session.sql("select count(*) from sink").rows() == [(9,)]


def test_types_are_checked_before_the_start(spark, session, tmp_path):
    spark.range(3).selectExpr("cast(id as string) as a", "id as l").write.parquet(str(tmp_path / "in"))
    session.sql("create table sink (a int)")
    stream = spark.readStream.schema("a string, l bigint").parquet(str(tmp_path / "in"))
    for rows, kind in ((stream, "InsertSchemaMismatch"), (stream.selectExpr("l as a"), "InsertSchemaMismatch"), (stream.select("l"), "ColumnNotFound")):
        with pytest.raises(SqlError) as error:
            insert_stream(session, rows, "sink", str(tmp_path / "checkpoint"))
        assert error.value.kind == kind
