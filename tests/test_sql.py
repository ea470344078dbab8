from __future__ import annotations

import io
import random
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone import golden
from marlstone.errors import SqlError
from marlstone.operators import relational
from marlstone.plans.parser import parse
from marlstone.repl import loop
from marlstone.session import Session
from marlstone.sources.catalog import Catalog, due

GOLDEN = sorted((Path(__file__).parent / "golden").glob("*.txt"))


@pytest.mark.parametrize("script", GOLDEN, ids=lambda p: p.stem)
def test_golden(session, script):
    assert golden.run(session, script.read_text()) > 5


REFUSED = {
    "ExpectedSingleStatement": ["", ";", "select a from t; select a from t"],
    "UnsupportedStatement": ["drop table t", "explain create table x (a int)", "explain analyze select a from t", "truncate t", "create view v as select a from t", "create table x (a int unique)", "create table x (a int not null)", "create table if not exists x (a int)", "insert into t values (1) on conflict do nothing", "create table x as select a from t"],
    "UnsupportedQuery": ["select distinct a from t", "select a from t, u", "select a from t union select a from t", "select a from t having a > 1", "with x as (select a from t) select a from x", "select a from (select a from t)", "select 1", "select a from t limit 1 offset 2", "select a from t right join t on true", "select a from t left outer join t on true", "select a from t join t using (a)", "select a from t group by all", "select a from t for update", "values (1)", "select a from t limit 2, 3", "select a from t tablesample (5)", "select a from t order by all", "select a from t order by a with fill", "select a from t order by a interpolate (a)", "select top 3 a from t", "select a from t group by rollup (a)"],
    "UnsupportedExpression": ["select a * 2 from t", "select a / 2 from t", "select a from t where a in (1)", "select a from t where a between 1 and 2", "select case when a then 1 end from t", "select cast(a as int) from t", "select a::int from t", "select +a from t", "select avg(a) from t", "select count(distinct a) from t", "select sum(a) over () from t", "select a from t where s like 'x'", "select a from t where a is true", "select s || 'x' from t", "select upper(s) from t", "select x.t.a from t", "select a from t where exists (select a from t)"],
    "UnsupportedDataType": ["create table x (a float)", "create table x (a text)", "create table x (a double precision)", "create table x (a timestamp)", "create table x (a numeric(5))"],
    "VarcharMissingSize": ["create table x (a varchar)"],
    "Parse": ["select a from", "select a from t where", "select a b c from t", "insert t values (1)", "select a from t order a", "select 'open from t"],
    "TableNotFound": ["select a from missing", "insert into missing values (1)", "delete from missing", "select a from T", "create index i on missing (a)"],
    "ColumnNotFound": ["select z from t", "select t.z from t", "update t set z = 1", "insert into t (z) values (1)", "select a from t limit a", "create index i on t (z)"],
    "MissingFromClauseEntry": ["select q.a from t", "select t.a from t x", "select q.* from t"],
    "AmbiguousColumn": ["select a from t join t u on true", "select t.a from t join t on true"],
    "ComparisonTypeMismatch": ["select a from t where a = 'x'", "select a from t where b = 1", "select a from t where s < 1", "select a from t where s = true"],
    "ExpectedBoolean": ["select a from t where a", "select a from t join t u on t.a", "select not a from t", "select a and b from t", "select a from t where s or b"],
    "ExpectedNumeric": ["select s + 1 from t", "select -b from t", "select b - b from t", "select sum(s) from t"],
    "ExpectedInteger": ["select a from t limit 'x'", "select a from t limit true", "select a from t limit 1.5"],
    "NegativeLimit": ["select a from t limit -1", "select a from t limit 2 - 3"],
    "UngroupedColumn": ["select a, count(*) from t", "select a from t group by b", "select count(*) from t group by b order by a", "select a + 1 from t group by a + 2"],
    "AggregateInGroupBy": ["select count(*) from t group by count(*)"],
    "NestedAggregate": ["select sum(count(a)) from t"],
    "InsertValuesDoesntMatchColumns": ["insert into t values (1)", "insert into t (a) values (1, 2)", "insert into t (a) select a, b from t"],
    "DuplicateInsertColumns": ["insert into t (a, A) values (1, 2)"],
    "InsertValuesEmpty": ["insert into t values ()"],
    "InsertSchemaMismatch": ["insert into t (a) values ('x')", "insert into t (s) values (1)", "insert into t (a) values (3000000000)", "insert into t (k) values (40000)", "insert into t (a) values (1.5)", "insert into t (k) select a from t", "insert into t (a) values (1), ('x')"],
    "UpdateSchemaMismatch": ["update t set a = 'x'", "update t set b = 1", "update t set k = a"],
    "InvalidTableName": ["insert into __t values (1)"],
    "DuplicateTable": ["create table t (a int)"],
    "DuplicateColumn": ["create table x (a int, A int)"],
    "CreateTableWithoutColumns": ["create table x ()"],
    "PrimaryKeyColumnNotFound": ["create table x (a int, primary key (z))"],
    "DuplicatePrimaryKeyColumn": ["create table x (a int, primary key (a, a))"],
    "DuplicateIndexColumn": ["create index i on t (a, a)"],
    "UnsupportedIndexType": ["create index i on t (s)", "create index i on t (a, b, k)", "create table x (s varchar(4) primary key)"],
}


@pytest.fixture(scope="module")
def refusing(spark):
    s = Session(spark)
    s.sql("create table t (a int, b boolean, s varchar(8), k smallint)")
    s.sql("create table u (a int)")
    return s


@pytest.mark.parametrize("kind", REFUSED)
def test_refused(refusing, kind):
    for text in REFUSED[kind]:
        with pytest.raises(SqlError) as error:
            refusing.sql(text)
        assert error.value.kind == kind, text


def test_unsupported_bind_positions(refusing):
    for text in ("select a from t where count(*) > 1", "select a from t order by 1", "update t set a = count(a)"):
        with pytest.raises(SqlError) as error:
            refusing.sql(text)
        assert error.value.kind == "UnsupportedExpression"


def test_failed_primary_key_leaves_no_table(refusing):
    with pytest.raises(SqlError):
        refusing.sql("create table later (s varchar(4) primary key)")
    assert "later" not in refusing.catalog.tables


def test_types_and_overflow(spark, session):
    schema = T.StructType([T.StructField(n, t) for n, t in (("s", T.ShortType()), ("i", T.IntegerType()), ("l", T.LongType()), ("d", T.DoubleType()))])
    session.register("edge", spark.createDataFrame([((1 << 15) - 1, (1 << 31) - 1, (1 << 63) - 1, 1e308), (-(1 << 15), -(1 << 31), -(1 << 63), -0.0)], schema))
    kinds = dict(session.select("select s + i as a, i - l as b, l + d as c, s + s as e, -s as f, s + 1 as g, null as h, sum(i) as j from edge group by s, i, l, d").dtypes)
    assert kinds == {"a": "int", "b": "bigint", "c": "double", "e": "smallint", "f": "smallint", "g": "int", "h": "int", "j": "bigint"}
    for text in ("i + 1", "l + 1", "s + s", "-s", "-i", "-l", "i - s - i - i"):
        with pytest.raises(Exception, match="OVERFLOW"):
            session.select(f"select {text} as x from edge").collect()
        with pytest.raises(SqlError) as error:
            session.sql(f"select {text} as x from edge").rows()
        assert error.value.kind == "NumericOutOfRange"
    assert session.select("select d + d as x from edge where d > 0").collect()[0][0] == float("inf")
    assert session.select("select count(*) as n from edge where s < i and i < l").collect()[0][0] == 1


def test_grouping_of_special_doubles(spark, session):
    session.register("d", spark.createDataFrame([(x,) for x in (float("nan"), float("nan"), 0.0, -0.0, None, None, 1.5)], "x double"))
    got = sorted(map(str, session.sql("select x, count(*) as n from d group by x").rows()))
    assert got == sorted(["(nan, 2)", "(0.0, 2)", "(None, 2)", "(1.5, 1)"])


def test_names(spark):
    s = Session(spark)
    s.sql("create table t (a int, b int)")
    assert s.select("select a, a + b, count(*), b as c from t group by a, b").columns == ["a", "__unnamed#1", "__agg#0", "c"]
    assert s.select("select * from t x join t y on x.a = y.a").columns == ["x.a", "x.b", "y.a", "y.b"]
    assert Session.select(s, "select T.A from t").columns == ["a"]
    q = Session(spark, qualified=True, narrow=True)
    q.sql("create table t (a smallint, b int)")
    assert q.select("select a, count(*), sum(a) from t group by a").dtypes == [("t.a", "smallint"), ("__agg#0", "int"), ("__agg#1", "smallint")]


def test_change_is_all_or_nothing(session):
    session.sql("create table t (a int)")
    session.sql("insert into t values (1), (2147483647)")
    with pytest.raises(SqlError) as error:
        session.sql("update t set a = a + 1")
    assert error.value.kind == "NumericOutOfRange"
    assert sorted(session.sql("select a from t").rows()) == [(1,), (2147483647,)]
    assert session.sql("update t set a = a + 1 where a < 5").rows() == [(1,)]  # the other row's overflow never happens


def test_change_rewrites_only_parts_that_match(session):
    session.sql("create table t (a int)")
    for i in range(3):
        session.sql(f"insert into t values ({i}), ({i + 10})")
    before = session.catalog.get("t").parts
    assert session.sql("delete from t where a = 11").rows() == [(1,)]
    after = session.catalog.get("t").parts
    assert after[0] is before[0] and after[2] is before[2] and after[1] is not before[1]


def test_change_beyond_a_batch(session, spark):
    session.register("n", spark.range(1000).select(F.col("id").cast("int").alias("v")))
    assert session.sql("update n set v = v + 1 where v >= 500").rows() == [(500,)]
    assert session.sql("insert into n select v from n").rows() == [(1000,)]
    assert session.sql("delete from n where v > 999").rows() == [(2,)]
    assert session.sql("select count(*), max(v) from n").rows() == [(1998, 999)]


def test_many_inserts_make_few_parts(session):
    session.sql("create table t (a int)")
    for i in range(40):
        session.sql(f"insert into t values ({i})")
    table = session.catalog.get("t")
    assert len(table.parts) < 16 and sum(p._rows for p in table.parts) == 40
    assert session.sql("select count(*), min(a), max(a) from t").rows() == [(40, 0, 39)]
    assert session.sql("explain select a from t").rows()[0][0].count("Union") == 0  # one scan over all parts
    assert session.sql("update t set a = a + 1 where a >= 0").rows() == [(40,)] and len(table.parts) == 1
    assert session.catalog.vacuum() > 0
    assert sorted(r[0] for r in session.sql("select a from t").rows()) == list(range(1, 41))


def test_size_classes():
    """A thousand single rows, then larger ones: few parts, and each row is written a few times."""
    rows, written = [], 0
    for n in [1] * 1_000 + [300] * 40 + [None] + [2] * 20:
        rows.append(n)
        while k := due(rows):
            rows, merged = rows[:-k], sum(rows[-k:])
            rows.append(merged)
            written += merged
    assert len(rows) < 3 * 16 and None in rows and sum(r or 0 for r in rows) == 1_000 + 12_000 + 40
    assert written < 3 * 13_040


def test_values_of_many_rows(session):
    session.sql("create table t (a int, d double, s varchar(9), b boolean, k smallint, l bigint)")
    rows = ", ".join(f"({i} - 1, {i}, 's{i}', {'true' if i % 2 else 'null'}, -{i % 9}, {i})" for i in range(1_500))
    assert session.sql(f"insert into t values {rows}").rows() == [(1_500,)]
    got = session.sql("select count(*), sum(a), sum(d), count(b), min(k), max(l), max(s) from t").rows()
    assert got == [(1_500, sum(range(1_500)) - 1_500, float(sum(range(1_500))), 750, -8, 1_499, "s999")]
    with pytest.raises(SqlError) as error:
        session.sql("insert into t (a) values (1), (2147483647 + 1)")
    assert error.value.kind == "NumericOutOfRange"
    assert session.sql("select count(*) from t").rows() == [(1_500,)]


def test_too_long_values(session):
    session.sql("create table t (s varchar(3))")
    session.sql("insert into t values ('abc')")
    for text, kind in (("insert into t values ('abcd')", "InsertSchemaMismatch"), ("update t set s = 'abcd'", "UpdateSchemaMismatch")):
        with pytest.raises(SqlError) as error:
            session.sql(text)
        assert error.value.kind == kind
    assert session.sql("select s from t").rows() == [("abc",)]


def test_counts_are_bigint(session):
    session.sql("create table t (a int)")
    assert session.sql("insert into t values (1)").frame.dtypes == [("__insert_rows", "bigint")]
    assert session._count("insert", 1 << 40).rows() == [(1 << 40,)]


def test_words_of_the_grammar_as_names(session):
    words = "key index values check window primary references default any all_ top row interval array rollup cube set table update unique constraint returning nulls asc offset for explain foreign"
    for word in words.split():
        session.sql(f"create table n_{word} ({word} int, other int)")
        session.sql(f"insert into n_{word} ({word}, other) values (1, 2)")
        session.sql(f"update n_{word} set {word} = {word} + 1 where {word} = 1")
        assert session.sql(f"select {word}, t.{word}, other as {word}2 from n_{word} t where {word} > 0 order by {word}").rows() == [(2, 2, 2)]
        assert session.sql(f"select {word}, count(*) from n_{word} group by {word}").rows() == [(2, 1)]
    session.sql("create table index (key int primary key, check varchar(2))")
    session.sql("insert into index values (1, 'x')")
    assert session.select("select key, check as values from index where index.key = 1").columns == ["key", "values"]
    session.sql("create index i on index (key)")


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(master="yarn", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        Catalog(SimpleNamespace(sparkContext=context)).new_path("t")


def test_explain(session):
    session.sql("create table t (a int)")
    raw, plan = (session.sql(f"explain {x}select a from t where a > 1").frame for x in ("(raw) ", ""))
    assert raw.columns == plan.columns == ["QUERY PLAN"] and "Filter" in raw.collect()[0][0]
    for text in ("insert into t values (1)", "update t set a = 2", "delete from t where a = 1"):
        assert session.sql(f"explain {text}").rows()[0][0]
    assert session.sql("select count(*) from t").rows() == [(0,)]


def test_pushdown_and_pruning(spark, session, tmp_path):
    spark.range(100).selectExpr("id as k", "id * 2 as v", "cast(id as string) as s").write.parquet(str(tmp_path / "wide.parquet"))
    session.register_parquet(str(tmp_path), "wide")
    plan = session.sql("explain select v from wide where k > 90").rows()[0][0]
    assert "PushedFilters: [IsNotNull(k), GreaterThan(k,90)]" in plan and "ReadSchema: struct<k:bigint,v:bigint>" in plan
    assert "TakeOrderedAndProject" in session.sql("explain select v from wide order by k limit 3").rows()[0][0]


def test_repl(session):
    out = io.StringIO()
    loop(session, io.StringIO("create table t (a int);\ninsert into t\nvalues (1), (null);\n.tables\nselect a from t order by a;\nselect z from t;\n.quit\n"), out)
    assert out.getvalue() == "CREATE TABLE\n2\nt\n1\nNULL\nerror: ColumnNotFound: z\n"


def test_repl_skips_what_is_blank_and_survives_errors(session, spark):
    out = io.StringIO()
    session.register("broken", spark.range(1).selectExpr("raise_error('no such thing') as a"))
    loop(session, io.StringIO("\n  \n;\n.tables\n\nselect a\n\nfrom broken;\n;;\n.nothing\n.quit\nselect 1;\n"), out)
    said = out.getvalue().splitlines()
    assert said[0] == "broken" and said[1].startswith("error: ") and said[2:] == ["unknown command .nothing"]


def test_parse_is_pure():
    assert parse("select a from t where (a) = 1 ;; ") == parse("SELECT a FROM t WHERE a = 1")


def _model(e, row):
    """Expressions over one row, in plain Python."""
    op = e[0]
    if op == "lit":
        return e[1]
    if op == "col":
        return row[e[1]]
    values = [_model(x, row) for x in e[1:]]
    if op == "isnull":
        return values[0] is None
    if op == "not":
        return None if values[0] is None else not values[0]
    if op == "and":
        return False if False in values else None if None in values else True
    if op == "or":
        return True if True in values else None if None in values else False
    if None in values:
        return None
    a, b = values
    return {"+": lambda: a + b, "-": lambda: a - b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">=": lambda: a >= b}[op]()


def _text(e):
    op = e[0]
    if op == "lit":
        return "null" if e[1] is None else str(e[1]).lower() if isinstance(e[1], bool) else str(e[1]) if e[1] >= 0 else f"({e[1]})"
    if op == "col":
        return e[1]
    parts = [_text(x) for x in e[1:]]
    return f"({parts[0]} is null)" if op == "isnull" else f"(not {parts[0]})" if op == "not" else f"({parts[0]} {op} {parts[1]})"


def _random(rng, kind, depth):
    if depth == 0:
        if kind == "number":
            return rng.choice([("col", "i"), ("col", "k"), ("lit", rng.randint(-9, 9)), ("lit", None)])
        return rng.choice([("col", "f"), ("lit", True), ("lit", False), ("lit", None)])
    down = lambda k: _random(rng, k, depth - 1)
    if kind == "number":
        return (rng.choice("+-"), down("number"), down("number"))
    op = rng.choice(["and", "or", "not", "isnull", "=", "<>", "<", ">="])
    if op == "not":
        return op, down("truth")
    if op == "isnull":
        return op, down(rng.choice(["truth", "number"]))
    return (op, down("truth"), down("truth")) if op in ("and", "or") else (op, down("number"), down("number"))


def test_expressions_against_a_model(spark, session):
    rng = random.Random(4)
    rows = [{"i": i, "k": k, "f": f} for i in (-3, 0, 7, None) for k in (1, None) for f in (True, False, None)]
    session.register("r", spark.createDataFrame([tuple(r.values()) for r in rows], "i int, k bigint, f boolean"))
    found = [_random(rng, rng.choice(["number", "truth"]), rng.randint(1, 3)) for _ in range(60)]
    got = session.select("select i, k, f, " + ", ".join(f"{_text(e)} as e{n}" for n, e in enumerate(found)) + " from r").collect()
    assert len(got) == len(rows)
    for row in got:
        at = {"i": row.i, "k": row.k, "f": row.f}
        for n, e in enumerate(found):
            assert row[f"e{n}"] == _model(e, at), (_text(e), at)


@pytest.mark.parametrize("kind", ["JOIN", "LEFT JOIN"])
def test_joins_without_equality_use_all_cores(spark, session, kind):
    """Tables of one partition, as files of one row group give them."""
    session.register("few", spark.range(2_000).selectExpr("id AS k", "id * 7919 % 2003 AS v").coalesce(1))
    session.register("many", spark.range(3_000).selectExpr("id AS k", "id * 104729 % 3001 AS v").coalesce(1))
    got = session.select(f"SELECT a.k AS x, b.k AS y FROM few a {kind} many b ON a.k < b.k AND a.v > b.v")
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    left, right = [(k, k * 7919 % 2003) for k in range(2_000)], [(k, k * 104729 % 3001) for k in range(3_000)]
    pairs = [(k, [m for m, w in right if k < m and v > w]) for k, v in left]
    assert sorted((r.x, -1 if r.y is None else r.y) for r in got.collect()) == sorted((k, m) for k, ms in pairs for m in (ms or ([-1] if kind == "LEFT JOIN" else [])))


def test_results_of_joins_by_comparison_take_few_bytes(spark, session, tmp_path):
    """Results grow with the product of the sides; the order of rows decides how well columns are encoded."""
    session.register("few", spark.range(3_000).selectExpr("id AS k", "id % 5 AS n", "id * 7919 % 3001 AS v").coalesce(1))
    session.register("many", spark.range(5_000).selectExpr("id AS k", "id % 5 AS n", "id * 104729 % 3001 AS v").coalesce(1))
    session.select("SELECT a.k AS x, b.k AS y FROM few a JOIN many b ON a.n < b.n AND a.v > b.v").write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").count()
    left, right = [(k % 5, k * 7919 % 3001) for k in range(3_000)], np.array([(k % 5, k * 104729 % 3001) for k in range(5_000)])
    assert rows == sum(int(((right[:, 0] > n) & (right[:, 1] < v)).sum()) for n, v in left)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.7 * rows


@pytest.mark.parametrize("on", ["a.x < b.y", "b.y <= a.x AND a.s > b.s", "a.x >= b.y AND a.i + 1 <> b.i", "a.i <= b.y AND 3 > b.i"])
def test_joins_by_comparison_of_odd_values(spark, session, monkeypatch, on):
    """NULL, NaN, zeros of both signs, infinities, equal rows and columns of different types."""
    monkeypatch.setattr(relational, "PAIR_BYTES", 0)
    monkeypatch.setattr(relational, "SMALL_SIDE", 2**70)
    monkeypatch.setattr(relational, "BLOCK_ROWS", 4)
    odd = [None, float("nan"), -0.0, 0.0, float("inf"), float("-inf"), 1.5, 2.0]
    rows = [(odd[i % 8], odd[i * 5 % 7], i % 6 if i % 4 else None, [None, "", "b", "ü"][i % 3]) for i in range(60)]
    for name in ("a", "b"):
        spark.createDataFrame(rows if name == "a" else rows[::-2], "x double, y double, i int, s string").coalesce(1).createOrReplaceTempView(f"odd_{name}")
        session.register(name, spark.table(f"odd_{name}"))
    plan = (got := session.select(f"SELECT a.x, b.y, b.s FROM a JOIN b ON {on} WHERE a.i >= 0"))._jdf.queryExecution().optimizedPlan().toString()
    assert "least_" in plan
    wanted = spark.sql(f"SELECT a.x, b.y, b.s FROM odd_a a CROSS JOIN odd_b b WHERE a.i >= 0 AND {on}")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
    count = session.sql(f"SELECT count(*) AS n FROM a JOIN b ON {on} CROSS JOIN b c").rows()
    assert count == [(spark.sql(f"SELECT 1 FROM odd_a a CROSS JOIN odd_b b WHERE {on}").count() * 30,)]
