"""Operators, semantics, the index, and equal results under any partitioning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from grainmill.functions import semantics
from grainmill.operators import relational as rel
from grainmill.operators.index import KeyIndex
from grainmill.plans.grammar import Call, Create, Insert, Name, Op, Select, SqlError, Star, parse, tokens


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(2000).select(F.col("id").cast("int").alias("id"), (F.col("id") * 2).cast("int").alias("val"))


@pytest.fixture(scope="module")
def refs(spark):
    return spark.range(1000).select(F.col("id").cast("int").alias("data_id"), (F.col("id") + 100).cast("int").alias("score"))


@pytest.mark.parametrize("n", [1, 2, 4, 8])
def test_parallel_equals_serial(data, refs, n):
    assert {r.id for r in data.repartition(n).collect()} == set(range(2000))
    joined = rel.join_on(data.repartition(n), refs.repartition(n), "id", "data_id")
    assert joined.count() == 1000
    ids = [r.id for r in rel.order_by(data.repartition(n), [("id", True)]).collect()]
    assert ids == list(range(2000))
    assert [r.id for r in rel.order_by(data.limit(5).repartition(n), [("id", False)]).collect()] == [4, 3, 2, 1, 0]


@pytest.mark.parametrize("hint", [None, "broadcast", "merge", "shuffle_hash"])
def test_join_strategies_agree(data, refs, hint):
    joined = rel.join_on(data, refs, "id", "data_id", hint)
    assert sorted((r.id, r.score) for r in joined.collect()) == [(i, i + 100) for i in range(1000)]


def _sides(spark, folder, rows, keys="id % 2"):
    for side, n in zip("ab", rows, strict=True):
        spark.range(n).selectExpr(f"id AS {side}_id", f"{keys} AS {side}_key", "sha(cast(id AS string)) AS " + side + "_text").coalesce(1).write.parquet(f"{folder}/{side}")
    return [spark.read.parquet(f"{folder}/{side}") for side in "ab"]


def test_pairs_of_a_key_are_dealt_over_tasks(spark, tmp_path):
    a, b = _sides(spark, tmp_path, (6000, 5000))
    each = rel.join_on(a, b, "b_key", "a_key").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("a_id").alias("a"), F.sum("b_id").alias("b")).collect()
    assert sum(r.n for r in each) == 2 * 3000 * 2500
    assert max(r.n for r in each) < sum(r.n for r in each) / 3  # one file a side: all were in one task, or in one a key
    assert (sum(r.a for r in each), sum(r.b for r in each)) == (2500 * sum(range(6000)), 3000 * sum(range(5000)))


@pytest.mark.parametrize("keys", ["if(id % 10 = 0, null, id % 3)", "cast(id % 3 AS string)", "if(id % 3 = 0, double('NaN'), -0.0 * (id % 2))", "if(id < 900, 0, id)"])
def test_dealt_pairs_are_those_of_the_join(spark, tmp_path, monkeypatch, keys):
    for name, value in (("SIDE", 50), ("FAN_OUT", 2), ("SMALL_BYTES", 1)):
        monkeypatch.setattr(rel, name, value)
    a, b = _sides(spark, tmp_path, (1000, 301), keys)
    expected = rel.join_on(a.union(a.limit(0)), b, "a_key", "b_key")  # a union is not a plain scan
    got = rel.join_on(a, b, "a_key", "b_key")
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString() and "__left" in got._jdf.queryExecution().optimizedPlan().toString()
    assert "__left" not in expected._jdf.queryExecution().optimizedPlan().toString() and got.columns == expected.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect())) != []
    few = rel.join_on(a, b, "a_id", "b_id")
    assert "__left" not in few._jdf.queryExecution().optimizedPlan().toString() and few.count() == 301


def test_dealt_pairs_of_equal_rows_and_mixed_keys(spark, tmp_path, monkeypatch):
    for name, value in (("SIDE", 20), ("FAN_OUT", 2), ("SMALL_BYTES", 1)):
        monkeypatch.setattr(rel, name, value)
    spark.range(300).selectExpr("id % 4 AS n").coalesce(1).write.parquet(f"{tmp_path}/n")
    spark.range(200).selectExpr("concat(if(id % 5 = 4, '0', ''), id % 4) AS t", "id % 7 AS x").coalesce(1).write.parquet(f"{tmp_path}/t")
    got = rel.join_on(spark.read.parquet(f"{tmp_path}/n"), spark.read.parquet(f"{tmp_path}/t"), "t", "n")
    assert "__left" in got._jdf.queryExecution().optimizedPlan().toString()
    rows = [(i % 4, ("0" if i % 5 == 4 else "") + str(i % 4), i % 7) for i in range(200)]
    assert sorted(map(tuple, got.collect())) == sorted((n, t, x) for n, t, x in rows if t == str(n) for _ in range(75))


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_size between 5 and 9").select("p_partkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,5)" in plan and "LessThanOrEqual(p_size,9)" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_averages_truncate(spark):
    df = spark.createDataFrame([("a", -5), ("a", 0), ("b", 5), ("b", 0), ("c", None)], "k string, v int")
    got = {r.k: r.m for r in df.groupBy("k").agg(semantics.int_avg(F.col("v")).alias("m")).collect()}
    assert got == {"a": -2, "b": 2, "c": None}


def test_wrapping(spark):
    df = spark.createDataFrame([(2**31,), (-(2**31) - 1,), (5,)], "v bigint")
    assert [r[0] for r in df.select(semantics.int32_wrap(F.col("v"))).collect()] == [-(2**31), 2**31 - 1, 5]


def test_global_aggregate_over_nothing(spark):
    df = spark.createDataFrame([], "v int")
    assert semantics.global_agg(df, F.count("*")).count() == 0
    assert semantics.global_agg(df, F.count("*"), empty="row").count() == 1


@pytest.mark.parametrize(("text", "n", "expected"), [("héllo", 2, "h"), ("héllo", 3, "hé"), ("😀a", 3, ""), ("😀a", 4, "😀"), ("abc", 9, "abc"), ("", 1, "")])
def test_fit_bytes(spark, text, n, expected):
    assert spark.createDataFrame([(text,)], "s string").select(semantics.fit_bytes(F.col("s"), n)).first()[0] == expected


def test_fit_bytes_of_long_texts(spark):
    text = "é漢😀a" * 8000
    for n in (1, 2, 3, 1001, 1002, 1003, 1004, 65535):
        expected = text.encode()[:n].decode("utf-8", "ignore")
        assert spark.createDataFrame([(text,)], "s string").select(semantics.fit_bytes(F.col("s"), n)).first()[0] == expected


def test_places_are_counted_after_the_sort(spark):
    rows = [(i * 37 % 101, i) for i in range(500)]
    got = rel.placed(spark.createDataFrame(rows, "a int, b int").repartition(7), [("a", False), ("b", True)]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r.place for r in got) == list(range(1, 501))


def test_latest_of_equal_writes(spark):
    from grainmill.operators.index import latest

    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "c"), (1, 5, "b"), (1, 4, "z"), (2, None, "x")], "k int, seq int, v string")
    for n in (1, 3):
        assert sorted(tuple(r) for r in latest(df.repartition(n), "k", "seq").select("k", "v").collect()) == [(1, "c"), (2, "x")]


def test_group_keys_do_not_run_together(spark):
    df = spark.createDataFrame([("a|", "b"), ("a", "|b")], "x string, y string")
    assert rel.aggregate(df, ["x", "y"], [rel.Aggregate("COUNT", None, "n")]).count() == 2


def test_multimap(spark):
    df = spark.createDataFrame([(42, i) for i in range(5)] + [(1, 9)], "k int, v int")
    assert {r.k: r["values"] for r in rel.multimap(df, "k", "v").collect()} == {42: [0, 1, 2, 3, 4], 1: [9]}


def test_index(spark, tmp_path):
    rows = spark.createDataFrame([(i, i, 0) for i in range(99, -1, -1)] + [(42, 99, 1)], "key int, slot int, seq int")
    found = KeyIndex.build(rows, "key", str(tmp_path / "index"), seq="seq")
    assert found.lookup(42).first().slot == 99 and found.lookup(7).first().slot == 7
    assert found.lookup(100).count() == 0 and not found.is_empty()
    assert [r.key for r in found.range(10, 20).collect()] == list(range(10, 21))
    plan = found.range(10, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,10)" in plan and "LessThanOrEqual(key,20)" in plan


def test_tokens():
    assert [t.kind for t in tokens("select * from Users")] == ["SELECT", "*", "FROM", "name", "end"]
    assert [t.kind for t in tokens("<= >= != <> < > =")] == ["<=", ">=", "!=", "!=", "<", ">", "=", "end"]
    with pytest.raises(SqlError):
        tokens("a # b")


def test_statements():
    made = parse("CREATE TABLE u (id INT, name VARCHAR(50), age INT)")
    assert isinstance(made, Create) and [c.length for c in made.columns] == [None, 50, None]
    assert parse("INSERT INTO u VALUES (1, 'Al', 3)") == Insert("u", [(1, "Al", 3)])
    made = parse("SELECT COUNT(*), SUM(x) AS s FROM t WHERE a > 1 AND b < 2 OR NOT c = 'x'")
    assert isinstance(made, Select) and made.items == [(Call("COUNT", Star()), None), (Call("SUM", Name("x")), "s")]
    assert made.where.sign == "OR" and made.where.operands[1] == Op("NOT", (Op("=", (Name("c"), parse("SELECT 'x' FROM t").items[0][0])),))
