"""Rows that steps make where many rows share a name: they follow the input, not its square."""

import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from wefthread.operators import resolve, search
from wefthread.plans import catalog, driver_views

N = 300


def most_rows(spark, df, metric="numOutputRows"):
    """The most rows that an operator of the plan gave."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        todo, most = [df._jdf.queryExecution().executedPlan()], 0
        while todo:
            plan = todo.pop()
            found = plan.metrics().get(metric)
            if found.isDefined():
                most = max(most, found.get().value())
            children = plan.children()
            todo += [children.apply(i) for i in range(children.size())]
        return most
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.range(N).select(
        F.concat(F.lit("m"), "id").alias("uid"), F.lit("run").alias("name"), F.lit("Method").alias("kind"), F.lit("a.rb").alias("file_path"), (F.col("id") % 2 == 0).alias("is_exported"), F.concat(F.lit("J"), F.col("id") % 2).alias("parent_name"),
        F.lit(None).cast("string").alias("type_annotation"), F.col("id").alias("ord"), (F.col("id") % 5).cast("int").alias("start_line"), (F.col("id") % 5 + 1).cast("int").alias("end_line"),
    )


def test_heirs_of_a_name_that_many_bear(spark):
    kind = F.when(F.col("id") % 3 == 0, "Class").when(F.col("id") % 3 == 1, "Interface").otherwise("Enum")
    rows = spark.range(N).select(F.concat(F.lit("s"), "id").alias("uid"), F.lit("Base").alias("name"), kind.alias("kind"), F.lit("f").alias("file_path"), (F.lit(N) - F.col("id")).alias("ord"), F.lit(None).cast("string").alias("parent_name"), F.lit("x::Base").alias("superclass"), F.array(F.lit("Base"), F.lit("none")).alias("interfaces"))
    df = resolve.inheritance(rows)
    assert most_rows(spark, df) <= 10 * N
    got = {(r.source_uid, r.place): (r.target_uid, r.kind) for r in df.collect()}
    assert len(got) == 2 * N and got["s0", -1] == ("s297", "EXTENDS") and got["s0", 0] == ("s298", "IMPLEMENTS") and got["s1", 0] == ("s298", "EXTENDS")


def test_flows_of_a_name_that_many_bear(spark, symbols):
    flows = spark.range(N).select(F.lit("a.rb").alias("file_path"), F.col("id").alias("ord"), F.lit("run").alias("enclosing_function"), F.when(F.col("id") % 7 > 0, "J1").alias("enclosing_parent"), (F.col("id") % 8).cast("int").alias("source_line"))
    df = resolve.flow_functions(flows, symbols)
    assert most_rows(spark, df) <= 10 * N
    def want(i):
        fit = [k for k in range(1, N, 2) if i % 7 and k % 5 <= i % 8 <= k % 5 + 1]
        return f"m{fit[0]}" if fit else None
    assert {r.ord: r.function_uid for r in df.collect()} == {i: want(i) for i in range(N)}


def test_callers_of_a_name_that_many_bear(spark, symbols):
    parent = F.when(F.col("id") % 3 == 0, "J1").when(F.col("id") % 3 == 1, "Z")
    calls = spark.range(N).select(F.col("id").alias("call_id"), F.lit("a.rb").alias("file_path"), F.when(F.col("id") % 4 > 0, "run").alias("caller_name"), parent.alias("caller_parent"))
    cls = symbols.where("ord < 2").withColumn("uid", F.concat(F.lit("c"), "ord")).withColumn("name", F.lit("Z")).withColumn("kind", F.lit("Class"))
    df = resolve.callers(calls, symbols.union(cls))
    assert most_rows(spark, df) <= 10 * N
    want = {i: ("m1" if i % 3 == 0 else "m0") if i % 4 else "c0" for i in range(N) if i % 4 or i % 3 == 1}
    assert {r.call_id: r.source_uid for r in df.collect()} == want


def test_calls_meet_the_symbols_of_their_first_strategy_only(spark, symbols):
    one = symbols.where("ord = 0").withColumn("uid", F.lit("mine")).withColumn("parent_name", F.lit("Own"))
    calls = spark.range(N).select(F.col("id").alias("call_id"), F.when(F.col("id") % 3 == 2, "gone").otherwise("run").alias("callee"), F.lit("this").alias("receiver"), F.lit("Own").alias("caller_parent"), F.lit("a.rb").alias("file_path"))
    df = resolve.resolve_calls(calls, symbols.union(one), spark.createDataFrame([], "file_path string, target_path string"))
    assert most_rows(spark, df) <= 10 * N  # every symbol has the file and the name of most calls
    assert {r.call_id: (r.target_uid, r.prio) for r in df.collect()} == {i: ("mine", 2) if i % 3 < 2 else ("External:<external>:gone:0", 9) for i in range(N)}


def test_types_with_the_same_methods_meet_interfaces_once(spark):
    methods = spark.range(10 * N).select((F.col("id") % N).alias("type_name"), (F.col("id") / N).cast("int").alias("method"), F.lit(None).cast("int").alias("arity")).where("type_name > 0 or method < 5")
    wanted = spark.range(80).select((F.col("id") % 8).alias("interface"), (F.col("id") / 8).cast("int").alias("method"), F.lit(1).alias("arity")).where("interface < 2 and (interface = 0 or method < 4) or method = 11")
    df = resolve.structural_implements(methods, wanted)
    assert most_rows(spark, df) <= 10 * N  # the rows that come in
    assert sorted(map(tuple, df.collect())) == [(t, i) for t in range(N) for i in (0, 1) if t or i]


def test_places_of_words_are_not_dealt(spark):
    docs = spark.range(20).select("id", F.repeat(F.lit("one two "), 30).alias("a"), F.when(F.col("id") > 3, "two").alias("b"))
    df = search.postings(docs, "id", ["a", "b"], 3)
    assert most_rows(spark, df, "shuffleRecordsWritten") == 20
    rows = {(r.token, r.id, r.column): r.positions for r in df.collect()}
    assert len(rows) == 56 and rows["two", 5, "a"] == list(range(1, 60, 2)) and rows["two", 5, "b"] == [0]


def test_pairs_of_parts_are_counted_in_blocks(spark):
    lines = spark.range(60).select((F.col("id") % 15).alias("l_orderkey"), (F.col("id") * F.col("id") % 7).alias("l_partkey"))
    df = driver_views._bought_together(lines, 9)
    assert df.rdd.getNumPartitions() == 9
    lines.createOrReplaceTempView("lineitem")
    assert sorted(df.collect()) == sorted(spark.sql(driver_views._PAIRS).collect())


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def thrice(tmp_path_factory):
    """The tables with the rows of keyed ones three times, under other keys."""
    to, con = tmp_path_factory.mktemp("thrice"), duckdb.connect()
    tables = {"customer": ["custkey"], "supplier": ["suppkey"], "part": ["partkey"], "lineitem": ["orderkey", "partkey", "suppkey"]}
    for file in os.listdir(SF):
        keys = tables.get(file[:-8])
        if keys is None:
            shutil.copy(f"{SF}/{file}", to)
        else:
            moved = ", ".join(f"{file[0]}_{k} + 2000 * n AS {file[0]}_{k}" for k in keys)
            con.execute(f"copy (select * replace ({moved}) from '{SF}/{file}', range(3) r(n)) to '{to}/{file}' (format parquet)".replace("select *", "select * exclude (n)"))
    return str(to)


@pytest.mark.parametrize("name", ["context_candidates"])
def test_query_matches_oracle_where_names_repeat(spark, thrice, name):
    con = duckdb.connect()
    for file in os.listdir(thrice):
        con.execute(f"create view {file[:-8]} as select * from '{thrice}/{file}'")
    df = catalog.queries()[name](spark, thrice)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert got == sorted(map(str, con.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]}) x").fetchall()))
