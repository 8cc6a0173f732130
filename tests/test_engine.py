"""The engine's operators on tiny tables, and its queries against their DuckDB forms."""

import os
import random

import duckdb
import pytest

from wefthread.operators import graph, resolve, search, traverse
from wefthread.plans import catalog
from wefthread.sources import store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for file in os.listdir(SF):
        c.execute(f"create view {file[:-8]} as select * from '{SF}/{file}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in cur.fetchall())


def test_communities_of_two_triangles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("c", "x")]
    found = graph.louvain_moves(pairs)
    assert len({found[n] for n in "abc"}) == 1 and len({found[n] for n in "xyz"}) == 1 and found["a"] != found["x"]
    rows = graph.communities(spark.createDataFrame([(g, a, b) for g in (1, 2) for a, b in pairs], "graph_id long, source string, target string")).collect()
    assert len(rows) == 12 and {r.community for r in rows} == {0, 1}


def bfs(edges, start, depth):
    seen, front, out = {start}, [start], {}
    for d in range(1, depth + 1):
        new = []
        for n in front:
            for _, other, kind, conf in sorted((e for e in edges if e[0] == n), key=lambda e: (e[1], -e[3], e[2])):
                if other not in seen:
                    seen.add(other)
                    new.append(other)
                    out[other] = (d, conf, kind)
        front = new
    return out


def test_impact_equals_a_queue(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(12), rng.randrange(12), rng.choice(["CALLS", "IMPORTS"]), rng.choice([0.5, 0.7, 0.9])) for _ in range(30)]
    frame = spark.createDataFrame(edges, "source_id long, target_id long, kind string, confidence double")
    starts = spark.createDataFrame([(i,) for i in range(4)], "origin_id long")
    got = {}
    for r in traverse.impact(frame, starts, "downstream", 4).collect():
        got.setdefault(r.origin_id, {})[r.id] = (r.depth, r.confidence, r.kind)
    for i in range(4):
        assert got.get(i, {}) == bfs(edges, i, 4)


def test_query_grammar():
    assert search.parse('a AND "b c" OR d*', ["x"]) == search.Either((search.Both((search.Phrase(("a",)), search.Phrase(("b", "c")))), search.Phrase(("d",), True)))
    assert search.parse("find_by_id", []) == search.Phrase(("find", "by", "id"))
    for bad in ("", "a.b", "src/x.rb", "foo-bar", "(a", "y:a", "AND"):
        with pytest.raises(search.QueryError):
            search.parse(bad, ["x"])


def test_cascade_stops_at_the_first_success(spark):
    symbols = spark.createDataFrame(
        [("m1", "run", "Method", "a.ts", False, "Job", None), ("f1", "run", "Function", "b.ts", True, None, None), ("p1", "job", "Property", "b.ts", False, "Box", "Job"), ("g", "only", "Function", "c.ts", True, None, None)],
        "uid string, name string, kind string, file_path string, is_exported boolean, parent_name string, type_annotation string",
    )
    calls = spark.createDataFrame([(1, "run", "job", "Box", "b.ts"), (2, "only", None, None, "x.ts"), (3, "gone", "Lib", None, "x.ts"), (4, "run", None, None, "b.ts")], "call_id long, callee string, receiver string, caller_parent string, file_path string")
    got = {r.call_id: (r.target_uid, r.confidence, r.reason) for r in resolve.resolve_calls(calls, symbols, spark.createDataFrame([], "file_path string, target_path string")).collect()}
    assert got == {1: ("m1", 0.9, "field-type-annotation"), 2: ("g", 0.8, "unique-global-match"), 3: ("External:<external>:Lib.gone:0", 0.0, "unresolved"), 4: ("f1", 0.9, "same-file-match")}


def test_guard_and_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.write("file_index", spark.createDataFrame([("a", 1, "5", "go", 3)], store.TABLES["file_index"]))
    s.write("file_index", store.upsert(s.read("file_index"), spark.createDataFrame([("a", 2, "6", "go", 3), ("b", 1, "6", "go", 3)], store.TABLES["file_index"]), ["path"]))
    assert sorted(r.path for r in s.sql("select path from file_index").collect()) == ["a", "b"]
    assert s.sql("with x as (select 1 as one) select * from x").collect()[0].one == 1
    assert s.status().first().file_index == 2
    for bad in ("drop table x", "insert into file_index select 1", "with x as (select 1) insert into file_index select * from x"):
        with pytest.raises(ValueError):
            s.sql(bad)
    registry = str(tmp_path / "r" / "repos.json")
    assert [store.register(registry, p, "1") for p in ("/x/App", "/y/app", "/x/App")] == ["app", "app-2", "app"]


def test_trace_dedup(spark):
    rows = [(1, [1, 2, 3]), (2, [1, 2]), (3, [1, 4, 3]), (4, [1, 4, 5, 3]), (5, [9, 8])]
    assert sorted(r.trace_id for r in graph.dedup_traces(spark.createDataFrame(rows, "trace_id long, path array<long>")).collect()) == [4, 5]


def test_index_scores_as_the_texts_do(spark, tmp_path):
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "alphabet", "été", "x1"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12))) if i % 9 else None, rng.choice(words)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, a string, b string")
    search.write_index(docs, "doc_id", ["a", "b"], str(tmp_path / "index"))
    index = search.read_index(spark, str(tmp_path / "index"), "long", ["a", "b"])
    for query in ("alpha beta", "alpha OR ete", '"alpha beta"', "alph*", '"beta alph"*', "alpha NOT gamma", "a:alpha b:beta", '"alpha alpha alpha"', "nothing", "alpha OR (beta gamma) OR alpha"):
        want = {r.doc_id: round(r.score, 9) for r in search.bm25(docs, "doc_id", ["a", "b"], query).collect()}
        assert {r.id: round(r.score, 9) for r in search.bm25_indexed(index, query).collect()} == want, query
    empty = str(tmp_path / "empty")
    search.write_index(docs.limit(0), "doc_id", ["a", "b"], empty)
    assert search.bm25_indexed(search.read_index(spark, empty, "long", ["a", "b"]), "alpha").collect() == []


def test_fusion_with_and_without_words(spark):
    hits = spark.createDataFrame([(1, 9.0), (2, 8.0)], "id long, score double")
    near = spark.createDataFrame([(2, 0.9), (3, 0.8)], "id long, score double")
    both = {r.id: r.score for r in search.hybrid(hits, near, "id", 10).collect()}
    assert both == {1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62}
    assert [(r.id, r.score) for r in search.hybrid(hits.limit(0), near, "id", 10).collect()] == [(2, 0.9), (3, 0.8)]
    assert [r.id for r in search.hybrid(hits, near.limit(0), "id", 10).collect()] == [1, 2]
