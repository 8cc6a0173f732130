"""Every registered query of the engine with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wefthread.functions.text import MARKED, PLAIN
from wefthread.operators import evaluate, graph, resolve, search, traverse
from wefthread.plans import driver_views as v
from wefthread.plans import ingest, resolution, stored
from wefthread.sources import store

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- traversal ---------------------------------------------------------------


@query(f"{v.WITH}, {v.impact_sql(v.HUB_SQL, 'downstream', 3, 0.5, 'kind = ' + repr('CALLS'))} SELECT origin_id, id, depth, round(confidence, 6) AS confidence, kind FROM reached")
def impact_downstream_calls(spark, sf):
    e = v.edges(spark, sf)
    return traverse.impact(e, v.hub(e), "downstream", 3, 0.5, True).withColumn("confidence", F.round("confidence", 6))


_PARTS = f"SELECT CAST({5 * v.BASE} + p_partkey AS BIGINT) AS origin_id FROM part WHERE p_size = 7"


@query(f"{v.WITH}, {v.impact_sql(_PARTS, 'upstream', 3, 0.5)} SELECT origin_id, id, depth, round(confidence, 6) AS confidence, kind FROM reached")
def impact_upstream_d3(spark, sf):
    starts = v.table(spark, sf, "part").where("p_size = 7").select((F.lit(5 * v.BASE) + F.col("p_partkey")).alias("origin_id"))
    return traverse.impact(v.edges(spark, sf), starts).withColumn("confidence", F.round("confidence", 6))


_SUMMARY = """ SELECT origin_id, count(*) AS total, count(*) FILTER (depth = 1) AS direct,
 CASE WHEN coalesce(bool_or(depth = 1 AND is_exported), false) OR count(*) >= 10 THEN 'high' WHEN count(*) FILTER (depth = 1) > 0 THEN 'medium' ELSE 'low' END AS risk
 FROM reached JOIN nd USING (id) GROUP BY 1"""


@query(f"{v.WITH}, {v.impact_sql(_PARTS, 'upstream', 3, 0.5)} {_SUMMARY}")
def impact_summary(spark, sf):
    return traverse.summarise(impact_upstream_d3(spark, sf), v.nodes(spark, sf))


_RANGE_SQL = "SELECT DISTINCT file_path, min(start_line) + 10 AS lo, min(start_line) + 60 AS hi FROM nd WHERE kind = 'Function' GROUP BY file_path"
_HIT_SQL = f"SELECT nd.* FROM nd WHERE kind = 'Function' AND EXISTS (SELECT 1 FROM ({_RANGE_SQL}) r WHERE r.file_path = nd.file_path AND nd.start_line <= r.hi AND nd.end_line >= r.lo)"


def _in_ranges(spark, sf):
    n = v.nodes(spark, sf).where("kind = 'Function'")
    ranges = n.groupBy("file_path").agg((F.min("start_line") + 10).alias("lo"), (F.min("start_line") + 60).alias("hi"))
    return traverse.overlapping(n, ranges)


@query(f"{v.WITH} SELECT id, file_path, start_line, end_line FROM ({_HIT_SQL}) x")
def symbols_in_range(spark, sf):
    return _in_ranges(spark, sf).select("id", "file_path", "start_line", "end_line")


_FIRST = f"SELECT id AS origin_id FROM ({_HIT_SQL}) x ORDER BY file_path, start_line, id LIMIT 20"


@query(f"{v.WITH}, {v.impact_sql(_FIRST, 'upstream', 3, 0.5)} {_SUMMARY}")
def impact_batch_ranges(spark, sf):
    starts = _in_ranges(spark, sf).orderBy("file_path", "start_line", "id").limit(20).select(F.col("id").alias("origin_id"))
    return traverse.summarise(traverse.impact(v.edges(spark, sf), starts), v.nodes(spark, sf))


_NATION = 2 * v.BASE + 3
_SUB = f"""{v.WITH}, o0 AS (SELECT CAST({_NATION} AS BIGINT) AS id), o1 AS (SELECT DISTINCT target_id AS id FROM e JOIN o0 ON source_id = o0.id),
o2 AS (SELECT DISTINCT target_id AS id FROM e JOIN o1 ON source_id = o1.id), i1 AS (SELECT DISTINCT source_id AS id FROM e JOIN o0 ON target_id = o0.id),
i2 AS (SELECT DISTINCT source_id AS id FROM e JOIN i1 ON target_id = i1.id),
sub AS (SELECT id, min(d) AS depth FROM (SELECT id, 0 AS d FROM o0 UNION ALL SELECT id, 1 FROM o1 UNION ALL SELECT id, 2 FROM o2 UNION ALL SELECT id, 1 FROM i1 UNION ALL SELECT id, 2 FROM i2) x GROUP BY id),
kept AS (SELECT id, depth FROM sub ORDER BY depth, id LIMIT 100)"""


@query(f"{_SUB} SELECT id, depth FROM sub")
def subgraph_both(spark, sf):
    return traverse.subgraph(v.edges(spark, sf), _NATION, "both", 2)


@query(f"{_SUB} SELECT id, depth FROM kept")
def subgraph_truncated(spark, sf):
    return traverse.subgraph(v.edges(spark, sf), _NATION, "both", 2, max_nodes=100)


@query(f"{_SUB} SELECT source_id, target_id, kind, round(confidence, 6) AS confidence FROM e WHERE source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept) ORDER BY 1, 2, 3 LIMIT 500")
def subgraph_edges(spark, sf):
    e = v.edges(spark, sf)
    return traverse.induced(e, traverse.subgraph(e, _NATION, "both", 2, max_nodes=100), max_edges=500).select("source_id", "target_id", "kind", F.round("confidence", 6).alias("confidence"))


@query(f"{v.WITH}, s AS (SELECT id FROM nd WHERE kind IN ('Class', 'Struct')) SELECT s.id, 'incoming' AS direction, source_id AS other_id, kind, round(confidence, 6) AS confidence FROM s JOIN e ON target_id = s.id UNION ALL SELECT s.id, 'outgoing', target_id, kind, round(confidence, 6) FROM s JOIN e ON source_id = s.id")
def context_incoming_outgoing(spark, sf):
    ids = v.nodes(spark, sf).where("kind in ('Class', 'Struct')").select("id")
    return traverse.context(v.edges(spark, sf), ids).withColumn("confidence", F.round("confidence", 6))


@query(f"{v.WITH} SELECT name, count(*) AS candidates, arg_min(id, CASE WHEN is_exported THEN id ELSE id + 1000000000 END) AS best FROM nd GROUP BY name")
def find_by_name(spark, sf):
    order = F.struct((~F.col("is_exported")).alias("hidden"), "id")
    return v.nodes(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("candidates"), F.min_by("id", order).alias("best"))


@query(f"{v.WITH} SELECT (SELECT count(*) FROM nd) AS symbols, (SELECT count(*) FROM e) AS relationships, (SELECT count(DISTINCT file_path) FROM nd) AS files, (SELECT max(file_path) FROM nd) AS last_file")
def status_counts(spark, sf):
    n = v.nodes(spark, sf).agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file_path").alias("files"), F.max("file_path").alias("last_file"))
    return n.crossJoin(v.edges(spark, sf).agg(F.count(F.lit(1)).alias("relationships"))).select("symbols", "relationships", "files", "last_file")


@query(f"{v.WITH}, r AS (SELECT parent_name, kind, name, row_number() OVER (PARTITION BY parent_name ORDER BY name, kind, id) AS k FROM nd WHERE parent_name IS NOT NULL) SELECT parent_name AS label, string_agg(concat(kind, ' ', name), ', ' ORDER BY k) AS members FROM r WHERE k <= 10 GROUP BY 1")
def top_members(spark, sf):
    n = v.nodes(spark, sf).where("parent_name is not null")
    top = n.withColumn("k", F.row_number().over(W.partitionBy("parent_name").orderBy("name", "kind", "id"))).where("k <= 10")
    return top.groupBy(F.col("parent_name").alias("label")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "kind", "name"))), lambda x: F.concat_ws(" ", x["kind"], x["name"])), ", ").alias("members"))


@query("SELECT conv_id AS process_id, string_agg(role, '>' ORDER BY turn) AS steps, count(*) AS step_count FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1")
def ordered_steps(spark, sf):
    steps = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return v.table(spark, sf, "conversations").where("conv_id is not null").groupBy(F.col("conv_id").alias("process_id")).agg(F.array_join(steps, ">").alias("steps"), F.count(F.lit(1)).alias("step_count"))


# --- search ------------------------------------------------------------------


def _bm25_term(i: int) -> str:
    idf = f"ln((n - n{i} + 0.5) / (n{i} + 0.5))"
    return f"(CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / avgd))"


def _bm25_sql(phrases: list[tuple[list[str], bool]], where: str, limit: int = 50) -> str:
    toks = {c: f"regexp_extract_all(translate(lower({c}), '{MARKED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+')" for c in ("text", "lang", "source")}

    def hits(c: str, words: list[str], prefix: bool) -> str:
        tests = [f"starts_with(t_{c}[i + {k}], '{w}')" if prefix and k == len(words) - 1 else f"t_{c}[i + {k}] = '{w}'" for k, w in enumerate(words)]
        return f"len(list_filter(range(1, len(t_{c}) + 1), lambda i: coalesce({' AND '.join(tests)}, false)))"

    f = ", ".join(f"{' + '.join(hits(c, w, p) for c in toks)} AS f{i}" for i, (w, p) in enumerate(phrases))
    n = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(phrases)))
    score = " + ".join(_bm25_term(i) for i in range(len(phrases)))
    return f"""WITH t AS (SELECT doc_id, {', '.join(f"coalesce({x}, []) AS t_{c}" for c, x in toks.items())} FROM documents),
x AS (SELECT doc_id, {' + '.join(f'len(t_{c})' for c in toks)} AS d, {f} FROM t), st AS (SELECT count(*) AS n, avg(d) AS avgd, {n} FROM x)
SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, {score} AS score FROM x, st WHERE {where}) y ORDER BY y.score DESC, doc_id LIMIT {limit}"""


def _bm25(spark, sf, text, limit=50):
    return search.bm25_indexed(v.text_index(spark, sf), text, limit).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_bm25_sql([(["that"], False), (["eres"], False)], "f0 > 0 AND f1 > 0"))
def bm25_and(spark, sf):
    return _bm25(spark, sf, "that eres")


@query(_bm25_sql([(["src3"], False), (["reque"], False)], "f0 > 0 OR f1 > 0"))
def bm25_or(spark, sf):
    return _bm25(spark, sf, "src3 OR reque")


@query(_bm25_sql([(["of", "the"], False)], "f0 > 0"))
def bm25_phrase(spark, sf):
    return _bm25(spark, sf, '"of the"')


@query(_bm25_sql([(["that"], False), (["eres"], False)], "f0 > 0 AND f1 > 0"))
def bm25_scanned(spark, sf):
    """As bm25_and, from the texts themselves: what a table without an index gets."""
    hits = search.bm25(v.table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "doc_id", ["text", "lang", "source"], "that eres", limit=50)
    return hits.withColumn("score", F.round("score", 6))


@query(_bm25_sql([(["of", "the"], True), (["that"], False)], "f0 > 0 AND NOT f1 > 0").replace(_bm25_term(1), "0"))
def bm25_phrase_prefix_not(spark, sf):
    return _bm25(spark, sf, '"of the"* NOT that')


@query(_bm25_sql([(["hand"], True), (["the"], False)], "f0 > 0 AND f1 > 0"))
def bm25_prefix(spark, sf):
    return _bm25(spark, sf, "hand* the")


_QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"
_VECTOR_SQL = f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[])), 6) AS score FROM embeddings WHERE embedding IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 20"


def _query_vector(spark, sf):
    return [float(x) for x in v.table(spark, sf, "embeddings").where("vec_id = 7").select("embedding").first()[0]]


@query(_VECTOR_SQL)
def vector_topk(spark, sf):
    rows = v.table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", F.round(search.cosine(F.col("embedding"), _query_vector(spark, sf)), 6).alias("score"))
    return rows.orderBy(F.desc("score"), "vec_id").limit(20)


@query(f"SELECT label, vec_id, score FROM (SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM (SELECT label, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[])), 6) AS score FROM embeddings) a) b WHERE k <= 5")
def vector_topk_per_label(spark, sf):
    rows = v.table(spark, sf, "embeddings").select("label", "vec_id", F.round(search.cosine(F.col("embedding"), _query_vector(spark, sf)), 6).alias("score"))
    return rows.withColumn("k", F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "vec_id"))).where("k <= 5").drop("k")


@query(f"""WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_bm25_sql([(["that"], False)], "f0 > 0")}) x),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[])), 6) AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY 2 DESC, 1 LIMIT 50) y)
SELECT id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 6) AS score FROM a FULL JOIN b USING (id)""")
def hybrid_rrf(spark, sf):
    text = _bm25(spark, sf, "that").withColumnRenamed("doc_id", "id")
    own = v.table(spark, sf, "embeddings").join(v.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = own.select(F.col("vec_id").alias("id"), F.round(search.cosine(F.col("embedding"), _query_vector(spark, sf)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return search.hybrid(text, near, "id", 200).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH h AS ({_bm25_sql([(["that"], False)], "f0 > 0")}) SELECT conv_id AS process_id, turn AS step_index, doc_id, score FROM h JOIN conversations c ON c.conv_id * 3 + c.turn = doc_id""")
def grouped_search(spark, sf):
    steps = v.table(spark, sf, "conversations").select(F.col("conv_id").alias("process_id"), F.col("turn").alias("step_index"), (F.col("conv_id") * 3 + F.col("turn")).alias("doc_id"))
    return search.grouped(_bm25(spark, sf, "that"), "doc_id", steps)[0]


@query("SELECT doc_id AS id, concat('Document ', source, '.', lang, ' in ', source) AS text FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL OR len(embedding) <> 64")
def embed_worklist(spark, sf):
    d = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("Document").alias("kind"), F.col("source").alias("parent_name"), F.col("lang").alias("name"), F.col("source").alias("file_path"))
    f = d.select(F.col("file_path").alias("path")).distinct().withColumn("content_hash", F.lit(1))
    e = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("symbol_id"), F.lit("m").alias("model_id"), F.size("embedding").alias("dims"), F.lit(1).alias("content_hash"))
    return store.embedding_worklist(d, f, e, "m", 64).select("id", "text")


# --- evaluation --------------------------------------------------------------

_EVAL_SQL = """WITH res AS (SELECT source AS query_id, doc_id AS key, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
rel AS (SELECT source AS query_id, doc_id AS key FROM documents JOIN labels USING (doc_id) WHERE quality = 1), h AS (SELECT query_id, count(*) AS hits, min(rank) AS first FROM res JOIN rel USING (query_id, key) WHERE rank <= 10 GROUP BY 1),
pq AS (SELECT q.query_id, coalesce(hits / s.size, 0.0) AS recall, coalesce(1.0 / first, 0.0) AS rr FROM (SELECT DISTINCT query_id FROM res) q LEFT JOIN (SELECT query_id, count(*) AS size FROM rel GROUP BY 1) s USING (query_id) LEFT JOIN h USING (query_id))"""


def _evaluated(spark, sf):
    d = v.table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("key"), "n_chars")
    res = d.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n_chars"), "key")))
    good = v.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("key"))
    return evaluate.per_query(res, d.join(good, "key").select("query_id", "key"), 10)


@query(f"{_EVAL_SQL} SELECT query_id, round(recall, 6) AS recall, round(rr, 6) AS rr FROM pq")
def eval_recall_mrr(spark, sf):
    return _evaluated(spark, sf).select("query_id", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"))


@query(f"{_EVAL_SQL} SELECT CASE WHEN length(query_id) = 4 THEN 'exact' ELSE 'mixed' END AS category, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, count(*) AS queries FROM pq GROUP BY 1")
def eval_by_category(spark, sf):
    s = _evaluated(spark, sf)
    out = evaluate.by_category(s, s.select("query_id", F.when(F.length("query_id") == 4, "exact").otherwise("mixed").alias("category")))
    return out.select("category", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "queries")


@query("SELECT source AS query_id, round(count(*) FILTER (lang = 'en' AND quality = 1 OR lang <> 'en' AND quality = 0) / count(*), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def eval_routing(spark, sf):
    d = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("key"), (F.col("lang") == "en").alias("placed"), (F.col("quality") == 1).alias("wanted"))
    out = evaluate.routing(d.select("query_id", "key", F.col("wanted").alias("in_process")), d.select("query_id", "key", F.col("placed").alias("in_process")))
    return out.select("query_id", F.round("accuracy", 6).alias("accuracy"))


# --- resolution --------------------------------------------------------------


@query("SELECT l_suppkey AS source_id, l_partkey AS target_id, arg_min(l_returnflag, l_orderkey * 100 + l_linenumber) AS reason, min(l_orderkey * 100 + l_linenumber) AS ord FROM lineitem GROUP BY 1, 2")
def edge_dedup_first_wins(spark, sf):
    rows = v.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("reason"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    return resolve.first_wins(rows, ["source_id", "target_id"], ["ord"])


@query("WITH m AS (SELECT DISTINCT l_suppkey AS t, l_partkey % 20 AS m FROM lineitem), i AS (SELECT DISTINCT concat(l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)) AS i, l_partkey % 20 AS m FROM lineitem WHERE l_quantity <= 2), s AS (SELECT i, count(*) AS n FROM i GROUP BY 1) SELECT t AS type_name, x.i AS interface FROM (SELECT t, i, count(*) AS have FROM m JOIN i USING (m) GROUP BY 1, 2) x JOIN s ON s.i = x.i WHERE have = n")
def structural_implements(spark, sf):
    li = v.table(spark, sf, "lineitem")
    arity = F.lit(None).cast("int").alias("arity")
    types = li.select(F.col("l_suppkey").alias("type_name"), (F.col("l_partkey") % 20).alias("method"), arity)
    wanted = li.where("l_quantity <= 2").select(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("interface"), (F.col("l_partkey") % 20).alias("method"), arity)
    return resolve.structural_implements(types, wanted)


@query(f"{v.WITH} SELECT name, min(uid) AS uid FROM nd WHERE is_exported GROUP BY 1 HAVING count(*) = 1")
def unique_global(spark, sf):
    return resolve.unique_global(v.nodes(spark, sf))


@query("WITH p AS (SELECT DISTINCT string_split(regexp_replace(url, '^[a-z]+://([^?#]*[^?#/])/*([?#].*)?$', '\\1'), '/') AS x FROM pages) SELECT DISTINCT array_to_string(x[1:k], '/') AS parent, array_to_string(x[1:k + 1], '/') AS child FROM (SELECT x, unnest(range(1, len(x))) AS k FROM p) q")
def contains_paths(spark, sf):
    path = F.regexp_replace("url", r"^[a-z]+://([^?#]*[^?#/])/*([?#].*)?$", "$1")
    return resolve.contains_edges(v.table(spark, sf, "pages").select(path.alias("path")).distinct())


@query("SELECT import_id, arg_min(path, prio) AS target FROM (SELECT c_custkey AS import_id, prio, concat('m', CAST(c_custkey % 97 AS VARCHAR), s) AS path FROM customer, (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '.rb'), (6, '.go'), (7, '/index.ts'), (8, '/index.tsx'), (9, '/index.js')) t(prio, s)) a JOIN (SELECT DISTINCT concat('m', CAST(p_partkey % 89 AS VARCHAR), CASE p_partkey % 3 WHEN 0 THEN '.go' WHEN 1 THEN '.ts' ELSE '/index.js' END) AS path FROM part) b USING (path) GROUP BY 1")
def import_candidates(spark, sf):
    imports = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("import_id"), F.concat(F.lit("m"), (F.col("c_custkey") % 97).cast("string")).alias("base"))
    third = F.col("p_partkey") % 3
    files = v.table(spark, sf, "part").select(F.concat(F.lit("m"), (F.col("p_partkey") % 89).cast("string"), F.when(third == 0, ".go").when(third == 1, ".ts").otherwise("/index.js")).alias("path"))
    return resolve.import_targets(imports, files)


@query("SELECT doc_id AS path FROM documents WHERE doc_id % 7 = 0 OR (doc_id % 5 = 0 AND md5(coalesce(text, '')) <> md5(upper(coalesce(text, ''))))")
def changed_files(spark, sf):
    d = v.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    index = d.where("path % 7 != 0").select("path", F.md5(F.when(F.col("path") % 5 == 0, F.upper("text")).otherwise(F.col("text"))).alias("content_hash"))
    return store.changed_files(d.select("path", F.md5("text").alias("content_hash")), index).select("path")


@query("SELECT doc_id AS path FROM documents WHERE doc_id % 11 = 0")
def stale_files(spark, sf):
    d = v.table(spark, sf, "documents").select(F.col("doc_id").alias("path"))
    return store.stale_files(d.where("path % 11 != 0"), d)


@query("SELECT a.conv_id AS function_uid, a.turn AS source_line, b.turn AS sink_line, concat(a.role, '>', b.role) AS flow_kind FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def dataflow_listing(spark, sf):
    c = v.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    a, b = c.alias("a"), c.alias("b")
    rows = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return rows.select(F.col("a.conv_id").alias("function_uid"), F.col("a.turn").alias("source_line"), F.col("b.turn").alias("sink_line"), F.concat("a.role", F.lit(">"), "b.role").alias("flow_kind"))


# --- graph analytics ---------------------------------------------------------


def _calls(spark, sf):
    return v.edges(spark, sf).where("kind = 'CALLS'").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "confidence")


@query(f"{v.WITH}, c AS (SELECT * FROM e WHERE kind = 'CALLS' AND confidence >= 0.5), o AS (SELECT source_id AS node, count(*) AS a FROM c GROUP BY 1), i AS (SELECT target_id AS node, count(*) AS b FROM c GROUP BY 1) SELECT node, round(coalesce(a, 0) / (coalesce(b, 0) + 1), 6) AS score FROM o FULL JOIN i USING (node)")
def entry_scores(spark, sf):
    return graph.entry_scores(_calls(spark, sf)).select("node", F.round("score", 6).alias("score"))


def _trace_ctes(depth: int = 10, branching: int = 4, pops: int = 10_000) -> str:
    """CTEs up to ``ended(entry, path, place)`` of the bounded walk: level by level, a window for the choice and one for the places."""
    ctes = [v.WITH, "c AS (SELECT DISTINCT source_id AS s, target_id AS t FROM e WHERE kind = 'CALLS')", "en AS (SELECT source_id AS entry FROM e WHERE kind = 'CALLS' GROUP BY 1 ORDER BY count(*) DESC, source_id LIMIT 200)"]
    ctes.append("p0 AS (SELECT entry, [entry] AS path, 1 AS place FROM en)")
    for d in range(depth):
        ctes.append(f"g{d} AS (SELECT entry, path, place, t, row_number() OVER (PARTITION BY entry, place ORDER BY t) AS r FROM p{d} JOIN c ON s = path[-1] WHERE NOT list_contains(path, t))")
        ctes.append(f"p{d + 1} AS (SELECT * FROM (SELECT g.entry, list_append(path, t) AS path, last + row_number() OVER (PARTITION BY g.entry ORDER BY place, r) AS place FROM g{d} g JOIN (SELECT entry, max(place) AS last FROM p{d} GROUP BY 1) m ON m.entry = g.entry WHERE r <= {branching}) x WHERE place <= {pops})")
    parts = [f"SELECT p.* FROM p{d} p LEFT JOIN (SELECT DISTINCT entry, place FROM g{d}) g ON g.entry = p.entry AND g.place = p.place WHERE g.entry IS NULL" for d in range(depth)]
    ctes.append(f"ended AS ({' UNION ALL '.join([*parts, f'SELECT * FROM p{depth}'])})")
    return ", ".join(ctes)


def _traces(spark, sf):
    """The paths of the shipped walk from the 200 parts that call most, to depth 10."""
    c = _calls(spark, sf)
    entries = c.groupBy("source").count().orderBy(F.desc("count"), "source").limit(200).select(F.col("source").alias("entry"))
    return graph.trace_paths_bounded(c.withColumn("ord", F.col("target")), entries)


def _joined(path):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">").alias("path")


@query(f"{_trace_ctes()} SELECT entry, array_to_string(path, '>') AS path, CAST(place AS BIGINT) AS place FROM ended")
def trace_paths(spark, sf):
    return _traces(spark, sf).select("entry", _joined("path"), F.col("place").cast("long").alias("place"))


_DEDUP = f"""{_trace_ctes()}, t AS (SELECT entry, path, place, entry * 100000 + place AS trace_id FROM ended),
h AS (SELECT path AS other, unnest(path) AS node, len(path) AS m FROM t),
inside AS (SELECT DISTINCT trace_id FROM t JOIN h ON node = path[1] WHERE m > len(path) AND list_has_all(other, path)),
kept AS (SELECT t.* FROM t LEFT JOIN inside i USING (trace_id) WHERE i.trace_id IS NULL QUALIFY row_number() OVER (PARTITION BY path[1], path[-1] ORDER BY len(path) DESC, trace_id) = 1)"""


@query(f"{_DEDUP} SELECT trace_id, array_to_string(path, '>') AS path FROM kept")
def dedup_traces(spark, sf):
    t = _traces(spark, sf).select("path", (F.col("entry") * 100_000 + F.col("place")).alias("trace_id"))
    return graph.dedup_traces(t).select("trace_id", _joined("path"))


_NAMES = """concat('Function:src/', id % 7, '.ts:', CASE WHEN id % 5 = 0 THEN 'handle' WHEN id % 5 = 1 THEN 'get' ELSE 'step' END, id, ':', id)"""


def _processes(spark, sf):
    """Process assembly on named parts: brands as communities."""
    uid = lambda col: F.expr(_NAMES.replace("id %", f"{col} %").replace(", id", f", {col}"))
    c = v.edges(spark, sf).where("kind = 'CALLS'").select(uid("source_id").alias("source"), uid("target_id").alias("target"), "confidence", F.col("target_id").alias("ord"))
    n = v.nodes(spark, sf).where("kind = 'Function'")
    symbols = n.select(uid("id").alias("uid"), "id", F.element_at(F.split(uid("id"), ":"), -2).alias("name"))
    members = n.select(F.substr("parent_name", F.lit(7)).cast("long").alias("community_id"), F.col("id").alias("symbol_id"))
    return ingest.process_rows(c, symbols, members)


_PROCESSES = (
    _trace_ctes()
    .replace("c AS (SELECT DISTINCT source_id AS s, target_id AS t FROM e WHERE kind = 'CALLS')", "c AS (SELECT DISTINCT source_id AS s, target_id AS t FROM e WHERE kind = 'CALLS' AND confidence >= 0.5)")
    .replace(
        "en AS (SELECT source_id AS entry FROM e WHERE kind = 'CALLS' GROUP BY 1 ORDER BY count(*) DESC, source_id LIMIT 200)",
        f"""sc AS (SELECT id, coalesce(a, 0) / (coalesce(b, 0) + 1) * CASE id % 5 WHEN 0 THEN 1.5 WHEN 1 THEN 0.3 ELSE 1.0 END AS score, {_NAMES} AS uid FROM (SELECT source_id AS id, count(*) AS a FROM e WHERE kind = 'CALLS' AND confidence >= 0.5 GROUP BY 1) o FULL JOIN (SELECT target_id AS id, count(*) AS b FROM e WHERE kind = 'CALLS' AND confidence >= 0.5 GROUP BY 1) i USING (id)),
en AS (SELECT id AS entry, score, uid FROM sc WHERE score > 0 ORDER BY score DESC, uid LIMIT 200)""",
    )
    + f""", t AS (SELECT x.entry, x.path, en.score, row_number() OVER (ORDER BY en.score DESC, en.uid, x.place) AS trace_id FROM ended x JOIN en ON en.entry = x.entry),
h AS (SELECT path AS other, unnest(path) AS node, len(path) AS m FROM t), inside AS (SELECT DISTINCT trace_id FROM t JOIN h ON node = path[1] WHERE m > len(path) AND list_has_all(other, path)),
kept AS (SELECT t.* FROM t LEFT JOIN inside i USING (trace_id) WHERE i.trace_id IS NULL QUALIFY row_number() OVER (PARTITION BY path[1], path[-1] ORDER BY len(path) DESC, trace_id) = 1),
top AS (SELECT row_number() OVER (ORDER BY len(path) DESC, score DESC, trace_id) AS pid, * FROM kept WHERE len(path) >= {ingest.MIN_STEPS}),
lim AS (SELECT * FROM top WHERE pid <= (SELECT least(greatest(CAST(floor(count(*) / 10) AS BIGINT), {ingest.FEWEST}), {ingest.MOST}) FROM nd WHERE kind = 'Function')),
st AS (SELECT pid, score, len(path) AS n, unnest(path) AS node, unnest(range(len(path))) AS step FROM lim), nm AS (SELECT st.*, string_split({_NAMES.replace("id %", "node %").replace(", id", ", node")}, ':')[3] AS name, nd.parent_name FROM st JOIN nd ON nd.id = node)
SELECT pid AS id, concat(arg_min(name, step), ' → ', arg_max(name, step)) AS label, CASE WHEN count(DISTINCT parent_name) > 1 THEN 'cross_community' ELSE 'intra_community' END AS process_type, round(any_value(score), 6) AS priority, any_value(n) AS step_count, string_agg(node, '>' ORDER BY step) AS steps FROM nm GROUP BY 1"""
)


@query(_PROCESSES)
def process_assembly(spark, sf):
    processes, steps = _processes(spark, sf)
    lists = steps.groupBy(F.col("process_id").alias("id")).agg(_joined(F.transform(F.sort_array(F.collect_list(F.struct("step_index", "symbol_id"))), lambda x: x["symbol_id"])).alias("steps"))
    return processes.join(lists, "id").select(F.col("id").cast("long").alias("id"), "label", "process_type", F.round("priority", 6).alias("priority"), "step_count", "steps")


@query()
def communities(spark, sf):
    """Of the parts bought together, as one graph; held against a plain Louvain pass in the tests."""
    rows = _calls(spark, sf).select(F.lit(0).cast("long").alias("graph_id"), F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    return graph.communities(rows)


@query(f"{v.WITH}, m AS (SELECT id AS node, parent_name AS community FROM nd WHERE kind = 'Function'), c AS (SELECT DISTINCT source_id AS s, target_id AS t FROM e WHERE kind = 'CALLS' AND source_id <> target_id), k AS (SELECT a.community, count(*) AS n FROM c JOIN m a ON a.node = s JOIN m b ON b.node = t AND a.community = b.community GROUP BY 1) SELECT community, count(*) AS size, round(CASE WHEN count(*) > 1 THEN coalesce(any_value(k.n), 0) / (count(*) * (count(*) - 1) / 2) ELSE 0 END, 6) AS cohesion FROM m LEFT JOIN k USING (community) GROUP BY 1")
def cohesion(spark, sf):
    members = v.nodes(spark, sf).where("kind = 'Function'").select(F.col("id").alias("node"), F.col("parent_name").alias("community"))
    return graph.cohesion(members, _calls(spark, sf)).select("community", "size", F.round("cohesion", 6).alias("cohesion"))


@query("WITH w AS (SELECT p_brand AS community, unnest(string_split(lower(p_name), ' ')) AS word FROM part), c AS (SELECT community, word, count(*) AS n FROM w WHERE strlen(word) >= 3 AND word NOT IN ('get', 'set', 'new', 'the', 'and', 'for', 'with', 'from', 'this', 'that') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, word) AS k FROM c) SELECT community, string_agg(concat(upper(word[1]), word[2:]), '' ORDER BY k) AS label FROM r WHERE k <= 2 GROUP BY 1")
def community_labels(spark, sf):
    return graph.labels(v.table(spark, sf, "part").select(F.col("p_brand").alias("community"), F.col("p_name").alias("name")))


# --- guarded SQL -------------------------------------------------------------

_REPORT = "WITH big AS (SELECT o_custkey, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DECIMAL(18, 2)) AS total FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS customers, sum(n) AS orders, max(total) AS most FROM customer JOIN big ON c_custkey = o_custkey GROUP BY c_mktsegment"


@query("SELECT c_mktsegment, customers, CAST(orders AS BIGINT) AS orders, most FROM (" + _REPORT + ") x")
def graph_sql_join(spark, sf):
    for name in ("orders", "customer"):
        v.table(spark, sf, name).createOrReplaceTempView(name)
    return store.read_only_sql(spark, _REPORT, 200)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | resolution.QUERIES | stored.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | resolution.SQL | stored.SQL
