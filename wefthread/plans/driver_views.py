"""The benchmark's tables as a graph, documents and vectors; each with its DuckDB form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wefthread.operators import search
from wefthread.operators.traverse import shared_folder

BASE = 10_000_000
_MADE: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations, suppliers, customers and parts as symbols."""
    for name in ("region", "nation", "supplier", "customer", "part"):
        table(spark, sf, name).createOrReplaceTempView(f"weft_{name}")
    sql = NODES_SQL
    for name in ("region", "nation", "supplier", "customer", "part"):
        sql = sql.replace(f"FROM {name} ", f"FROM weft_{name} ").replace(f"JOIN {name} ", f"JOIN weft_{name} ")
    return spark.sql(sql)


NODES_SQL = f"""
SELECT CAST({BASE} + r_regionkey AS BIGINT) AS id, concat('Module:', r_name) AS uid, r_name AS name, 'Module' AS kind, 'world' AS file_path, CAST(r_regionkey AS BIGINT) AS start_line, CAST(r_regionkey AS BIGINT) AS end_line, true AS is_exported, CAST(NULL AS VARCHAR(99)) AS parent_name FROM region t
UNION ALL SELECT CAST({2 * BASE} + n_nationkey AS BIGINT), concat('Struct:', n_name), n_name, 'Struct', concat('world/', r_name), CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), true, r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey
UNION ALL SELECT CAST({3 * BASE} + s_suppkey AS BIGINT), concat('Class:', s_name), s_name, 'Class', concat('suppliers/', n_name), CAST(s_suppkey % 1000 AS BIGINT), CAST(s_suppkey % 1000 + 5 AS BIGINT), s_acctbal > 0, n_name FROM supplier s JOIN nation n ON s_nationkey = n_nationkey
UNION ALL SELECT CAST({4 * BASE} + c_custkey AS BIGINT), concat('Interface:', c_name), c_name, 'Interface', concat('customers/', n_name), CAST(c_custkey % 1000 AS BIGINT), CAST(c_custkey % 1000 + 5 AS BIGINT), c_acctbal > 0, n_name FROM customer c JOIN nation n ON c_nationkey = n_nationkey
UNION ALL SELECT CAST({5 * BASE} + p_partkey AS BIGINT), concat('Function:', p_name, ':', p_partkey), p_name, 'Function', concat(p_brand, '/', p_type), CAST(p_partkey % 1000 AS BIGINT), CAST(p_partkey % 1000 + p_size AS BIGINT), p_size > 25, p_brand FROM part p
"""

_PAIRS = "SELECT a.l_partkey AS p, b.l_partkey AS q, count(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2"
EDGES_SQL = f"""
SELECT CAST({BASE} + n_regionkey AS BIGINT) AS source_id, CAST({2 * BASE} + n_nationkey AS BIGINT) AS target_id, 'CONTAINS' AS kind, CAST(1.0 AS DOUBLE) AS confidence FROM nation t
UNION ALL SELECT CAST({2 * BASE} + s_nationkey AS BIGINT), CAST({3 * BASE} + s_suppkey AS BIGINT), 'CONTAINS', CAST(1.0 AS DOUBLE) FROM supplier t
UNION ALL SELECT CAST({2 * BASE} + c_nationkey AS BIGINT), CAST({4 * BASE} + c_custkey AS BIGINT), 'CONTAINS', CAST(1.0 AS DOUBLE) FROM customer t
UNION ALL SELECT CAST({5 * BASE} + p AS BIGINT), CAST({5 * BASE} + q AS BIGINT), 'CALLS', least(CAST(0.95 AS DOUBLE), CAST(0.3 AS DOUBLE) * n) FROM (
  {_PAIRS}
) x WHERE n >= 2
UNION ALL SELECT CAST({3 * BASE} + l_suppkey AS BIGINT), CAST({5 * BASE} + l_partkey AS BIGINT), 'IMPORTS', CAST(0.7 AS DOUBLE) FROM (SELECT l_suppkey, l_partkey FROM lineitem t GROUP BY 1, 2 HAVING count(*) >= 2) y
"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Containment, parts bought together, and parts that a supplier sells again.

    Written once a session, as a store's edges are: a walk reads them at each level.
    """
    folder = once(spark, sf, "edges", lambda to: _made(spark, sf).write.parquet(to))
    return spark.read.schema("source_id long, target_id long, kind string, confidence double").parquet(folder)


def text_index(spark: SparkSession, sf: str) -> search.Index:
    """The inverted index of ``documents``, written once a session."""
    columns = ["text", "lang", "source"]
    folder = once(spark, sf, "postings", lambda to: search.write_index(table(spark, sf, "documents").select("doc_id", *columns), "doc_id", columns, to))
    return search.read_index(spark, folder, "long", columns)


def once(spark: SparkSession, sf: str, what: str, write: Callable[[str], None]) -> str:
    """The folder of what ``write`` makes of the tables at ``sf``, made once a session in the shared folder; it goes with the session."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _MADE:
        folder = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        write(folder)
        _MADE[key] = folder
    return _MADE[key]


#: Lines of orders in a task that makes edges: what it holds doesn't grow with the table.
LINES = 1_000_000


def _bought_together(lines: DataFrame, blocks: int) -> DataFrame:
    """(p, q, n): parts p < q and in how many orders both are: ``_PAIRS``, each order's parts once, so that its pairs need only be counted."""
    once_each = lines.select("l_orderkey", "l_partkey").repartition(blocks, "l_orderkey").distinct()
    a, b = once_each.select("l_orderkey", F.col("l_partkey").alias("p")), once_each.select("l_orderkey", F.col("l_partkey").alias("q"))
    return a.hint("merge").join(b, "l_orderkey").where("p < q").select("p", "q").repartition(blocks, "p", "q").groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"))


def _made(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // LINES + 1)
    _bought_together(lines, blocks).createOrReplaceTempView("weft_pairs")
    lines.select("l_suppkey", "l_partkey").repartition(blocks, "l_suppkey", "l_partkey").createOrReplaceTempView("weft_lines")
    sql = EDGES_SQL.replace(_PAIRS, "SELECT * FROM weft_pairs").replace("FROM lineitem t ", "FROM weft_lines t ")
    for name in ("nation", "supplier", "customer"):
        table(spark, sf, name).createOrReplaceTempView(f"weft_{name}")
        sql = sql.replace(f"FROM {name} t\n", f"FROM weft_{name} t\n")
    return spark.sql(sql)


def hub(e: DataFrame) -> DataFrame:
    """The part that calls most others, of these the smallest id, as origin_id."""
    calls = e.where("kind = 'CALLS'").groupBy("source_id").count()
    return calls.orderBy(F.desc("count"), "source_id").limit(1).select(F.col("source_id").alias("origin_id"))


HUB_SQL = "SELECT source_id AS origin_id FROM e WHERE kind = 'CALLS' GROUP BY 1 ORDER BY count(*) DESC, source_id LIMIT 1"
WITH = f"WITH e AS ({EDGES_SQL}), nd AS ({NODES_SQL})"


def impact_sql(starts: str, direction: str, depth: int, min_confidence: float, where: str = "true") -> str:
    """CTEs l1..ld and ``reached`` of a walk from ``starts`` (a query of origin_id)."""
    a, b = ("target_id", "source_id") if direction == "upstream" else ("source_id", "target_id")
    ctes = [f"st AS ({starts})", f"step AS (SELECT {a} AS id, {b} AS nxt, confidence, kind FROM e WHERE confidence >= {min_confidence} AND {where})", "l0 AS (SELECT origin_id, origin_id AS id, 0 AS depth, 1.0 AS confidence, '' AS kind, 1 AS place FROM st)"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT origin_id, id FROM l{k}" for k in range(d))
        ctes.append(f"""l{d} AS (
  SELECT origin_id, id, {d} AS depth, confidence, kind, row_number() OVER (PARTITION BY origin_id ORDER BY pplace, id) AS place FROM (
    SELECT l.origin_id, s.nxt AS id, s.confidence, s.kind, l.place AS pplace, row_number() OVER (PARTITION BY l.origin_id, s.nxt ORDER BY l.place, s.confidence DESC, s.kind) AS r
    FROM l{d - 1} l JOIN step s ON l.id = s.id WHERE NOT EXISTS (SELECT 1 FROM ({seen}) z WHERE z.origin_id = l.origin_id AND z.id = s.nxt)
  ) w WHERE r = 1)""")
    ctes.append("reached AS (" + " UNION ALL ".join(f"SELECT origin_id, id, depth, confidence, kind FROM l{k}" for k in range(1, depth + 1)) + ")")
    return ", ".join(ctes)
