"""Graph analytics: communities, cohesion, labels, entry points and paths."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wefthread.functions.text import capitalised, is_test_uid, name_words
from wefthread.operators.traverse import cut

PASSES = 20
# What names say about a symbol.
STOP_WORDS = ("get", "set", "new", "the", "and", "for", "with", "from", "this", "that")
ENTRY_PREFIXES = ("main", "init", "bootstrap", "start", "run", "handle", "dispatch", "execute", "process")
ENTRY_SUFFIXES = ("controller", "handler", "action", "endpoint", "route")
ROUTE_PREFIXES = ("get", "post", "put", "delete", "patch")
UTIL_PREFIXES = (
    "get", "set", "is", "has", "can", "should", "will", "did", "format", "parse", "validate", "convert", "transform",
    "encode", "decode", "serialize", "deserialize", "to_", "from_",
)
UTIL_SUFFIXES = ("helper", "util", "utils")


def louvain_moves(pairs: list[tuple[str, str]]) -> dict[str, int]:
    """Community of each node after local moves: nodes by name, ties and zero gains to the smaller community."""
    names = sorted({x for p in pairs for x in p})
    number = {x: i for i, x in enumerate(names)}
    weight: list[dict[int, int]] = [defaultdict(int) for _ in names]
    for a, b in pairs:
        i, j = number[a], number[b]
        if i != j:
            weight[i][j] += 1
            weight[j][i] += 1
    degree = [sum(w.values()) for w in weight]
    two_m = float(sum(degree))
    own = list(range(len(names)))
    total = [float(d) for d in degree]
    for _ in range(PASSES if two_m else 0):
        moved = False
        for i in range(len(names)):
            links: dict[int, int] = defaultdict(int)
            for j, w in weight[i].items():
                links[own[j]] += w
            here, best, gain = own[i], own[i], 0.0
            for c in sorted(links):
                if c != here:
                    delta = (links[c] - links.get(here, 0)) / two_m + degree[i] * (total[here] - total[c] - degree[i]) / (two_m * two_m)
                    if delta > gain or (delta == gain and c < best):
                        best, gain = c, delta
            if best != here:
                total[here] -= degree[i]
                total[best] += degree[i]
                own[i] = best
                moved = True
        if not moved:
            break
    return {x: own[number[x]] for x in names}


def communities(edges: DataFrame) -> DataFrame:
    """(graph_id, node, community) of edges(graph_id, source, target): sequential in a graph, graphs in parallel.

    Singletons are left out; communities are numbered from 0 by their key.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = louvain_moves(list(zip(pdf["source"], pdf["target"])))
        members: dict[int, list[str]] = defaultdict(list)
        for node, c in found.items():
            members[c].append(node)
        rows = [(pdf["graph_id"].iloc[0], n, k) for k, c in enumerate(x for x in sorted(members) if len(members[x]) > 1) for n in members[c]]
        return pd.DataFrame(rows, columns=["graph_id", "node", "community"])

    return edges.groupBy("graph_id").applyInPandas(solve, "graph_id long, node string, community int")


def cohesion(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, size, cohesion): distinct directed edges inside over n (n - 1) / 2. members(node, community)."""
    a, b = members.toDF("source", "ca"), members.toDF("target", "cb")
    inner = edges.select("source", "target").distinct().where("source != target").join(a, "source").join(b, "target").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("m"))
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return sizes.join(inner, "community", "left").select("community", "size", F.when(pairs > 0, F.coalesce("m", F.lit(0)) / pairs).otherwise(F.lit(0.0)).alias("cohesion"))


def labels(members: DataFrame) -> DataFrame:
    """(community, label): the two most frequent words of the names, capitalised. members(community, name)."""
    words = members.select("community", F.explode_outer(name_words(F.col("name"))).alias("word"))
    counts = words.where(~F.col("word").isin(*STOP_WORDS)).groupBy("community", "word").count()
    top = counts.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy(F.desc("count"), "word"))).where("r <= 2")
    text = top.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda x: capitalised(x["word"])), "").alias("label"))
    return members.select("community").distinct().join(text, "community", "left").select("community", F.coalesce("label", F.lit("Unnamed")).alias("label"))


def name_multiplier(name: Column) -> Column:
    """How much a name looks like an entry point; the first fitting rule counts."""
    low = F.lower(name)
    starts = lambda words: low.rlike(f"^({'|'.join(words)})")
    ends = lambda words: low.rlike(f"({'|'.join(words)})$")
    fourth = F.substring(name, 4, 1).rlike(r"\p{Lu}")
    return (
        F.when(starts(ENTRY_PREFIXES) | ends(ENTRY_SUFFIXES), 1.5)
        .when(starts(ROUTE_PREFIXES) & (F.octet_length(name) > 4) & fourth, 1.3)
        .when(starts(("use",)) & (F.octet_length(name) > 3) & fourth, 1.2)
        .when(starts(UTIL_PREFIXES) | ends(UTIL_SUFFIXES), 0.3)
        .otherwise(1.0)
    )


def entry_scores(edges: DataFrame, name: Column | None = None) -> DataFrame:
    """(node, score): callees / (callers + 1) by name, 0 for files and tests; edges(source, target, confidence) of 0.5 or more."""
    e = edges.where("confidence >= 0.5")
    out = e.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("callees"))
    into = e.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("callers"))
    score = F.coalesce("callees", F.lit(0)) / (F.coalesce("callers", F.lit(0)) + 1) * (name_multiplier(name) if name is not None else F.lit(1.0))
    dead = F.col("node").cast("string").startswith("File:") | is_test_uid(F.col("node").cast("string"))
    return out.join(into, "node", "full").select("node", F.when(dead, F.lit(0.0)).otherwise(score).alias("score"))


def dedup_traces(traces: DataFrame) -> DataFrame:
    """Traces(trace_id, path) whose nodes are no proper part of another's; then the longest of each (first, last), the earliest on ties.

    Candidates to contain a trace share its first node, so the join is on a node, not on all pairs.
    """
    t = traces.withColumn("n", F.size(F.array_distinct("path")))
    holders = t.select(F.col("path").alias("other"), F.col("n").alias("m"), F.explode(F.array_distinct("path")).alias("node"))
    inside = t.withColumn("node", F.element_at("path", 1)).join(holders, "node").where((F.col("m") > F.col("n")) & (F.size(F.array_except("path", "other")) == 0)).select("trace_id").distinct()
    rest = traces.join(inside, "trace_id", "left_anti")
    order = W.partitionBy(F.element_at("path", 1), F.element_at("path", -1)).orderBy(F.desc(F.size("path")), "trace_id")
    return rest.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def trace_paths_bounded(edges: DataFrame, entries: DataFrame, depth: int = 10, branching: int = 4, pops: int = 10_000) -> DataFrame:
    """(entry, path, place): simple paths from entries(entry), nearest first, each node going on to its first ``branching`` fresh neighbours.

    edges(source, target, ord). A path ends at a leaf, where all neighbours are on it,
    or past ``depth`` steps; an entry's walk ends after ``pops`` paths. A path's number
    is its place in its level plus all earlier levels; equal paths count once. Levels
    are cut from their lineage, and the walk stops at an empty one.
    """
    nbr = cut(edges.groupBy(F.col("source").alias("node"), F.col("target").alias("next")).agg(F.min("ord").alias("ord")))  # read at each level
    front = entries.select("entry", F.array("entry").alias("path"), F.col("entry").alias("node"), F.lit(1).cast("long").alias("place"))
    ended = []
    for d in range(depth + 1):
        front = cut(front)
        if not front.limit(1).count():
            break
        if d == depth:
            ended.append(front.select("entry", "path", "place"))
            break
        size = front.groupBy("entry").agg(F.max("place").alias("__last"))
        grown = front.join(nbr, "node").where(~F.array_contains("path", F.col("next")))
        first = grown.withColumn("r", F.row_number().over(W.partitionBy("entry", "path").orderBy("ord"))).where(F.col("r") <= branching)
        ended.append(front.join(first.select("entry", "place").distinct(), ["entry", "place"], "left_anti").select("entry", "path", "place"))
        order = W.partitionBy("entry").orderBy("place", "r")
        place = F.row_number().over(order) + F.col("__last")
        front = first.select("entry", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("node"), "place", "r").join(size, "entry").withColumn("place", place).where(F.col("place") <= pops).select("entry", "path", "node", "place")
    out = ended[0] if ended else front.select("entry", "path", "place")
    for x in ended[1:]:
        out = out.union(x)
    return out
