"""Traversal of a typed, weighted graph: edges(source_id, target_id, kind, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_KINDS = ("IMPORTS", "CALLS", "CALLS_UNRESOLVED", "CALLS_EXTERNAL", "EXTENDS", "IMPLEMENTS", "DEFINES", "CONTAINS")
#: Levels that stay one lazy plan; deeper walks are cut.
LAZY = 5


def neighbours(edges: DataFrame, direction: str, min_confidence: float = 0.0, kinds: list[str] | None = None) -> DataFrame:
    """(id, next, confidence, kind): against the edges for ``upstream``, along them for anything else."""
    for k in kinds or ():
        if k not in EDGE_KINDS:
            raise ValueError(f"unknown edge kind {k}")
    e = edges.where(F.col("confidence") >= min_confidence)
    if kinds:
        e = e.where(F.col("kind").isin(kinds))
    a, b = ("target_id", "source_id") if direction == "upstream" else ("source_id", "target_id")
    return e.select(F.col(a).alias("id"), F.col(b).alias("next"), "confidence", "kind")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; only on one machine may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return "/tmp/checkpoints/wefthread-engine"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def impact(edges: DataFrame, starts: DataFrame, direction: str = "upstream", depth: int = 3, min_confidence: float = 0.5, calls_only: bool = False) -> DataFrame:
    """(origin_id, id, depth, confidence, kind): what each start reaches, all starts in one walk.

    Breadth first; the first visit wins: within a level the earlier parent, then the
    higher confidence, then the kind. Starts themselves are left out. Each level is
    one join, one aggregate by (origin, node) and an anti-join with what was seen. A
    node's place in its level is the ids on its way there: places compare as in a
    queue, and no task sorts an origin's whole frontier to number it.
    """
    step = neighbours(edges, direction, min_confidence, ["CALLS"] if calls_only else None)
    front = starts.select("origin_id", F.col("origin_id").alias("id"), F.array().cast("array<bigint>").alias("place"))
    seen = front.select("origin_id", "id")
    levels = []
    for d in range(1, depth + 1):
        reached = front.join(step, "id").select("origin_id", F.col("next").alias("id"), "place", "confidence", "kind")
        new = reached.join(seen, ["origin_id", "id"], "left_anti")
        best = new.groupBy("origin_id", "id").agg(F.min(F.struct("place", (-F.col("confidence")).alias("c"), "kind")).alias("b"))
        place = F.concat("b.place", F.array(F.col("id").cast("long"))).alias("place")
        level = best.select("origin_id", "id", F.lit(d).alias("depth"), (-F.col("b.c")).alias("confidence"), F.col("b.kind").alias("kind"), place)
        if d > LAZY:
            level = cut(level)
            if not level.limit(1).count():
                break
        levels.append(level.drop("place"))
        front = level.select("origin_id", "id", "place")
        seen = seen.union(level.select("origin_id", "id"))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def risk(total: Column, direct: Column, exported_direct: Column) -> Column:
    return F.when(exported_direct | (total >= 10), "high").when(direct > 0, "medium").otherwise("low")


def summarise(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """(origin_id, total, direct, risk) of every origin that reaches something."""
    known = reached.join(nodes.select("id", "is_exported"), "id")
    agg = known.groupBy("origin_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("depth") == 1).alias("direct"), F.max((F.col("depth") == 1) & F.col("is_exported")).alias("__e"))
    return agg.select("origin_id", "total", "direct", risk(F.col("total"), F.col("direct"), F.coalesce("__e", F.lit(False))).alias("risk"))


def subgraph(edges: DataFrame, start_id: int, direction: str = "outgoing", depth: int = 3, kinds: list[str] | None = None, max_nodes: int | None = None) -> DataFrame:
    """(id, depth) within ``depth`` of the start, itself at 0; ``both`` unites the two directed walks.

    With ``max_nodes`` the nearest are kept, by depth and then id.
    """
    if direction == "both":
        one = subgraph(edges, start_id, "outgoing", depth, kinds).union(subgraph(edges, start_id, "incoming", depth, kinds))
        out = one.groupBy("id").agg(F.min("depth").alias("depth"))
    else:
        step = neighbours(edges, "upstream" if direction == "incoming" else "downstream", 0.0, kinds).select("id", "next").distinct()
        out = edges.sparkSession.range(1).select(F.lit(start_id).cast("long").alias("id"), F.lit(0).alias("depth"))
        front = out
        for d in range(1, depth + 1):
            front = front.join(step, "id").select(F.col("next").alias("id")).distinct().join(out, "id", "left_anti").select("id", F.lit(d).alias("depth"))
            if d > LAZY:
                front = cut(front)
                if not front.limit(1).count():
                    break
            out = out.union(front)
    return out.orderBy("depth", "id").limit(max_nodes) if max_nodes else out


def induced(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None, max_edges: int | None = None) -> DataFrame:
    """Edges with both ends among ``nodes(id)``, by (source, target, kind) up to ``max_edges``."""
    e = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    ids = nodes.select("id")
    e = e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return e.orderBy("source_id", "target_id", "kind").limit(max_edges) if max_edges else e


def context(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, direction, other_id, kind, confidence): edges into and out of each of ``ids(id)``."""
    into = edges.join(ids.withColumnRenamed("id", "target_id"), "target_id").select(F.col("target_id").alias("id"), F.lit("incoming").alias("direction"), F.col("source_id").alias("other_id"), "kind", "confidence")
    out = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id").select(F.col("source_id").alias("id"), F.lit("outgoing").alias("direction"), F.col("target_id").alias("other_id"), "kind", "confidence")
    return into.union(out)


def overlapping(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Nodes whose lines meet a range of ranges(file_path, lo, hi); a node once, however many it meets."""
    return nodes.join(ranges, (nodes["file_path"] == ranges["file_path"]) & (nodes["start_line"] <= ranges["hi"]) & (nodes["end_line"] >= ranges["lo"]), "left_semi")
