"""From a source tree to the stored graph."""

from __future__ import annotations

import resource
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wefthread.functions.text import ancestors
from wefthread.operators import graph, resolve
from wefthread.sources import store, tree

ENTRIES, MIN_STEPS, FEWEST, MOST = 200, 3, 20, 300
_EDGE = ("file_path", "phase", "ord", "place", "source_uid", "target_uid", "kind", "confidence", "reason")


@dataclass
class Metrics:
    """Seconds by phase, counts, and the driver's peak memory."""

    seconds: dict[str, float] = field(default_factory=dict)
    files: int = 0
    changed: int = 0
    stale: int = 0
    parse_errors: int = 0
    symbols: int = 0
    relationships: int = 0
    communities: int = 0
    processes: int = 0
    up_to_date: bool = False
    peak_rss_kb: int = 0

    def timed(self, name: str, began: float) -> float:
        now = time.perf_counter()
        self.seconds[name] = round(now - began, 3)
        return now

    def report(self) -> dict:
        self.peak_rss_kb = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        return asdict(self)


def edge_candidates(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Every edge that the records give, in the order that decides between equal ones.

    (file_path, phase, ord, place, source_uid, target_uid, kind, confidence, reason):
    imports, calls, inheritance and definitions file by file, then structural
    implementations, then containment.
    """
    symbols, imports, calls = (tree.records(parsed, k) for k in ("symbols", "imports", "calls"))
    shape = lambda df, phase, kind, *, path=F.col("file_path"), ord_=F.col("ord"), place=F.lit(0), confidence=F.lit(1.0), reason=None: df.select(path.alias("file_path"), F.lit(phase).alias("phase"), ord_.cast("int").alias("ord"), place.cast("int").alias("place"), "source_uid", "target_uid", kind.alias("kind"), confidence.alias("confidence"), (F.col("reason") if reason is None else F.lit(reason)).alias("reason"))

    imported = resolve.import_files(imports, files)
    out = [shape(resolve.import_edges(imports, files, symbols), 0, F.lit("IMPORTS"), confidence=F.col("confidence"))]

    c = calls.withColumn("call_id", F.concat_ws("#", "file_path", F.lpad(F.col("ord").cast("string"), 9, "0"))).withColumnRenamed("callee_name", "callee")
    c = c.join(resolve.callers(c, symbols), "call_id")
    found = resolve.resolve_calls(c.select("call_id", "callee", "receiver", "caller_parent", "file_path"), symbols, imported.select("file_path", "target_path").distinct())
    kind = F.when(F.col("prio") < 9, "CALLS").when(F.col("receiver").contains("::"), "CALLS_EXTERNAL").otherwise("CALLS_UNRESOLVED")
    out.append(shape(found.join(c.select("call_id", "file_path", "ord", "receiver", "source_uid"), "call_id"), 1, kind, confidence=F.col("confidence")))

    out.append(shape(resolve.inheritance(symbols), 2, F.col("kind"), place=F.col("place")))
    defined = symbols.select("file_path", "ord", F.concat(F.lit("File:"), "file_path").alias("source_uid"), F.col("uid").alias("target_uid"))
    out.append(shape(defined, 3, F.lit("DEFINES"), reason="file-defines-symbol"))
    last = F.lit("\U0010ffff")  # after all paths
    out.append(shape(resolve.implicit_implements(symbols), 4, F.lit("IMPLEMENTS"), path=last, ord_=F.lit(0), confidence=F.lit(0.85), reason="go-implicit-implements"))
    tails = resolve.contains_edges(files.select("path")).join(files.select(F.col("path").alias("child"), F.lit(True).alias("is_file")), "child", "left")
    held = tails.select(F.concat(F.lit("Folder:"), "parent").alias("source_uid"), F.concat(F.when(F.col("is_file"), "File:").otherwise("Folder:"), "child").alias("target_uid"), F.when(F.col("is_file"), "directory-contains-file").otherwise("directory-contains-directory").alias("reason"))
    out.append(shape(held, 5, F.lit("CONTAINS"), path=last, ord_=F.lit(0)))
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    return every.select(*_EDGE)


def symbol_rows(parsed: DataFrame, files: DataFrame, candidates: DataFrame) -> DataFrame:
    """The table ``symbols``: what files define, by path and place; then folders and files; then external targets.

    Of equal uids the first stays. Ids count from 1; only one row a file passes
    through the single task that adds up the counts.
    """
    s = tree.records(parsed, "symbols").join(files.select(F.col("path").alias("file_path"), "content_hash"), "file_path")
    own = s.select("uid", "name", "kind", "file_path", "start_line", "end_line", "is_exported", "parent_name", "content_hash", F.lit(0).alias("stage"), "ord")
    base = F.element_at(F.split("path", "/"), -1)
    node = lambda df, kind, digest: df.select(F.concat(F.lit(f"{kind}:"), "path").alias("uid"), (F.col("path") if kind == "File" else base).alias("name"), F.lit(kind).alias("kind"), F.col("path").alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(False).alias("is_exported"), F.lit(None).cast("string").alias("parent_name"), digest.alias("content_hash"), F.lit(1).alias("stage"), F.lit(0).alias("ord"))
    folders = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    outside = candidates.where(F.col("target_uid").startswith("External:")).select(F.col("target_uid").alias("uid")).distinct()
    name = F.regexp_extract("uid", r"(?s)^External:<external>:(.*):0$", 1)
    strange = outside.select("uid", name.alias("name"), F.lit("External").alias("kind"), F.lit("<external>").alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(False).alias("is_exported"), F.lit(None).cast("string").alias("parent_name"), F.lit(0).cast("long").alias("content_hash"), F.lit(2).alias("stage"), F.lit(0).alias("ord"))
    rows = own.union(node(files, "File", F.col("content_hash"))).union(node(folders, "Folder", F.lit(0).cast("long"))).union(strange)
    rows = resolve.first_wins(rows, ["uid"], ["stage", "file_path", "ord"])
    # external targets share one path: their own uid takes its place, so that no group is large
    rows = rows.withColumn("__g", F.when(F.col("stage") == 2, F.col("uid")).otherwise(F.col("file_path")))
    counts = rows.groupBy("stage", "__g").count()
    offsets = counts.select("stage", "__g", (F.sum("count").over(W.orderBy("stage", "__g").rowsBetween(W.unboundedPreceding, -1))).alias("__o"))
    place = F.row_number().over(W.partitionBy("stage", "__g").orderBy("ord", "uid"))
    out = rows.withColumn("__k", place).join(offsets, ["stage", "__g"])
    empty = F.lit(None).cast("string")
    return out.select((F.coalesce("__o", F.lit(0)) + F.col("__k")).alias("id"), "uid", "name", "kind", "file_path", "start_line", "end_line", "is_exported", "parent_name", empty.alias("type_info"), empty.alias("metadata"), "content_hash")


def relationship_rows(candidates: DataFrame, symbols: DataFrame) -> DataFrame:
    """The table ``relationships``: of each (source, target, kind) the first candidate, if both ends are stored."""
    a, b = symbols.select(F.col("uid").alias("source_uid"), F.col("id").alias("source_id")), symbols.select(F.col("uid").alias("target_uid"), F.col("id").alias("target_id"))
    order = ["stage", "file_path", "phase", "ord", "place", "confidence", "reason"]
    rows = candidates.withColumn("stage", F.when(F.col("phase") < 4, 0).otherwise(F.col("phase")))
    first = resolve.first_wins(rows.select("source_uid", "target_uid", "kind", *order), ["source_uid", "target_uid", "kind"], order)
    rows = first.join(a, "source_uid").join(b, "target_uid")
    counts = rows.groupBy("source_id").count()
    offsets = counts.select("source_id", F.sum("count").over(W.orderBy("source_id").rowsBetween(W.unboundedPreceding, -1)).alias("__o"))
    place = F.row_number().over(W.partitionBy("source_id").orderBy("target_id", "kind"))
    return rows.withColumn("__k", place).join(offsets, "source_id").select((F.coalesce("__o", F.lit(0)) + F.col("__k")).alias("id"), "source_id", "target_id", "kind", "confidence", "reason", F.lit(None).cast("string").alias("metadata"))


def community_rows(calls: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables ``communities`` and ``community_members`` of calls(source, target)."""
    members = graph.communities(calls.select(F.lit(0).cast("long").alias("graph_id"), "source", "target")).select("node", F.col("community").cast("long").alias("community"))
    named = members.join(symbols.select(F.col("uid").alias("node"), "name", "id"), "node")
    out = graph.labels(named.select("community", "name")).join(graph.cohesion(members, calls), "community")
    return out.select(F.col("community").alias("id"), "label", "cohesion", F.col("size").alias("symbol_count")), named.select(F.col("community").alias("community_id"), F.col("id").alias("symbol_id"))


def process_rows(calls: DataFrame, symbols: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables ``processes`` and ``process_steps`` of calls(source, target, confidence, ord)."""
    name = F.element_at(F.split("node", ":"), -2)
    entries = graph.entry_scores(calls, name).where("score > 0").orderBy(F.desc("score"), "node").limit(ENTRIES).select(F.col("node").alias("entry"), "score")
    paths = graph.trace_paths_bounded(calls.where("confidence >= 0.5"), entries.select("entry"))
    ranked = paths.join(F.broadcast(entries), "entry").withColumn("trace_id", F.row_number().over(W.orderBy(F.desc("score"), "entry", "place")))  # 200 entries
    kept = graph.dedup_traces(ranked).where(F.size("path") >= MIN_STEPS)
    most = F.least(F.greatest((F.lit(symbols.count()) / 10).cast("int"), F.lit(FEWEST)), F.lit(MOST))
    top = kept.withColumn("id", F.row_number().over(W.orderBy(F.desc(F.size("path")), F.desc("score"), "trace_id"))).where(F.col("id") <= most)
    steps = top.select("id", "score", F.size("path").alias("n"), F.posexplode("path").alias("step", "uid")).join(symbols.select("uid", F.col("id").alias("symbol_id"), "name"), "uid")
    steps = steps.join(members.withColumnRenamed("community_id", "c"), "symbol_id", "left")
    crossing = F.when(F.countDistinct("c") > 1, "cross_community").otherwise("intra_community")
    label = F.concat(F.min_by("name", "step"), F.lit(" → "), F.max_by("name", "step"))
    processes = steps.groupBy("id").agg(label.alias("label"), crossing.alias("process_type"), F.first("score").alias("priority"), F.first("n").cast("long").alias("step_count"))
    return processes, steps.select(F.col("id").alias("process_id"), "symbol_id", F.col("step").alias("step_index"))


def ingest(spark: SparkSession, root: str | DataFrame, folder: str, force: bool = False, exclude_tests: bool = False, now: str | None = None) -> dict:
    """Reads a tree, or a frame of (path, content), into the store at ``folder``; returns the metrics.

    Nothing is done where no file changed or went. Every file is parsed, as edges
    cross files; the parsed records are written once and read again.
    """
    m, began = Metrics(), time.perf_counter()
    s = store.Store(spark, folder)
    files = tree.scan(spark, root, exclude_tests) if isinstance(root, str) else tree.described(root)
    work = f"{s.folder}/_work/{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    try:
        files = kept(files, "files")
        m.files = files.count()
        began = m.timed("scan", began)
        index = s.read("file_index")
        described = files.drop("content")
        m.changed, m.stale = store.changed_files(described, index).count(), store.stale_files(described, index).count()
        if not force and m.changed == 0 and m.stale == 0 and m.files:
            m.up_to_date = True
            return m.report()
        parsed = kept(tree.extract(files), "parsed")
        m.parse_errors = parsed.where("parse_error is not null").count()
        began = m.timed("parse", began)
        candidates = kept(edge_candidates(parsed, described), "candidates")
        began = m.timed("resolve", began)
        symbols = kept(symbol_rows(parsed, described, candidates), "symbols")
        s.write("symbols", symbols)
        s.write("relationships", relationship_rows(candidates, symbols))
        flows = resolve.flow_functions(tree.records(parsed, "flows"), tree.records(parsed, "symbols"))
        s.write("data_flows", flows.withColumn("id", F.row_number().over(W.partitionBy("file_path").orderBy("ord")) + F.xxhash64("file_path") % 2**40 * 2**20))
        began = m.timed("store", began)
        called = candidates.where("kind = 'CALLS'").select(F.col("source_uid").alias("source"), F.col("target_uid").alias("target"), "confidence", F.struct("file_path", "phase", "ord", "place", "target_uid").alias("ord"))
        communities, members = community_rows(called, symbols)
        members = kept(members, "members")
        s.write("communities", communities)
        s.write("community_members", members)
        began = m.timed("communities", began)
        processes, steps = process_rows(called, symbols, members)
        s.write("processes", processes)
        s.write("process_steps", steps)
        began = m.timed("processes", began)
        stamp = now or str(int(time.time()))
        s.write("file_index", described.select("path", "content_hash", F.lit(stamp).alias("last_indexed"), "language", "size_bytes"))
        for name in ("symbols", "relationships", "communities", "processes"):
            setattr(m, name, s.read(name).count())
        m.timed("count", began)
        return m.report()
    finally:
        fs, where = s._hadoop(work)
        fs.delete(where, True)
