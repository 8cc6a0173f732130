"""The stored graph: Parquet tables, change detection, guarded SQL."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "symbols": "id long, uid string, name string, kind string, file_path string, start_line int, end_line int, is_exported boolean, parent_name string, type_info string, metadata string, content_hash long",
    "relationships": "id long, source_id long, target_id long, kind string, confidence double, reason string, metadata string",
    "communities": "id long, label string, cohesion double, symbol_count long",
    "community_members": "community_id long, symbol_id long",
    "processes": "id long, label string, process_type string, priority double, step_count long",
    "process_steps": "process_id long, symbol_id long, step_index long",
    "file_index": "path string, content_hash long, last_indexed string, language string, size_bytes long",
    "embeddings": "symbol_id long, model_id string, dims int, vector array<float>, content_hash long, updated_at long",
    "data_flows": "id long, function_uid string, source_expr string, sink_expr string, flow_kind string, source_line int, sink_line int",
}


class Store:
    """Tables under a folder; a table is written beside the old one and swapped in by a pointer file."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _versions(self, name: str) -> list[int]:
        fs, where = self._hadoop(f"{self.folder}/{name}")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(where) if fs.exists(self._hadoop(f"{s.getPath()}/_SUCCESS")[1]))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}/v{versions[-1]}")

    def write(self, name: str, rows: DataFrame) -> None:
        """A new version; readers take the latest that is complete."""
        versions = self._versions(name)
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(f"{self.folder}/{name}/v{(versions or [0])[-1] + 1}")
        for old in versions[:-1]:
            fs, where = self._hadoop(f"{self.folder}/{name}/v{old}")
            fs.delete(where, True)

    def views(self) -> None:
        for name in TABLES:
            self.read(name).createOrReplaceTempView(name)

    def sql(self, text: str, limit: int = 200) -> DataFrame:
        self.views()
        return read_only_sql(self.spark, text, limit)

    def status(self) -> DataFrame:
        counts = [self.read(t).agg(F.count(F.lit(1)).alias(t)) for t in ("file_index", "symbols", "relationships", "communities", "processes")]
        out = self.read("file_index").agg(F.max("last_indexed").alias("last_indexed"))
        for c in counts:
            out = out.crossJoin(c)  # one row each
        return out


_WRITES = ("Insert", "Delete", "Update", "Merge", "Create", "Drop", "Command", "Alter", "Truncate", "Replace", "Set", "Load", "Cache", "Refresh")


def read_only_sql(spark: SparkSession, text: str, limit: int = 200) -> DataFrame:
    """The first ``limit`` rows of a SELECT or WITH statement; anything that writes is refused before it is analysed."""
    start = text.strip()[:6].upper()
    if not (start.startswith("SELECT") or start.startswith("WITH")):
        raise ValueError("only SELECT and WITH are allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name.startswith(_WRITES) or name.endswith("Command"):
            raise ValueError(f"not a read: {name}")
        for group in (node.children(), node.innerChildren()):
            waiting += [x for x in (group.apply(i) for i in range(group.size())) if hasattr(x, "children")]
    return spark.sql(text).limit(limit)


def changed_files(scanned: DataFrame, index: DataFrame) -> DataFrame:
    """Scanned(path, content_hash) that the index lacks or has with another hash."""
    old = index.select("path", F.col("content_hash").alias("__old"))
    return scanned.join(old, "path", "left").where("__old is null or __old != content_hash").drop("__old")


def stale_files(scanned: DataFrame, index: DataFrame) -> DataFrame:
    return index.join(scanned.select("path"), "path", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with their key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def embedding_worklist(symbols: DataFrame, files: DataFrame, embeddings: DataFrame, model_id: str, dims: int) -> DataFrame:
    """Symbols (but files and folders) whose embedding is missing or of another hash, model or size."""
    s = symbols.where(~F.col("kind").isin("File", "Folder"))
    f = files.select(F.col("path").alias("file_path"), F.col("content_hash").alias("__h"))
    e = embeddings.select(F.col("symbol_id").alias("id"), "model_id", "dims", F.col("content_hash").alias("__eh"))
    rows = s.join(f, "file_path").join(e, "id", "left")
    rows = rows.where(F.col("model_id").isNull() | (F.col("__eh") != F.col("__h")) | (F.col("model_id") != model_id) | (F.col("dims") != dims))
    text = F.concat(F.col("kind"), F.lit(" "), F.coalesce(F.concat("parent_name", F.lit(".")), F.lit("")), F.col("name"), F.lit(" in "), F.col("file_path"))
    return rows.select("id", text.alias("text"), F.col("__h").alias("content_hash"))


def read_registry(path: str) -> list[dict]:
    if not os.path.exists(path):
        return []
    with open(path) as file:
        return json.load(file)


def register(path: str, repo: str, now: str) -> str:
    """Adds or renews a repository in the JSON list; returns its name, unique by a number at the end."""
    rows = read_registry(path)
    for r in rows:
        if r["path"] == repo:
            r["indexed_at"] = now
            break
    else:
        base = os.path.basename(repo.rstrip("/")).lower()
        names, name, k = {r["name"] for r in rows}, base, 2
        while name in names:
            name, k = f"{base}-{k}", k + 1
        r = {"name": name, "path": repo, "indexed_at": now}
        rows.append(r)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w") as file:
        json.dump(rows, file, indent=1)
    os.replace(f"{path}.new", path)
    return r["name"]
