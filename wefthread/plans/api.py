"""Questions to a stored graph, by name: what a command line or a tool server calls."""

from __future__ import annotations

import json
import os
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wefthread.operators import diff, evaluate, search, traverse
from wefthread.plans.ingest import ingest
from wefthread.sources import store

# Kinds that a filter may name, and those that a batch takes unless told otherwise.
SYMBOL_KINDS = {"Function", "Method", "Class", "Module", "Interface", "Struct", "Enum", "Constant", "Type", "Property", "Constructor", "External", "Field", "Variable"}
BATCH_KINDS = ("Function", "Method")
HIDDEN = ("File", "Folder", "External")
CANDIDATES = 50
DIMS = 384
FIELDS = ("id", "uid", "name", "kind", "file_path", "start_line", "end_line", "is_exported", "parent_name")

Embedder = Callable[[list[str]], list[list[float]]]


class NotFound(LookupError):
    """No symbol, index or repository of that name."""


class Ambiguous(LookupError):
    """A name with several meanings; ``candidates`` are its first symbols."""

    def __init__(self, message: str, candidates: list[dict] | None = None):
        super().__init__(message)
        self.candidates = candidates or []


def hashing_embedder(texts: list[str]) -> list[list[float]]:
    """Unit vectors of signed word hashes: deterministic, and no model to load."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for row, text in zip(out, texts):
        for word in search.tokens_of(text):
            h = zlib.crc32(word.encode())
            row[h % DIMS] += 1.0 if h & 0x80000000 else -1.0
        norm = float(np.linalg.norm(row))
        row /= norm or 1.0
    return out.tolist()


class Graph:
    """A store and the questions it answers. Frames are lazy; dictionaries are small and collected."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder = hashing_embedder, model_id: str = "hashing-384"):
        self.spark, self.store = spark, store.Store(spark, folder)
        self.embedder, self.model_id = embedder, model_id

    def index(self, root: str, **options) -> dict:
        return ingest(self.spark, root, self.store.folder, **options)

    @property
    def symbols(self) -> DataFrame:
        return self.store.read("symbols")

    @property
    def edges(self) -> DataFrame:
        return self.store.read("relationships")

    def exists(self) -> bool:
        return bool(self.store._versions("file_index"))

    # --- symbols

    def by_name(self, name: str, limit: int = CANDIDATES) -> DataFrame:
        """Exported ones first, then by id."""
        return self.symbols.where(F.col("name") == name).orderBy(F.desc("is_exported"), "id").limit(limit).select(*FIELDS)

    def resolve(self, name: str | None = None, uid: str | None = None, file: str | None = None, id: int | None = None) -> dict:
        """The one symbol meant: by id, else uid, else name and file, else name."""
        if id is not None or uid is not None:
            rows = self.symbols.where(F.col("id") == id if id is not None else F.col("uid") == uid).orderBy("id").select(*FIELDS).limit(1).collect()
            if not rows:
                raise NotFound(f"No symbol found with uid '{uid}'" if id is None else f"No symbol found with id {id}")
            return rows[0].asDict()
        if name is None:
            raise ValueError("a name, a uid or an id is needed")
        if file is not None:
            rows = self.symbols.where((F.col("name") == name) & (F.col("file_path") == file)).orderBy("id").select(*FIELDS).limit(CANDIDATES + 1).collect()
            where = f" in '{file}'"
        else:
            rows, where = self.by_name(name, CANDIDATES + 1).collect(), ""
        if not rows:
            raise NotFound(f"Symbol '{name}' not found{where}")
        if len(rows) > 1:
            many = f"more than {CANDIDATES}" if len(rows) > CANDIDATES else str(len(rows))
            raise Ambiguous(f"Symbol '{name}'{where} matches {many} entries; choose one by its uid", [r.asDict() for r in rows[:CANDIDATES]])
        return rows[0].asDict()

    def best(self, name: str) -> dict:
        rows = self.by_name(name, 1).collect()
        if not rows:
            raise NotFound(f"Symbol '{name}' not found")
        return rows[0].asDict()

    def context(self, name: str | None = None, uid: str | None = None, file: str | None = None) -> dict:
        """{status: found | ambiguous | not_found, ...} with the edges into and out of the symbol."""
        try:
            found = self.resolve(name, uid, file)
        except Ambiguous as e:
            return {"status": "ambiguous", "message": str(e), "candidates": e.candidates}
        except NotFound as e:
            return {"status": "not_found", "message": str(e)}
        ids = self.spark.range(1).select(F.lit(found["id"]).alias("id"))
        near = traverse.context(self.edges, ids).join(self.symbols.select(*[F.col(c).alias(f"o_{c}") for c in FIELDS]), F.col("other_id") == F.col("o_id"))
        rows = near.orderBy(F.desc("confidence"), "other_id", "kind").select("direction", F.col("kind").alias("edge_kind"), "confidence", *[F.col(f"o_{c}").alias(c) for c in FIELDS]).collect()
        side = lambda d: [{k: v for k, v in r.asDict().items() if k != "direction"} for r in rows if r.direction == d]
        return {"status": "found", "symbol": found, "incoming": side("incoming"), "outgoing": side("outgoing")}

    def around(self, ids: DataFrame) -> DataFrame:
        """(id, incoming, outgoing): how many edges to known symbols ``context`` has on either side of each of ids(id), in one pass for all."""
        near = traverse.context(self.edges, ids).join(self.symbols.select(F.col("id").alias("other_id")), "other_id")
        count = near.groupBy("id").agg(*[F.count_if(F.col("direction") == d).alias(d) for d in ("incoming", "outgoing")])
        return ids.join(count, "id", "left").select("id", F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"))

    # --- traversal

    def _impacts(self, starts: list[dict], direction: str, depth: int, min_confidence: float, calls_only: bool) -> list[dict]:
        """One walk from all starts; one result for each."""
        if not starts:
            return []
        origins = self.spark.createDataFrame([(s["id"],) for s in starts], "origin_id long")
        reached = traverse.impact(self.edges, origins, direction, depth, min_confidence, calls_only).join(self.symbols.select(*FIELDS), "id")
        modules = self.store.read("community_members").join(self.store.read("communities").select(F.col("id").alias("community_id"), F.col("label").alias("module")), "community_id").select(F.col("symbol_id").alias("id"), "community_id", "module")
        steps = self.store.read("process_steps").join(self.store.read("processes").select(F.col("id").alias("process_id"), F.col("label").alias("process")), "process_id").select(F.col("symbol_id").alias("id"), "process_id", "process")
        rows = reached.orderBy("origin_id", "depth", "id").collect()
        named = lambda df, key, label: df.join(reached.select("origin_id", "id").distinct(), "id").select("origin_id", key, label).distinct().orderBy("origin_id", key).collect()
        in_modules, in_processes = named(modules, "community_id", "module"), named(steps, "process_id", "process")
        out = []
        by_origin: dict[int, list] = {}
        for r in rows:
            by_origin.setdefault(r.origin_id, []).append(r)
        for s in starts:
            own = by_origin.get(s["id"], [])
            levels: dict[int, list[dict]] = {}
            for r in own:
                levels.setdefault(r.depth, []).append({c: r[c] for c in (*FIELDS, "confidence")})
            mods, procs = [r.module for r in in_modules if r.origin_id == s["id"]], [r.process for r in in_processes if r.origin_id == s["id"]]
            direct = len(levels.get(1, ()))
            risk = "high" if any(x["is_exported"] for x in levels.get(1, ())) or len(own) >= 10 else "medium" if direct else "low"
            more = (f" in {len(mods)} module(s)" if mods else "") + (f" and {len(procs)} process(es)" if procs else "")
            summary = f"Changing {s['name']} ({direction}) affects {len(own)} symbol(s) ({direct} direct){more}. Risk: {risk}."
            out.append({"target": s, "direction": direction, "by_depth": levels, "total_affected": len(own), "risk": risk, "summary": summary, "affected_modules": mods, "affected_processes": procs})
        return out

    def impact(self, name: str, direction: str = "upstream", depth: int = 3, min_confidence: float = 0.5, calls_only: bool = False) -> dict:
        return self._impacts([self.best(name)], direction, depth, min_confidence, calls_only)[0]

    def impact_batch(self, symbols: list[dict] | None = None, ranges: list[dict] | None = None, direction: str = "upstream", depth: int = 3, min_confidence: float = 0.5, calls_only: bool = False, max_symbols: int = 20, kinds: list[str] | None = None, all_kinds: bool = False) -> dict:
        """Impacts of symbols, [{id}] or [{name, file}], and of what ranges, [{file, start, end}], touch; by file, line and id."""
        if not symbols and not ranges:
            raise ValueError("symbols or ranges are needed")
        for k in kinds or ():
            if k not in SYMBOL_KINDS:
                raise ValueError(f"unknown symbol kind {k}")
        wanted = None if all_kinds or kinds == [] else list(kinds or BATCH_KINDS)
        s, parts = self.symbols, []
        if ids := [int(x["id"]) for x in symbols or () if "id" in x]:
            parts.append(s.join(self.spark.createDataFrame([(i,) for i in ids], "id long"), "id", "left_semi"))
        names = [x for x in symbols or () if "id" not in x]
        if any("name" not in x or "file" not in x for x in names):
            raise ValueError("a symbol needs an id, or a name and a file")
        if names:
            parts.append(s.join(self.spark.createDataFrame([(x["name"], x["file"]) for x in names], "name string, file_path string"), ["name", "file_path"], "left_semi"))
        if ranges:
            if any(not {"file", "start", "end"} <= set(x) for x in ranges):
                raise ValueError("a range needs a file, a start and an end")
            parts.append(traverse.overlapping(s, self.spark.createDataFrame([(x["file"], int(x["start"]), int(x["end"])) for x in ranges], diff.RANGES)))
        found = parts[0].select(*FIELDS)
        for p in parts[1:]:
            found = found.union(p.select(*FIELDS))
        found = found.where(F.col("kind").isin(wanted)) if wanted else found
        rows = [r.asDict() for r in found.distinct().orderBy("file_path", "start_line", "id").limit(max_symbols + 1).collect()]
        results = self._impacts(rows[:max_symbols], direction, depth, min_confidence, calls_only)
        return {"results": results, "total": len(results), "truncated": len(rows) > max_symbols}

    def detect_changes(self, repo: str, base: str = "HEAD", head: str | None = None, **options) -> dict:
        """The batch impact of what a diff touches; empty where it touches nothing."""
        changed = [{"file": f, "start": a, "end": b} for f, a, b in diff.changed_ranges(diff.git_diff(repo, base, head))]
        return self.impact_batch(ranges=changed, **options) if changed else {"results": [], "total": 0, "truncated": False}

    def subgraph(self, name: str | None = None, uid: str | None = None, id: int | None = None, file: str | None = None, direction: str = "outgoing", depth: int = 3, edge_types: list[str] | None = None, max_nodes: int = 100, max_edges: int = 500) -> dict | None:
        """Nodes and edges around a symbol; None where it isn't known."""
        try:
            start = self.resolve(None, uid, None, id) if uid or id is not None else (self.resolve(name, file=file) if file else self.best(name))
        except NotFound:
            return None
        nodes = traverse.subgraph(self.edges, start["id"], direction, depth, edge_types, max_nodes + 1)
        rows = nodes.join(self.symbols.select(*FIELDS), "id").orderBy("depth", "id").collect()
        kept = self.spark.createDataFrame([(r.id,) for r in rows[:max_nodes]], "id long")
        edges = traverse.induced(self.edges, kept, edge_types, max_edges + 1).orderBy("source_id", "target_id", "kind").select("source_id", "target_id", "kind", "confidence").collect()
        reasons = [f"more than {n} {what}" for got, n, what in ((rows, max_nodes, "nodes"), (edges, max_edges, "edges")) if len(got) > n]
        out = {"start_id": start["id"], "nodes": [r.asDict() for r in rows[:max_nodes]], "edges": [r.asDict() for r in edges[:max_edges]]}
        return out | {"node_count": len(out["nodes"]), "edge_count": len(out["edges"]), "truncated": bool(reasons), "truncated_reason": "; ".join(reasons) or None}

    # --- search

    def has_embeddings(self) -> bool:
        return bool(self.store.read("embeddings").where((F.col("model_id") == self.model_id) & (F.col("dims") == DIMS)).limit(1).count())

    def hits(self, term: str, mode: str = "bm25", limit: int = 10) -> DataFrame:
        """(id, score), best first; vector modes fall back to words where nothing is embedded."""
        if mode not in ("bm25", "vector", "hybrid"):
            raise ValueError(f"unknown mode {mode}")
        if mode != "bm25" and not self.has_embeddings():
            mode = "bm25"
        corpus = self.symbols.where("kind != 'External'")
        words = lambda n: search.bm25(corpus, "id", ["name", "file_path", "kind", "parent_name"], term, ~F.col("kind").isin(*HIDDEN), n)
        if mode == "bm25":
            return words(limit)
        stored = self.store.read("embeddings").where((F.col("model_id") == self.model_id) & (F.col("dims") == DIMS))
        near = search.vector_search(stored, "symbol_id", "vector", self.embedder([term])[0], limit if mode == "vector" else search.CANDIDATES).withColumnRenamed("symbol_id", "id")
        return near if mode == "vector" else search.hybrid(words(search.CANDIDATES), near, "id", limit)

    def search(self, term: str, mode: str = "bm25", limit: int = 10) -> DataFrame:
        return self.hits(term, mode, limit).join(self.symbols.select(*FIELDS), "id").orderBy(F.desc("score"), "id")

    def search_grouped(self, term: str, limit: int = 10) -> dict:
        """Hits by process, in the order of their steps, and hits of no process."""
        found = self.search(term, "bm25", limit)
        inside, outside = search.grouped(found, "id", self.store.read("process_steps").withColumnRenamed("symbol_id", "id"))
        labels = self.store.read("processes").select(F.col("id").alias("process_id"), "label", "process_type")
        groups: dict[int, dict] = {}
        for r in inside.join(labels, "process_id").join(self.symbols.select(*FIELDS), "id").orderBy("process_id", "step_index").collect():
            g = groups.setdefault(r.process_id, {"id": r.process_id, "label": r.label, "process_type": r.process_type, "matched_symbols": []})
            g["matched_symbols"].append({c: r[c] for c in (*FIELDS, "score", "step_index")})
        definitions = [r.asDict() for r in outside.orderBy(F.desc("score"), "id").collect()]
        return {"processes": list(groups.values()), "definitions": definitions, "total": found.count()}

    def embed(self, force: bool = False, batch: int = 64) -> int:
        """Embeds what is missing or outdated, or all with ``force``; returns how many symbols."""
        known = self.store.read("embeddings")
        work = store.embedding_worklist(self.symbols.drop("content_hash"), self.store.read("file_index"), known.limit(0) if force else known, self.model_id, DIMS)
        embedder, model, now = self.embedder, self.model_id, int(time.time())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for k in range(0, len(pdf), batch):
                    part = pdf.iloc[k : k + batch]
                    yield pd.DataFrame({"symbol_id": part["id"], "model_id": model, "dims": DIMS, "vector": embedder(list(part["text"])), "content_hash": part["content_hash"], "updated_at": now})

        fresh = work.mapInPandas(run, store.TABLES["embeddings"])
        self.store.write("embeddings", fresh if force else store.upsert(known, fresh, ["symbol_id"]))
        return self.store.read("embeddings").where(F.col("updated_at") == now).count()

    # --- lists

    def status(self) -> dict | None:
        return self.store.status().first().asDict() if self.exists() else None

    def communities(self) -> DataFrame:
        """With their first ten members by name, largest first."""
        m = self.store.read("community_members").join(self.symbols.select(F.col("id").alias("symbol_id"), "name", "kind"), "symbol_id")
        top = m.withColumn("r", F.row_number().over(W.partitionBy("community_id").orderBy("name", "symbol_id"))).where("r <= 10")
        lists = top.groupBy(F.col("community_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "kind", "name"))), lambda x: F.concat(x["kind"], F.lit(" "), x["name"])).alias("members"))
        return self.store.read("communities").join(lists, "id", "left").orderBy(F.desc("symbol_count"), "id")

    def processes(self) -> DataFrame:
        steps = self.store.read("process_steps").join(self.symbols.select(F.col("id").alias("symbol_id"), "name", "file_path"), "symbol_id")
        lists = steps.groupBy(F.col("process_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("step_index", "name", "file_path"))).alias("steps"))
        return self.store.read("processes").join(lists, "id", "left").orderBy(F.desc("priority"), "id")

    def dataflow(self, name: str | None = None, uid: str | None = None, file: str | None = None) -> DataFrame:
        """Flows of one function, by line. Of several symbols of a name the only function or method is meant."""
        try:
            found = self.resolve(name, uid, file)
        except Ambiguous as e:
            callables = [c for c in e.candidates[:10] if c["kind"] in BATCH_KINDS]
            if file is not None or len(callables) != 1:
                raise
            found = callables[0]
        return self.store.read("data_flows").where(F.col("function_uid") == found["uid"]).orderBy("source_line", "id")

    def sql(self, text: str, limit: int = 200) -> DataFrame:
        return self.store.sql(text, limit)

    # --- evaluation

    def evaluate(self, fixture: dict, mode: str = "bm25", k: int = 5) -> dict:
        """Recall and mean reciprocal rank of an evaluation set, over all and by category; ``grouped`` adds routing."""
        ranks, wanted, routes, placed = [], [], [], []
        for q in fixture["queries"]:
            for r in q["relevant"]:
                key = json.dumps([r["name"], r["file_path"], r["kind"]])
                wanted.append((q["id"], key))
                if r.get("in_process") is not None:
                    routes.append((q["id"], key, r["in_process"]))
            key_of = lambda r: json.dumps([r["name"], r["file_path"], r["kind"]])
            try:
                if mode == "grouped":
                    keys, most = [], 3 * k
                    while True:
                        g = self.search_grouped(q["query"], most)
                        inside = [key_of(x) for p in g["processes"] for x in p["matched_symbols"]]
                        keys = list(dict.fromkeys(inside + [key_of(x) for x in g["definitions"]]))
                        if len(keys) >= k or g["total"] < most or most >= 1000:
                            break
                        most = min(2 * most, 1000)
                    placed += [(q["id"], x, x in set(inside)) for x in keys]
                else:
                    keys = [key_of(r) for r in self.search(q["query"], mode, k).collect()]
            except search.QueryError:
                keys = []
            ranks += [(q["id"], i + 1, x) for i, x in enumerate(keys)]
        frame = self.spark.createDataFrame
        scores = evaluate.per_query(frame(ranks, "query_id string, rank int, key string"), frame(wanted, "query_id string, key string"), k)
        categories = frame([(q["id"], q["category"]) for q in fixture["queries"]], "query_id string, category string")
        scores = categories.select("query_id").join(scores, "query_id", "left").fillna(0.0)  # a query without relevant keys or hits scores 0
        rows = evaluate.by_category(scores, categories).orderBy("category").collect()
        total = sum(r.queries for r in rows) or 1
        out = {"mode": mode, "k": k, "queries": sum(r.queries for r in rows), "recall": sum(r.recall * r.queries for r in rows) / total, "mrr": sum(r.mrr * r.queries for r in rows) / total, "by_category": [r.asDict() for r in rows]}
        if mode == "grouped":
            want = frame(routes, "query_id string, key string, in_process boolean")
            got = frame(placed, "query_id string, key string, in_process boolean")
            mean = lambda df: df.agg(F.avg("accuracy")).first()[0]
            out |= {"process_recall": mean(evaluate.routing(want.where("in_process"), got)), "routing_accuracy": mean(evaluate.routing(want, got))}
        return out


def gate(report: dict, **least: float) -> list[str]:
    """The measures of a report that miss their minimum."""
    return [f"{name} {report.get(name)} < {value}" for name, value in least.items() if value is not None and (report.get(name) is None or report[name] < value)]


def find_repository(registry: str, wanted: str | None, marker: str) -> str:
    """The path of a registered repository with an index folder ``marker``: a path, an exact name, part of one name, or the only one."""
    if wanted and os.path.exists(os.path.join(os.path.abspath(wanted), marker)):
        return os.path.abspath(wanted)
    rows = [r for r in store.read_registry(registry) if os.path.exists(os.path.join(r["path"], marker))]
    known = ", ".join(r["name"] for r in rows) or "none"
    if not wanted:
        if len(rows) == 1:
            return rows[0]["path"]
        raise (Ambiguous if rows else NotFound)(f"name a repository; known: {known}")
    low = wanted.lower()
    fits = [r for r in rows if r["name"] == low] or [r for r in rows if low in r["name"]]
    if len(fits) == 1:
        return fits[0]["path"]
    raise (Ambiguous if fits else NotFound)(f"repository {wanted!r}: {'several fit: ' + ', '.join(r['name'] for r in fits) if fits else 'unknown; known: ' + known}")
