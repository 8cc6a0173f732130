"""``python -m wefthread COMMAND``: the questions of ``wefthread.plans.api`` with JSON answers."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

MARKER = ".wefthread"
#: How deep a change is felt (fixed values).
FELT = {1: "WILL BREAK", 2: "LIKELY AFFECTED", 3: "MAY NEED TESTING"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wefthread")
    top.add_argument("--store", help="folder of the tables; default: .wefthread in the repository")
    top.add_argument("--repo", help="a path, or a registered name or part of it")
    top.add_argument("--registry", default=os.environ.get("WEFTHREAD_REGISTRY", os.path.expanduser("~/.wefthread/repos.json")))
    top.add_argument("--master", default="local[*]")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments):
        p = commands.add_parser(name)
        for flags, options in arguments:
            p.add_argument(*flags.split(), **options)
        return p

    flag, number = {"action": "store_true"}, lambda n: {"type": int, "default": n}
    symbol = [("name", {"nargs": "?"}), ("--uid", {}), ("--file", {})]
    walk = [("--direction", {"default": "upstream"}), ("--depth", number(3)), ("--min-confidence", {"type": float, "default": 0.5}), ("--calls-only", flag)]
    add("index", ("path", {"nargs": "?", "default": "."}), ("--force", flag), ("--metrics", flag), ("--exclude-tests", flag))
    for name in ("status", "clusters", "processes", "list-repos"):
        add(name)
    add("query", ("term", {}), ("--limit", number(10)), ("--mode", {"default": "bm25", "choices": ["bm25", "vector", "hybrid"]}), ("--grouped", flag))
    add("context", *symbol)
    add("dataflow", *symbol)
    add("impact", ("name", {}), *walk)
    add("impact-batch", ("--symbols", {"type": json.loads}), ("--ranges", {"type": json.loads}), *walk, ("--max-symbols", number(20)), ("--kinds", {"type": lambda s: [k for k in s.split(",") if k]}), ("--all-kinds", flag))
    add("detect-changes", ("base", {"nargs": "?", "default": "HEAD"}), ("head", {"nargs": "?"}), *walk)
    add("subgraph", *symbol, ("--id", {"type": int}), ("--direction", {"default": "outgoing"}), ("--depth", number(3)), ("--edge-types", {"type": lambda s: s.split(",")}), ("--max-nodes", number(100)), ("--max-edges", number(500)))
    add("embed", ("--force", flag))
    add("eval", ("fixture", {}), ("--k", number(5)), ("--mode", {"default": "bm25", "choices": ["bm25", "vector", "hybrid", "grouped", "all"]}), ("--output", {}), ("--min-recall", {"type": float}), ("--min-mrr", {"type": float}), ("--min-routing", {"type": float}))
    add("graph-query", ("sql", {}), ("--limit", number(200)))
    return top


def plain(x):
    """Frames as lists of rows; of columns of one name the last stays."""
    if isinstance(x, DataFrame):
        return [dict(zip(r.__fields__, map(plain, r))) for r in x.collect()]
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def answer(spark: SparkSession, a: argparse.Namespace) -> tuple[object, int]:
    from wefthread.plans import api
    from wefthread.sources import store

    if a.command == "list-repos":
        return [r for r in store.read_registry(a.registry) if os.path.exists(os.path.join(r["path"], MARKER))], 0
    if a.command == "index":
        root = os.path.abspath(a.path)
        report = api.Graph(spark, a.store or os.path.join(root, MARKER)).index(root, force=a.force, exclude_tests=a.exclude_tests)
        try:
            report["name"] = store.register(a.registry, root, str(int(time.time())))
        except (OSError, ValueError) as e:  # the index stands without it
            print(f"not registered: {e}", file=sys.stderr)
        return (report if a.metrics else {k: v for k, v in report.items() if k not in ("seconds", "peak_rss_kb")}), 0
    repo = None if a.store else api.find_repository(a.registry, a.repo or ("." if os.path.exists(MARKER) else None), MARKER)
    g = api.Graph(spark, a.store or os.path.join(repo, MARKER))
    if a.command == "status":
        return g.status(), 0
    if not g.exists():
        raise api.NotFound("no index; run the index command first")
    if a.command in ("impact", "impact-batch", "detect-changes"):
        walk = {"direction": a.direction, "depth": a.depth, "min_confidence": a.min_confidence, "calls_only": a.calls_only}
        if a.command == "impact":
            out = g.impact(a.name, **walk)
            return out | {"labels": {d: FELT.get(d, FELT[3]) for d in out["by_depth"]}}, 0
        if a.command == "impact-batch":
            return g.impact_batch(a.symbols, a.ranges, max_symbols=a.max_symbols, kinds=a.kinds, all_kinds=a.all_kinds, **walk), 0
        return g.detect_changes(repo or a.repo or ".", a.base, a.head, **walk), 0
    if a.command == "eval":
        with open(a.fixture) as file:
            fixture = json.load(file)
        modes = ["bm25", "vector", "hybrid"] if a.mode == "all" else [a.mode]
        reports = [g.evaluate(fixture, m, a.k) for m in modes]
        missed = [x for r in reports for x in api.gate(r, recall=a.min_recall, mrr=a.min_mrr, routing_accuracy=a.min_routing)]
        if a.output:
            with open(a.output, "w") as file:
                json.dump(plain(reports), file, indent=1)
        return {"reports": reports, "missed": missed}, int(bool(missed))
    simple = {
        "query": lambda: g.search_grouped(a.term, a.limit) if a.grouped else g.search(a.term, a.mode, a.limit),
        "context": lambda: g.context(a.name, a.uid, a.file),
        "dataflow": lambda: g.dataflow(a.name, a.uid, a.file),
        "subgraph": lambda: g.subgraph(a.name, a.uid, a.id, a.file, a.direction, a.depth, a.edge_types, a.max_nodes, a.max_edges),
        "clusters": g.communities,
        "processes": g.processes,
        "embed": lambda: {"embedded": g.embed(a.force)},
        "graph-query": lambda: g.sql(a.sql, a.limit),
    }
    return simple[a.command](), 0


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    if spark is None:
        spark = SparkSession.builder.master(a.master).appName("wefthread").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    try:
        out, code = answer(spark, a)
        print(json.dumps(plain(out), ensure_ascii=False, default=str))
        return code
    except (LookupError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
