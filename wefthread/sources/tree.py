"""Source trees as tables: files, and the raw records that the readers find in them."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wefthread.sources.braces import Go, TypeScript
from wefthread.sources.ruby import Ruby

# Languages by extension, folders that are never read, folders and endings of tests.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "go": "go", "rb": "ruby"}
SKIPPED_FOLDERS = {"node_modules", "vendor", "target", "dist", "build", "__pycache__"}
TEST_FOLDERS = {"spec", "specs", "test", "tests", "__tests__", "fixtures"}
TEST_FILE = r"(_spec\.rb|_test\.go|\.(test|spec)\.(ts|js|tsx))$"

READERS = {"typescript": TypeScript, "go": Go, "ruby": Ruby}
#: Files parsed before rows are handed on, so that one batch of output stays small.
FILES_A_BATCH = 64

_SYMBOL = "name string, kind string, start_line int, end_line int, is_exported boolean, parent_name string, superclass string, interfaces array<string>, type_annotation string, param_count int"
_IMPORT = "source_path string, imported_names array<string>, line int"
_CALL = "callee_name string, receiver string, caller_name string, caller_parent string, line int"
_FLOW = "source_expr string, sink_expr string, flow_kind string, enclosing_function string, enclosing_parent string, enclosing_start_line int, source_line int, sink_line int"


def language(path: Column) -> Column:
    """By extension; null for all others."""
    extension = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F.lit(None).cast("string")
    for name in sorted(set(LANGUAGES.values())):
        out = F.when(extension.isin([e for e, n in LANGUAGES.items() if n == name]), name).otherwise(out)
    return out


def is_test(path: Column) -> Column:
    return path.rlike(rf"(^|/)({'|'.join(sorted(TEST_FOLDERS))})/") | path.rlike(TEST_FILE)


class Ignore:
    """The patterns of one ignore file, read from its folder down; the last that fits decides."""

    def __init__(self, lines: list[str]):
        self.rules = []
        for line in lines:
            line = line.rstrip("\n").rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line.lstrip("!") if keep else line
            only_folder = line.endswith("/")
            body = line.strip("/")
            anchored = "/" in line.rstrip("/")
            pattern = "".join(self._piece(p) for p in re.split(r"(\*\*/|/\*\*$|\*|\?|\[[^]]*\])", body) if p)
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + pattern + r"\Z"), only_folder, keep))

    @staticmethod
    def _piece(p: str) -> str:
        if p.startswith("[") and p.endswith("]"):
            return fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")
        return {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.escape(p)

    def verdict(self, path: str, folder: bool) -> bool | None:
        out = None
        for pattern, only_folder, keep in self.rules:
            if (folder or not only_folder) and pattern.match(path):
                out = not keep
        return out


def listing(root: str, exclude_tests: bool = False) -> list[str]:
    """Relative paths of the readable sources below ``root``, sorted.

    Hidden entries and build folders are left out, as is what ignore files name:
    ``.ignore`` always, ``.gitignore`` inside a repository.
    """
    root = os.path.abspath(root)
    up = [root]
    while os.path.dirname(up[-1]) != up[-1]:
        up.append(os.path.dirname(up[-1]))
    names = [".ignore"] + ([".gitignore"] if any(os.path.exists(os.path.join(p, ".git")) for p in up) else [])
    rules: dict[str, list[Ignore]] = {}
    out = []
    for folder, folders, files in os.walk(root):
        here = os.path.relpath(folder, root)
        here = "" if here == "." else here + "/"
        own = [n for n in reversed(names) if n in files]
        rules[here] = [Ignore(open(os.path.join(folder, n), encoding="utf-8", errors="replace").readlines()) for n in own]
        above = [here[:i] for i in range(len(here) + 1) if i == 0 or here[i - 1] == "/"]

        def ignored(name: str, is_folder: bool) -> bool:
            found = None
            for base in above:
                for rule in rules.get(base, ()):
                    verdict = rule.verdict((here + name)[len(base) :], is_folder)
                    found = verdict if verdict is not None else found
            return bool(found)

        folders[:] = [f for f in sorted(folders) if not f.startswith(".") and f not in SKIPPED_FOLDERS and not (exclude_tests and f in TEST_FOLDERS) and not ignored(f, True)]
        for f in files:
            known = not f.startswith(".") and f.rpartition(".")[2] in LANGUAGES and "." in f
            if known and not (exclude_tests and re.search(TEST_FILE, f)) and not ignored(f, False):
                out.append(here + f)
    return sorted(out)


def scan(spark: SparkSession, root: str, exclude_tests: bool = False) -> DataFrame:
    """files(path, language, content_hash, size_bytes, content) below ``root``.

    The driver lists names only; executors read the contents, so ``root`` is a folder
    that all of them see. Sources in a table or object store skip this step: any frame
    with path and content goes through ``described``.
    """
    base = os.path.abspath(root)
    paths = spark.createDataFrame([(p,) for p in listing(root, exclude_tests)], "path string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), FILES_A_BATCH):
                part = list(pdf["path"].iloc[k : k + FILES_A_BATCH])
                contents = []
                for p in part:
                    with open(os.path.join(base, p), "rb") as file:
                        contents.append(file.read())
                yield pd.DataFrame({"path": part, "content": contents})

    return described(paths.mapInPandas(read, "path string, content binary"))


def described(files: DataFrame) -> DataFrame:
    """(path, content) with language, hash and size; files of no known language go."""
    rows = files.select("path", language(F.col("path")).alias("language"), F.xxhash64("content").alias("content_hash"), F.octet_length("content").cast("long").alias("size_bytes"), "content")
    return rows.where("language is not null")


def parse_text(language_name: str, text: str) -> dict[str, list[dict]]:
    """Symbols, imports, calls and flows of one text."""
    r = READERS[language_name](text).read()
    return {"symbols": r.symbols, "imports": r.imports, "calls": r.calls, "flows": r.flows}


def extract(files: DataFrame) -> DataFrame:
    """One row a file with its raw records; a file that can't be read has a ``parse_error`` and no records."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), FILES_A_BATCH):
                rows = []
                for path, kind, content in pdf[["path", "language", "content"]].iloc[k : k + FILES_A_BATCH].itertuples(index=False):
                    empty = {"symbols": [], "imports": [], "calls": [], "flows": []}
                    try:
                        found, error = parse_text(kind, bytes(content).decode("utf-8", "replace")), None
                    except Exception as e:  # one bad file is reported and must not end the run
                        found, error = empty, f"{type(e).__name__}: {e}"
                    rows.append({"file_path": path, **found, "parse_error": error})
                yield pd.DataFrame(rows)

    return files.select("path", "language", "content").mapInPandas(parse, _schema())


def _schema() -> str:
    nested = lambda s: ", ".join(f"{n}: {t}" for n, t in (x.split(" ", 1) for x in s.split(", ")))
    arrays = ", ".join(f"{n} array<struct<{nested(s)}>>" for n, s in (("symbols", _SYMBOL), ("imports", _IMPORT), ("calls", _CALL), ("flows", _FLOW)))
    return f"file_path string, {arrays}, parse_error string"


def records(parsed: DataFrame, kind: str) -> DataFrame:
    """(file_path, ord, ...) of one kind of record; symbols also get their uid."""
    rows = parsed.select("file_path", F.posexplode(kind).alias("ord", "__r")).select("file_path", "ord", "__r.*")
    return rows.withColumn("uid", uid(F.col("kind"), F.col("file_path"), F.col("name"), F.col("start_line"))) if kind == "symbols" else rows


def uid(kind: Column, path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", kind, path, name, line.cast("string"))
