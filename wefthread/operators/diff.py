"""Changed lines of a unified diff, and what they touch."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

RANGES = "file_path string, lo int, hi int"
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def changed_ranges(diff: str) -> list[tuple[str, int, int]]:
    """(file, first line, last line) on both sides of every hunk: old lines by the old path, new ones by the new path.

    A side that is ``/dev/null`` or has no lines gives nothing.
    """
    out: list[tuple[str, int, int]] = []
    paths: list[str | None] = [None, None]
    left = [0, 0]  # lines of the hunk still to come; a line of text may look like a header
    for line in diff.splitlines():
        if left[0] > 0 or left[1] > 0:
            if not line.startswith("\\"):
                left[0] -= line[:1] in ("-", " ", "")
                left[1] -= line[:1] in ("+", " ", "")
            continue
        if line.startswith(("--- ", "+++ ")):
            side = line[0] == "+"
            path = line[4:].split("\t")[0]
            paths[side] = None if path == "/dev/null" else path.removeprefix("b/" if side else "a/")
        elif m := _HUNK.match(line):
            a, n, b, k = m.groups()
            left = [int(n if n is not None else 1), int(k if k is not None else 1)]
            for path, first, count in ((paths[0], int(a), left[0]), (paths[1], int(b), left[1])):
                if path and count:
                    out.append((path, max(first, 1), max(first, 1) + count - 1))
    return out


def ranges(spark: SparkSession, diff: str) -> DataFrame:
    return spark.createDataFrame(changed_ranges(diff), RANGES)


def git_diff(repo: str, base: str, head: str | None = None) -> str:
    for ref in (base, head):
        if ref is not None and (not ref or ref.startswith("-")):
            raise ValueError(f"not a revision: {ref!r}")
    command = ["git", "-C", repo, "diff", "--unified=0", base, *([head] if head else []), "--"]
    return subprocess.run(command, check=True, capture_output=True, text=True, timeout=30).stdout
