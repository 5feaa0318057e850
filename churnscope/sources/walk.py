"""Files of a working tree under nested ignore files, as a table.

Hidden files count, links are not followed, ``.git`` is left out at any depth and
the index folder at the root. A link counts if it leads to a file or nowhere.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.scratch import materialize

INDEX_DIR = ".churnscope"


@dataclass(frozen=True)
class IgnoreRule:
    base: str
    pattern: re.Pattern
    negated: bool
    only_dirs: bool


def _translate(glob: str) -> str:
    """A gitignore glob as a regular expression over a path below its folder."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i:] == "**" and i and glob[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def parse_ignore(text: str, base: str) -> list[IgnoreRule]:
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        only_dirs, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        if line:
            rules.append(IgnoreRule(base, re.compile(("" if anchored else "(?:.*/)?") + _translate(line) + r"\Z", re.S), negated, only_dirs))
    return rules


def ignored(rules: list[IgnoreRule], path: str, is_dir: bool) -> bool:
    """The last rule that fits decides."""
    for r in reversed(rules):
        below = path[len(r.base) :].lstrip("/") if not r.base or path.startswith(r.base + "/") else None
        if below is not None and (is_dir or not r.only_dirs) and r.pattern.match(below):
            return not r.negated
    return False


def walk(root: str) -> Iterator[tuple[str, str, int | None, int | None]]:
    """(path, relative_path, byte_size, mtime_ms) of all files, in order of path."""
    root = os.path.realpath(root)

    def visit(folder: str, relative: str, rules: list[IgnoreRule]) -> Iterator[tuple[str, str, int | None, int | None]]:
        try:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                rules = rules + parse_ignore(f.read(), relative)
        except OSError:
            pass
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            path = f"{relative}/{entry.name}" if relative else entry.name
            is_dir = entry.is_dir(follow_symlinks=False)
            if entry.name == ".git" or (path == INDEX_DIR and is_dir) or ignored(rules, path, is_dir):
                continue
            if is_dir:
                yield from visit(entry.path, path, rules)
                continue
            try:
                if entry.is_symlink() and os.path.isdir(entry.path):
                    continue
                at = entry.stat()
                yield entry.path, path, at.st_size, at.st_mtime_ns // 1_000_000
            except OSError:
                yield entry.path, path, None, None

    yield from visit(root, "", [])


def files(spark: SparkSession, root: str, rows: int = 200_000) -> DataFrame:
    """The walk as a table; the driver holds ``rows`` of them at a time."""
    schema, found, table = "path string, relative_path string, byte_size long, mtime_ms long", walk(root), None
    while part := list(islice(found, rows)):
        frame = pd.DataFrame(part, columns=[c.split()[0] for c in schema.split(", ")]).astype({"byte_size": "Int64", "mtime_ms": "Int64"})
        more = spark.createDataFrame(frame, schema)
        if table is not None or len(part) == rows:
            more = materialize(more, "files")
        table = more if table is None else table.unionByName(more)
    return spark.createDataFrame([], schema) if table is None else table


def read_windows(found: DataFrame, window: int) -> DataFrame:
    """``found`` with content (the first ``window`` bytes, null if unreadable) and truncated."""

    @F.pandas_udf("content binary, truncated boolean")
    def read(paths: pd.Series) -> pd.DataFrame:
        out = []
        for p in paths:
            try:
                with open(p, "rb") as f:
                    data = f.read(window)
                    out.append((data, bool(f.read(1))))
            except OSError:
                out.append((None, False))
        return pd.DataFrame(out, columns=["content", "truncated"])

    return found.withColumn("_w", read("path")).select("*", "_w.content", "_w.truncated").drop("_w")
