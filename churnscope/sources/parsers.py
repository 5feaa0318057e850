"""Parsers as plug-ins, and the one map that runs them over file contents."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope import gosyntax

PARSED = (
    "path string, parser_status string, attempts long, language string, function_count long, method_count long, type_count long, import_count long, "
    "symbol_count long, complexity long, max_function_complexity long, imports array<string>, diagnostics array<struct<code:string,message:string>>"
)


class LanguageParser(Protocol):
    language: str

    def recognize(self, path: str) -> bool: ...

    def parse(self, source: str) -> gosyntax.GoFacts: ...


class GoParser:
    language = "go"

    def recognize(self, path: str) -> bool:
        return path.lower().endswith(".go")

    def parse(self, source: str) -> gosyntax.GoFacts:
        return gosyntax.analyze(source)


def parse_file(path: str, content: bytes | None, truncated: bool, parsers: list[LanguageParser]) -> dict:
    """The first parser that recognizes the path; what can't be read counts as empty source."""
    notes, facts, attempts, found = [], gosyntax.GoFacts(), 0, None
    for attempts, parser in enumerate(parsers, 1):
        if parser.recognize(path):
            found = parser
            break
    if found:
        if truncated:
            notes.append(("truncated_source", "The file is longer than the content window."))
        elif content is None or b"\0" in content:
            notes.append(("unsupported_content_kind", "The file is not text."))
        else:
            try:
                facts = found.parse(content.decode())
                if facts.problem:
                    notes.append(("parse_error", facts.problem))
            except UnicodeDecodeError:
                notes.append(("invalid_utf8", "The file is not valid UTF-8."))
    counts = (len(facts.functions), len(facts.methods), len(facts.types), len(facts.imports))
    return {
        "path": path, "parser_status": "parsed" if found else "unsupported", "attempts": attempts, "language": found.language if found else None,
        "function_count": counts[0], "method_count": counts[1], "type_count": counts[2], "import_count": counts[3], "symbol_count": sum(counts[:3]),
        "complexity": facts.total if found else None, "max_function_complexity": facts.most if found else None, "imports": facts.imports,
        "diagnostics": [{"code": c, "message": m} for c, m in notes],
    }


def parsed(path: Column, content: Column, truncated: Column, parsers: list[LanguageParser] | None = None) -> Column:
    """A struct of what ``PARSED`` says but the path, so that one reading of a file serves all that is derived from it."""
    parsers = parsers or [GoParser()]
    schema = PARSED.removeprefix("path string, ")
    names = [c.split()[0] for c in PARSED.split(", ")][1:]

    @F.pandas_udf(schema)
    def parse(paths: pd.Series, contents: pd.Series, cut: pd.Series) -> pd.DataFrame:
        rows = [parse_file(p, c, bool(t), parsers) for p, c, t in zip(paths, contents, cut)]
        return pd.DataFrame(rows, columns=names).astype({"complexity": "Int64", "max_function_complexity": "Int64"})

    return parse(path, content, truncated)


def parse_files(windows: DataFrame, parsers: list[LanguageParser] | None = None) -> DataFrame:
    """``windows``: (path, content, truncated). One row each, as ``PARSED`` says."""
    rows = windows.select("path", parsed(F.col("path"), F.col("content"), F.col("truncated"), parsers).alias("_p"))
    return rows.select("path", "_p.*")
