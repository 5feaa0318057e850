"""Column functions over file contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER_HEAD, MARKER_TAIL = "// Code generated ", " DO NOT EDIT."


def content_kind(content: Column) -> Column:
    """``binary`` with a NUL byte, ``text`` if valid UTF-8, else ``unknown``."""
    nul = F.contains(content, F.lit(bytearray(b"\0")))
    return F.when(content.isNull(), "unknown").when(nul, "binary").when(F.is_valid_utf8(content.cast("string")), "text").otherwise("unknown")


def line_count(text: Column) -> Column:
    """Lines as read one by one: a closing newline adds none, an empty text has none."""
    breaks = F.regexp_count(text, F.lit("\n"))
    return (breaks + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("long")


def has_generated_marker(text: Column) -> Column:
    """Whether the first line that is neither blank nor a plain comment is the marker.

    A marker line may end the comment block; the two literals may share a space.
    """
    lines = F.transform(F.split(text, "\r?\n", -1), lambda x: F.trim(x))
    is_marker = lambda x: x.startswith(MARKER_HEAD) & x.endswith(MARKER_TAIL)
    step = lambda state, x: F.when(state != 0, state).when(is_marker(x), 1).when((x == "") | x.startswith("//"), 0).otherwise(-1)
    return F.aggregate(lines, F.lit(0), step) == 1


def diagnostics_json(diagnostics: Column) -> Column:
    return F.to_json(F.array_distinct(diagnostics))


def diagnostics_from_json(text: Column) -> Column:
    """Rows (code, message); invalid JSON is one row that says so, bad items are dropped."""
    kind = "array<struct<code:string,message:string>>"
    parsed = F.filter(F.from_json(text, kind), lambda x: x["code"].isNotNull() & x["message"].isNotNull())
    bad = F.array(F.struct(F.lit("invalid_diagnostics_json").alias("code"), F.lit("Stored diagnostics could not be read.").alias("message")))
    return F.when(F.try_parse_json(text).isNull() | ~F.trim(text).startswith("["), bad).otherwise(F.coalesce(parsed, F.array().cast(kind)))


def module_prefix(lines: Column) -> Column:
    """From the lines of a module file: the first trimmed ``module`` line's rest."""
    rests = F.transform(F.filter(lines, lambda x: F.trim(x).rlike(r"^module \s*\S")), lambda x: F.trim(F.regexp_replace(F.trim(x), "^module ", "")))
    return F.get(rests, F.lit(0))
