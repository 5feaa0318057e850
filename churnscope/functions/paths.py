"""Column functions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories and names that mark vendored and generated files.
VENDOR_DIRS = ("node_modules", "vendor", "third_party", "third-party", "external")
GENERATED_DIRS = ("generated", "gen", "codegen", "dist", "build")
GENERATED_INFIXES = (".generated.", ".gen.")
GENERATED_SUFFIXES = (".pb.go", ".pb.rs", ".g.cs")
TEST_SUFFIX = "_test.go"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last extension in lower case; null for none and for names like .gitignore."""
    found = F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)
    return F.lower(F.nullif(found, F.lit("")))


def _has_dir(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(n) for n in names]))


def is_vendor(path: Column) -> Column:
    return _has_dir(path, VENDOR_DIRS)


def is_test(path: Column) -> Column:
    return F.lower(file_name(path)).endswith(TEST_SUFFIX)


def is_generated_path(path: Column) -> Column:
    name, test = F.lower(file_name(path)), _has_dir(path, GENERATED_DIRS)
    for infix in GENERATED_INFIXES:
        test = test | name.contains(infix)
    for suffix in GENERATED_SUFFIXES:
        test = test | name.endswith(suffix)
    return test


def relative_path(root: str, path: Column) -> Column:
    """Path below a canonical root; null outside it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, F.lit(2**31 - 1)))


def package_path(relative: Column) -> Column:
    """The parent directory, ``.`` at the root."""
    return F.when(F.instr(relative, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(relative, "/[^/]*$", ""))


def normalize_package_path(path: Column) -> Column:
    inner = F.replace(F.btrim(F.trim(path), F.lit("/")), F.lit("\\"), F.lit("/"))
    return F.coalesce(F.nullif(inner, F.lit("")), F.lit("."))


def normalize_change_path(path: Column) -> Column:
    """Path of a change row: forward slashes, no doubled ones, null if empty."""
    return F.nullif(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/{2,}", "/"), F.lit(""))


def rename_sides(raw: Column) -> Column:
    """struct(old_path, path) of a change row's path; old_path only for renames.

    ``pre{old => new}post`` takes the last ``{`` before the arrow's close and the
    first ``}``; without braces the arrow splits the whole text.
    """
    brace = r"^(.*)\{(.*?) => ([^}]*)\}(.*)$"
    plain = r"^(.*?) => (.*)$"
    group = lambda rx, i: F.regexp_extract(raw, rx, i)
    old = F.when(raw.rlike(brace), F.concat(group(brace, 1), group(brace, 2), group(brace, 4))).when(raw.rlike(plain), group(plain, 1))
    new = F.when(raw.rlike(brace), F.concat(group(brace, 1), group(brace, 3), group(brace, 4))).when(raw.rlike(plain), group(plain, 2)).otherwise(raw)
    return F.struct(normalize_change_path(old).alias("old_path"), normalize_change_path(new).alias("path"))
