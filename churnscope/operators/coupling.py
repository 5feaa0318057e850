"""Import references to packages: resolution, edges and coupling counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions import paths as P
from churnscope.scratch import lookup_join, materialize


def file_packages(files: DataFrame) -> DataFrame:
    """(path, package) of active Go files, vendored, generated and test files among them."""
    return files.where("is_active AND language = 'go' AND path IS NOT NULL").select("path", P.package_path(F.col("path")).alias("package"))


def resolve_targets(references: DataFrame, packages: DataFrame, module_prefix: str | None, by: list[str]) -> DataFrame:
    """Rows with a raw_target and their resolved_package.

    Candidates in order: the target below the module prefix, then the target itself;
    the first that is a known package wins. Known packages are looked up by name, with the
    rows in place while they are few and salted by the columns ``by`` beyond.
    """
    target = F.trim(F.col("raw_target"))
    candidates = [target]
    if module_prefix:
        below = F.when(target == module_prefix, F.lit(".")).when(target.startswith(module_prefix + "/"), F.substring(target, len(module_prefix) + 2, F.lit(2**31 - 1)))
        candidates.insert(0, below)
    known, tried, rows = materialize(packages.select("package").distinct(), "packages"), [], references
    for i, c in enumerate(candidates):
        names = known.select(F.col("package").alias(f"_name{i}"), F.col("package").alias(f"_known{i}"))
        rows = lookup_join(rows.withColumn(f"_name{i}", F.when(c.isNotNull(), P.normalize_package_path(c))), names, [f"_name{i}"], by)
        tried.append(f"_known{i}")
    return rows.select(*references.columns, F.coalesce(*tried).alias("resolved_package"))


def resolve_imports(references: DataFrame, packages: DataFrame, module_prefix: str | None) -> DataFrame:
    """``references`` (source_path, idx, raw_target) with resolved_package and source_package."""
    own = packages.select(F.col("path").alias("source_path"), F.col("package").alias("source_package"))
    return resolve_targets(references, packages, module_prefix, ["source_path", "idx"]).join(own, "source_path", "left")


def dependency_edges(resolved: DataFrame) -> DataFrame:
    """Distinct (source_path, source_package, target_package); edges within a package stay.

    The package follows from the path, so each (source_path, target_package) is one row
    and couplings are plain counts.
    """
    return resolved.where("resolved_package IS NOT NULL").select("source_path", "source_package", F.col("resolved_package").alias("target_package")).distinct()


def coupling_in(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target_package").alias("package")).agg(F.count("*").alias("coupling_in"))


def coupling_out(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("coupling_out"))


def file_facts(files: DataFrame, metrics: DataFrame, owners: DataFrame, packages: DataFrame, edges: DataFrame) -> DataFrame:
    """Active files with all that is known of them; counters 0 where unknown, ages and owners null."""
    zero = ("commits", "total_added", "total_deleted", "total_churn", "recent_churn", "recent_added", "recent_deleted", "author_count", "co_changed_files", "coupling_in", "coupling_out")
    wide = (
        files.where("is_active").join(metrics, "path", "left").join(owners, "path", "left")
        .join(packages.join(coupling_in(edges), "package", "left"), "path", "left").join(coupling_out(edges), "path", "left"))
    return wide.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in zero})
