"""Maintenance of stored tables: upserts, merges, soft deletes and reuse, as pure DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_replace(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows, and old rows whose key is not among them."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)


def upsert_accumulate(old: DataFrame, delta: DataFrame, key: list[str], sums=(), lows=(), highs=()) -> DataFrame:
    """Keys of either side, with sums, minima and maxima merged; nulls don't count."""
    parts = [F.sum(c).alias(c) for c in sums] + [F.min(c).alias(c) for c in lows] + [F.max(c).alias(c) for c in highs]
    return old.unionByName(delta).groupBy(*key).agg(*parts)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti").dropDuplicates(key))


def replace_children(old: DataFrame, new: DataFrame, changed: DataFrame, parent: list[str]) -> DataFrame:
    """Child rows of changed parents are replaced as a whole."""
    return old.join(changed.select(*parent).distinct(), parent, "left_anti").unionByName(new)


def soft_delete(rows: DataFrame, scan_id: int) -> DataFrame:
    """Rows that the scan has not seen become inactive."""
    return rows.withColumn("is_active", F.col("active_scan_id") == F.lit(scan_id))


def touch(rows: DataFrame, reused: DataFrame, key: list[str], scan_id: int) -> DataFrame:
    """Unchanged rows are active in the new scan."""
    seen = reused.select(*key).distinct().withColumn("_seen", F.lit(True))
    hit = F.col("_seen").isNotNull()
    return rows.join(seen, key, "left").withColumns({
        "active_scan_id": F.when(hit, F.lit(scan_id)).otherwise(F.col("active_scan_id")), "is_active": hit | F.col("is_active")}).drop("_seen")


def reusable(found: DataFrame, stored: DataFrame, usable: bool = True) -> DataFrame:
    """Found files whose active stored row has the same size and time (nulls are equal)."""
    if not usable:
        return found.limit(0)
    s = stored.where("is_active").select(F.col("path").alias("_p"), F.col("byte_size").alias("_b"), F.col("mtime_ms").alias("_m"))
    same = (F.col("path") == F.col("_p")) & F.col("byte_size").eqNullSafe(F.col("_b")) & F.col("mtime_ms").eqNullSafe(F.col("_m"))
    return found.join(s, same, "left_semi")


def to_analyze(found: DataFrame, stored: DataFrame, usable: bool = True) -> DataFrame:
    return found.join(reusable(found, stored, usable).select("path"), "path", "left_anti")


def clear_family(metadata: DataFrame, pattern: str = "git_%") -> DataFrame:
    return metadata.where(~F.col("key").like(pattern))
