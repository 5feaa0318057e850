"""Time-decayed ownership, compacted to the leading owners and one row of others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.config import DAY, HistoryOptions
from churnscope.functions import history as H

OTHERS, KEPT = "others", 3
DEFAULT = HistoryOptions()


def _placed(accumulators: DataFrame) -> DataFrame:
    """Accumulators with score, total, place ``i`` and ``is_other``, which is null where no score counts."""
    path = Window.partitionBy("path")
    floor = F.least(F.lit(200), F.greatest(F.lit(1), H.ceil_div(F.sum("changed_lines").over(path) * 5, 100)))
    scored = accumulators.withColumns({
        "line_floor": floor, "score": F.col("line_score") * H.sustained_activity_weight(F.col("meaningful_commits"))})
    ordered = path.orderBy(F.desc("score"), "author")
    up_to = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = scored.withColumn("i", F.row_number().over(ordered) - 1).withColumn("running", F.sum("score").over(up_to)).withColumn(
        "total", F.max("running").over(path))
    standing = ((F.col("score") / F.col("total") >= 0.10) | (F.col("i") < 3)) & (
        (F.col("changed_lines") >= F.col("line_floor")) | (F.col("meaningful_commits") >= 3))
    counts = (F.col("score") > 0) & (F.col("total") > 2.220446049250313e-16)
    placed = shares.withColumn("stands", counts & standing).withColumn("place", F.sum(F.when(F.col("stands"), 1).otherwise(0)).over(up_to))
    return placed.withColumn("is_other", F.when(counts, ~(F.col("stands") & (F.col("place") <= KEPT))))


def ownership(accumulators: DataFrame) -> DataFrame:
    """(path, owner_rank, owner, share, score, touches), ranks from 1.

    An owner stands if it has a tenth of the score or is among the first three, and
    enough lines or commits; three stand at most. All others share a last row.
    Totals add scores from the largest on, in a fixed order.
    """
    path = Window.partitionBy("path")
    placed = _placed(accumulators).where("is_other IS NOT NULL")
    rows = placed.groupBy("path", "is_other", F.when(F.col("is_other"), F.lit(None)).otherwise(F.col("author")).alias("author")).agg(
        F.sum("score").alias("score"), F.sum("touches").alias("touches"), F.max("total").alias("total"), F.min("i").alias("i"))
    return rows.select(
        "path", F.row_number().over(path.orderBy("is_other", "i")).alias("owner_rank"),
        F.when(F.col("is_other"), F.lit(OTHERS)).otherwise(F.col("author")).alias("owner"),
        (F.col("score") / F.col("total")).alias("share"), "score", "touches")


def owner_summary(owners: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, owner_count, dominant_owner, dominant_share) for every path of ``paths``.

    The first row dominates, even if it is the others; paths without owners count 0.
    """
    per = owners.groupBy("path").agg(
        F.sum(F.when(F.col("owner") != OTHERS, 1).otherwise(0)).alias("owner_count"),
        F.min_by(F.struct("owner", "share"), "owner_rank").alias("first"))
    return paths.select("path").distinct().join(per, "path", "left").select(
        "path", F.coalesce("owner_count", F.lit(0)).cast("long").alias("owner_count"),
        F.col("first.owner").alias("dominant_owner"), F.col("first.share").alias("dominant_share"))


def file_histories(touches: DataFrame, head: DataFrame, options: HistoryOptions = DEFAULT) -> DataFrame:
    """Per path: what ``churn`` has, author_count, and ``owners`` as ``ownership`` ranks them.

    The touches are hashed by path once; accumulators, places and sums follow in the same
    tasks. ``owners`` has at most four structs (author, is_other, share, score, touches).
    """
    lines, recent = F.col("added") + F.col("deleted"), F.col("ts") >= F.col("head_ts") - options.recent_days * DAY
    total = lambda c, test=None: F.sum(F.col(c) if test is None else F.when(test, F.col(c)).otherwise(0))
    rows = touches.where("ts IS NOT NULL").drop("peers").repartition("path").join(F.broadcast(head))
    accumulators = rows.groupBy("path", "author").agg(
        F.count("*").alias("touches"), F.sum(F.when(lines > 0, 1).otherwise(0)).alias("meaningful_commits"), F.sum(lines).alias("changed_lines"),
        F.sum(lines * (H.bulk_weight(F.col("breadth")) * F.col("recency"))).alias("line_score"), total("added").alias("total_added"), total("deleted").alias("total_deleted"),
        total("added", recent).alias("recent_added"), total("deleted", recent).alias("recent_deleted"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    sums = ("total_added", "total_deleted", "recent_added", "recent_deleted")
    kept = _placed(accumulators).groupBy("path", "is_other", F.when(~F.col("is_other"), F.col("author")).alias("author")).agg(
        F.sum("score").alias("score"), F.sum("touches").alias("touches"), F.max("total").alias("total"), F.min("i").alias("i"), F.count("*").alias("authors"),
        *[F.sum(c).alias(c) for c in sums], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    owner = F.when(F.col("is_other").isNotNull(), F.struct("is_other", "i", "author", (F.col("score") / F.col("total")).alias("share"), "score", "touches"))
    return kept.groupBy("path").agg(
        F.sum("touches").alias("commits"), *[F.sum(c).alias(c) for c in sums], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.sum("authors").alias("author_count"), F.array_sort(F.collect_list(owner)).alias("owners")).withColumns({
            "total_churn": F.col("total_added") + F.col("total_deleted"), "recent_churn": F.col("recent_added") + F.col("recent_deleted")})
