"""From change rows to per-file, per-author and per-commit aggregates.

Inputs: commits (commit_id, author, ts), changes (commit_id, path, added, deleted),
head (one row: head_ts). Changes that ``touched`` has widened need no further joins.
All results are lazy; partial aggregation is Catalyst's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.config import DAY, HistoryOptions
from churnscope.functions import history as H

DEFAULT = HistoryOptions()


def collapse(raw: DataFrame) -> DataFrame:
    """One row per commit and path, counts summed."""
    return raw.groupBy("commit_id", "path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def bounded_counts(commits: DataFrame, head: DataFrame, options: HistoryOptions = DEFAULT) -> DataFrame:
    """Commits within the age bound, and those that the count bound lets through."""
    aged = commits.join(F.broadcast(head)).where(
        F.lit(True) if options.max_age_days is None else F.col("ts") >= F.col("head_ts") - options.max_age_days * DAY)
    n = F.count("*")
    return aged.agg(n.alias("commits_in_age"), (n if options.max_commits is None else F.least(n, F.lit(options.max_commits))).cast("long").alias("commits_read"))


def breadth(changes: DataFrame) -> DataFrame:
    """(commit_id, breadth): files per commit of collapsed changes."""
    return changes.groupBy("commit_id").agg(F.count("*").alias("breadth"))


def touched(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Collapsed changes with author, time and breadth of their commits: what all history aggregates start from."""
    return changes.join(commits.select("commit_id", "author", "ts").join(breadth(changes), "commit_id"), "commit_id")


def _with_breadth(changes: DataFrame) -> DataFrame:
    return changes if "breadth" in changes.columns else changes.join(breadth(changes), "commit_id")


def breadth_summary(changes: DataFrame, commits: DataFrame, options: HistoryOptions = DEFAULT) -> DataFrame:
    """One row: commits, file changes, pairs, broad commits, widest commit (earliest at ties)."""
    b, limit = F.col("breadth"), options.cochange_max_files
    wide = commits.select("commit_id", "ts").join(breadth(changes), "commit_id", "left").withColumn("breadth", F.coalesce("breadth", F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return wide.agg(
        F.count("*").alias("commits"), zero(F.sum(b)).alias("file_changes"),
        zero(F.sum(F.when(b <= limit, (b * (b - 1) / 2).cast("long")))).alias("cochange_pairs"),
        zero(F.sum(F.when(b > limit, 1))).alias("broad_commits"), zero(F.max(b)).alias("max_files"),
        F.min_by("commit_id", F.struct(-b, F.col("ts"), F.col("commit_id"))).alias("broadest_commit"))


def chunk_rollup(chunks: DataFrame) -> DataFrame:
    """One row over all reads of the history: broad commits, the most files in a commit, and that commit (the smaller id at ties)."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    named = F.when(F.col("broadest_commit").isNotNull(), F.struct(-F.col("max_files"), F.col("broadest_commit")))
    return chunks.agg(zero(F.sum("broad_commits")).alias("broad_commits"), zero(F.max("max_files")).alias("max_files"),
                      F.min_by("broadest_commit", named).alias("broadest_commit"))


def planned_records(metrics: DataFrame, accumulators: DataFrame, analysis: DataFrame, summaries: int = 1, chunks: int = 1) -> DataFrame:
    """One row: records that the end of a scan will write, of the history and of active files."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    owned = accumulators.where("changed_lines > 0").select("path").distinct()
    row = count(metrics, "metrics").join(F.broadcast(count(owned, "owned"))).join(F.broadcast(count(analysis.where("is_active"), "materialized_file_records")))
    return row.select((F.col("metrics") + F.col("owned") + summaries + chunks).alias("git_final_records"), "materialized_file_records")


def with_commits(changes: DataFrame, commits: DataFrame, head: DataFrame) -> DataFrame:
    known = changes if "ts" in changes.columns else changes.join(commits, "commit_id")
    return known.join(F.broadcast(head))


def churn(changes: DataFrame, commits: DataFrame, head: DataFrame, options: HistoryOptions = DEFAULT) -> DataFrame:
    """Per path: commits, lines in all and in the recent window (its edge included), first and last touch."""
    recent = F.col("ts") >= F.col("head_ts") - options.recent_days * DAY
    total = lambda c, test=None: F.sum(F.col(c) if test is None else F.when(test, F.col(c)).otherwise(0))
    return with_commits(changes, commits, head).groupBy("path").agg(
        F.count("*").alias("commits"), total("added").alias("total_added"), total("deleted").alias("total_deleted"),
        total("added", recent).alias("recent_added"), total("deleted", recent).alias("recent_deleted"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    ).withColumns({"total_churn": F.col("total_added") + F.col("total_deleted"), "recent_churn": F.col("recent_added") + F.col("recent_deleted")})


def author_accumulators(changes: DataFrame, commits: DataFrame, head: DataFrame, options: HistoryOptions = DEFAULT) -> DataFrame:
    """Per path and author: touches, commits that change lines, lines, weighted lines."""
    lines = F.col("added") + F.col("deleted")
    weight = H.bulk_weight(F.col("breadth")) * F.col("recency")
    rows = with_commits(_with_breadth(changes), commits, head).withColumn("recency", H.recency_weight(F.col("head_ts"), F.col("ts"), options.half_life_days))
    return rows.groupBy("path", "author").agg(
        F.count("*").alias("touches"), F.sum(F.when(lines > 0, 1).otherwise(0)).alias("meaningful_commits"),
        F.sum(lines).alias("changed_lines"), F.sum(lines * weight).alias("line_score"))


def cochange_pairs(changes: DataFrame, options: HistoryOptions = DEFAULT) -> DataFrame:
    """(left_path, right_path, pair_count) of paths changed together, left < right.

    Wide commits are left out before the self-join, so a commit gives at most
    limit * (limit - 1) / 2 pairs. Both sides are hashed by commit once.
    """
    narrow = _with_breadth(changes).where(F.col("breadth").between(2, options.cochange_max_files)).select("commit_id", "path")
    left, right = narrow.withColumnRenamed("path", "left_path"), narrow.withColumnRenamed("path", "right_path")
    return left.join(right, "commit_id").where("left_path < right_path").groupBy("left_path", "right_path").agg(F.count("*").alias("pair_count"))


def touches(changes: DataFrame, commits: DataFrame, head: DataFrame, options: HistoryOptions = DEFAULT) -> DataFrame:
    """All that histories of files need, once: (path, author, ts, recency, breadth, added, deleted, peers).

    ``changes`` are collapsed and hashed by commit, so nothing but commits is shuffled.
    ``peers`` lists the files of a commit of 2 to ``cochange_max_files`` files, on the row
    of its first file. Changes of unknown commits only have a path and peers.
    """
    commit = Window.partitionBy("commit_id")
    few = F.col("breadth").between(2, options.cochange_max_files)
    wide = changes.withColumn("breadth", F.count("*").over(commit)).withColumns({
        "peers": F.collect_list(F.when(few, F.col("path"))).over(commit), "_first": F.min("path").over(commit)})
    of = commits.select("commit_id", "author", "ts").join(F.broadcast(head)).withColumn("recency", H.recency_weight(F.col("head_ts"), F.col("ts"), options.half_life_days))
    return wide.join(of.drop("head_ts"), "commit_id", "left").select(
        "path", "author", "ts", "recency", "breadth", "added", "deleted", F.when(few & (F.col("path") == F.col("_first")), F.col("peers")).alias("peers"))


def commit_files(changes: DataFrame, options: HistoryOptions = DEFAULT) -> DataFrame:
    """(peers): the files of each commit of 2 to ``cochange_max_files`` files."""
    narrow = changes.withColumn("breadth", F.count("*").over(Window.partitionBy("commit_id"))).where(F.col("breadth").between(2, options.cochange_max_files))
    return narrow.groupBy("commit_id").agg(F.collect_list("path").alias("peers")).select("peers")


def partner_rows(lists: DataFrame) -> DataFrame:
    """(path, partner, pair_count), both directions of all pairs, from ``peers`` of commits; hashed by path.

    Each file gets its commits' lists, which are bounded, and counts their members; so
    pairs are shuffled as lists and never one by one.
    """
    sets = lists.where("peers IS NOT NULL").select(F.explode("peers").alias("path"), "peers").repartition("path")
    return sets.select("path", F.explode("peers").alias("partner")).where("path <> partner").groupBy("path", "partner").agg(F.count("*").alias("pair_count"))


def first_partners(rows: DataFrame, n: int = 10) -> DataFrame:
    """(path, partner, pair_count, n): the ``n`` leading partners of each path, with their place."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("pair_count"), "partner"))).where(F.col("n") <= n)


def partners(pairs: DataFrame) -> DataFrame:
    """Both directions of the pairs, from one pass over them: (path, partner, pair_count)."""
    way = lambda a, b: F.struct(F.col(a).alias("path"), F.col(b).alias("partner"), F.col("pair_count").alias("pair_count"))
    return pairs.select(F.inline(F.array(way("left_path", "right_path"), way("right_path", "left_path"))))


def partner_counts(pairs: DataFrame) -> DataFrame:
    """Partners per path; pairs are unique, so counting rows saves a distinct shuffle."""
    return partners(pairs).groupBy("path").agg(F.count("*").alias("co_changed_files"))


def repository_summary(commits: DataFrame, head: DataFrame) -> DataFrame:
    """One row: authors, age in days (null without commits), first, last and head times."""
    one = commits.agg(F.countDistinct("author").alias("author_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("indexed_commits"))
    status = F.when(F.col("indexed_commits") > 0, "available").otherwise("unavailable")
    return one.join(F.broadcast(head), F.lit(True), "left").select(
        "author_count", H.age_days(F.col("head_ts"), F.col("first_ts")).alias("age_days"), "first_ts", "last_ts", "indexed_commits", status.alias("status"))


def automated_authors(commits: DataFrame) -> DataFrame:
    return commits.select("author").distinct().agg(F.coalesce(F.sum(F.when(H.looks_automated(F.col("author")), 1)), F.lit(0)).cast("long").alias("automated_authors"))


# Texts of warnings.
CONCENTRATION_WARNING = (
    "one author accounts for at least 80 percent of Git file touches; ownership may be distorted by bulk or automated changes")
BROAD_WARNING = "commits over the co-change file limit skipped co-change pair generation but still counted churn and ownership"


def top_author_share(accumulators: DataFrame) -> DataFrame:
    """One row: rounded percent of touches by the busiest author, and a warning from 80 on."""
    by_author = accumulators.groupBy("author").agg(F.sum("touches").alias("touches"))
    share = F.try_divide(F.lit(100.0) * F.max("touches"), F.sum("touches"))
    return by_author.agg(share.alias("share")).select(
        F.coalesce(F.round("share"), F.lit(0.0)).alias("top_share_percent"),
        F.when(F.col("share") >= 80, F.lit(CONCENTRATION_WARNING)).alias("warning"))


def metrics(churned: DataFrame, pairs: DataFrame, accumulators: DataFrame, head: DataFrame) -> DataFrame:
    """Churn with author count, age and partner count (0 without partners)."""
    authors = accumulators.groupBy("path").agg(F.count("*").alias("author_count"))  # one row per path and author
    return churned.join(authors, "path", "left").join(partner_counts(pairs), "path", "left").join(F.broadcast(head), F.lit(True), "left").withColumns({
        "co_changed_files": F.coalesce("co_changed_files", F.lit(0).cast("long")),
        "file_age_days": H.age_days(F.col("head_ts"), F.col("first_ts"))}).drop("head_ts")
