"""Change history: from exported log text or a local repository to change rows.

A record starts with 0x1E and a header of commit, parents, author and committer
time, split by 0x1F; lines of counts and paths follow. Records are parsed by column
expressions; only rename resolution, an ordered fold over the few rename rows, runs
as one small Python step.
"""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from churnscope.config import DAY, HistoryOptions
from churnscope.functions.history import parse_count
from churnscope.functions.paths import rename_sides

RECORD, FIELD = "\x1e", "\x1f"
LOG_FORMAT = "%x1e%H%x1f%P%x1f%an <%ae>%x1f%ct"


def log_command(head_ts: int | None, options: HistoryOptions, since_commit: str | None = None) -> list[str]:
    """The git arguments of a first-parent read, oldest first; a range read has no bounds."""
    args = ["-c", "core.quotePath=false", "log", "--reverse", f"--format={LOG_FORMAT}", "--numstat", "--no-ext-diff", "--first-parent", "--root",
            "--find-renames" if options.find_renames else "--no-renames"]
    if since_commit:
        return [*args, f"{since_commit}..HEAD"]
    if options.max_commits is not None:
        args.append(f"-n{options.max_commits}")
    if options.max_age_days is not None and head_ts is not None:
        args.append(f"--since=@{head_ts - options.max_age_days * DAY}")
    return args


def git(repo: str, *args: str, check: bool = True) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, errors="replace")
    if check and done.returncode:
        raise GitError(classify_error(done.stderr), done.stderr.strip())
    return done.stdout


class GitError(RuntimeError):
    def __init__(self, code: str, message: str):
        super().__init__(message or code)
        self.code = code


def classify_error(stderr: str) -> str:
    text = stderr.lower()
    for mark, code in (("not a git repository", "not_git"), ("does not have any commits", "no_head"), ("unknown revision", "no_head"), ("bad revision", "no_head"),
                       ("needed a single revision", "no_head"), ("dubious ownership", "unsafe_repository")):
        if mark in text:
            return code
    return "git_failed"


@dataclass(frozen=True)
class GitPlan:
    """What a scan knows before it reads: head, and counts under the bounds."""

    head: str
    head_ts: int
    shallow: bool
    first_parent: int
    reachable: int
    merges: int


def plan(repo: str, options: HistoryOptions) -> GitPlan:
    """Raises GitError with code not_git or no_head."""
    git(repo, "rev-parse", "--is-inside-work-tree")
    head, ts = git(repo, "rev-parse", "--verify", "HEAD").strip(), int(git(repo, "show", "-s", "--format=%ct", "HEAD"))
    since = [f"--since=@{ts - options.max_age_days * DAY}"] if options.max_age_days is not None else []

    def n(*args: str) -> int:
        found = int(git(repo, "rev-list", "--count", *since, *args, "HEAD"))
        return found if options.max_commits is None else min(found, options.max_commits)

    return GitPlan(head, ts, git(repo, "rev-parse", "--is-shallow-repository").strip() == "true", n("--first-parent"), n(), n("--merges"))


def is_ancestor(repo: str, old: str, new: str = "HEAD") -> bool:
    done = subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", old, new], capture_output=True, text=True)
    if done.returncode in (0, 1):
        return done.returncode == 0
    raise GitError(classify_error(done.stderr), done.stderr.strip())


def commit_chunks(ids: list[str], size: int) -> list[list[str]]:
    size = max(size, 1)
    return [ids[i : i + size] for i in range(0, len(ids), size)]


class GitLogSource(DataSource):
    """``spark.read.format("git_log").option("path", repo)``: rows (seq, record).

    Options: path, args (tab-separated git arguments), or ids (comma-separated
    commits, read by chunks of ``chunk`` in parallel).
    """

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "seq long, record string"

    def reader(self, schema) -> "GitLogReader":
        return GitLogReader(dict(self.options))


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        ids = [i for i in self.options.get("ids", "").split(",") if i]
        if "ids" not in self.options:
            return [InputPartition((0, None))]
        size = int(self.options.get("chunk", "512"))
        return [InputPartition((k * max(size, 1), part)) for k, part in enumerate(commit_chunks(ids, size))] or [InputPartition((0, []))]

    def read(self, partition):
        first, ids = partition.value
        if ids is not None and not ids:
            return
        args = self.options["args"].split("\t") if ids is None else ["-c", "core.quotePath=false", "show", f"--format={LOG_FORMAT}", "--numstat", "--no-ext-diff", "--stdin"]
        with subprocess.Popen(["git", "-C", self.options["path"], *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, errors="replace") as run:
            if ids:
                run.stdin.write("\n".join(ids) + "\n")
            run.stdin.close()
            pending, n = [], first
            for line in run.stdout:  # one record in memory at a time
                if line.startswith(RECORD) and pending:
                    yield (n, "".join(pending))
                    pending, n = [], n + 1
                pending.append(line)
            if pending:
                yield (n, "".join(pending))


def read_repository(spark: SparkSession, repo: str, args: list[str]) -> DataFrame:
    spark.dataSource.register(GitLogSource)
    return spark.read.format("git_log").option("path", repo).option("args", "\t".join(args)).load()


def parse_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, changes) from rows (seq, record); records without a valid time are dropped whole."""
    body = F.regexp_replace("record", f"^{RECORD}", "")
    lines = F.split(body, "\r?\n", -1)
    head = F.split(F.get(lines, F.lit(0)), FIELD, -1)
    field = lambda i: F.get(head, F.lit(i))
    parsed = records.select(
        F.col("seq").alias("commit_seq"), F.trim(field(0)).alias("commit_id"), F.size(F.filter(F.split(field(1), " "), lambda x: x != "")).alias("parent_count"),
        field(2).alias("author"), F.trim(field(3)).try_cast("bigint").alias("ts"), lines.alias("lines")).where("ts IS NOT NULL AND commit_id <> ''")
    cells = F.transform(F.col("lines"), lambda x: F.split(x, "\t", 3))
    rows = parsed.select("commit_seq", "commit_id", F.explode(F.filter(cells, lambda c: F.size(c) >= 3)).alias("c"))
    changes = rows.select(
        "commit_seq", "commit_id", parse_count(F.get("c", F.lit(0))).alias("added"), parse_count(F.get("c", F.lit(1))).alias("deleted"),
        rename_sides(F.trim(F.get("c", F.lit(2)))).alias("p")).select("commit_seq", "commit_id", "added", "deleted", "p.old_path", "p.path").where("path IS NOT NULL")
    return parsed.drop("lines"), changes


def alias_map(renames: list[tuple[str, str]]) -> dict[str, str]:
    """Where each old path ends, from renames in order of commit and path.

    A new rename of a path that others end on moves them along; the map holds for
    the whole history, so a file made later at an old name counts as the renamed one.
    """
    ends: dict[str, str] = {}
    ending: dict[str, set[str]] = {}  # what ends where
    for old, new in renames:
        target, seen = new, set()
        while ends.get(target, target) != target and target not in seen:
            seen.add(target)
            target = ends[target]
        moved = ending.pop(old, set()) | {old}
        if old in ends:
            ending.get(ends[old], set()).discard(old)
        ends.update(dict.fromkeys(moved, target))
        ending.setdefault(target, set()).update(moved)
    return ends


def apply_renames(changes: DataFrame) -> DataFrame:
    """``changes`` with renamed paths moved to where they end.

    The fold needs all renames in order in one group; there are few beside the change
    rows, which stay distributed and meet the resulting map in a join.
    """
    renames = changes.where("old_path IS NOT NULL AND old_path <> path").select("commit_seq", "path", "old_path")

    @F.pandas_udf("array<struct<path:string,final_path:string>>")
    def fold(rows):
        import pandas as pd

        return pd.Series([[{"path": a, "final_path": b} for a, b in alias_map([(r["old_path"], r["path"]) for r in items]).items()] for items in rows])

    ordered = renames.agg(F.array_sort(F.collect_list(F.struct("commit_seq", "path", "old_path"))).alias("r"))
    ends = ordered.select(F.inline(fold("r")))
    return changes.join(ends, "path", "left").withColumn("path", F.coalesce("final_path", "path")).drop("final_path", "old_path")
