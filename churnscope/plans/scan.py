"""One scan of a repository: sources, merge with the stored index, finalization, tables.

Only the walk and the git processes run beside Spark; everything between is lazy
and ends in one write per table.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.config import DAY, ScanOptions
from churnscope.functions import paths as P
from churnscope.functions import text as X
from churnscope.operators import changes as C
from churnscope.operators import coupling as K
from churnscope.operators import ownership as O
from churnscope.operators import risk as R
from churnscope.operators import snapshots as N
from churnscope.plans import documents
from churnscope.scratch import with_rank
from churnscope.sources import git_log, walk
from churnscope.sources.parsers import parsed
from churnscope.sources.store import Store

CHURN_SUMS = ("commits", "total_added", "total_deleted", "recent_added", "recent_deleted", "total_churn", "recent_churn")
ACC_SUMS = ("touches", "meaningful_commits", "changed_lines", "line_score")
HISTORY = ("churn", "accumulators", "pairs", "repository_authors", "history_bounds", "chunks")
# Why first-parent history may fall short.
MERGES_WARNING = "many first-parent commits are merges; Git metrics may undercount side-branch work"
REACHABLE_WARNING = "all reachable history is much larger than first-parent history; Git metrics may undercount side-branch work"


def merge_warning(first_parent: int, reachable: int, merges: int) -> str | None:
    """The first cause that holds; None if first-parent history tells enough."""
    if first_parent >= 4 and merges >= 3 and 4 * merges >= first_parent:
        return MERGES_WARNING
    if reachable >= first_parent + 3 and 4 * reachable >= 5 * max(first_parent, 1):
        return REACHABLE_WARNING
    return None


def decide(state: dict[str, str], plan: "git_log.GitPlan | git_log.GitError", signature: str, is_ancestor) -> tuple[str, str]:
    """(mode, index action) of the history read."""
    if isinstance(plan, git_log.GitError):
        return ("skipped_not_git", "cleared_not_git") if plan.code == "not_git" else ("skipped_error", "cleared_error")
    if plan.shallow:
        return "skipped_shallow", "cleared_shallow"
    if state.get("last_scan_completed") != "1" or "last_indexed_head" not in state:
        return "full", "fully_rebuilt"
    if state.get("git_options_signature") != signature:
        return "full", "cleared_options_changed"
    if state["last_indexed_head"] == plan.head:
        return "up_to_date", "reused"
    try:
        return ("incremental", "incrementally_updated") if is_ancestor(state["last_indexed_head"]) else ("fallback_full", "fully_rebuilt")
    except git_log.GitError:
        return "fallback_full", "fully_rebuilt"


def pairs_table(spark: SparkSession, values: dict[str, object]) -> DataFrame:
    """key/value rows; warnings and messages must not be blank."""
    for k, v in values.items():
        if k.endswith(("_warning", "_diagnostic_message")) and not str(v).strip():
            raise ValueError(f"metadata {k} is blank")
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")


class Scan:
    def __init__(self, spark: SparkSession, root: str, options: ScanOptions = ScanOptions()):
        self.spark, self.root, self.o = spark, os.path.realpath(root), options
        self.store = Store(spark, "file://" + os.path.join(self.root, walk.INDEX_DIR))

    def state(self) -> dict[str, str]:
        return {r.key: r.value for r in self.store.read("scan_state").collect()} if self.store.exists("scan_state") else {}

    def run(self, full: bool = False) -> dict:
        """Scan, write all tables, and return the summary document.

        The stored state says that a scan has begun before any table changes, and that it
        is complete after the last one. So a scan that ended in between, perhaps with some
        increments merged and others not, is followed by a full read of the history.
        """
        os.makedirs(os.path.join(self.root, walk.INDEX_DIR), exist_ok=True)
        began = time.time()
        with self.store.lock("scan"):
            state = {} if full else self.state()
            self.store.write("scan_state", pairs_table(self.spark, state | {"last_scan_completed": 0}))
            files, counts = self._files(state)
            meta = self._history(state) | counts
            self._finalize(files, meta)
        return documents.scan_document(self.store, int((time.time() - began) * 1000))

    # files

    def _files(self, state: dict[str, str]) -> tuple[DataFrame, dict]:
        scan_id = int(time.time() * 1000)
        found = walk.files(self.spark, self.root).drop("path").withColumnRenamed("relative_path", "path")
        usable = state.get("last_scan_completed") == "1" and state.get("file_analysis_signature") == self.o.analysis.signature() and self.store.exists("file_analysis")
        stored = self.store.read("file_analysis") if usable else None
        fresh = N.to_analyze(found, stored) if usable else found
        windows = walk.read_windows(fresh.withColumn("path", F.concat(F.lit(self.root + "/"), "path")), self.o.analysis.content_window).withColumn("path", P.relative_path(self.root, F.col("path")))
        kind = X.content_kind(F.col("content"))
        text = F.when((F.col("kind") == "text") & ~F.col("truncated"), F.col("content").cast("string"))
        facts = windows.withColumn("_p", parsed(F.col("path"), F.col("content"), F.col("truncated"))).select("*", "_p.*").drop("_p").withColumn("kind", kind).withColumn("text", text).withColumns({
            "content_kind": F.col("kind"), "line_count": X.line_count(F.col("text")), "extension": P.extension(F.col("path")),
            "is_generated": P.is_generated_path(F.col("path")) | F.coalesce(X.has_generated_marker(F.col("text")), F.lit(False)),
            "is_vendor": P.is_vendor(F.col("path")), "is_test": P.is_test(F.col("path")),
            "active_scan_id": F.lit(scan_id), "is_active": F.lit(True)})
        note = lambda test, code, message: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(message).alias("message")))
        notes = F.array_compact(F.array(
            note(F.col("content").isNull(), "read_failed", "The file could not be read."),
            note((F.col("content_kind") == "unknown") & F.col("content").isNotNull(), "unsupported_encoding", "The file is not valid UTF-8 text."),
            note(F.col("truncated") | (F.col("content_kind") != "text"), "line_count_skipped", "Lines were not counted.")))
        fresh_rows = facts.withColumn("diagnostics", X.diagnostics_json(F.concat(notes, "diagnostics"))).drop("content", "text", "kind")
        rows = fresh_rows
        if usable:
            kept = N.touch(stored, N.reusable(found, stored), ["path"], scan_id)
            rows = N.upsert_replace(kept, fresh_rows, ["path"])
        self.store.write("file_analysis", N.soft_delete(rows, scan_id))
        files = self.store.read("file_analysis")
        n = files.where("is_active").count()
        return files, {"files_detected": n, "files_analyzed": n}

    # history

    def _history(self, state: dict[str, str]) -> dict:
        h = self.o.history
        try:
            plan = git_log.plan(self.root, h)
        except git_log.GitError as e:
            plan = e
        mode, action = decide(state, plan, h.signature(), lambda old: git_log.is_ancestor(self.root, old))
        meta: dict[str, object] = {"git_mode": mode, "git_index_action": action}
        if mode.startswith("skipped"):
            for t in HISTORY:
                self.store.drop(t)
            code = plan.code if isinstance(plan, git_log.GitError) else "shallow"
            return meta | {"git_diagnostic": code, "git_diagnostic_message": f"Git history is not available: {code}", "git_commits_processed": 0, "git_index_status": "unavailable"}
        bounded = h.max_commits is not None or h.max_age_days is not None
        meta |= {
            "git_confidence": "incremental" if mode in ("incremental", "up_to_date") else "bounded" if bounded else "first_parent_only",
            "git_head_timestamp": plan.head_ts, "git_first_parent_commit_count": plan.first_parent, "git_all_reachable_commit_count": plan.reachable,
            "git_merge_commit_count": plan.merges, "git_max_commits": h.max_commits or "unbounded", "git_max_age_days": h.max_age_days or "unbounded",
            "git_cochange_max_files_per_commit": h.cochange_max_files, "git_recent_churn_window_days": h.recent_days,
            "git_ownership_recency_half_life_days": h.half_life_days, "git_renames": "follow" if h.find_renames else "off", "git_first_parent": "true",
            "git_index_head": plan.head, "git_index_status": "available", "git_options_signature": h.signature()}
        if warning := merge_warning(plan.first_parent, plan.reachable, plan.merges):
            meta["git_merge_heavy_warning"] = warning
        meta["git_commits_processed"] = 0
        if mode != "up_to_date":
            meta["git_commits_processed"] = self._read_history(plan, state.get("last_indexed_head") if mode == "incremental" else None)
        meta["git_commits_total"] = plan.first_parent
        return meta

    def _read_history(self, plan: "git_log.GitPlan", since: str | None) -> int:
        h, merge = self.o.history, since is not None
        records = git_log.read_repository(self.spark, self.root, git_log.log_command(plan.head_ts, h, since))
        self.store.write("records", records)
        commits, raw = git_log.parse_records(self.store.read("records"))
        commits = commits.withColumn("ts", F.col("ts"))
        self.store.write("touched", C.touched(C.collapse(git_log.apply_renames(raw)), commits))
        changes = self.store.read("touched")
        head = self.spark.createDataFrame([(plan.head_ts,)], "head_ts long")
        deltas = {
            "churn": (C.churn(changes, commits, head, h), ["path"], CHURN_SUMS, ("first_ts",), ("last_ts",)),
            "accumulators": (C.author_accumulators(changes, commits, head, h), ["path", "author"], ACC_SUMS, (), ()),
            "pairs": (C.cochange_pairs(changes, h), ["left_path", "right_path"], ("pair_count",), (), ()),
            "history_bounds": (commits.agg(F.lit(1).alias("one"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("indexed_commits")),
                               ["one"], ("indexed_commits",), ("first_ts",), ("last_ts",)),
            "repository_authors": (commits.select("author").distinct(), ["author"], (), (), ()),
        }
        for name, (rows, key, sums, lows, highs) in deltas.items():
            if merge and self.store.exists(name):
                old = self.store.read(name)
                rows = N.insert_ignore(old, rows, key) if not (sums or lows or highs) else N.upsert_accumulate(old, rows, key, sums, lows, highs)
            self.store.write(name, rows)
        chunk = C.breadth_summary(changes.drop("author", "ts", "breadth"), commits, h)
        self.store.write("chunks", self.store.read("chunks").unionByName(chunk) if merge and self.store.exists("chunks") else chunk)
        n = commits.count()
        for used in ("records", "touched"):
            self.store.drop(used)
        return n

    # finalization

    def _empty(self, name: str) -> DataFrame:
        schemas = {
            "churn": "path string, " + ", ".join(f"{c} long" for c in (*CHURN_SUMS, "first_ts", "last_ts")),
            "accumulators": "path string, author string, touches long, meaningful_commits long, changed_lines long, line_score double",
            "pairs": "left_path string, right_path string, pair_count long", "repository_authors": "author string",
            "history_bounds": "one int, first_ts long, last_ts long, indexed_commits long"}
        return self.spark.createDataFrame([], schemas[name])

    def _history_table(self, name: str) -> DataFrame:
        return self.store.read(name) if self.store.exists(name) else self._empty(name)

    def _finalize(self, analysis: DataFrame, meta: dict) -> None:
        s, spark = self.store, self.spark
        head_ts = meta.get("git_head_timestamp")
        head = spark.createDataFrame([(head_ts,)], "head_ts long")
        acc, pairs = self._history_table("accumulators"), self._history_table("pairs")
        files = analysis.where("is_active")
        s.write("metrics", C.metrics(self._history_table("churn"), pairs, acc, head))
        s.write("owners", O.ownership(acc))
        packages = K.file_packages(files)
        references = files.where("language = 'go'").select(F.col("path").alias("source_path"), F.posexplode("imports").alias("idx", "raw_target"))
        s.write("references", K.resolve_imports(references, packages, self._module()))
        s.write("edges", K.dependency_edges(s.read("references")))
        s.write("facts", K.file_facts(files, s.read("metrics"), O.owner_summary(s.read("owners"), acc), packages, s.read("edges")))
        facts = s.read("facts")
        bounds = self._history_table("history_bounds").first()
        available = meta["git_index_status"] == "available" and bounds is not None
        age = max((head_ts - bounds["first_ts"]) // DAY, 0) if available and bounds["first_ts"] is not None else None
        authors = self._history_table("repository_authors").count() if available else None
        context = spark.createDataFrame([(age, authors, files.count())], "repository_age_days long, repository_authors long, repository_files long")
        s.write("scores", with_rank(R.file_scores(facts, context), "path", falling=("score",)))
        scores = s.read("scores")
        s.write("terms", R.score_terms(scores))
        s.write("score_facts", R.score_facts(scores))
        s.write("score_limitations", R.score_limitations(scores))
        s.write("package_scores", with_rank(R.package_scores(scores), "package", falling=("score",)))
        s.write("package_terms", R.package_terms(s.read("package_scores")))
        s.write("package_facts", R.package_facts(s.read("package_scores")))
        s.write("project", R.project_score(scores, facts, str(meta["git_index_status"])))
        s.write("project_terms", R.project_terms(s.read("project")))
        if s.exists("chunks"):
            chunk, share = C.chunk_rollup(s.read("chunks")).first(), C.top_author_share(acc).first()
            meta |= {"git_broad_commits_skipped_for_cochange": chunk["broad_commits"], "git_max_touched_files_in_commit": chunk["max_files"],
                     "git_broadest_commit": chunk["broadest_commit"] or "", "git_top_author_touch_share_percent": share["top_share_percent"],
                     "git_likely_automated_author_count": C.automated_authors(self._history_table("repository_authors")).first()[0]}
            if chunk["broad_commits"]:
                meta["git_broad_commit_warning"] = C.BROAD_WARNING
            if share["warning"]:
                meta["git_author_concentration_warning"] = share["warning"]
        project, o = s.read("project").first(), self.o.scoring
        planned = C.planned_records(s.read("metrics"), acc, analysis, int(available), int(s.exists("chunks"))).first()
        meta |= {"store_planned_records": planned["git_final_records"] + planned["materialized_file_records"]}
        meta |= {"file_risk_formula_id": o.file_formula, "package_risk_formula_id": o.package_formula, "project_risk_formula_id": o.project_formula,
                 "project_risk_score": project["score"], "project_risk_band": project["band"], "project_risk_confidence": project["confidence"],
                 "project_risk_scored_file_count": project["scored_files"], "project_risk_active_file_count": project["active_files"]}
        s.write("metadata", pairs_table(spark, meta))
        state = {"schema_version": 1, "file_analysis_signature": self.o.analysis.signature(), "root": self.root, "last_scan_completed": 1}
        if "git_index_head" in meta:
            state |= {"last_indexed_head": meta["git_index_head"], "git_options_signature": meta["git_options_signature"]}
        s.write("scan_state", pairs_table(spark, state))

    def _module(self) -> str | None:
        path = os.path.join(self.root, "go.mod")
        if not os.path.isfile(path):
            return None
        with open(path, encoding="utf-8", errors="replace") as f:
            return next((x.strip()[7:].strip() for x in f if x.strip().startswith("module ") and x.strip()[7:].strip()), None)
