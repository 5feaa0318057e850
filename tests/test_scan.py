import os
import shutil
import subprocess

import pytest

from churnscope import cli
from churnscope.operators import snapshots as N
from churnscope.plans import documents
from churnscope.plans.scan import Scan
from churnscope.sources import git_log, walk
from churnscope.sources.store import IndexIncomplete, IndexLocked, Store
from churnscope.streaming import events as E
from churnscope.streaming.ingest import merge_into

needs_git = pytest.mark.skipif(shutil.which("git") is None, reason="git is not installed")


def put(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def commit(root, message, day):
    env = os.environ | {"GIT_AUTHOR_DATE": f"2025-01-{day:02}T00:00:00Z", "GIT_COMMITTER_DATE": f"2025-01-{day:02}T00:00:00Z", "GIT_CONFIG_GLOBAL": "/dev/null"}
    for args in (["add", "-A"], ["-c", "user.name=Dev", "-c", "user.email=dev@example.invalid", "commit", "-qm", message]):
        subprocess.run(["git", "-C", root, *args], check=True, env=env)


def test_walk_obeys_ignore_files(tmp_path):
    root = str(tmp_path)
    for p in ("a.go", ".hidden", "build/x.go", "sub/keep.log", "sub/drop.log", "sub/deep/t.tmp", ".git/config", "x/.git/config", f"{walk.INDEX_DIR}/t"):
        put(root, p, "x")
    put(root, ".gitignore", "build/\n*.log\n!keep.log\n/sub/deep/*.tmp\n")
    assert [p for _, p, _, _ in walk.walk(root)] == [".gitignore", ".hidden", "a.go", "sub/keep.log"]


@needs_git
def test_scan_twice_then_advance(spark, tmp_path, monkeypatch, capsys):
    root = str(tmp_path)
    subprocess.run(["git", "init", "-q", root], check=True)
    put(root, "go.mod", "module app\n")
    put(root, ".gitignore", walk.INDEX_DIR + "\n")
    put(root, "svc/a.go", 'package svc\n\nfunc A(x bool) int {\n\tif x && x {\n\t\treturn 1\n\t}\n\treturn 0\n}\n')
    put(root, "main.go", 'package main\n\nimport "app/svc"\n\nfunc main() { svc.A(true) }\n')
    commit(root, "one", 1)
    first = Scan(spark, root).run()
    assert first["scan"]["type"] == "full" and first["scan"]["commits_processed"] == 1
    assert {h["path"] for h in first["top_hotspots"]} == {"svc/a.go", "main.go"}
    again = Scan(spark, root).run()
    assert again["scan"]["commits_processed"] == 0 and again["scan"]["git_history"] == "incremental"
    put(root, "svc/a.go", "package svc\n\nfunc A(x bool) int { return 2 }\n")
    commit(root, "two", 2)
    third = Scan(spark, root).run()
    assert third["scan"]["commits_processed"] == 1 and third["scan"]["type"] == "incremental"
    facts = {r.path: r for r in Scan(spark, root).store.read("facts").collect()}
    assert facts["svc/a.go"].commits == 2 and facts["svc/a.go"].coupling_in == 1 and facts["main.go"].coupling_out == 1
    monkeypatch.chdir(os.path.join(root, "svc"))
    assert cli.main(["explain", "a.go"], spark) == 0 and "Owners" in capsys.readouterr().out
    assert cli.main(["hotspots", "--json", "--all"], spark) == 0 and '"command":"hotspots"' in capsys.readouterr().out
    assert cli.main(["explain", "/etc/passwd"], spark) == 1
    ids = subprocess.run(["git", "-C", root, "rev-list", "--reverse", "HEAD"], capture_output=True, text=True).stdout.split()
    spark.dataSource.register(git_log.GitLogSource)
    shown = spark.read.format("git_log").option("path", root).option("ids", ",".join(ids)).option("chunk", "1").load()
    assert git_log.parse_records(shown)[0].count() == 2
    assert git_log.is_ancestor(root, ids[0]) and git_log.commit_chunks([1, 2, 3], 0) == [[1], [2], [3]]


@needs_git
def test_a_scan_that_ends_between_tables_is_made_good(spark, tmp_path, monkeypatch, capsys):
    root, other = str(tmp_path / "a"), str(tmp_path / "b")
    subprocess.run(["git", "init", "-q", root], check=True)
    put(root, ".gitignore", walk.INDEX_DIR + "\n")
    for day in (1, 2):
        put(root, "a.go", f"package a\n\nvar X = {day}\n")
        put(root, "b.go", f"package a\n\nvar Y = {day}\n")
        commit(root, f"day {day}", day)
    Scan(spark, root).run()
    put(root, "a.go", "package a\n\nvar X = 3\n")
    commit(root, "day 3", 3)
    whole, written = Store.write, []

    def breaks(self, table, rows, epoch=-1):
        if table == "pairs":  # churn and accumulators have been merged
            raise OSError("lost")
        written.append(table)
        whole(self, table, rows, epoch)

    monkeypatch.setattr(Store, "write", breaks)
    with pytest.raises(OSError):
        Scan(spark, root).run()
    monkeypatch.setattr(Store, "write", whole)
    assert "churn" in written and "accumulators" in written and Scan(spark, root).state()["last_scan_completed"] == "0"
    monkeypatch.chdir(root)
    assert cli.main(["hotspots"], spark) == 1 and "run a scan first" in capsys.readouterr().err
    again = Scan(spark, root).run()
    assert again["scan"]["type"] == "full" and Scan(spark, root).state()["last_scan_completed"] == "1"
    shutil.copytree(root, other, ignore=shutil.ignore_patterns(walk.INDEX_DIR))
    Scan(spark, other).run()
    for table in ("churn", "accumulators", "pairs", "history_bounds", "repository_authors"):
        rows = [sorted(map(tuple, Scan(spark, r).store.read(table).collect())) for r in (root, other)]
        assert rows[0] == rows[1] and rows[0], table
    with Scan(spark, root).store.lock("scan"):
        assert cli.main(["hotspots"], spark) == 1 and cli.main(["explain", "a.go"], spark) == 1
    assert capsys.readouterr().err.count("in use") == 2
    # broad commits of earlier reads still count after an incremental one
    put(root, "a.go", "package a\n\nvar X = 4\n")
    commit(root, "day 4", 4)
    Scan(spark, root).run()
    meta = {r.key: r.value for r in Scan(spark, root).store.read("metadata").collect()}
    assert meta["git_max_touched_files_in_commit"] == "3" and meta["git_commits_processed"] == "1" and int(meta["store_planned_records"]) > 0


def test_a_pointer_appears_whole(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    for n in (1, 2, 3, 4):
        store.write("t", spark.createDataFrame([(n,)], "n int"))
    (tmp_path / "t" / "new-left-by-a-crash").write_text("")
    shutil.copytree(tmp_path / "t" / "v4", tmp_path / "t" / "v5")  # written, but never pointed to
    assert store.read("t").first().n == 4 and store.version("t") == 4
    store.write("t", spark.createDataFrame([(5,)], "n int"))
    assert [r.n for r in store.read("t").collect()] == [5]
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name[0] in "pv") == ["pointer-5.json", "v4", "v5"]


def test_merge_heavy_causes():
    from churnscope.plans import scan

    assert scan.merge_warning(4, 4, 3) == scan.MERGES_WARNING and scan.merge_warning(10, 13, 2) == scan.REACHABLE_WARNING
    assert scan.merge_warning(13, 13, 3) is None and scan.merge_warning(3, 3, 3) is None and scan.merge_warning(100, 124, 0) is None


def test_scan_without_history(spark, tmp_path):
    put(str(tmp_path), "a.go", "package a\n")
    d = Scan(spark, str(tmp_path)).run()
    assert d["scan"]["git_history"] == "absent" and not d["assessment"]["is_reliable"]
    assert any(x["code"] == "git" for x in d["limitations"]) and "Top Hotspots" in documents.scan_text(d)


def test_lock_and_missing_index(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    with store.lock("a"), pytest.raises(IndexLocked):
        store.lock("b").__enter__()
    with store.lock("c"):
        pass
    with pytest.raises(IndexIncomplete):
        store.require_complete()


def test_snapshots(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(N.upsert_replace(old, new, ["k"])) == [("a", 1), ("b", 3), ("c", 4)]
    assert rows(N.upsert_accumulate(old, new, ["k"], sums=["v"])) == [("a", 1), ("b", 5), ("c", 4)]
    assert rows(N.insert_ignore(old, new, ["k"])) == [("a", 1), ("b", 2), ("c", 4)]
    meta = spark.createDataFrame([("git_mode", "x"), ("files", "1"), ("gitXa", "2")], "key string, value string")
    assert [r.key for r in N.clear_family(meta).collect()] == ["files"]


def event(run, seq, kind, files=None, n=None, m=None, elapsed=None, note=None):
    return (run, seq, kind, files, n, m, elapsed, note)


EVENTS = [
    event("s", 1, "file_found"), event("s", 2, "chunk_done", n=9, m=9, elapsed=50.0), event("r", 1, "scan_started"), event("r", 2, "walk_progress", 3, 7, elapsed=1.0), event("r", 3, "file_found"),
    event("r", 4, "files_counted", 5, elapsed=2.0), event("r", 5, "walk_done", 6, 9, elapsed=3.0), event("r", 6, "history_planning"), event("r", 7, "history_planned", n=10, m=2),
    event("r", 8, "history_status", note="fully_rebuilt"), event("r", 9, "chunk_done", n=4, m=8, elapsed=6.0), event("r", 10, "chunk_failed", elapsed=9.0), event("r", 11, "odd"),
    event("s", 3, "scan_started"), event("s", 4, "history_status", note="reused"), event("s", 5, "history_planned", n=0, m=0), event("s", 6, "history_skipped"), event("s", 7, "history_done", n=3, elapsed=1.5),
    event("r", 12, "file_analyzed", 4, elapsed=4.0), event("r", 13, "history_done", n=7, elapsed=7.0), event("r", 14, "records_planned", n=5), event("r", 15, "batch_stored", n=8, elapsed=8.0),
    event("r", 16, "store_done", n=12, elapsed=8.5), event("r", 17, "scan_done", 6, 7, 6, elapsed=9.5)]


def test_event_fold_batch_equals_stream(spark, tmp_path):
    assert len(E.KINDS) == 17
    batch = {r.run: r.asDict() for r in E.fold_batch(spark.createDataFrame(EVENTS, E.EVENTS)).collect()}
    r, s = batch["r"], batch["s"]
    assert (r["files_found"], r["entries_walked"], r["files_total"], r["files_analyzed"], r["records_planned"], r["records_stored"]) == (6, 9, 6, 6, 12, 12)
    assert (r["commits_processed"], r["commits_total"], r["chunks_total"], r["file_changes"]) == (7, 7, 2, 8)
    assert (r["walk_time"], r["analysis_time"], r["history_time"], r["store_time"], r["total_time"]) == (3.0, 4.0, 9.0, 8.5, 9.5)
    assert r["done"] and r["store_done"] and r["history_done"] and not r["history_skipped"] and (r["last_seq"], r["restarts"]) == (17, 1)
    # a new start forgets; a reused index keeps its total and is not skipped
    assert (s["files_found"], s["commits_processed"], s["commits_total"], s["total_time"], s["history_skipped"], s["history_done"], s["restarts"]) == (0, 3, 0, 1.5, False, True, 1)
    for k, part in enumerate((EVENTS[:7], EVENTS[7:])):
        spark.createDataFrame(part, E.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    told = {}
    stream = E.fold_stream(spark.readStream.schema(E.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*")))
    run = stream.writeStream.outputMode("update").foreachBatch(E.observed(lambda row: told.update({row["run"]: row}))).option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert told == batch
    assert E.fold_batch(spark.createDataFrame([], E.EVENTS)).count() == 0


def test_micro_batches_merge_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    add = merge_into(store, "churn", ["path"], sums=["n"], lows=["t"])
    one = spark.createDataFrame([("a", 1, 5)], "path string, n long, t long")
    add(one, 0)
    add(one, 0)  # run again after a failure
    add(spark.createDataFrame([("a", 2, 3)], "path string, n long, t long"), 1)
    assert [tuple(r) for r in store.read("churn").collect()] == [("a", 3, 3)]
