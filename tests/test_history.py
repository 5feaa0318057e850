import math
import random

from pyspark.sql import functions as F

from churnscope.config import DAY, HistoryOptions
from churnscope.functions import history as H
from churnscope.operators import changes as C
from churnscope.operators import coupling as K
from churnscope.operators import ownership as O
from churnscope.sources import git_log

HEAD = 1_700_000_000


def log(*commits):
    """commits: (id, author, ts, [line, ...])"""
    return [(i, f"\x1e{c}\x1fp\x1f{a}\x1f{t}\n\n" + "\n".join(lines) + "\n") for i, (c, a, t, lines) in enumerate(commits)]


def parsed(spark, *commits):
    return git_log.parse_records(spark.createDataFrame(log(*commits), "seq long, record string"))


def head(spark):
    return spark.createDataFrame([(HEAD,)], "head_ts long")


def test_records_binary_and_bad_time(spark):
    commits, changes = parsed(spark, ("a", "A <a>", HEAD, ["3\t1\tsrc/main.rs", "-\t-\tlogo.png"]), ("b", "B <b>", HEAD, ["1\t0\tsrc/main.rs", "2\t2\tREADME"]), ("c", "C", "x", ["9\t9\tlost"]))
    assert commits.count() == 2 and changes.count() == 4
    churn = {r.path: r for r in C.churn(C.collapse(changes), commits, head(spark)).collect()}
    assert churn["src/main.rs"].total_added == 4 and churn["logo.png"].total_churn == 0


def test_recent_window_includes_its_edge(spark):
    commits, changes = parsed(spark, ("a", "A", HEAD - 91 * DAY, ["1\t0\tf"]), ("b", "A", HEAD - 90 * DAY, ["2\t0\tf"]))
    row = C.churn(C.collapse(changes), commits, head(spark)).first()
    assert (row.total_added, row.recent_added) == (3, 2)


def test_breadth_limit_and_pairs(spark):
    commits, changes = parsed(spark, ("a", "A", HEAD, ["1\t0\tc", "1\t0\ta", "1\t0\tb"]), ("b", "A", HEAD, ["1\t0\tz"]))
    flat = C.collapse(changes)
    pairs = sorted((r.left_path, r.right_path) for r in C.cochange_pairs(flat).collect())
    assert pairs == [("a", "b"), ("a", "c"), ("b", "c")]
    narrow = HistoryOptions(cochange_max_files=2)
    one = C.breadth_summary(flat, commits, narrow).first()
    assert C.cochange_pairs(flat, narrow).count() == 0
    assert (one.broad_commits, one.max_files, one.broadest_commit, one.cochange_pairs) == (1, 3, "a", 0)


def test_renames_follow_to_the_last_name(spark):
    _, changes = parsed(spark, ("a", "A", HEAD, ["4\t0\tpkg/old.go"]), ("b", "A", HEAD, ["1\t0\tpkg/{old.go => new.go}"]), ("c", "A", HEAD, ["2\t0\tpkg/new.go"]))
    moved = git_log.apply_renames(changes)
    assert {r.path for r in moved.collect()} == {"pkg/new.go"} and sum(r.added for r in moved.collect()) == 7
    assert git_log.alias_map([("a", "b"), ("b", "c"), ("x", "a")]) == {"a": "c", "b": "c", "x": "c"}
    assert git_log.alias_map([("a", "b"), ("b", "a")])["b"] == "b"


def test_rename_forms(spark):
    rows = spark.createDataFrame([("a/{ => b}/f",), ("a/{b => }/f",), ("x => y",), ("plain",), ("p{q => r}s",)], "raw string")
    from churnscope.functions.paths import rename_sides

    got = [tuple(r.x) for r in rows.select(rename_sides(rows.raw).alias("x")).collect()]
    assert got == [("a/f", "a/b/f"), ("a/b/f", "a/f"), ("x", "y"), (None, "plain"), ("pqs", "prs")]


def test_bulk_commits_count_less(spark):
    commits, changes = parsed(spark, ("a", "A", HEAD, [f"10\t0\tf{i}" for i in range(25)]))
    row = C.author_accumulators(C.collapse(changes), commits, head(spark)).first()
    assert math.isclose(row.line_score, 10 * math.sqrt(0.4))


def test_recency_has_the_last_bit_of_the_c_library(spark):
    """Lines of 20 and, a half-life before, of 40 weigh alike or not as the SQL's engine says."""
    ages = spark.range(3000).select("id", H.recency_weight(F.lit(HEAD), HEAD - F.col("id") * DAY).alias("w"), H.recency_weight(F.lit(HEAD), HEAD + F.col("id")).alias("ahead"))
    assert [(r.w, r.ahead) for r in ages.orderBy("id").collect()] == [(math.pow(0.5, i * DAY / float(DAY) / 730.0), 1.0) for i in range(3000)]


def test_ownership_compaction(spark):
    acc = spark.createDataFrame(
        [("f", a, 5, 5, lines, float(lines)) for a, lines in (("a", 500), ("b", 300), ("c", 200), ("d", 150), ("e", 5))] + [("g", "z", 1, 1, 0, 0.0)],
        "path string, author string, touches long, meaningful_commits long, changed_lines long, line_score double")
    rows = O.ownership(acc).orderBy("path", "owner_rank").collect()
    assert [r.owner for r in rows] == ["a", "b", "c", "others"] and math.isclose(sum(r.share for r in rows), 1)
    summary = {r.path: r for r in O.owner_summary(O.ownership(acc), acc).collect()}
    assert summary["f"].owner_count == 3 and summary["f"].dominant_owner == "a"
    assert summary["g"].owner_count == 0 and summary["g"].dominant_share is None


def test_imports_resolve_to_the_first_known_package(spark):
    packages = spark.createDataFrame([("a/a.go", "a"), ("pkg/service/s.go", "pkg/service"), ("pkg/direct/d.go", "pkg/direct")], "path string, package string")
    refs = spark.createDataFrame([("a/a.go", i, t) for i, t in enumerate(("app/pkg/service", "app/pkg/service", "pkg/direct", "fmt"))], "source_path string, idx int, raw_target string")
    resolved = K.resolve_imports(refs, packages, "app")
    assert resolved.count() == 4 and resolved.where("resolved_package IS NOT NULL").count() == 3
    edges = K.dependency_edges(resolved)
    assert edges.count() == 2 and K.coupling_out(edges).first().coupling_out == 2
    assert K.dependency_edges(K.resolve_imports(refs, packages, None)).count() == 1


def test_histories_and_partners_equal_the_single_steps(spark):
    """One pass over touches and lists of peers give what churn, ownership and pairs give."""
    r = random.Random(3)
    commits = spark.createDataFrame([(c, f"a{c % 7}", HEAD - r.randrange(900) * DAY) for c in range(120)], "commit_id long, author string, ts long")
    raw = [(c, f"f{r.randrange(12):02}", r.randrange(40), r.randrange(3)) for c in range(123) for _ in range(r.randrange(1, 9))]
    flat = C.collapse(spark.createDataFrame(raw, "commit_id long, path string, added long, deleted long"))
    options = HistoryOptions(cochange_max_files=5)
    touches = C.touches(flat, commits, head(spark), options)
    want = {(x.path, x.partner): x.pair_count for x in C.partners(C.cochange_pairs(flat, options)).collect()}
    for lists in (touches, C.commit_files(flat, options)):
        assert {(x.path, x.partner): x.pair_count for x in C.partner_rows(lists).collect()} == want and max(want.values()) > 1
    acc, got = C.author_accumulators(flat, commits, head(spark)), {x.path: x for x in O.file_histories(touches, head(spark)).collect()}
    churn = {x.path: x.asDict() for x in C.churn(flat, commits, head(spark)).collect()}
    assert churn == {p: {c: x[c] for c in churn[p]} for p, x in got.items()}
    assert {x.path: x.n for x in acc.groupBy("path").agg(F.count("*").alias("n")).collect()} == {p: x.author_count for p, x in got.items()}
    owners = sorted((x.path, x.owner_rank, x.owner, round(x.share, 9), x.touches) for x in O.ownership(acc).collect())
    assert owners == sorted((p, i, "others" if o.is_other else o.author, round(o.share, 9), o.touches) for p, x in got.items() for i, o in enumerate(x.owners, 1))


def test_references_are_resolved_in_place(spark):
    """A package that most files import must not gather its references in one task."""
    packages = spark.createDataFrame([("hot/a.go", "hot"), ("b.go", ".")], "path string, package string")
    refs = spark.range(2000, numPartitions=4).select(F.concat(F.lit("f"), "id").alias("source_path"), F.lit(0).alias("idx"), F.lit("app/hot").alias("raw_target"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    resolved = K.resolve_targets(refs, packages, "app", ["source_path"])
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "hashpartitioning" not in plan and resolved.where("resolved_package = 'hot'").count() == 2000
    odd = spark.createDataFrame([(None,), ("",), ("app",), (" app/hot/ ",), ("fmt",)], "raw_target string")
    assert [x.resolved_package for x in K.resolve_targets(odd, packages, "app", ["raw_target"]).collect()] == [None, ".", ".", "hot", None]
