from pyspark.sql import functions as F

from churnscope.functions import scoring as S
from churnscope.functions import text as X
from churnscope.operators import risk as R
from churnscope.plans import reports
from churnscope.scratch import with_rank

FACTS = (
    "path string, package string, language string, is_test boolean, is_generated boolean, is_vendor boolean, line_count long, byte_size long, complexity long, "
    "max_function_complexity long, total_churn long, recent_churn long, co_changed_files long, coupling_in long, coupling_out long, owner_count long, "
    "dominant_owner string, dominant_share double, file_age_days long")


def facts(spark, *rows):
    base = dict(path="a.go", package=".", language="go", is_test=False, is_generated=False, is_vendor=False, line_count=10, byte_size=100, complexity=0, max_function_complexity=0,
                total_churn=0, recent_churn=0, co_changed_files=0, coupling_in=0, coupling_out=0, owner_count=1, dominant_owner="o", dominant_share=1.0, file_age_days=1)
    names = [c.split()[0] for c in FACTS.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], FACTS)


def context(spark, age=800, authors=20, files=300):
    return spark.createDataFrame([(age, authors, files)], "repository_age_days long, repository_authors long, repository_files long")


BIG = dict(line_count=5000, total_churn=9000, recent_churn=6000, co_changed_files=90, coupling_in=90, coupling_out=90, complexity=900, max_function_complexity=90)


def test_extreme_and_drivers(spark):
    s = R.file_scores(facts(spark, BIG), context(spark))
    row = s.first()
    assert row.band == "extreme" and 0.85 <= row.score <= 1
    kinds = [r.kind for r in R.score_facts(s).orderBy("fact_index").collect()]
    assert kinds == ["high_churn", "recent_churn", "high_complexity_pressure", "source_coupling_pressure", "cochange_pressure", "ownership"]
    assert R.score_terms(s).count() == 7


def test_missing_values(spark):
    s = R.file_scores(facts(spark, dict(line_count=None, byte_size=None, complexity=None, max_function_complexity=None, owner_count=None, dominant_share=None)), context(spark, None, None))
    codes = [r.code for r in R.score_limitations(s).orderBy("limitation_index").collect()]
    assert codes == ["missing_size_metric", "missing_recent_growth_line_count", "missing_complexity_pressure", "missing_ownership_risk_metrics"]
    half = R.file_scores(facts(spark, dict(line_count=None, byte_size=65_536)), context(spark)).first()
    assert half.n_size == 0.5


def test_ties_tests_and_exclusions(spark):
    f = facts(spark, dict(path="zeta.go"), dict(path="alpha.go"), dict(path="x_test.go", is_test=True), dict(path="g.go", is_generated=True), dict(path="r.rs", language=None))
    s = R.file_scores(f, context(spark))
    assert [r.path for r in with_rank(s, "path", falling=("score",)).orderBy("rank").collect()][:2] == ["alpha.go", "x_test.go"]
    assert {r.position: r.path for r in reports.hotspots(s).collect()} == {1: "alpha.go", 2: "zeta.go"}
    counts = R.scoring_counts(f).first()
    assert (counts.scored, counts.scored_production, counts.scored_test, counts.excluded_generated_vendor) == (3, 2, 1, 1)
    project = R.project_score(s, f).first()
    assert project.scored_files == 2 and [x.code for x in project.limitations] == ["partial_go_score_coverage"]
    assert R.package_scores(s).first().file_count == 2 and R.package_terms(R.package_scores(s)).count() == 5


def test_ranks_over_many_parts(spark):
    rows = spark.createDataFrame([(f"k{i:04}", float(i % 7)) for i in range(500)], "key string, score double").repartition(5)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    got = [(r.key, r.rank) for r in with_rank(rows, "key", falling=("score",)).orderBy("rank").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    want = sorted((-(i % 7), f"k{i:04}") for i in range(500))
    assert got == [(k, n + 1) for n, (_, k) in enumerate(want)]
    assert with_rank(rows.limit(0), "key", falling=("score",)).count() == 0


def test_explain_counts_what_it_does_not_list(spark):
    f = facts(spark, *[dict(path=f"p/{i}.go", package="p") for i in range(6)])
    s = with_rank(R.file_scores(f, context(spark)), "path", falling=("score",))
    edges = spark.createDataFrame([(f"p/{i}.go", "p", "p") for i in range(5)], "source_path string, source_package string, target_package string")
    owners = spark.createDataFrame([], "path string, owner_rank int, owner string, share double, score double, touches long")
    pairs = spark.createDataFrame([], "left_path string, right_path string, pair_count long")
    resolved = spark.createDataFrame([], "source_path string, idx int, raw_target string, source_package string, resolved_package string")
    got = {r.path: r for r in reports.explain(f, s, owners, pairs, resolved, edges, f.select("path"), importers=2).collect()}
    assert [x.source_path for x in got["p/0.go"].inbound] == ["p/1.go", "p/2.go"] and got["p/0.go"].inbound_count == 4
    assert [x.source_path for x in got["p/5.go"].inbound] == ["p/0.go", "p/1.go"] and got["p/5.go"].inbound_count == 5


def test_six_decimals_as_the_sql_rounds(spark):
    from churnscope.plans.queries import r6

    rows = spark.createDataFrame([(6.8996224999999995,), (5.6131174999999995,), (0.25,), (None,)], "x double")
    assert [r.x for r in rows.select(*r6("x")).collect()] == [6.899623, 5.613118, 0.25, None]


def test_empty_project(spark):
    s = R.file_scores(facts(spark).limit(0), context(spark))
    p = R.project_score(s, facts(spark, dict(language=None)), "unavailable").first()
    assert (p.band, p.confidence, p.score) == ("unavailable", "none", 0.0)
    assert [x.code for x in p.limitations] == ["no_scored_files", "git_index_unavailable"]
    assert {r.band: r.files for r in R.band_histogram(s).collect()} == dict.fromkeys(S.BANDS, 0)


def test_tags_and_phrases(spark):
    flags = dict(is_test=F.lit(True), is_generated=F.lit(False), is_vendor=F.lit(False))
    terms = dict(churn=F.lit(0.7), complexity_pressure=F.lit(1.0), size=F.lit(0.3), cochange_pressure=F.lit(None).cast("double"))
    row = spark.range(1).select(S.tags(flags, terms).alias("t")).select("t", S.phrase(F.col("t")).alias("p")).first()
    assert row.t == ["high churn", "complexity pressure", "test file"] and row.p == "Frequently changed, high-complexity file"


def test_text_functions(spark):
    rows = spark.createDataFrame([(bytearray(b"a\nb\n"),), (bytearray(b"a\0"),), (bytearray(b"a\xff"),), (bytearray(b""),)], "c binary")
    assert [r[0] for r in rows.select(X.content_kind(F.col("c"))).collect()] == ["text", "binary", "unknown", "text"]
    texts = spark.createDataFrame([("a\nb\n",), ("a\nb",), ("",), ("\n",)], "t string")
    assert [r[0] for r in texts.select(X.line_count(F.col("t"))).collect()] == [2, 2, 0, 1]
    marks = spark.createDataFrame([("// c\n\n// Code generated by x. DO NOT EDIT.\n",), ("package p\n// Code generated by x. DO NOT EDIT.\n",), ("// Code generated DO NOT EDIT.",)], "t string")
    assert [r[0] for r in marks.select(X.has_generated_marker(F.col("t"))).collect()] == [True, False, True]
    notes = spark.createDataFrame([('[{"code":"a","message":"m"},{"code":"b"}]',), ("no",)], "t string")
    assert [[tuple(x) for x in r[0]] for r in notes.select(X.diagnostics_from_json(F.col("t"))).collect()] == [[("a", "m")], [("invalid_diagnostics_json", "Stored diagnostics could not be read.")]]
    assert [r[0] for r in spark.createDataFrame([(1.0005,), (0.5,), (2.675,)], "x double").select(S.fixed(F.col("x"), 3)).collect()] == ["1.000", "0.500", "2.675"]
