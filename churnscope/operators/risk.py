"""Risk scores of files, packages and the project, with what explains them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions import scoring as S

# Weights of the formulas.
FILE_WEIGHTS = {
    "churn": 0.18, "recent_churn": 0.14, "size": 0.12, "ownership_risk": 0.14, "cochange_pressure": 0.10,
    "source_coupling_pressure": 0.16, "complexity_pressure": 0.16,
}
PACKAGE_WEIGHTS = {"max_file_score": 0.45, "mean_file_score": 0.25, "top_3_mean_score": 0.20, "file_count": 0.05, "source_coupling": 0.05}
PROJECT_WEIGHTS = {
    "max_file_score": 0.35, "top_10_mean_score": 0.25, "high_risk_share_pressure": 0.20, "medium_risk_share_pressure": 0.10,
    "dominant_dimension_pressure": 0.10,
}

# Texts of limitations.
LIMITATIONS = {
    "size_uses_byte_size_fallback": "Line count is unavailable, so byte size is used for size normalization.",
    "missing_size_metric": "Neither line count nor byte size is available.",
    "missing_recent_growth_line_count": "Line count is unavailable for recent churn normalization.",
    "zero_line_count_recent_growth": "Recent churn exists for a zero-line file, so recent churn saturates.",
    "missing_complexity_pressure": "Parser-backed approximate complexity pressure is unavailable.",
    "invalid_dominant_owner_share": "Dominant owner share is not finite and is omitted.",
    "dominant_owner_share_out_of_range": "Dominant owner share is clamped to 0.0..=1.0.",
    "ownership_risk_missing_owner_share": "Owner risk uses owner count only.",
    "ownership_risk_missing_owner_count": "Owner risk uses dominant owner share only.",
    "missing_ownership_risk_metrics": "Neither owner count nor dominant owner share is available.",
    "ownership_risk_missing_repository_age": "Repository age is unavailable, so maturity is lower.",
    "ownership_risk_missing_repository_author_count": "Repository author count is unavailable, so maturity is lower.",
    "no_scored_files": "No Go file risk scores are available.",
    "low_language_coverage": "Only a small share of active files has Go risk scores.",
    "partial_go_score_coverage": "Some active Go files do not have persisted risk scores.",
    "git_index_unavailable": "Git-derived repository context is unavailable.",
    "language_scope": "Only production Go files receive risk scores in the default summary.",
}


def scorable(facts: DataFrame) -> DataFrame:
    """Go files that are neither generated nor vendored; tests are scored too."""
    return facts.where("language = 'go' AND path IS NOT NULL AND NOT is_generated AND NOT is_vendor")


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _share() -> Column:
    """The dominant share if it is a finite number, clamped."""
    share = F.col("dominant_share")
    finite = share.isNotNull() & ~F.isnan(share) & (F.abs(share) != F.lit(float("inf")))
    return F.when(finite, S.clamp01(share))


def file_terms(context: dict[str, Column]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Raw and normalized values of the seven terms as expressions over facts.

    ``context``: repository_age_days, repository_authors, repository_files.
    """
    col = F.col
    churn = S.normalized(col("total_churn"), 2000)
    recent = F.when(col("line_count") > 0, S.clamp01(col("recent_churn") / col("line_count"))).when(
        col("line_count") == 0, F.when(col("recent_churn") == 0, 0.0).otherwise(1.0))
    size = F.coalesce(S.normalized(col("line_count"), 1000), S.normalized(col("byte_size"), 131_072))
    cochange = S.normalized(col("co_changed_files"), 25)
    coupling = F.greatest(S.normalized(col("coupling_in"), 25), S.normalized(col("coupling_out"), 15))
    both = F.coalesce("complexity", "max_function_complexity").isNotNull()
    complexity = F.when(both, F.greatest(
        S.normalized(F.coalesce("complexity", F.lit(0)), 150), S.normalized(F.coalesce("max_function_complexity", F.lit(0)), 30)))

    count = S.owner_count_component(col("owner_count"))
    concentration = F.coalesce((count + _share()) / 2.0, count, _share())
    maturity = (
        0.35 * _or0(S.normalized(context["repository_age_days"], 730))
        + 0.35 * _or0(S.clamp01(F.greatest(context["repository_authors"] - 1, F.lit(0)) / 9.0))
        + 0.15 * _or0(S.normalized(context["repository_files"], 200)) + 0.15 * _or0(S.normalized(col("file_age_days"), 365)))
    pressure = 0.35 * _or0(churn) + 0.25 * _or0(recent) + 0.25 * _or0(cochange) + 0.15 * _or0(size)
    owner = F.coalesce(S.clamp01(concentration * (0.20 + 0.80 * maturity) * (0.30 + 0.70 * pressure)), F.lit(0.0))

    raw = {
        "churn": col("total_churn"), "recent_churn": col("recent_churn"), "size": F.coalesce("line_count", "byte_size"), "ownership_risk": owner,
        "cochange_pressure": col("co_changed_files"), "source_coupling_pressure": F.greatest("coupling_in", "coupling_out"),
        "complexity_pressure": F.when(both, F.coalesce("complexity", F.lit(0))),
    }
    values = {
        "churn": churn, "recent_churn": recent, "size": size, "ownership_risk": owner, "cochange_pressure": cochange,
        "source_coupling_pressure": coupling, "complexity_pressure": complexity,
    }
    return {k: v.cast("double") for k, v in raw.items()}, values


def file_scores(facts: DataFrame, context: DataFrame) -> DataFrame:
    """Facts of scorable files with raw_*, n_*, score, risk_10 and band.

    ``context`` is one row and is broadcast; the sums keep the order of the terms. Ranks
    are added by ``with_rank`` where they are wanted.
    """
    raw, values = file_terms({c: F.col(f"_x.{c}") for c in ("repository_age_days", "repository_authors", "repository_files")})
    rows = scorable(facts).join(F.broadcast(context.select(F.struct("repository_age_days", "repository_authors", "repository_files").alias("_x"))))
    rows = rows.withColumns({f"raw_{k}": v for k, v in raw.items()} | {f"n_{k}": v for k, v in values.items()})
    total = sum((_or0(F.col(f"n_{k}")) * w for k, w in FILE_WEIGHTS.items()), F.lit(0.0))
    return rows.withColumn("score", S.clamp01(total)).withColumns({"risk_10": F.col("score") * 10.0, "band": S.risk_band(F.col("score"))})


def term_rows(*first: str) -> Column:
    """Structs (first, term, raw_value, normalized_value, weight, contribution) of a file's seven terms, as an array."""
    return F.array(*[F.struct(*[F.lit(i).alias(c) for c in first], F.lit(k).alias("term"), F.col(f"raw_{k}").alias("raw_value"), F.col(f"n_{k}").alias("normalized_value"),
                              F.lit(w).alias("weight"), (_or0(F.col(f"n_{k}")) * w).alias("contribution")) for i, (k, w) in enumerate(FILE_WEIGHTS.items())])


def score_terms(scores: DataFrame) -> DataFrame:
    """Seven rows per file: (path, term_index, term, raw_value, normalized_value, weight, contribution)."""
    return scores.select("path", F.inline(term_rows("term_index")))


def _coded(codes: list[Column]) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in LIMITATIONS.items() for x in pair])
    return F.transform(F.array_compact(F.array(*codes)), lambda c: F.struct(c.alias("code"), F.element_at(texts, c).alias("message")))


def limitation_codes() -> list[Column]:
    """Codes of a file's limitations in the order of the formula's steps."""
    col, share = F.col, F.col("dominant_share")
    finite, neither = _share().isNotNull(), col("owner_count").isNull() & _share().isNull()
    return [
        F.when(col("line_count").isNull() & col("byte_size").isNotNull(), "size_uses_byte_size_fallback"),
        F.when(col("line_count").isNull() & col("byte_size").isNull(), "missing_size_metric"),
        F.when(col("line_count").isNull(), "missing_recent_growth_line_count").when(
            (col("line_count") == 0) & (col("recent_churn") > 0), "zero_line_count_recent_growth"),
        F.when(F.coalesce("complexity", "max_function_complexity").isNull(), "missing_complexity_pressure"),
        F.when(share.isNotNull() & ~finite, "invalid_dominant_owner_share").when((share < 0) | (share > 1), "dominant_owner_share_out_of_range"),
        F.when(neither, "missing_ownership_risk_metrics").when(~finite, "ownership_risk_missing_owner_share").when(
            col("owner_count").isNull(), "ownership_risk_missing_owner_count"),
        F.when(~neither & col("_x.repository_age_days").isNull(), "ownership_risk_missing_repository_age"),
        F.when(~neither & col("_x.repository_authors").isNull(), "ownership_risk_missing_repository_author_count"),
    ]


def score_limitations(scores: DataFrame) -> DataFrame:
    """(path, limitation_index, code, message)."""
    return scores.select("path", F.posexplode(_coded(limitation_codes())).alias("limitation_index", "x")).select("path", "limitation_index", "x.code", "x.message")


def driver_facts() -> Column:
    """Ordered facts (kind, message); a summary if none applies."""
    col = F.col
    fact = lambda test, kind, *message: F.when(test, F.struct(F.lit(kind).alias("kind"), F.concat(*message).alias("message")))
    text = lambda c: F.coalesce(col(c), F.lit(0)).cast("string")
    facts = F.array_compact(F.array(
        fact(col("total_churn") >= 1000, "high_churn", F.lit("High total churn: "), text("total_churn"), F.lit(" changed lines")),
        fact(col("line_count").isNotNull() & (col("recent_churn") >= F.greatest("line_count", F.lit(1))), "recent_churn",
             F.lit("Recent churn is high: "), text("recent_churn"), F.lit(" changed lines")),
        fact(col("max_function_complexity") >= 20, "high_complexity_pressure",
             F.lit("High approximate cognitive complexity pressure: max function "), text("max_function_complexity")),
        fact((col("coupling_in") >= 10) | (col("coupling_out") >= 10), "source_coupling_pressure", F.lit("High source coupling pressure: "), text("coupling_in"),
             F.lit(" inbound resolved local imports, "), text("coupling_out"), F.lit(" outbound resolved local imports")),
        fact(col("co_changed_files") >= 15, "cochange_pressure", F.lit("High co-change pressure: "), text("co_changed_files"), F.lit(" files")),
        fact(col("dominant_share") >= 0.75, "ownership", F.lit("High ownership concentration: dominant owner share "), S.fixed(F.coalesce("dominant_share", F.lit(0.0)), 2)),
    ))
    summary = F.array(F.struct(F.lit("summary").alias("kind"), F.concat(
        F.lit("Advisory risk score "), S.fixed(col("score"), 3),
        F.lit(" from local file, Git, source coupling pressure, and complexity pressure signals")).alias("message")))
    return F.when(F.size(facts) > 0, facts).otherwise(summary)


def score_facts(scores: DataFrame) -> DataFrame:
    """(path, fact_index, kind, message)."""
    return scores.select("path", F.posexplode(driver_facts()).alias("fact_index", "x")).select("path", "fact_index", "x.kind", "x.message")


def production(scores: DataFrame) -> DataFrame:
    return scores.where("NOT is_test")


def scoring_counts(facts: DataFrame) -> DataFrame:
    """One row: scored, production, test and excluded Go files."""
    go, out = F.col("language") == "go", F.col("is_generated") | F.col("is_vendor")
    n = lambda test: F.coalesce(F.sum(F.when(test, 1)), F.lit(0)).cast("long")
    return facts.where("path IS NOT NULL").agg(
        n(go & ~out).alias("scored"), n(go & ~out & ~F.col("is_test")).alias("scored_production"),
        n(go & ~out & F.col("is_test")).alias("scored_test"), n(go & out).alias("excluded_generated_vendor"))


def _mean_desc(scores: Column) -> Column:
    """Mean of an array from its largest value on, so the sum's order is fixed."""
    ordered = F.sort_array(scores, asc=False)
    return F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x) / F.size(scores)


def package_scores(scores: DataFrame) -> DataFrame:
    """Per package of production files: counts, means, the five normalized terms, score and band.

    The three largest scores of a package are cut out before the shuffle, so a package of
    any size is a few rows per task.
    """
    files = production(scores).select("package", "path", "score", "coupling_in", "coupling_out")
    per = files.groupBy("package").agg(
        F.count("*").alias("file_count"), F.sum("coupling_in").alias("coupling_in"), F.sum("coupling_out").alias("coupling_out"),
        F.max("score").alias("max_file_score"), F.avg("score").alias("mean_file_score"))
    largest = files.select("package", "path", "score").withColumn("n", F.row_number().over(Window.partitionBy("package").orderBy(F.desc("score"), "path"))).where("n <= 3")
    top = largest.groupBy("package").agg(_mean_desc(F.collect_list("score")).alias("top_3_mean_score"))
    rows = per.join(top.withColumnRenamed("package", "top_package"), F.col("package").eqNullSafe(F.col("top_package"))).drop("top_package")
    values = {
        **{k: F.col(k) for k in ("max_file_score", "mean_file_score", "top_3_mean_score")},
        "file_count": S.normalized(F.col("file_count"), 10), "source_coupling": S.normalized(F.greatest("coupling_in", "coupling_out"), 10)}
    rows = rows.withColumns({f"n_{k}": v for k, v in values.items()})
    rows = rows.withColumn("score", S.clamp01(sum((F.col(f"n_{k}") * w for k, w in PACKAGE_WEIGHTS.items()), F.lit(0.0))))
    return rows.withColumn("band", S.risk_band(F.col("score")))


def package_terms(packages: DataFrame) -> DataFrame:
    raw = {"source_coupling": F.greatest("coupling_in", "coupling_out")}
    rows = F.array(*[F.struct(
        F.lit(k).alias("term"), raw.get(k, F.col(k if k != "source_coupling" else "file_count")).cast("double").alias("raw_value"),
        F.col(f"n_{k}").alias("normalized_value"), F.lit(w).alias("weight"), (F.col(f"n_{k}") * w).alias("contribution")) for k, w in PACKAGE_WEIGHTS.items()])
    return packages.select("package", F.inline(rows))


def package_facts(packages: DataFrame) -> DataFrame:
    rows = F.array(
        F.struct(F.lit("package_file_count").alias("kind"), F.concat(F.lit("Package "), F.col("package"), F.lit(" contains "), F.col("file_count").cast("string"), F.lit(" scored Go file(s)")).alias("message")),
        F.struct(F.lit("package_file_scores").alias("kind"), F.concat(
            F.lit("Package risk uses max "), S.fixed(F.col("max_file_score"), 3), F.lit(", mean "), S.fixed(F.col("mean_file_score"), 3),
            F.lit(", and top-three mean "), S.fixed(F.col("top_3_mean_score"), 3), F.lit(" file scores")).alias("message")))
    return packages.select("package", F.posexplode(rows).alias("fact_index", "x")).select("package", "fact_index", "x.kind", "x.message")


def top_files(scores: DataFrame, n: int = 10) -> DataFrame:
    return production(scores).orderBy(F.desc("score"), "path").limit(n)


def dominant_dimension(scores: DataFrame) -> DataFrame:
    """One row: the term with the largest mean over the top ten files, the smaller name at ties."""
    means = score_terms(top_files(scores)).groupBy("term").agg(F.avg(_or0(S.clamp01(F.col("normalized_value")))).alias("mean"))
    return means.agg(F.min_by("term", F.struct(-F.col("mean"), F.col("term"))).alias("dominant_dimension"), F.coalesce(F.max("mean"), F.lit(0.0)).alias("dominant_dimension_pressure"))


def band_histogram(scores: DataFrame) -> DataFrame:
    """One row per band, 0 where no production file lies."""
    counts = [F.coalesce(F.sum(F.when(F.col("band") == b, 1)), F.lit(0)).cast("long").alias(b) for b in S.BANDS]
    return production(scores).agg(*counts).select(F.expr("stack(4, " + ", ".join(f"'{b}', {b}" for b in S.BANDS) + ") AS (band, files)"))


def project_score(scores: DataFrame, facts: DataFrame, git_status: str = "available") -> DataFrame:
    """One row: score, band, confidence, counts, terms as n_*, and limitations."""
    n = lambda test: F.coalesce(F.sum(F.when(test, 1)), F.lit(0)).cast("long")
    s = F.col("score")
    per_file = production(scores).agg(F.count("*").alias("scored_files"), F.coalesce(F.max(s), F.lit(0.0)).alias("max_file_score"), n(s >= 0.70).alias("high_files"), n(s >= 0.40).alias("medium_files"))
    top = top_files(scores).agg(F.collect_list("score").alias("t")).select(F.when(F.size("t") > 0, _mean_desc(F.col("t"))).otherwise(0.0).alias("top_10_mean_score"))
    active = facts.agg(F.count("*").alias("active_files"), n(F.col("language") == "go").alias("active_go_files"))
    row = per_file.join(F.broadcast(top)).join(F.broadcast(active)).join(F.broadcast(dominant_dimension(scores)))
    files = F.col("scored_files")
    values = {
        "max_file_score": F.col("max_file_score"), "top_10_mean_score": F.col("top_10_mean_score"),
        "high_risk_share_pressure": _or0(S.clamp01(F.try_divide(F.col("high_files"), files) / 0.10)),
        "medium_risk_share_pressure": _or0(S.clamp01(F.try_divide(F.col("medium_files"), files) / 0.30)),
        "dominant_dimension_pressure": S.clamp01(F.col("dominant_dimension_pressure"))}
    row = row.withColumns({f"n_{k}": v for k, v in values.items()})
    row = row.withColumn("score", S.clamp01(sum((F.col(f"n_{k}") * w for k, w in PROJECT_WEIGHTS.items()), F.lit(0.0))))
    coverage = S.ratio(files, F.col("active_files"))
    row = row.withColumns({
        "risk_10": F.col("score") * 10.0, "band": F.when(files == 0, "unavailable").otherwise(S.risk_band(F.col("score"))),
        "scoring_coverage": coverage, "confidence": S.confidence(coverage),
        "go_score_coverage": F.try_divide(files.cast("double"), F.col("active_go_files").cast("double")), "git_status": F.lit(git_status)})
    codes = [
        F.when(files == 0, "no_scored_files"), F.when((files > 0) & F.col("confidence").isin("low", "none"), "low_language_coverage"),
        F.when((files > 0) & (F.col("go_score_coverage") < 1), "partial_go_score_coverage"), F.when(F.col("git_status") != "available", "git_index_unavailable")]
    return row.withColumn("limitations", _coded(codes))


def project_terms(project: DataFrame) -> DataFrame:
    raw = {"high_risk_share_pressure": "high_files", "medium_risk_share_pressure": "medium_files"}
    rows = F.array(*[F.struct(
        F.lit(k).alias("term"), F.col(raw.get(k, k)).cast("double").alias("raw_value"), F.col(f"n_{k}").alias("normalized_value"), F.lit(w).alias("weight"),
        (F.col(f"n_{k}") * w).alias("contribution")) for k, w in PROJECT_WEIGHTS.items()])
    return project.select(F.inline(rows))
