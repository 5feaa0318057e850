"""Registered queries over the evaluation binding, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.config import HistoryOptions
from churnscope.functions import history as H
from churnscope.functions import paths as P
from churnscope.functions import scoring as S
from churnscope.functions import text as X
from churnscope.operators import changes as C
from churnscope.operators import coupling as K
from churnscope.operators import ownership as O
from churnscope.operators import risk as R
from churnscope.operators import snapshots as N
from churnscope.plans import reports
from churnscope.plans.binding import Binding, sql
from churnscope.scratch import with_rank
from churnscope.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Binding(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(*names: str) -> list:
    """Six decimals, by scaling to whole numbers as the SQL does; decimals of the exact value differ from that at ties."""
    return [(F.round(F.col(n) * 1e6) / 1e6).alias(n) for n in names]


def sql6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(sql("SELECT * FROM changes", "changes"))
def change_collapse(b: Binding) -> DataFrame:
    return b.changes()


@query(sql("SELECT * FROM churn", "churn"))
def file_churn(b: Binding) -> DataFrame:
    return b.churn()


@query(sql("SELECT count(*) AS commits_in_age, least(count(*), 2000) AS commits_read FROM commits, head WHERE ts >= head_ts - 730 * 86400", "commits", "head"))
def history_bounded_counts(b: Binding) -> DataFrame:
    return C.bounded_counts(b.commits(), b.head(), HistoryOptions(max_commits=2000))


@query(sql("""
SELECT count(*) AS commits, sum(n)::BIGINT AS file_changes, coalesce(sum(n * (n - 1) // 2) FILTER (n <= 8), 0)::BIGINT AS cochange_pairs,
       count(*) FILTER (n > 8) AS broad_commits, max(n)::BIGINT AS max_files,
       arg_min(commit_id, {'a': -n, 'b': ts, 'c': commit_id}) AS broadest_commit
FROM (SELECT commit_id, ts, coalesce(breadth, 0) AS n FROM commits LEFT JOIN breadth USING (commit_id))""", "commits", "breadth"))
def commit_breadth(b: Binding) -> DataFrame:
    return C.breadth_summary(b.changes(), b.commits(), HistoryOptions(cochange_max_files=8))


@query(sql(f"SELECT path, author, touches, meaningful_commits, changed_lines, {sql6('line_score')} FROM accumulators", "accumulators"))
def author_accumulators(b: Binding) -> DataFrame:
    return b.accumulators().select("path", "author", "touches", "meaningful_commits", "changed_lines", *r6("line_score"))


@query(sql("SELECT * FROM narrow_pairs", "narrow_pairs"))
def cochange_pairs(b: Binding) -> DataFrame:
    """With a limit of 8 files, so that wide commits show."""
    return b.pairs(limit=8)


@query(sql("SELECT path, count(DISTINCT partner) AS co_changed_files FROM partners GROUP BY path", "partners"))
def cochange_partner_counts(b: Binding) -> DataFrame:
    return C.partner_counts(b.pairs())


@query(sql("""
SELECT path, partner, pair_count, n FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY pair_count DESC, partner)::INT AS n FROM partners) WHERE n <= 10""", "partners"))
def cochange_partners_top10(b: Binding) -> DataFrame:
    return b.named_partners(C.first_partners(b.partner_rows()))


@query(sql("SELECT * FROM summary", "summary"))
def repository_summary(b: Binding) -> DataFrame:
    return C.repository_summary(b.commits(), b.head())


@query(sql("""
SELECT count(*) AS automated_authors FROM (SELECT DISTINCT author FROM commits)
WHERE lower(author) LIKE '%bot%' OR lower(author) LIKE '%automation%' OR lower(author) LIKE '%noreply%'""", "commits"))
def automated_author_count(b: Binding) -> DataFrame:
    return C.automated_authors(b.commits())


@query(sql(f"""
SELECT coalesce(round(share), 0) AS top_share_percent, CASE WHEN share >= 80 THEN '{C.CONCENTRATION_WARNING}' END AS warning FROM (
  SELECT 100.0::DOUBLE * max(t) / nullif(sum(t), 0) AS share FROM (SELECT author, sum(touches)::BIGINT AS t FROM accumulators GROUP BY author))""", "accumulators"))
def top_author_share(b: Binding) -> DataFrame:
    return C.top_author_share(b.accumulators())


@query(sql(f"SELECT path, owner_rank, owner, {sql6('share', 'score')}, touches FROM owners", "owners"))
def ownership(b: Binding) -> DataFrame:
    return b.owners().select("path", "owner_rank", "owner", *r6("share", "score"), "touches")


@query(sql(f"SELECT path, owner_count, dominant_owner, {sql6('dominant_share')} FROM owner_summary", "owner_summary"))
def owner_summary(b: Binding) -> DataFrame:
    acc = b.accumulators()
    return O.owner_summary(O.ownership(acc), acc).select("path", "owner_count", "dominant_owner", *r6("dominant_share"))


@query(sql("SELECT * FROM packages", "packages"))
def file_packages(b: Binding) -> DataFrame:
    return b.packages()


@query(sql("SELECT source_path, idx, raw_target, source_package, resolved_package FROM resolved", "resolved"))
def import_resolution(b: Binding) -> DataFrame:
    return b.resolved()


@query(sql("SELECT * FROM edges", "edges"))
def dependency_edges(b: Binding) -> DataFrame:
    return b.edges()


@query(sql("SELECT * FROM coupling_in", "coupling_in"))
def coupling_in(b: Binding) -> DataFrame:
    return K.coupling_in(b.edges())


@query(sql("SELECT * FROM coupling_out", "coupling_out"))
def coupling_out(b: Binding) -> DataFrame:
    return K.coupling_out(b.edges())


_FACTS = ("path", "package", "line_count", "byte_size", "complexity", "max_function_complexity", "language", "is_test", "is_generated", "is_vendor", "commits",
          "total_added", "total_deleted", "total_churn", "recent_churn", "first_ts", "last_ts", "author_count", "co_changed_files", "file_age_days", "owner_count",
          "dominant_owner", "coupling_in", "coupling_out")


@query(sql(f"SELECT {', '.join(_FACTS)}, {sql6('dominant_share')} FROM facts", "facts"))
def file_facts(b: Binding) -> DataFrame:
    return b.facts().select(*_FACTS, *r6("dominant_share"))


@query(sql("SELECT path, is_test, is_generated, is_vendor FROM files", "files"))
def path_flags(b: Binding) -> DataFrame:
    return b.files().select("path", "is_test", "is_generated", "is_vendor")


@query(sql(r"SELECT path, nullif(lower(regexp_extract(path, '[^/]\.([^./]+)$', 1)), '') AS extension FROM files", "files"))
def file_extension(b: Binding) -> DataFrame:
    return b.files().select("path", P.extension(F.col("path")).alias("extension"))


@query(sql(r"SELECT path, CASE WHEN instr(path, '/') = 0 THEN '.' ELSE regexp_replace(path, '/[^/]*$', '') END AS package FROM files", "files"))
def package_path(b: Binding) -> DataFrame:
    return b.files().select("path", P.package_path(F.col("path")).alias("package"))


@query("""
SELECT doc_id, (len(text) - len(replace(text, chr(10), '')) + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END)::BIGINT AS line_count
FROM documents""")
def line_counts(b: Binding) -> DataFrame:
    return b.table("documents").select("doc_id", X.line_count(F.col("text")).alias("line_count"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'unknown' WHEN contains(text, chr(0)) THEN 'binary' ELSE 'text' END AS content_kind FROM documents")
def content_kind(b: Binding) -> DataFrame:
    return b.table("documents").select("doc_id", X.content_kind(F.col("text").cast("binary")).alias("content_kind"))


_MARKER_SQL = f"starts_with({{0}}, '{X.MARKER_HEAD}') AND ends_with({{0}}, '{X.MARKER_TAIL}')"


@query(f"""
WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: trim(x)),
                                            lambda x: ({_MARKER_SQL.format("x")}) OR (x <> '' AND NOT starts_with(x, '//')))[1] AS stop FROM documents)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN doc_id % 3 = 0 OR coalesce({_MARKER_SQL.format("stop")}, false) END AS marked FROM l""")
def generated_marker(b: Binding) -> DataFrame:
    """Every third document gets a comment head with the marker; the others one without."""
    head = F.when(F.col("doc_id") % 3 == 0, F.lit("// notice\n\n// Code generated by a tool. DO NOT EDIT.\n")).otherwise(F.lit("// notice\n// Code written by hand.\n"))
    return b.table("documents").select("doc_id", X.has_generated_marker(F.concat(head, "text")).alias("marked"))


_N = tuple(f"n_{t}" for t in S.TERMS)


@query(sql(f"SELECT path, rank, band, {sql6('score', 'risk_10')} FROM scores", "scores"))
def file_risk_scores(b: Binding) -> DataFrame:
    return b.ranked_scores().select("path", "rank", "band", *r6("score", "risk_10"))


@query(sql(f"SELECT path, term_index, term, weight, {sql6('raw_value', 'normalized_value', 'contribution')} FROM terms", "terms"))
def file_risk_terms(b: Binding) -> DataFrame:
    return R.score_terms(b.scores()).select("path", "term_index", "term", "weight", *r6("raw_value", "normalized_value", "contribution"))


@query(sql(f"""
SELECT path, 0 AS limitation_index, 'missing_ownership_risk_metrics' AS code, '{R.LIMITATIONS["missing_ownership_risk_metrics"]}' AS message
FROM scores WHERE owner_count IS NULL AND dominant_share IS NULL
UNION ALL SELECT path, 0, 'ownership_risk_missing_owner_share', '{R.LIMITATIONS["ownership_risk_missing_owner_share"]}' FROM scores
WHERE owner_count IS NOT NULL AND dominant_share IS NULL""", "scores"))
def file_risk_limitations(b: Binding) -> DataFrame:
    return R.score_limitations(b.scores())


@query(sql("""
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY o) - 1)::INT AS fact_index, kind FROM (
  SELECT path, 1 AS o, 'high_churn' AS kind FROM scores WHERE total_churn >= 1000
  UNION ALL SELECT path, 2, 'recent_churn' FROM scores WHERE recent_churn >= greatest(line_count, 1)
  UNION ALL SELECT path, 3, 'high_complexity_pressure' FROM scores WHERE max_function_complexity >= 20
  UNION ALL SELECT path, 4, 'source_coupling_pressure' FROM scores WHERE coupling_in >= 10 OR coupling_out >= 10
  UNION ALL SELECT path, 5, 'cochange_pressure' FROM scores WHERE co_changed_files >= 15
  UNION ALL SELECT path, 6, 'ownership' FROM scores WHERE dominant_share >= 0.75
  UNION ALL SELECT path, 7, 'summary' FROM scores WHERE NOT (total_churn >= 1000 OR recent_churn >= greatest(line_count, 1) OR max_function_complexity >= 20
    OR coupling_in >= 10 OR coupling_out >= 10 OR co_changed_files >= 15 OR coalesce(dominant_share, 0) >= 0.75))""", "scores"))
def file_risk_facts(b: Binding) -> DataFrame:
    return R.score_facts(b.scores()).select("path", "fact_index", "kind")


@query(sql("""
SELECT count(*) FILTER (language = 'go' AND NOT is_generated AND NOT is_vendor) AS scored,
       count(*) FILTER (language = 'go' AND NOT is_generated AND NOT is_vendor AND NOT is_test) AS scored_production,
       count(*) FILTER (language = 'go' AND NOT is_generated AND NOT is_vendor AND is_test) AS scored_test,
       count(*) FILTER (language = 'go' AND (is_generated OR is_vendor)) AS excluded_generated_vendor FROM files""", "files"))
def scoring_counts(b: Binding) -> DataFrame:
    return R.scoring_counts(b.files())


@query(sql(f"SELECT package, file_count, coupling_in, coupling_out, rank, band, {sql6('max_file_score', 'mean_file_score', 'top_3_mean_score', 'score')} FROM package_scores", "package_scores"))
def package_risk(b: Binding) -> DataFrame:
    packages = R.package_scores(b.stored_scores()).withColumn("order", F.round("score", 9))
    return with_rank(packages, "package", falling=("order",)).select(
        "package", "file_count", "coupling_in", "coupling_out", "rank", "band", *r6("max_file_score", "mean_file_score", "top_3_mean_score", "score"))


_PACKAGE_TERMS = " UNION ALL ".join(
    f"SELECT package, '{k}' AS term, {raw}::DOUBLE AS raw_value, {norm}::DOUBLE AS normalized_value, {w}::DOUBLE AS weight, {norm} * {w}::DOUBLE AS contribution FROM package_scores"
    for k, raw, norm, w in (
        ("max_file_score", "max_file_score", "max_file_score", 0.45), ("mean_file_score", "mean_file_score", "mean_file_score", 0.25),
        ("top_3_mean_score", "top_3_mean_score", "top_3_mean_score", 0.2), ("file_count", "file_count", "least(file_count / 10.0::DOUBLE, 1)", 0.05),
        ("source_coupling", "greatest(coupling_in, coupling_out)", "least(greatest(coupling_in, coupling_out) / 10.0::DOUBLE, 1)", 0.05)))


@query(sql(f"SELECT package, term, weight, {sql6('raw_value', 'normalized_value', 'contribution')} FROM ({_PACKAGE_TERMS})", "package_scores"))
def package_risk_terms(b: Binding) -> DataFrame:
    return R.package_terms(R.package_scores(b.stored_scores())).select("package", "term", "weight", *r6("raw_value", "normalized_value", "contribution"))


_PROJECT = """
SELECT *, least(max_file_score * 0.35::DOUBLE + top_10_mean_score * 0.25::DOUBLE + least(high_files / scored_files::DOUBLE / 0.1::DOUBLE, 1) * 0.2::DOUBLE
         + least(medium_files / scored_files::DOUBLE / 0.3::DOUBLE, 1) * 0.1::DOUBLE + dominant_dimension_pressure * 0.1::DOUBLE, 1) AS score,
       scored_files / active_files::DOUBLE AS scoring_coverage, scored_files / active_go_files::DOUBLE AS go_score_coverage FROM (
  SELECT count(*) AS scored_files, max(score) AS max_file_score, count(*) FILTER (score >= 0.7) AS high_files, count(*) FILTER (score >= 0.4) AS medium_files,
         (SELECT avg(score) FROM top10) AS top_10_mean_score, (SELECT count(*) FROM files) AS active_files,
         (SELECT count(*) FROM files WHERE language = 'go') AS active_go_files FROM production), dimension"""


@query(sql(f"""
SELECT scored_files, active_files, active_go_files, high_files, medium_files, dominant_dimension,
       {sql6('score', 'max_file_score', 'top_10_mean_score', 'dominant_dimension_pressure', 'scoring_coverage', 'go_score_coverage')},
       CASE WHEN score >= 0.85 THEN 'extreme' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS band,
       CASE WHEN scoring_coverage >= 0.8 THEN 'high' WHEN scoring_coverage >= 0.3 THEN 'medium' WHEN scoring_coverage > 0 THEN 'low' ELSE 'none' END AS confidence
FROM ({_PROJECT})""", "production", "top10", "files", "dimension"))
def project_risk(b: Binding) -> DataFrame:
    return R.project_score(b.stored_scores(), b.files()).select(
        "scored_files", "active_files", "active_go_files", "high_files", "medium_files", "dominant_dimension", "band", "confidence",
        *r6("score", "max_file_score", "top_10_mean_score", "dominant_dimension_pressure", "scoring_coverage", "go_score_coverage"))


@query(sql(f"SELECT dominant_dimension, {sql6('dominant_dimension_pressure')} FROM dimension", "dimension"))
def dominant_dimension(b: Binding) -> DataFrame:
    return R.dominant_dimension(b.scores()).select("dominant_dimension", *r6("dominant_dimension_pressure"))


@query(sql("""
SELECT band, count(path) AS files FROM (VALUES ('low'), ('medium'), ('high'), ('extreme')) AS v(band) LEFT JOIN (SELECT band, path FROM production) USING (band) GROUP BY band""", "production"))
def band_histogram(b: Binding) -> DataFrame:
    return R.band_histogram(b.scores())


_TAG_SQL = " UNION ALL ".join(
    [f"SELECT path, '{label}' AS label, {p} AS p, n_{t}::DOUBLE AS v FROM scores WHERE n_{t} >= 0.6" for t, (label, p) in S.TAG_OF_TERM.items()]
    + [f"SELECT path, '{label}', {p}, 1.0 FROM scores WHERE {flag}" for flag, (label, p) in S.TAG_OF_FLAG.items()])
_TAGS_OF = f"""
SELECT path, string_agg(label, ', ' ORDER BY p DESC, v DESC, label) AS tags FROM (
  SELECT path, label, max(p) AS p, max(v) AS v FROM ({_TAG_SQL}) GROUP BY path, label) GROUP BY path"""


def _hotspot_sql(source: str, limit: str) -> str:
    return sql(f"""
SELECT row_number() OVER (ORDER BY s.score DESC, s.path)::INT AS position, s.path, s.is_test, s.band, round(s.score, 6) AS score, coalesce(tags, '') AS tags
FROM (SELECT * FROM {source} ORDER BY score DESC, path {limit}) s LEFT JOIN ({_TAGS_OF}) t USING (path)""", "scores", source)


def _hotspot_rows(rows: DataFrame) -> DataFrame:
    return rows.select("position", "path", "is_test", "band", *r6("score"), F.array_join("tags", ", ").alias("tags"))


@query(_hotspot_sql("production", "LIMIT 5"))
def hotspots_top5(b: Binding) -> DataFrame:
    return _hotspot_rows(reports.hotspots(b.scores()))


@query(_hotspot_sql("scores", ""))
def hotspots_all_with_tests(b: Binding) -> DataFrame:
    return _hotspot_rows(reports.hotspots(b.stored_scores(), include_tests=True, top=None))


_PHRASE_SQL = "CASE " + " ".join(
    f"WHEN t1 = '{a}' AND t2 = '{c}' THEN '{text}'" for (a, c), text in S.PHRASES.items() if c) + " " + " ".join(
    f"WHEN t1 = '{a}' THEN '{text}'" for (a, c), text in S.PHRASES.items() if c is None) + " END"


@query(sql(f"""
SELECT path, coalesce(tags, '') AS tags, {_PHRASE_SQL} AS phrase FROM (
  SELECT path, tags, string_split(tags, ', ')[1] AS t1, string_split(tags, ', ')[2] AS t2 FROM scores LEFT JOIN ({_TAGS_OF}) USING (path))""", "scores"))
def hotspot_tags(b: Binding) -> DataFrame:
    return reports.with_tags(b.scores()).select("path", F.array_join("tags", ", ").alias("tags"), "phrase")


@query("""
SELECT row_number() OVER (ORDER BY first)::INT AS position, event_type AS code, message FROM (
  SELECT props AS message, min(event_id) AS first, arg_min(event_type, event_id) AS event_type FROM events GROUP BY props)""")
def limitations_dedup(b: Binding) -> DataFrame:
    return reports.first_messages(b.table("events").select(F.col("event_type").alias("code"), F.col("props").alias("message"), "event_id"), ["event_id"])


_N_OF = "(SELECT {0} AS k, count(*) AS n FROM {1} GROUP BY 1)"


@query(sql(f"""
SELECT f.path, f.package, s.rank, round(s.score, 6) AS score, coalesce(o.n, 0) AS owners, least(coalesce(p.n, 0), 10) AS partners, coalesce(i.n, 0) AS imports,
       coalesce(e.n, 0) AS outbound, coalesce(t.n, 0) - coalesce(w.n, 0) AS inbound,
       CASE WHEN s.path IS NULL THEN concat_ws(',', CASE WHEN f.language IS NULL THEN 'unsupported_language' END, CASE WHEN f.is_generated OR f.is_vendor THEN 'generated_or_vendor_excluded' END) END AS unavailable
FROM facts f LEFT JOIN scores s ON s.path = f.path LEFT JOIN {_N_OF.format("path", "owners")} o ON o.k = f.path LEFT JOIN {_N_OF.format("path", "partners")} p ON p.k = f.path
LEFT JOIN {_N_OF.format("source_path", "imports")} i ON i.k = f.path LEFT JOIN {_N_OF.format("source_path", "edges")} e ON e.k = f.path
LEFT JOIN {_N_OF.format("target_package", "edges")} t ON t.k = f.package LEFT JOIN (SELECT DISTINCT source_path, target_package, 1 AS n FROM edges) w ON w.source_path = f.path AND w.target_package = f.package""",
    "facts", "scores", "owners", "partners", "imports", "edges"))
def explain_files(b: Binding) -> DataFrame:
    """Every file explained at once."""
    row = b.explained(importers=3)
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(a[c])
    a = {"owners": "owners", "cochange_partners": "partners", "references": "imports", "outbound": "outbound"}
    return row.select("path", "package", "score.rank", F.round("score.score", 6).alias("score"), *[n(c) for c in a], F.col("inbound_count").alias("inbound"),
                      F.array_join("unavailable", ",").alias("unavailable"))


@query(sql("SELECT * FROM churn", "churn"))
def delta_merge(b: Binding) -> DataFrame:
    """The history in two halves, each aggregated alone and then merged."""
    from churnscope.streaming.ingest import CHURN_SUMS

    changes, commits, head = b.changes(), b.commits(), b.head()
    half = lambda test: C.churn(changes, commits.where(test), head)
    early = F.col("ts") < 1_100_000_000
    return N.upsert_accumulate(half(early), half(~early), ["path"], sums=CHURN_SUMS, lows=["first_ts"], highs=["last_ts"])


def _two_scans(b: Binding) -> tuple[DataFrame, DataFrame]:
    """Files of a first scan, and of a second in which every third size has changed and every fifth file is gone."""
    first = b.parts().select("p_partkey", "path", (F.col("p_retailprice") * 100).cast("bigint").alias("byte_size"), F.col("p_size").cast("bigint").alias("mtime_ms"),
                             F.lit(1).alias("active_scan_id"), F.lit(True).alias("is_active"))
    second = first.where("p_partkey % 5 <> 0").withColumns({
        "byte_size": F.col("byte_size") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0), "active_scan_id": F.lit(2)})
    return first, second


_SCANS = """first AS (SELECT p_partkey, path, trunc(p_retailprice * 100)::BIGINT AS byte_size FROM parts),
second AS (SELECT p_partkey, path, byte_size + (p_partkey % 3 = 0)::INT AS byte_size FROM first WHERE p_partkey % 5 <> 0)"""


def _scan_sql(select: str) -> str:
    head, _, _ = sql("SELECT 1", "parts").rpartition("\n")
    return f"{head},\n{_SCANS}\n{select}"


@query(_scan_sql("SELECT path, coalesce(s.byte_size, f.byte_size) AS byte_size, CASE WHEN s.path IS NULL THEN 1 ELSE 2 END AS active_scan_id FROM first f LEFT JOIN second s USING (path)"))
def snapshot_upsert(b: Binding) -> DataFrame:
    first, second = _two_scans(b)
    return N.upsert_replace(first, second, ["path"]).select("path", "byte_size", "active_scan_id")


@query(_scan_sql("SELECT path, s.path IS NOT NULL AS is_active FROM first f LEFT JOIN second s USING (path)"))
def soft_delete(b: Binding) -> DataFrame:
    first, second = _two_scans(b)
    return N.soft_delete(N.upsert_replace(first, second, ["path"]), 2).select("path", "is_active")


@query(_scan_sql("SELECT s.path, s.byte_size = f.byte_size AS reused FROM second s JOIN first f USING (path)"))
def file_reuse(b: Binding) -> DataFrame:
    first, second = _two_scans(b)
    reused = N.reusable(second, first).select("path", F.lit(True).alias("reused"))
    return reused.unionByName(N.to_analyze(second, first).select("path", F.lit(False).alias("reused")))


#: Columns of a folded run by DuckDB type, and each kind's update of the state ``s`` by the event ``e``.
_RUN = {c: "BIGINT" for c in (*E.COUNTS, *E.PLANNED)} | {c: "DOUBLE" for c in E.TIMES} | {c: "BOOLEAN" for c in E.FLAGS} | {"index_action": "VARCHAR", "last_seq": "BIGINT", "restarts": "BIGINT"}
_PROCESSED = "greatest(s.commits_processed, e.n)"
_SETTLED = f"CASE WHEN s.index_action IS DISTINCT FROM 'reused' AND s.commits_total IS NOT NULL THEN {_PROCESSED} ELSE s.commits_total END"
_FOLD = {
    "files_found": {"walk_progress": "e.files", "walk_done": "e.files", "scan_done": "e.files", "file_found": "s.files_found + 1"},
    "entries_walked": {"walk_progress": "e.n", "walk_done": "e.n"},
    "files_analyzed": {"file_analyzed": "greatest(s.files_analyzed, e.files)", "scan_done": "e.m"},
    "commits_processed": {"chunk_done": "s.commits_processed + e.n", "history_done": _PROCESSED, "scan_done": _PROCESSED, "history_skipped": "0"},
    "file_changes": {"chunk_done": "s.file_changes + e.m"},
    "records_stored": {k: "greatest(s.records_stored, e.n)" for k in ("batch_stored", "store_done")},
    "files_total": {k: "e.files" for k in ("files_counted", "walk_done", "scan_done")},
    "commits_total": {"history_planned": "e.n", "history_skipped": "CASE WHEN s.index_action = 'reused' THEN s.commits_total ELSE 0 END", "history_done": _SETTLED, "scan_done": _SETTLED},
    "chunks_total": {"history_planned": "e.m", "history_skipped": "CASE WHEN s.index_action = 'reused' THEN s.chunks_total ELSE 0 END"},
    "records_planned": {"records_planned": "greatest(coalesce(s.records_planned, 0), e.n)"} | {k: "greatest(coalesce(s.records_planned, 0), 2 * e.files)" for k in ("files_counted", "walk_done")},
    "walk_time": {k: "e.elapsed" for k in ("walk_progress", "walk_done")},
    "analysis_time": {"file_analyzed": "greatest(s.analysis_time, e.elapsed)"},
    "history_time": {k: "greatest(s.history_time, e.elapsed)" for k in ("chunk_done", "chunk_failed", "history_done")},
    "store_time": {k: "greatest(s.store_time, e.elapsed)" for k in ("batch_stored", "store_done")},
    "total_time": {k: "greatest(s.total_time, e.elapsed)" for k in ("walk_progress", "walk_done", "file_analyzed", "chunk_done", "chunk_failed", "history_done", "batch_stored", "store_done", "files_counted", "scan_done")},
    "history_done": {"history_planning": "false", "history_planned": "s.history_done OR e.n = 0"} | {k: "true" for k in ("history_skipped", "history_done", "scan_done")},
    "history_skipped": {"history_planning": "false", "history_skipped": "s.history_skipped OR s.index_action IS DISTINCT FROM 'reused'"},
    "store_done": {"store_done": "true", "scan_done": "true"}, "done": {"scan_done": "true"}, "index_action": {"history_status": "e.note"},
    "last_seq": {}, "restarts": {},
}
_NOTHING = {"BIGINT": "0", "DOUBLE": "0", "BOOLEAN": "false", "VARCHAR": "NULL"}


def _field(c: str) -> str:
    if c == "last_seq":
        return "last_seq := e.last_seq"
    if c == "restarts":
        return "restarts := s.restarts + (e.kind = 'scan_started')::BIGINT"
    start = f"CAST({'NULL' if c in E.PLANNED else _NOTHING[_RUN[c]]} AS {_RUN[c]})"
    return f"{c} := CAST(CASE e.kind WHEN 'scan_started' THEN {start} " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in _FOLD[c].items()) + f" ELSE s.{c} END AS {_RUN[c]})"


_EVENT = "kind, files, n, m, elapsed, note"
_START = ", ".join(f"{c} := CAST({'NULL' if c in E.PLANNED else _NOTHING[t]} AS {t})" for c, t in _RUN.items())


@query(f"""
WITH k AS (SELECT list_value({", ".join(f"'{k}'" for k in E.KINDS)}) AS kinds),
e AS (SELECT (user_id % 40)::VARCHAR AS run, event_id AS last_seq, CASE WHEN event_id % 101 = 0 THEN kinds[1] ELSE kinds[(event_id % 16 + 2)::INT] END AS kind, event_id % 50 AS files, event_id % 31 AS n,
             event_id % 13 AS m, (event_id % 97)::DOUBLE AS elapsed, CASE WHEN event_id % 3 = 0 THEN 'reused' ELSE 'fully_rebuilt' END AS note FROM events, k),
l AS (SELECT run, list({{{", ".join(f"'{c}': " + ("last_seq" if c == "last_seq" else f"CAST(NULL AS {t})") for c, t in _RUN.items())}, {", ".join(f"'{c}': {c}" for c in _EVENT.split(", "))}}} ORDER BY last_seq) AS es FROM e GROUP BY run),
f AS (SELECT run, list_reduce(es, lambda s, e: struct_pack({", ".join(map(_field, _RUN))}, {", ".join(f"{c} := e.{c}" for c in _EVENT.split(", "))}),
             struct_pack({_START}, kind := '', files := 0::BIGINT, n := 0::BIGINT, m := 0::BIGINT, elapsed := 0::DOUBLE, note := '')) AS s FROM l)
SELECT run, {", ".join(f"s.{c} AS {c}" for c in _RUN)} FROM f""")
def event_state_fold(b: Binding) -> DataFrame:
    """Events of all 17 kinds in turn, with a new start now and then."""
    kinds, e = list(E.KINDS), F.col("event_id")
    kind = F.when(e % 101 == 0, kinds[0]).otherwise(F.get(F.array(*map(F.lit, kinds)), (e % 16 + 1).cast("int")))
    note = F.when(e % 3 == 0, "reused").otherwise("fully_rebuilt")
    return E.fold_batch(b.table("events").select(
        (F.col("user_id") % 40).cast("string").alias("run"), e.alias("seq"), kind.alias("kind"), (e % 50).alias("files"), (e % 31).alias("n"), (e % 13).alias("m"),
        (e % 97).cast("double").alias("elapsed"), note.alias("note")))


@query("""
SELECT event_id, CASE WHEN v <= 10 THEN 1.0::DOUBLE ELSE round(greatest(sqrt(10.0::DOUBLE / v), 0.1::DOUBLE), 6) END AS bulk_weight,
       CASE WHEN v <= 0 THEN 0.0::DOUBLE WHEN v = 1 THEN 0.25::DOUBLE WHEN v = 2 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS sustained,
       ceil(v * 5 / 100.0)::BIGINT AS line_floor,
       CASE WHEN v >= 4 AND 4 * v >= v AND v >= 3 THEN true ELSE false END AS merge_heavy,
       strftime(make_timestamp(v * 1000000 * 86400), '%Y-%m-%dT%H:%M:%SZ') AS day
FROM (SELECT event_id, trunc(abs(value))::BIGINT AS v FROM events)""")
def history_functions(b: Binding) -> DataFrame:
    v = F.abs("value").cast("bigint")
    return b.table("events").select("event_id", v.alias("v")).select(
        "event_id", F.round(H.bulk_weight(F.col("v")), 6).alias("bulk_weight"), H.sustained_activity_weight(F.col("v")).alias("sustained"),
        H.ceil_div(F.col("v") * 5, 100).alias("line_floor"), H.merge_heavy(F.col("v"), F.col("v"), F.col("v")).alias("merge_heavy"),
        S.utc_iso8601(F.col("v") * 86_400).alias("day"))
