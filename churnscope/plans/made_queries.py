"""Queries over rows made from the evaluation tables so that every branch is taken.

The tables themselves hold no binary contents, renames, broken records or missing
metrics; here they are made from keys, and the SQL twins say what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.functions import history as H
from churnscope.functions import paths as P
from churnscope.functions import scoring as S
from churnscope.functions import text as X
from churnscope.operators import changes as C
from churnscope.operators import risk as R
from churnscope.operators import snapshots as N
from churnscope.plans.binding import Binding, sql
from churnscope.plans.queries import query
from churnscope.sources import git_log
from churnscope.sources.parsers import parse_files


def _case(key: str, *values) -> Column:
    """The value whose place is the key modulo their number."""
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


@query("""
SELECT p_partkey, k % 3 <> 2 AS inside, CASE WHEN k % 3 <> 2 THEN 'src/' || p_partkey || '.go' END AS relative,
       CASE WHEN k % 4 = 3 THEN '.' ELSE 'b' || p_size || '/x' END AS package,
       CASE k % 5 WHEN 0 THEN 'pre/old_' || k || '/f.go' WHEN 1 THEN 'old_' || k WHEN 2 THEN 'pre/f.go' WHEN 3 THEN 'pre/o/f.go' END AS old_path,
       CASE k % 5 WHEN 0 THEN 'pre/new_' || k || '/f.go' WHEN 1 THEN 'new_' || k WHEN 2 THEN 'pre/n/f.go' WHEN 3 THEN 'pre/f.go' ELSE 'plain/' || k || '.go' END AS new_path,
       CASE WHEN k % 2 = 0 THEN 'a/b' || k END AS change_path
FROM (SELECT *, p_partkey AS k FROM part)""")
def path_functions(b: Binding) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    full = F.concat(_case("p_partkey", "/repo/", "/repo/", "/elsewhere/"), F.lit("src/"), k, F.lit(".go"))
    package = F.when(F.col("p_partkey") % 4 == 3, "  // ").otherwise(F.concat(F.lit("  /b"), F.col("p_size").cast("string"), F.lit("\\x/ ")))
    raw = _case("p_partkey", F.concat(F.lit("pre/{old_"), k, F.lit(" => new_"), k, F.lit("}/f.go")), F.concat(F.lit("old_"), k, F.lit(" => new_"), k),
                "pre/{ => n}/f.go", "pre/{o => }/f.go", F.concat(F.lit("plain/"), k, F.lit(".go")))
    sides = P.rename_sides(raw)
    return b.table("part").select(
        "p_partkey", P.relative_path("/repo", full).isNotNull().alias("inside"), P.relative_path("/repo/", full).alias("relative"),
        P.normalize_package_path(package).alias("package"), sides["old_path"].alias("old_path"), sides["path"].alias("new_path"),
        P.normalize_change_path(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a\\b"), k)).otherwise("")).alias("change_path"))


@query("""
SELECT l_orderkey || '-' || l_linenumber AS commit_id, 'A <a' || l_orderkey || '>' AS author, l_orderkey AS ts, 1 + (l_linenumber % 2) AS parent_count,
       CASE WHEN l_linenumber <> 4 THEN 'f' || l_partkey END AS path, sum(CASE l_linenumber WHEN 4 THEN NULL WHEN 3 THEN 0 ELSE l_quantity::BIGINT END)::BIGINT AS added,
       sum(CASE WHEN l_linenumber <> 4 THEN l_suppkey END)::BIGINT AS deleted FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL""")
def history_records(b: Binding) -> DataFrame:
    """Log records of one change each; from the sixth on times are broken, and binary or short lines come among them."""
    text = lambda c: F.col(c).cast("string")
    name = F.concat(text("l_orderkey"), F.lit("-"), text("l_linenumber"))
    ts = F.when(F.col("l_linenumber") < 6, text("l_orderkey")).otherwise("soon")
    added = F.when(F.col("l_linenumber") == 3, "-").otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    line = F.when(F.col("l_linenumber") == 4, F.concat(added, F.lit("\tf"))).otherwise(F.concat(added, F.lit("\t"), text("l_suppkey"), F.lit("\tf"), text("l_partkey")))
    record = F.concat(F.lit("\x1e"), name, F.lit("\x1f"), F.when(F.col("l_linenumber") % 2 == 1, "p q").otherwise("p"), F.lit("\x1fA <a"), text("l_orderkey"), F.lit(">\x1f"), ts, F.lit("\n\n"), line, F.lit("\n"))
    commits, changes = git_log.parse_records(b.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), record.alias("record")))
    commits = commits.select("commit_id", "author", "ts", "parent_count").distinct()
    return commits.join(C.collapse(changes), "commit_id", "left").select("commit_id", "author", "ts", "parent_count", "path", "added", "deleted")


@query("""
SELECT event_id, CASE WHEN e % 5 = 0 THEN 'absent' WHEN e % 3 = 0 THEN 'incremental' WHEN e % 4 < 3 THEN ['full', 'bounded', 'incremental'][e % 4 + 1] ELSE 'first_parent_only' END AS history,
       CASE WHEN e % 3 = 0 THEN 'incremental' ELSE 'full' END AS scan_type, CASE e % 4 WHEN 0 THEN 'churn' WHEN 1 THEN 'complexity' WHEN 2 THEN 'cochange' END AS driver,
       e % 4 < 2 AND e % 5 <> 0 AS reliable, CASE WHEN e % 3 = 0 THEN 'incremental' WHEN e % 2 = 0 THEN 'bounded' ELSE 'first_parent_only' END AS confidence,
       (e % 11 >= 4 AND e % 7 >= 3 AND 4 * (e % 7) >= e % 11) OR (e % 23 >= e % 11 + 3 AND 4 * (e % 23) >= 5 * greatest(e % 11, 1)) AS merge_heavy,
       CASE WHEN e % 6 = 0 THEN (e % 100)::DOUBLE ELSE (e % 100) / (e % 6 / 4.0::DOUBLE) END AS rate, format('{:.3f}', value::DOUBLE) AS shown
FROM (SELECT *, event_id::BIGINT AS e FROM events)""")
def scan_status_functions(b: Binding) -> DataFrame:
    e = F.col("event_id")
    status, action = F.when(e % 5 == 0, "unavailable").otherwise("available"), F.when(e % 3 == 0, _case("event_id", "reused", "incrementally_updated")).otherwise("fully_rebuilt")
    history = S.git_history(status, _case("event_id", "full", "bounded", "incremental", "odd"), action)
    return b.table("events").select(
        "event_id", history.alias("history"), S.scan_type(action).alias("scan_type"),
        S.primary_driver(F.when(e % 8 == 4, "recent_churn").otherwise(_case("event_id", "churn", "complexity_pressure", "cochange_pressure", "size"))).alias("driver"),
        S.is_reliable(_case("event_id", "high", "medium", "low", "none"), history).alias("reliable"),
        H.history_confidence(F.when(e % 3 == 0, _case("event_id", "incremental", "up_to_date")).otherwise("full"), e % 2 == 0).alias("confidence"),
        H.merge_heavy(e % 11, e % 23, e % 7).alias("merge_heavy"), S.rate(e % 100, (e % 6) / 4.0).alias("rate"), S.fixed(F.col("value").cast("double"), 3).alias("shown"))


@query("""
SELECT event_id, '[{"code":"a","message":"' || event_type || '"}' || CASE WHEN event_id % 2 = 1 THEN ',{"code":"b","message":"m"}' ELSE '' END || ']' AS stored,
       CASE event_id % 3 WHEN 0 THEN 'invalid_diagnostics_json' WHEN 1 THEN 'a' ELSE '' END AS codes FROM events""")
def diagnostics_json(b: Binding) -> DataFrame:
    """Notes encoded once each; decoded from good, partly bad and broken texts."""
    note = lambda code, message: F.struct(F.lit(code).alias("code"), message.alias("message"))
    same, other = note("a", F.col("event_type")), note("b", F.lit("m"))
    stored = X.diagnostics_json(F.concat(F.array(same), F.when(F.col("event_id") % 2 == 1, F.array(other, other)).otherwise(F.array(same))))
    given = _case("event_id", "not json", '[{"code":"a","message":"m"},{"code":"b"}]', '[{"message":"m"}]')
    return b.table("events").select("event_id", stored.alias("stored"), F.array_join(F.transform(X.diagnostics_from_json(given), lambda x: x["code"]), ",").alias("codes"))


@query("""
SELECT doc_id, CASE WHEN text IS NULL THEN 'unknown' WHEN doc_id % 3 = 0 OR contains(text, chr(0)) THEN 'binary' WHEN doc_id % 3 = 1 THEN 'unknown' ELSE 'text' END AS content_kind FROM documents""")
def content_kinds_made(b: Binding) -> DataFrame:
    tail = F.when(F.col("doc_id") % 3 == 0, F.lit(bytearray(b"\0\xff"))).when(F.col("doc_id") % 3 == 1, F.lit(bytearray(b"\xff"))).otherwise(F.lit(bytearray(b".")))
    return b.table("documents").select("doc_id", X.content_kind(F.concat(F.col("text").cast("binary"), tail)).alias("content_kind"))


@query("""
SELECT p_partkey, p_partkey % 6 IN (0, 1, 2) AS is_vendor, p_partkey % 6 IN (3, 4, 5) AND p_partkey % 2 = 1 AS is_generated, p_partkey % 6 = 4 AS is_test FROM part""")
def path_flags_made(b: Binding) -> DataFrame:
    path = _case("p_partkey", "A/Vendor/x.go", "node_modules/x.js", "third_party/y/z.c", "a/Build/x.go", "vendored/x_TEST.go", "a/x.gen.rs")
    return b.table("part").select("p_partkey", P.is_vendor(path).alias("is_vendor"), P.is_generated_path(path).alias("is_generated"), P.is_test(path).alias("is_test"))


@query("SELECT count(*) AS automated_authors FROM (SELECT DISTINCT s_suppkey FROM supplier) WHERE s_suppkey % 5 < 3")
def automated_authors_made(b: Binding) -> DataFrame:
    name = F.concat(_case("s_suppkey", "Dependa-BOT ", "Automation ", "x@NoReply ", "Ann ", "Bo "), F.col("s_suppkey").cast("string"))
    return C.automated_authors(b.table("supplier").select(name.alias("author")))


@query("""
SELECT p_partkey, f + 1 AS function_count, p_partkey % 2 AS method_count, 3 AS type_count, d AS import_count, f + 1 + p_partkey % 2 + 3 AS symbol_count,
       (f + 1) * (d * (d + 1) // 2 + 2) + (p_partkey % 2) * 5 AS complexity, greatest(d * (d + 1) // 2 + 2, (p_partkey % 2) * 5) AS max_function_complexity,
       CASE WHEN d = 0 THEN '' WHEN d = 1 THEN 'fmt' WHEN d = 2 THEN 'fmt,app/x' ELSE 'fmt,app/x,os' END AS imports
FROM (SELECT *, p_size % 3 AS f, p_partkey % 4 AS d FROM part)""")
def go_structure(b: Binding) -> DataFrame:
    """Go sources made from keys: imports, functions with nested branches and a loop with ``&&``, a method with a switch."""
    part, empty = b.spread("part", "p_partkey"), F.lit("")
    times = lambda n, text: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(i < n, text(i)).otherwise(empty)), "")
    d, f = F.col("p_partkey") % 4, F.col("p_size") % 3
    imports = F.when(d == 0, empty).otherwise(F.concat(F.lit('import (\n\t"fmt"\n'), F.when(d > 1, '\tx "app/x"\n').otherwise(empty), F.when(d > 2, "\t`os`\n").otherwise(empty), F.lit(")\n")))
    body = F.concat(times(d, lambda i: F.lit("if a {\n")), times(d, lambda i: F.lit("}\n")), F.lit("for b && a {\n}\n"))
    functions = times(f + 1, lambda i: F.concat(F.lit("func F"), i.cast("string"), F.lit("(a, b bool) {\n"), body, F.lit("}\n")))
    method = F.when(F.col("p_partkey") % 2 == 1, "func (t *T) M(n int) {\nswitch n {\ncase 1:\ncase 2:\n}\n}\n").otherwise(empty)
    source = F.concat(F.lit("package p\n// if x { for {} }\n"), imports, F.lit("type T struct{}\ntype (\n\tI interface{ A() }\n\tN int\n)\ntype Z = T\n"), functions, method, F.lit('var s = "func if {"\n'))
    rows = parse_files(part.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"), source.cast("binary").alias("content"), F.lit(False).alias("truncated")))
    return rows.select(F.regexp_extract("path", r"^\d+", 0).cast("bigint").alias("p_partkey"), "function_count", "method_count", "type_count", "import_count", "symbol_count",
                       "complexity", "max_function_complexity", F.array_join("imports", ",").alias("imports"))


@query("""
SELECT p_partkey, CASE k % 6 WHEN 5 THEN 'unsupported' ELSE 'parsed' END AS parser_status, 1 AS attempts, CASE WHEN k % 6 <> 5 THEN 'go' END AS language,
       CASE k % 6 WHEN 0 THEN 'truncated_source' WHEN 1 THEN 'unsupported_content_kind' WHEN 2 THEN 'invalid_utf8' WHEN 3 THEN 'parse_error' ELSE '' END AS notes
FROM (SELECT *, p_partkey AS k FROM part)""")
def parser_guards(b: Binding) -> DataFrame:
    """Sources that a parser can't take, each with its note."""
    content = _case("p_partkey", F.lit(bytearray(b"package p")), F.lit(bytearray(b"a\0b")), F.lit(bytearray(b"package \xff")), F.lit(bytearray(b"package p\nfunc f( {")), F.lit(bytearray(b"package p\n")), F.lit(bytearray(b"x")))
    path = F.concat(F.col("p_partkey").cast("string"), _case("p_partkey", ".go", ".GO", ".go", ".go", ".Go", ".rs"))
    rows = parse_files(b.spread("part", "p_partkey").select(path.alias("path"), content.alias("content"), (F.col("p_partkey") % 6 == 0).alias("truncated")))
    return rows.select(F.regexp_extract("path", r"^\d+", 0).cast("bigint").alias("p_partkey"), "parser_status", "attempts", "language",
                       F.array_join(F.transform("diagnostics", lambda x: x["code"]), ",").alias("notes"))


@query("""
SELECT CASE WHEN o_custkey % 3 = 0 THEN 'x' || o_custkey ELSE 'y' || o_custkey % 10 END AS author, min(o_orderkey % 2 = 0) AS old FROM orders GROUP BY 1""")
def authors_inserted_once(b: Binding) -> DataFrame:
    """Authors of odd orders, then those of even ones that are not among them."""
    name = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("y"), (F.col("o_custkey") % 10).cast("string")))
    rows = b.table("orders").select(name.alias("author"), (F.col("o_orderkey") % 2 == 0).alias("old"))
    return N.insert_ignore(rows.where("NOT old").distinct(), rows.where("old"), ["author"])


@query("""
SELECT source_path, idx, raw_target FROM (
  SELECT l_partkey AS source_path, l_suppkey AS idx, CASE WHEN l_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS raw_target, l_suppkey % 2 = 0 AS again FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))
WHERE raw_target = 'old' OR again""")
def children_replaced(b: Binding) -> DataFrame:
    """References of every third file are read again, half of them are gone."""
    old = b.table("lineitem").select(F.col("l_partkey").alias("source_path"), F.col("l_suppkey").alias("idx")).distinct().withColumn("raw_target", F.lit("old"))
    changed = old.where("source_path % 3 = 0")
    return N.replace_children(old, changed.where("idx % 2 = 0").withColumn("raw_target", F.lit("new")), changed, ["source_path"])


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 7 ELSE 1 END AS active_scan_id, p_partkey % 4 = 0 OR p_partkey % 3 = 0 AS is_active FROM part""")
def reused_rows_touched(b: Binding) -> DataFrame:
    rows = b.table("part").select("p_partkey", F.lit(1).alias("active_scan_id"), (F.col("p_partkey") % 3 == 0).alias("is_active"))
    return N.touch(rows, rows.where("p_partkey % 4 = 0"), ["p_partkey"], 7)


@query("""
SELECT CASE event_id % 4 WHEN 1 THEN 'gitX' WHEN 2 THEN 'files' ELSE 'agit_' END || event_id AS key FROM events WHERE event_id % 4 > 1""")
def metadata_family_cleared(b: Binding) -> DataFrame:
    """Keys of the history's family go; the pattern's underscore stands for any character."""
    key = F.concat(_case("event_id", "git_", "gitX", "files", "agit_"), F.col("event_id").cast("string"))
    return N.clear_family(b.table("events").select(key.alias("key"))).select("key")


@query("""
SELECT o_custkey, min(first_ts) AS first_ts, max(last_ts) AS last_ts, sum(n)::BIGINT AS n FROM (
  SELECT o_custkey, o_orderkey % 2 AS half, min(o_orderkey) FILTER (o_orderkey % 3 = 0) AS first_ts, max(o_orderkey) FILTER (o_orderkey % 3 = 0) AS last_ts, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def bounds_merged(b: Binding) -> DataFrame:
    """Bounds of two reads, either or both of which may be null."""
    ts = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey"))
    half = lambda k: b.table("orders").where(F.col("o_orderkey") % 2 == k).groupBy("o_custkey").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    return N.upsert_accumulate(half(0), half(1), ["o_custkey"], sums=["n"], lows=["first_ts"], highs=["last_ts"])


@query(sql("""
SELECT coalesce(sum(broad), 0)::BIGINT AS broad_commits, coalesce(max(most), 0)::BIGINT AS max_files, arg_min(widest, {'a': -most, 'b': widest}) AS broadest_commit FROM (
  SELECT commit_id % 7 AS chunk, count(*) FILTER (breadth > 5) AS broad, max(breadth) AS most, arg_min(commit_id, {'a': -breadth, 'b': commit_id}) AS widest FROM breadth GROUP BY 1)""", "breadth"))
def chunk_rollup(b: Binding) -> DataFrame:
    """Seven reads of the history, each with its broadest commit."""
    wide = C.breadth(b.changes()).groupBy(F.col("commit_id") % 7).agg(
        F.sum(F.when(F.col("breadth") > 5, 1).otherwise(0)).alias("broad_commits"), F.max("breadth").alias("max_files"),
        F.min_by("commit_id", F.struct(-F.col("breadth"), F.col("commit_id"))).alias("broadest_commit"))
    return C.chunk_rollup(wide)


@query(sql("""
SELECT (SELECT count(*) FROM churn) + (SELECT count(DISTINCT path) FROM accumulators WHERE changed_lines > 0) + 2 AS git_final_records, (SELECT count(*) FROM files) AS materialized_file_records""",
    "churn", "accumulators", "files"))
def planned_records(b: Binding) -> DataFrame:
    b.touched()
    return C.planned_records(b.churn(), b.accumulators(), b.files())


_MADE_FACTS = """
SELECT p_partkey::VARCHAR AS path, p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 0 ELSE p_size END AS line_count,
       CASE WHEN p_partkey % 2 = 0 THEN p_size END AS byte_size, p_size % 2 AS recent_churn, CASE WHEN p_partkey % 5 > 0 THEN 1 END AS complexity,
       CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS share, CASE WHEN p_partkey % 7 > 2 THEN 2 END AS owners FROM part"""


def _made_scores(b: Binding) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    zero = F.lit(0).cast("bigint")
    facts = b.table("part").select(
        k.cast("string").alias("path"), F.lit("p").alias("package"), F.lit("go").alias("language"), F.lit(False).alias("is_test"), F.lit(False).alias("is_generated"), F.lit(False).alias("is_vendor"),
        F.when(k % 3 == 1, 0).when(k % 3 == 2, size).alias("line_count"), F.when(k % 2 == 0, size).alias("byte_size"), F.when(k % 5 > 0, F.lit(1)).cast("bigint").alias("complexity"),
        F.lit(None).cast("bigint").alias("max_function_complexity"), zero.alias("total_churn"), (size % 2).alias("recent_churn"), zero.alias("co_changed_files"), zero.alias("coupling_in"), zero.alias("coupling_out"),
        F.when(k % 7 > 2, F.lit(2)).cast("bigint").alias("owner_count"), F.lit("o").alias("dominant_owner"),
        F.when(k % 4 == 1, F.lit(float("nan"))).when(k % 4 == 2, F.lit(1.5)).when(k % 4 == 3, F.lit(0.5)).alias("dominant_share"), F.lit(1).cast("bigint").alias("file_age_days"))
    context = b.spark.createDataFrame([(None, None, 5)], "repository_age_days long, repository_authors long, repository_files long")
    return R.file_scores(facts, context)


@query(f"""
WITH f AS ({_MADE_FACTS}),
c AS (SELECT path, unnest([
    CASE WHEN line_count IS NULL THEN CASE WHEN byte_size IS NOT NULL THEN 'size_uses_byte_size_fallback' ELSE 'missing_size_metric' END END,
    CASE WHEN line_count IS NULL THEN 'missing_recent_growth_line_count' WHEN line_count = 0 AND recent_churn > 0 THEN 'zero_line_count_recent_growth' END,
    CASE WHEN complexity IS NULL THEN 'missing_complexity_pressure' END,
    CASE WHEN isnan(share) THEN 'invalid_dominant_owner_share' WHEN share > 1 THEN 'dominant_owner_share_out_of_range' END,
    CASE WHEN owners IS NULL AND (share IS NULL OR isnan(share)) THEN 'missing_ownership_risk_metrics' WHEN share IS NULL OR isnan(share) THEN 'ownership_risk_missing_owner_share' WHEN owners IS NULL THEN 'ownership_risk_missing_owner_count' END,
    CASE WHEN NOT (owners IS NULL AND (share IS NULL OR isnan(share))) THEN 'ownership_risk_missing_repository_age' END,
    CASE WHEN NOT (owners IS NULL AND (share IS NULL OR isnan(share))) THEN 'ownership_risk_missing_repository_author_count' END]) AS code, generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) AS step FROM f)
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY step) - 1)::INT AS limitation_index, code FROM c WHERE code IS NOT NULL""")
def file_risk_limitations_made(b: Binding) -> DataFrame:
    """Files whose metrics are missing, broken or out of range."""
    return R.score_limitations(_made_scores(b)).select("path", "limitation_index", "code")


@query(sql("""
SELECT f.path, coalesce(o.x, '') AS owners, coalesce(p.x, '') AS partners, coalesce(i.x, '') AS imports, coalesce(e.x, '') AS outbound, coalesce(t.x, '') AS terms FROM files f
LEFT JOIN (SELECT path, string_agg(owner_rank || ':' || owner || ':' || touches, ',' ORDER BY owner_rank) AS x FROM owners GROUP BY path) o USING (path)
LEFT JOIN (SELECT path, string_agg(partner || ':' || pair_count, ',' ORDER BY n) AS x FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pair_count DESC, partner) AS n FROM partners) WHERE n <= 10 GROUP BY path) p USING (path)
LEFT JOIN (SELECT source_path AS path, string_agg(idx || ':' || raw_target || ':' || coalesce(resolved_package, '-'), ',' ORDER BY idx) AS x FROM resolved GROUP BY 1) i USING (path)
LEFT JOIN (SELECT source_path AS path, string_agg(target_package, ',' ORDER BY target_package) AS x FROM edges GROUP BY 1) e USING (path)
LEFT JOIN (SELECT path, string_agg(term, ',' ORDER BY term) AS x FROM terms GROUP BY path) t USING (path)""", "files", "owners", "partners", "resolved", "edges", "terms"))
def explain_lists(b: Binding) -> DataFrame:
    """What explain lists of every file, in its order."""
    row = b.explained(importers=3)
    joined = lambda c, *names: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[F.coalesce(x[n].cast("string"), F.lit("-")) for n in names])), ","), F.lit(""))
    return row.select("path", joined("owners", "owner_rank", "owner", "touches").alias("owners"), joined("cochange_partners", "partner", "pair_count").alias("partners"),
                      joined("references", "idx", "raw_target", "resolved_package").alias("imports"), joined("outbound", "target_package").alias("outbound"), joined("terms", "term").alias("terms"))
