"""Secret scans with corpus-wide ownership frequency.

Candidates are found by built-in regular expressions in whole texts. Their hashes
are counted by distinct repositories and owners over the corpus: a value that many
owners hold, or a few owners in many repositories, is a copied example; one that keeps
to its owner looks live, in however many of the owner's repositories it is. Base spans
always stand; looser candidates become spans only where they look live.

Defined results: a null or empty text has no spans. Spans count code points, ends
exclusive; those that start together go in the order of kinds. Rows with equal doc_id
and text are treated alike and counted once per owner; a null owner is an owner, a null
doc_id an id. Texts of any length are scanned whole, in time in proportion to their
length and matches. An empty table gives an empty result. All other columns pass
through; the result's name can be chosen, and a column of that name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import fresh, let, materialize, running, spread_join, text_or_empty


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the secret, its least length and what it must hold."""

    name: str
    pattern: str
    group: int
    least: int
    needs: tuple[str, ...] = ()
    base: bool = True


#: Base kinds in the order in which ties are listed, then looser ones.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    Kind("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    Kind("hex", r"([0-9a-f]{24,})", 1, 24),
    Kind("mixed", r"([A-Za-z0-9+/_-]{24,})", 1, 24, needs=("[0-9]", "[A-Z]", "[a-z]"), base=False),
)


@dataclass(frozen=True)
class Sharing:
    """A value is an example if ``owners`` or more hold it, or if ``few`` or more hold it in ``repos`` repositories."""

    owners: int = 3
    few: int = 2
    repos: int = 4

    def is_example(self, owners: Column, repos: Column) -> Column:
        return (owners >= self.owners) | ((owners >= self.few) & (repos >= self.repos))


_SPAN = "array<struct<start:bigint,kind_order:int,kind:string,stop:bigint,secret:string>>"


def _spans_of_kind(text: Column, order: int, kind: Kind) -> Column:
    """Leftmost non-overlapping matches with their places.

    Splitting at the pattern gives what lies between the matches, so running
    lengths of gaps and matches are the places.
    """
    rx = F.lit(kind.pattern)

    def located(gaps: Column, whole: Column, secrets: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("bigint"))
        ends = running(sizes, lambda a, b: a + b, 0)
        spans = F.zip_with(F.arrays_zip(ends.alias("stop"), whole.alias("m")), secrets, lambda p, s: F.struct(
            (p["stop"] - F.char_length(p["m"])).alias("start"), F.lit(order).alias("kind_order"), F.lit(kind.name).alias("kind"), p["stop"].alias("stop"), s.alias("secret")))

        def stands(x: Column) -> Column:
            test = F.char_length(x["secret"]) >= kind.least
            for need in kind.needs:
                test = test & x["secret"].rlike(need)
            return test

        return F.filter(spans, stands)

    found = located(F.split(text, kind.pattern, -1), F.regexp_extract_all(text, rx, F.lit(1)), F.regexp_extract_all(text, rx, F.lit(kind.group)))
    return F.when(text.rlike(kind.pattern), found).otherwise(F.array().cast(_SPAN))


def _outside(spans: Column, base_kinds: int) -> Column:
    """Spans in order, looser ones only if they touch no base span.

    A looser span touches one that began before it if the furthest base end so far lies
    behind its start, and a later one if the next base start lies before its end.
    """
    is_base = lambda x: x["kind_order"] < base_kinds
    far = 1 << 62

    def kept(s: Column) -> Column:
        ends = running(F.transform(s, lambda x: F.when(is_base(x), x["stop"]).otherwise(0)), F.greatest, 0)
        starts = F.reverse(running(F.reverse(F.transform(s, lambda x: F.when(is_base(x), x["start"]).otherwise(far))), F.least, far))
        return let(ends, lambda e: let(starts, lambda b: F.filter(s, lambda x, i: is_base(x) | (
            (F.get(e, i) <= x["start"]) & (F.get(b, i) >= x["stop"])))))

    return let(F.array_sort(spans), lambda s: F.when(F.exists(s, lambda x: ~is_base(x)), kept(s)).otherwise(s))


def candidate_spans(text: Column, kinds=KINDS) -> Column:
    """All candidates of a text in order of start, then kind; looser ones only outside base spans."""
    ordered = sorted(kinds, key=lambda k: not k.base)
    return let(text_or_empty(text), lambda t: _outside(
        F.concat(*[_spans_of_kind(t, i, k) for i, k in enumerate(ordered)]), sum(k.base for k in ordered)))


def ownership(candidates: DataFrame, sharing: Sharing = Sharing()) -> DataFrame:
    """Per secret hash: rows, distinct owners and repositories, and whether it is an example.

    First distinct (hash, owner, repository) with partial aggregation, so that a
    value copied into a third of all rows is a few rows before any shuffle by hash.
    """
    distinct = candidates.groupBy("secret_hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = distinct.groupBy("secret_hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("secret_hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("_n")).withColumn(
        "is_example", sharing.is_example(F.col("n_owners"), F.col("n_repos")))


def scan_secrets(docs: DataFrame, owner: Column, repo: Column, kinds=KINDS, sharing: Sharing = Sharing(), into: str = "_secrets") -> DataFrame:
    """``docs`` with ``into``: an array of (start, kind_order, kind, stop, is_example).

    Only rows with candidates take part in the counting; they go by keys of document
    and text hash. Rows of hot values are spread when the counts are joined back.
    """
    key = (F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text_or_empty(F.col("text"))))
    found = materialize(
        docs.select(key[0].alias("_doc"), key[1].alias("_text"), owner.alias("owner"), repo.alias("repo"),
                    candidate_spans(F.col("text"), kinds).alias("spans")).where(F.size("spans") > 0), "candidates")
    each = found.select("_doc", "_text", "owner", "repo", F.explode("spans").alias("s")).select(
        "_doc", "_text", "owner", "repo", "s.start", "s.kind_order", "s.kind", "s.stop",
        F.struct(F.xxhash64("s.secret").alias("hash"), F.octet_length("s.secret").alias("size")).alias("secret_hash"))
    held = materialize(ownership(each, sharing).select("secret_hash", "is_example", "_n"), "held")
    judged = spread_join(each.drop("owner", "repo").distinct(), held.drop("_n"), "secret_hash", "_text", counts=held.select("secret_hash", "_n"))
    loose = [k.name for k in kinds if not k.base]
    stands = ~F.col("kind").isin(*loose) | ~F.col("is_example") if loose else F.lit(True)
    a, b, spans_of = (fresh(docs.columns, n) for n in ("_span_doc", "_span_text", "_spans"))
    spans = judged.where(stands).groupBy(F.col("_doc").alias(a), F.col("_text").alias(b)).agg(
        F.array_sort(F.collect_list(F.struct("start", "kind_order", "kind", "stop", "is_example"))).alias(spans_of))
    empty = F.array().cast("array<struct<start:bigint,kind_order:int,kind:string,stop:bigint,is_example:boolean>>")
    return docs.join(materialize(spans, "spans"), (key[0] == F.col(a)) & (key[1] == F.col(b)), "left").drop(a, b).withColumn(
        into, F.coalesce(F.col(spans_of), empty)).drop(spans_of)


def listed(spans: Column) -> Column:
    """kind:start:stop of spans in order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column, block: int = 256) -> Column:
    """The text with each run of overlapping spans replaced by one mark.

    The text is cut in two steps, first for each ``block`` spans: taking a substring
    walks from the beginning of the string.
    """
    cut = lambda t, start, stop: F.substring(t, (start + 1).cast("int"), (stop - start).cast("int"))
    mark = lambda x: F.concat(F.lit("<"), F.when(x["is_example"], F.lit("example")).otherwise(F.lit("secret")), F.lit(">"))

    def pieces(t: Column, s: Column, ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0).cast("bigint"))

        def of_block(k: Column) -> Column:
            first, last = k * block, F.least((k + 1) * block, F.size(s)) - 1
            return let(before(first), lambda at: let(cut(t, at, F.get(ends, last)), lambda part: F.array_join(F.transform(
                F.sequence(first, last), lambda i: let(F.get(s, i), lambda x: F.when(x["start"] < before(i), F.lit("")).otherwise(
                    F.concat(cut(part, before(i) - at, x["start"] - at), mark(x))))), "")))

        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int")), of_block)
        return F.concat(F.array_join(blocks, ""), F.substring(t, (F.get(ends, F.size(s) - 1) + 1).cast("int"), F.lit(2**31 - 1)))

    return F.when(F.size(spans) == 0, text).otherwise(let(text_or_empty(text), lambda t: let(spans, lambda s: let(
        running(F.transform(s, lambda x: x["stop"]), F.greatest, 0), lambda ends: pieces(t, s, ends)))))


def secrets_stage(docs: DataFrame) -> DataFrame:
    """All documents, with secrets taken out of their texts; n_chars follows if it is there."""
    columns, found = docs.columns, fresh(docs.columns, "_secrets")
    clean = scan_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"), into=found).withColumn("text", redacted(F.col("text"), F.col(found)))
    if "n_chars" in columns:
        clean = clean.withColumn("n_chars", F.when(F.size(found) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*[F.col(f"`{c}`") for c in columns])
