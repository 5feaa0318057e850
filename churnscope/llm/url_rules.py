"""URL filters: fixed host and path rules first, then mined association rules.

FP-growth, stopped at the longest rule allowed, mines combinations of URL tokens that go
with a verdict in labelled URLs; all tokens of a URL take part. Rules are pruned by support, confidence and lift. At match time an inverted index
from token to rules finds the rules whose tokens a URL holds.

Defined results: a null or empty URL, or one without ``://``, has empty host and path,
no tokens and the default verdict. Several rules that fit alike go by length, then
name. A page with labels that contradict each other counts as blocked; labels without
id or verdict count for nothing. Repeated rows are judged alike, and each counts as a
labelled URL. Without labelled URLs nothing is mined; an empty table gives an empty
result. All other columns pass through; the result's name can be chosen, and a column
of that name is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import bound_batches, fresh, let, lower_az, materialize


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


BASE_RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)


@dataclass(frozen=True)
class MiningOptions:
    """A rule needs ``min_support`` of all labelled URLs, ``min_confidence`` and ``min_lift``.

    Rules have at most ``max_tokens`` tokens, and sets aren't grown beyond that. All tokens
    of a URL are mined: ``telling``, which once capped them, decides nothing any more.
    """

    min_support: float = 0.005
    min_confidence: float = 0.9
    min_lift: float = 1.2
    max_tokens: int = 3
    telling: int = 10


def host_and_path(url: Column) -> Column:
    """struct(host, path) as the text around the first ``://`` says."""
    def cut(u: Column) -> Column:
        at = F.locate("://", u)
        rest = F.when(at > 0, F.substring(u, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
        return let(rest, lambda r: F.struct(
            lower_az(F.regexp_extract(r, r"^([^/?#]*)", 1)).alias("host"),
            F.regexp_extract(r, r"^[^/?#]*([^?#]*)", 1).alias("path")))

    return let(F.coalesce(url, F.lit("")), cut)


def base_rule(host: Column, path: Column, rules=BASE_RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, nulls if none."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens with their place: host labels, path parts without numbers, query keys."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("p:"), x))
    query = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    bare = F.transform(F.split(F.regexp_replace(host, r"^.*?([^.]*-[^.]*).*$", "$1"), "-"), lambda x: F.concat(F.lit("w:"), x))
    return F.array_distinct(F.concat(F.when(host != "", labels).otherwise(F.array().cast("array<string>")), parts, query,
                                     F.when(host.contains("-"), bare).otherwise(F.array().cast("array<string>"))))


def _ranked(labelled: DataFrame, growing: list[str]) -> DataFrame:
    """Distinct rows (items, verdict) with their number ``n``: each row's tokens by their places in ``growing``, in order."""
    sent = labelled.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(growing)})

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = sent.value
        for batch in batches:
            yield pd.DataFrame({"items": [sorted(of[t] for t in tokens if t in of) for tokens in batch["tokens"]], "verdict": batch["verdict"]})

    return labelled.mapInPandas(rank, "items array<int>, verdict string").where(F.size("items") > 1).groupBy("items", "verdict").agg(F.count("*").alias("n"))


def _by_verdict(counts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, n, by): rows of each key and, of verdicts with ``least`` rows, struct(verdict, n); keys without any are left out."""
    support = F.when(F.col("n") >= least, F.struct("verdict", "n"))
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list(support).alias("by")).where("size(by) > 0")


def _associations(labelled: DataFrame, options: MiningOptions) -> list[tuple[str, frozenset[str], float]]:
    """(verdict, tokens, confidence) of every rule that no smaller set of its tokens makes needless, and of some others.

    FP-growth to a fixed depth: a set's conditional base holds, of each row with the set,
    the tokens commoner than the set's; equal bases are merged, tokens with support in a
    base extend the set, and their bases follow. Two kinds of sets aren't extended, as
    their extensions only repeat the confidence of smaller sets: those whose rows all
    have one verdict, and those with as many rows as the set that they extend.
    The tokens with support are at most (tokens of a URL on average) / min_support.
    """
    totals = {r.verdict: r.n for r in labelled.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    rows = sum(totals.values())
    least = max(1, math.ceil(options.min_support * rows))
    share = F.create_map(*[F.lit(x) for v, n in totals.items() if n >= least for x in (v, n / rows)])

    def rules(sets: DataFrame, tokens: str) -> list:
        each = sets.select(F.col(tokens).alias("tokens"), "n", F.explode("by").alias("v")).select("tokens", "v.verdict", (F.col("v.n") / F.col("n")).alias("confidence"))
        return each.where((F.col("confidence") >= options.min_confidence) & (F.col("confidence") / share[F.col("verdict")] >= options.min_lift)).collect()

    mixed = ~F.exists("by", lambda x: x["n"] == F.col("n"))
    each = labelled.select(F.explode("tokens").alias("token"), "verdict").groupBy("token", "verdict").agg(F.count("*").alias("n"))
    single = materialize(_by_verdict(each, ["token"], least), "tokens")
    found = [(r.verdict, frozenset([r.tokens]), r.confidence) for r in rules(single, "token")]
    growing = single.where(mixed & (F.col("n") < rows)).select("token", "n").orderBy(F.desc("n"), "token").collect()
    if options.max_tokens < 2 or len(growing) < 2:
        return found
    names = [r.token for r in growing]
    sizes = labelled.sparkSession.createDataFrame([(i, r.n) for i, r in enumerate(growing)], "item int, total long")
    # rows (set, total, base, verdict, n); total: rows with the set
    bases = _ranked(labelled, names).select("verdict", "n", "items", F.posexplode("items").alias("place", "item")).where("place > 0").join(F.broadcast(sizes), "item").select(
        F.array("item").alias("set"), "total", F.slice("items", F.lit(1), F.col("place")).alias("base"), "verdict", "n")
    for size in range(2, options.max_tokens + 1):
        bases = materialize(bases.groupBy("set", "total", "base", "verdict").agg(F.sum("n").alias("n")), "bases")
        counts = bases.select("set", "total", F.explode("base").alias("item"), "verdict", "n").groupBy("set", "total", "item", "verdict").agg(F.sum("n").alias("n"))
        grown = materialize(_by_verdict(counts, ["set", "total", "item"], least).where("n < total"), "grown")
        found += [(r.verdict, frozenset(names[i] for i in r.tokens), r.confidence) for r in rules(grown.withColumn("tokens", F.concat("set", F.array("item"))), "tokens")]
        if size < options.max_tokens:
            live = grown.where(mixed).groupBy("set").agg(F.map_from_entries(F.collect_list(F.struct("item", "n"))).alias("live"))
            kept = F.filter("base", lambda x: F.map_contains_key(F.col("live"), x))
            bases = bases.join(live, "set").select("set", "live", kept.alias("base"), "verdict", "n").select(
                "set", "live", "base", "verdict", "n", F.posexplode("base").alias("place", "item")).where("place > 0").select(
                F.concat("set", F.array("item")).alias("set"), F.col("live")[F.col("item")].alias("total"),
                F.slice("base", F.lit(1), F.col("place")).alias("base"), "verdict", "n")
    return found


def mine_rules(labelled: DataFrame, options: MiningOptions = MiningOptions()) -> list[tuple[str, tuple[str, ...], float]]:
    """(verdict, tokens, confidence) from rows (tokens, verdict), smallest sets first.

    A rule that a kept rule with fewer of its tokens makes needless is dropped.
    """
    if labelled.isEmpty():
        return []
    kept: dict[tuple[str, frozenset[str]], float] = {}
    for verdict, tokens, confidence in sorted(_associations(labelled, options), key=lambda r: (len(r[1]), -r[2], sorted(r[1]), r[0])):
        smaller = (frozenset(s) for k in range(1, len(tokens)) for s in combinations(tokens, k))
        if not any(kept.get((verdict, s), -1.0) >= confidence for s in smaller):
            kept[verdict, tokens] = confidence
    return [(verdict, tuple(sorted(tokens)), confidence) for (verdict, tokens), confidence in kept.items()]


def _matcher(rules: list[tuple[str, tuple[str, ...], float]], default: str):
    """Inverted index by one token of each rule, the one that fewest rules hold."""
    held: dict[str, int] = {}
    for _, tokens, _ in rules:
        for t in tokens:
            held[t] = held.get(t, 0) + 1
    index: dict[str, list[int]] = {}
    for i, (_, tokens, _) in enumerate(rules):
        index.setdefault(min(tokens, key=lambda t: (held[t], t)), []).append(i)

    @F.pandas_udf("verdict string, mined string")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tokens in batch:
                have = set(tokens)
                hits = [i for t in have if t in index for i in index[t] if have.issuperset(rules[i][1])]
                best = max(hits, key=lambda i: (rules[i][2], len(rules[i][1]), -i), default=None)
                out.append((default, None) if best is None else (rules[best][0], " ".join(rules[best][1])))
            yield pd.DataFrame(out, columns=["verdict", "mined"])

    return match.asNondeterministic()  # else filters on the verdict would take it into expressions that can't hold it


def judged_by_rules(url: Column, rules=BASE_RULES) -> Column:
    """struct(host, path, rule, base, tokens); ``base`` is the fixed rule's verdict."""
    return let(host_and_path(url), lambda hp: let(base_rule(hp["host"], hp["path"], rules), lambda b: F.struct(
        hp["host"].alias("host"), hp["path"].alias("path"), b["rule"].alias("rule"), b["verdict"].alias("base"),
        url_tokens(F.coalesce(url, F.lit("")), hp["host"], hp["path"]).alias("tokens"))))


def url_filter(pages: DataFrame, labels: DataFrame, rules=BASE_RULES, options: MiningOptions = MiningOptions(), default: str = "allow", into: str = "_url") -> DataFrame:
    """``pages`` (page_id, url, ...) with a struct ``into``: host, path, rule, verdict, mined.

    ``labels`` has (page_id, verdict); pages under a fixed rule are labelled by it.
    """
    bound_batches(pages.sparkSession)
    parsed, mined_by = (fresh([*pages.columns, into], n) for n in ("_parsed", "_mined"))
    known = labels.where("page_id IS NOT NULL AND verdict IS NOT NULL").groupBy("page_id").agg(F.max("verdict").alias("label"))
    labelled = pages.select("page_id", judged_by_rules(F.col("url"), rules).alias("u")).join(known, "page_id", "left").select(
        F.col("u.tokens").alias("tokens"), F.coalesce("u.base", "label").alias("verdict")).where("verdict IS NOT NULL AND size(tokens) > 0")
    mined = mine_rules(materialize(labelled, "labelled"), options)
    judged = pages.withColumn(parsed, judged_by_rules(F.col("url"), rules)).withColumn(mined_by, _matcher(mined, default)(F.col(f"{parsed}.tokens")))
    u, m = F.col(parsed), F.col(mined_by)
    result = F.struct(u["host"].alias("host"), u["path"].alias("path"), u["rule"].alias("rule"), F.coalesce(u["base"], m["verdict"]).alias("verdict"),
                      F.when(u["rule"].isNull(), m["mined"]).alias("mined"))
    return judged.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() != into.lower()], result.alias(into))
