"""Mixing sources to target weights.

Words are summed per source, targets come from the weights by reshare under a
cap, and each document is taken floor(rate) times plus once more if its hash
falls under the fraction.

Defined results: a null or empty text has size 0; a null source is a source of its own,
last in order; sources that tie in what decides go by code point; rows with one doc_id
(a null one included) draw the same number, so repeated rows are taken alike. A source
of size 0 has target 0 and is not taken. An empty table gives an empty result. All other
columns pass through; the result's name can be chosen, and a column of that name is
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.common import WORD, fresh, lookup_join, materialize, text_or_empty, unit_hash

DEFAULT_WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=DEFAULT_WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Sizes and targets by source from rows (source, size).

    The i-th source in order weighs ``weights[i % len(weights)]``. All targets
    together are all sizes together; no target exceeds ``max_repeats`` times its
    source. Capped sources are those whose cap per weight lies under the final
    level, so running sums over the sources in that order find it in one pass.
    The windows run over one row per source, after the aggregation.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    index = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    weighed = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (index + 1).cast("int")))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighed.withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_level), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weight_left"))
    )
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level"))))
    return levels.withColumn("final", open_level.over(everything)["level"]).select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
    )


def mix_sources(docs: DataFrame, weights=DEFAULT_WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, into: str = "_mix") -> DataFrame:
    """``docs`` with a struct column ``into``: size, source_size, target, copies.

    Sources may be of any size: only (source, size) pairs are summed, with map-side
    partial sums, and the table of targets is joined by ``lookup_join``.
    """
    targets = materialize(source_targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, max_repeats), "targets")
    none, name, of_source = (fresh([*docs.columns, into], n) for n in ("_mix_none", "_mix_source", "_mix_target"))
    key = F.col("source").isNull().alias(none), F.coalesce("source", F.lit("")).alias(name)
    mixed = lookup_join(docs.select("*", *key), targets.select(*key, F.struct("source_size", "target").alias(of_source)), [none, name], ["doc_id"])
    t = F.col(of_source)
    rate = F.when(t["source_size"] > 0, F.least(t["target"] / t["source_size"], F.lit(float(max_repeats)))).otherwise(F.lit(0.0))
    extra = F.when(unit_hash(F.col("doc_id"), seed) < rate - F.floor(rate), F.lit(1)).otherwise(F.lit(0))
    result = F.struct(word_count(F.col("text")).alias("size"), t["source_size"].alias("source_size"), t["target"].alias("target"), (F.floor(rate) + extra).cast("int").alias("copies"))
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()], result.alias(into))


def mixing_stage(docs: DataFrame, weights=DEFAULT_WEIGHTS) -> DataFrame:
    """The mix itself: every document as often as it is taken, in its own columns."""
    columns, into = docs.columns, fresh(docs.columns, "_mix")
    taken = mix_sources(docs, weights, into=into).where(F.col(f"{into}.copies") > 0)
    return taken.withColumn(into, F.explode(F.sequence(F.lit(1), F.col(f"{into}.copies")))).select(*[F.col(f"`{c}`") for c in columns])
