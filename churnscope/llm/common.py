"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.scratch import drop_scratch, fresh, lookup_join, materialize, scratch_until, shared_dir  # noqa: F401

#: One word: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Keep Arrow batches under ``size`` bytes, whatever the length of the texts in them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > size:
        spark.conf.set(key, str(size))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order; no empty ones."""
    bare = F.btrim(text, F.lit(BLANKS))
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+", -1)))


def unit_hash(value: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on value and seed alone (52 bits of MD5)."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(value.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str, how: str = "inner", *, counts: DataFrame | None = None, hot: int = 2000, least: int = 200, salts: int = 32) -> DataFrame:
    """Join of any number of rows per key with a table that has one row per key.

    The ``hot`` commonest keys, of those with ``least`` rows or more, are broadcast, and
    the rows of each go to ``salts`` places, told apart by column ``by``. Any other key
    has fewer than 1/``hot`` of the rows. ``counts`` has (on, _n), the rows per key where
    the caller knows them; keys it leaves out aren't hot.
    """
    counts = left.groupBy(on).agg(F.count("*").alias("_n")) if counts is None else counts
    salt = fresh([*left.columns, *right.columns], "_salt")
    most = counts.where(F.col("_n") >= least).orderBy(F.desc("_n")).limit(hot).select(on, F.lit(salts).alias(salt))
    marked = lambda side: side.join(F.broadcast(most), on, "left")
    spread = marked(left).withColumn(salt, F.when(F.col(salt).isNotNull(), F.pmod(F.hash(by), F.lit(salts))).otherwise(F.lit(0)))
    copies = marked(right).withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salt, F.lit(1)) - 1)))
    return spread.join(copies, [on, salt], how).drop(salt)


def running(values: Column, op, zero: int, block: int = 256) -> Column:
    """For each place of an array of longs, ``op`` over all values up to it; ``op`` is associative.

    Arrays only grow by copying, so values are taken in blocks: the work is in
    proportion to the length and, for long arrays, to the square of its 256th part.
    """
    none = F.array().cast("array<bigint>")

    def steps(items: Column, of) -> Column:
        start = F.struct(F.lit(zero).cast("bigint").alias("now"), none.alias("out"))

        def add(acc: Column, x: Column) -> Column:
            return let(op(acc["now"], of(x)).cast("bigint"), lambda y: F.struct(y.alias("now"), F.concat(acc["out"], F.array(y)).alias("out")))

        return F.aggregate(items, start, add)

    def joined(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda k: steps(F.slice(v, k * block + 1, block), lambda x: x))
        return let(blocks, lambda b: let(steps(b, lambda x: x["now"])["out"], lambda ends: F.flatten(F.transform(b, lambda x, k: F.when(
            k == 0, x["out"]).otherwise(F.transform(x["out"], lambda y: op(F.get(ends, k - 1), y).cast("bigint")))))))

    return let(values, lambda v: F.when(F.size(v) == 0, none).when(F.size(v) <= block, steps(v, lambda x: x)["out"]).otherwise(joined(v)))
