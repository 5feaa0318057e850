"""Intermediate tables in the folder that driver and executors share, ranks and look-ups."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a session on one machine (tests) gets a folder of its own; on a
    cluster, whose machines would not see it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="churnscope-"))
    return f"file://{_own_dir[0]}"


def materialize(df: DataFrame, name: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by a column's values if one is named, and read it back.

    That cuts lineage: a lost executor then costs a re-read of Parquet, not a
    recomputation. ``codec``: Parquet's compression, else the session's. ``drop_scratch``
    deletes what a session has written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/churnscope/{name}-{uuid.uuid4().hex}"
    (df.write if by is None else df.write.partitionBy(by)).parquet(path, compression=codec)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_until() -> Iterator[list[DataFrame]]:
    """Tables that ``materialize`` writes in this block are deleted at its end, but for those put on the list.

    Nothing that is used later may still stand on the deleted ones.
    """
    begin, kept = len(_written), []
    yield kept
    stay = {df._scratch_path for df in kept}
    for spark, path in _written[begin:]:
        if path not in stay:
            _delete(spark, path)
    _written[begin:] = [x for x in _written[begin:] if x[1] in stay]


def drop_scratch() -> None:
    """Delete every table that ``materialize`` wrote; results built on them are then gone."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session may have ended, and its folder with it
            return


atexit.register(drop_scratch)


def with_rank(rows: DataFrame, key: str, falling: tuple[str, ...] = (), rising: tuple[str, ...] = (), into: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, in an order by falling, then rising columns, then the key.

    No task sees all rows: only the key and the order's columns are sorted, by range.
    Places in a part and the sizes of the parts before it (one number a part) add up to
    ranks, which are joined back by the key. Keys are unique.
    """
    spark, order = rows.sparkSession, (*map(F.desc, falling), *map(F.asc, rising), F.asc(key))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select(key, *falling, *rising).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(placed.select(key, F.monotonically_increasing_id().alias("at")), "ranks").select(
        key, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place"))
    before, sizes = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("part").count().collect())):
        sizes.append((part, before))
        before += n
    ranks = placed.join(F.broadcast(spark.createDataFrame(sizes, "part long, before long")), "part")
    return rows.join(ranks.select(key, (F.col("before") + F.col("place") + 1).cast("int").alias(into)), key)


def fresh(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column in ``taken`` has it, in whatever case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], *, rows: int = 50_000, salts: int = 16) -> DataFrame:
    """Left join with a materialized lookup table that has one row per key.

    At most ``rows`` rows (counted, keys of at most 16 MB in all) are broadcast.
    Beyond that both sides are shuffled, with the left side salted by the columns
    in ``spread`` so that no key, however common, meets in one task.
    """
    width = F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in on), F.lit(0)))
    n, size = right.agg(F.count("*"), F.coalesce(width, F.lit(0))).first()
    if n <= rows and size <= 16 << 20:
        return left.join(F.broadcast(right), on, "left")
    salt = fresh([*left.columns, *right.columns], "_salt")
    salted = left.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, salt], "left").drop(salt)
