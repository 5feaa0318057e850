"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred on their mean, rotated by a random orthogonal matrix and cut to
their signs. A code's correction scalars (length, and the inner product of code and
vector) turn packed bits into an estimate of the inner product with a query and a
bound on its error. Only vectors whose bound reaches into the best so far are
reranked on the original vectors.

Defined results: vectors that are null, zero, empty or that hold a null or non-finite
component take no part, nor do rows without an id. Vectors are near to those of their
own length only; each length is searched by itself. A repeated (id, vector) counts once;
ids with several vectors keep their nearest. Ties go to the smaller id. An empty table
gives an empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.common import bound_batches, materialize


@dataclass(frozen=True)
class OneBitOptions:
    """``dim``: length of the vectors, each length of the data if it is left out.
    ``slack``: width of the error bound in units of its deviation. ``wave``: queries
    that are broadcast at once, so memory doesn't depend on how many there are."""

    dim: int | None = None
    k: int = 10
    seed: int = 7
    slack: float = 5.0
    wave: int = 16_384


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, options: OneBitOptions) -> DataFrame:
    """(vec_id, v) of the rows that take part, as doubles."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    length = F.size(v) > 0 if options.dim is None else F.size(v) == options.dim
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & length).where(F.coalesce(fine, F.lit(False))).select(
        "vec_id", v.cast("array<double>").alias("v"))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, dim))


def build_index(rows: DataFrame, options: OneBitOptions) -> tuple[DataFrame, np.ndarray]:
    """Every row with its code, and the centre: a mean of ``dim`` numbers over all rows."""
    means = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).toPandas()
    centre = np.zeros(options.dim)
    centre[means["i"].to_numpy()] = means["m"].to_numpy()
    turn = rotation(options.dim, options.seed)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = (_matrix(batch["v"], options.dim) - centre) @ turn.T
            length = np.sqrt((x * x).sum(axis=1))
            with np.errstate(invalid="ignore"):
                agree = np.abs(x).sum(axis=1) / (np.sqrt(options.dim) * length)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": batch["v"], "code": [c.tobytes() for c in np.packbits(x > 0, axis=1)],
                                "length": length, "agree": np.where(length > 0, agree, 1.0)})

    schema = "vec_id long, v array<double>, code binary, length double, agree double"
    return materialize(rows.mapInPandas(encode, schema), "codes"), centre


def exact_distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances, the squares added in order of component."""
    total = np.zeros(len(rows))
    for i in range(rows.shape[1]):
        total += (rows[:, i] - query[i]) ** 2
    return np.sqrt(total)


def _best(ids: np.ndarray, distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest, ties to the smaller id, each id once."""
    order = np.lexsort((ids, distances))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order], distances[order]


def _searcher(sent, centre: np.ndarray, options: OneBitOptions):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, queries = sent.value
        turned = (queries - centre) @ rotation(options.dim, options.seed).T
        lengths = np.sqrt((turned * turned).sum(axis=1))
        found = [(np.empty(0, np.int64), np.empty(0))] * len(query_ids)
        for batch in batches:
            ids, rows = batch["vec_id"].to_numpy(np.int64), _matrix(batch["v"], options.dim)
            bits = np.unpackbits(np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(len(ids), -1), axis=1, count=options.dim)
            signs = bits.astype(np.float32) * 2 - 1
            length, agree = batch["length"].to_numpy(), batch["agree"].to_numpy()
            # of the part of a vector that its code misses, a query sees a random share
            spread = options.slack * np.sqrt(np.maximum(1 - agree**2, 0)) / agree / np.sqrt(max(options.dim - 1, 1))
            for at in range(0, len(query_ids), 256):
                block = slice(at, at + 256)
                inner = (signs @ turned[block].T.astype(np.float32)).T / np.sqrt(options.dim) / agree * length
                error = spread * length * lengths[block, None]
                squared = length**2 + lengths[block, None] ** 2 - 2 * inner
                low = np.sqrt(np.maximum(squared - 2 * error, 0)) * (1 - 1e-6)
                for q in range(low.shape[0]):
                    i = at + q
                    near_ids, near = found[i]
                    bound = near[-1] if len(near) == options.k else np.inf
                    if bound == np.inf and len(ids) > 4 * options.k:
                        # exact distances of the best estimates give a first bound
                        some = np.argpartition(squared[q], 4 * options.k)[: 4 * options.k]
                        some = some[ids[some] != query_ids[i]]
                        near_ids, near = _best(np.concatenate([near_ids, ids[some]]), np.concatenate([near, exact_distances(queries[i], rows[some])]), options.k)
                        bound = near[-1] if len(near) == options.k else np.inf
                    rerank = np.flatnonzero((low[q] <= bound) & (ids != query_ids[i]))
                    found[i] = _best(np.concatenate([near_ids, ids[rerank]]), np.concatenate([near, exact_distances(queries[i], rows[rerank])]), options.k)
        for i, (ids, near) in enumerate(found):
            if len(ids):
                yield pd.DataFrame({"query_id": query_ids[i], "vec_id": ids, "score": near})

    return search


def nearest(vectors: DataFrame, is_query, options: OneBitOptions = OneBitOptions()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest of all other rows.

    Queries come in waves of bounded size, each broadcast to all blocks of the
    index; each task keeps k rows a query, and a window ranks what tasks have kept.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    if options.dim is None:
        lengths = sorted(r[0] for r in usable(vectors, options).select(F.size("v")).distinct().collect())
        found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        for dim in lengths:  # one, as a rule
            part = nearest(vectors, is_query, replace(options, dim=dim))
            found = part if dim == lengths[0] else found.unionByName(part)
        return found
    index, centre = build_index(usable(vectors, options), options)
    queries = materialize(index.where(is_query).select("vec_id", "v").distinct(), "queries")
    waves = -(-queries.count() // options.wave)
    queries = queries.withColumn("_wave", F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(waves, 1))))
    kept = None
    for wave in range(waves):
        rows = queries.where(F.col("_wave") == wave).select("vec_id", "v").toPandas()
        sent = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"], options.dim)))
        part = materialize(index.mapInPandas(_searcher(sent, centre, options), "query_id long, vec_id long, score double"), "near")
        kept = part if kept is None else kept.unionByName(part)
        sent.unpersist()
    if kept is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = kept.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.k).select("query_id", "rank", "vec_id", "score")
