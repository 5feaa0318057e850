"""Language-model scoring with a hashed maximum-entropy model.

The next token is predicted in three steps of 16 ways each: its class, its class within
that, and the leaf there. Each step is a softmax whose weights lie in a hashed table, over
a bias, the last token (bigram), the one before it (skip) and both together; a feature's
16 weights lie side by side. The ``words`` commonest tokens have leaves of their own. All
others, those never seen included, are dealt by hash to the ``buckets`` other leaves, and
within a bucket a token's chance follows its smoothed count. So every token has n-gram
and skip features, as what is predicted and as what it is predicted from.

Texts are hashed to tokens once. Training goes once over all training texts, in ``steps``
parts by a hash of their ids: each task of a part counts how often features were seen
with outcomes and how often the model expects them, sums by weight go to the driver (at
most as many as there are weights), and the weights move along the gradient, each by the
share in which both counts differ. Counts of frequent tokens, whose number is bounded
because each is at least 1/``frequent`` of all tokens, are broadcast; counts of the
others are joined by a shuffle.

Defined results: null or empty texts consist of the end token. A null doc_id hashes as
the empty string. Repeated rows count repeatedly and score alike. A text of any length is
scored whole, in parts of bounded size. An empty table gives an empty result. Other
columns, whatever their names, aren't read. Tokens are told apart by 64-bit hashes; that
the end token or two words agree in all bits is left to chance (under 1e-7 for a million
million pairs of words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import bound_batches, materialize
from churnscope.llm.dedup import Shingler

#: The end token's hash, and what stands for tokens before the first.
END = np.uint64(0x0A0A0A0A0A0A0A0A)
START = 1 << 12
_WAYS = 16
#: Weights whose sums go in one row, and the schema of these rows.
_BLOCK = 1 << 12
_BLOCKS = "block int, seen binary, expected binary"


@dataclass(frozen=True)
class MaxentOptions:
    """``words`` and ``buckets`` share the 4096 leaves. ``rows``: rows of 16 weights of the
    bigram, skip and joint features. ``prior``: counts that a weight needs to move.
    ``task``: tokens, about, that a training task counts before it sends its sums."""

    words: int = 3072
    buckets: int = 1024
    rows: tuple[int, int, int] = (1 << 15, 1 << 14, 1 << 14)
    frequent: int = 1 << 17
    steps: int = 4
    rate: float = 1.0
    prior: float = 8.0
    smoothing: float = 0.1
    chunk: int = 1 << 12
    task: int = 1 << 22

    @property
    def table(self) -> int:
        return 1 + _WAYS + _WAYS**2 + sum(self.rows)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts to packed token hashes, each text closed by the end token."""
    shingler = Shingler(1)
    for batch in batches:
        packed = [np.append(shingler.hashes(None if t is pd.NA else t), END).tobytes() for t in batch["text"].array]
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "part": batch["part"], "tokens": packed})


def _joined(packed) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a batch and where its texts end."""
    return np.frombuffer(b"".join(packed), dtype=np.int64), np.cumsum([len(x) // 8 for x in packed], dtype=np.int64)


def _counter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        token, n = np.unique(_joined(batch["tokens"].array)[0], return_counts=True)
        yield pd.DataFrame({"token": token, "n": n})


class Vocabulary:
    """Frequent tokens by hash, with their counts and leaves, and the buckets' totals."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, total: int, distinct: int, options: MaxentOptions):
        order = np.argsort(tokens)
        self.tokens, self.counts, self.options = tokens[order], counts[order], options
        self.total, self.distinct = total, distinct
        self.top = np.lexsort((self.tokens, -self.counts))[: options.words]
        self.leaves = options.words + self.tokens % options.buckets
        self.leaves[self.top] = np.arange(len(self.top))
        self.base_total = total + options.smoothing * (distinct + 1)
        self.bucket_counts, self.bucket_totals = np.zeros(options.buckets), np.ones(options.buckets)

    def fill_buckets(self, buckets: np.ndarray, counts: np.ndarray, distinct: np.ndarray) -> None:
        """What tokens without a leaf of their own add up to in each bucket."""
        self.bucket_counts[buckets] = counts
        sizes = np.zeros(self.options.buckets)
        sizes[buckets] = distinct
        self.bucket_totals = self.bucket_counts + self.options.smoothing * (sizes + 1)

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, counts, leaves); a token that isn't found has count 0 and a bucket."""
        other = self.options.words + tokens % self.options.buckets
        if not len(self.tokens):
            return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64), other
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        found = self.tokens[at] == tokens
        return found, np.where(found, self.counts[at], 0), np.where(found, self.leaves[at], other)

    def leaf_counts(self) -> np.ndarray:
        seen = np.zeros(self.options.words + self.options.buckets)
        seen[: len(self.top)] = self.counts[self.top]
        seen[self.options.words :] = self.bucket_counts
        return seen


def contexts(leaves: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaves of the last token and of the one before, for each token."""
    one, two = np.roll(leaves, 1), np.roll(leaves, 2)
    first = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    one[first] = two[first] = START
    two[first[(ends - first) > 1] + 1] = START
    return one, two


def _hash(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Model:
    """Rows of 16 weights: one for each node of the tree, then the hashed features."""

    def __init__(self, weights: np.ndarray, options: MaxentOptions):
        self.w, self.o = weights, options
        # where no sum of weights can leave the range of exp, the largest need not be taken off
        nodes, features = weights[: 1 + _WAYS + _WAYS**2], weights[1 + _WAYS + _WAYS**2 :]
        self.tame = bool(nodes.max() + 3 * features.max() < 80 and nodes.max(axis=1).min() + 3 * features.min() > -80)

    def places(self, leaf: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [feature, level, token] and ways [level, token]."""
        nodes = np.stack([np.zeros_like(leaf), 1 + (leaf >> 8), 1 + _WAYS + (leaf >> 4)])
        ways = np.stack([leaf >> 8, (leaf >> 4) & 15, leaf & 15])
        at, out = 1 + _WAYS + _WAYS**2, [nodes]
        for kind, (context, rows) in enumerate(zip((one, two, one * (2 * START) + two), self.o.rows)):
            hashed = _hash((context * 4 + kind) * 512 + nodes)
            hashed = hashed % np.uint64(rows) if rows & (rows - 1) else hashed & np.uint64(rows - 1)
            out.append(at + hashed.astype(np.int64))
            at += rows
        return np.stack(out), ways

    def buffers(self, n: int) -> np.ndarray:
        """Two arrays [level, token, way] that ``logits`` and its callers fill: new ones for each chunk cost more than what is done in them."""
        return np.empty((2, 3, n, _WAYS), dtype=self.w.dtype)

    def logits(self, rows: np.ndarray, out: np.ndarray, spare: np.ndarray) -> None:
        np.take(self.w, rows[0], axis=0, out=out, mode="clip")
        for feature in rows[1:]:
            np.take(self.w, feature, axis=0, out=spare, mode="clip")
            out += spare
        if not self.tame:
            out -= out.max(axis=-1, keepdims=True)

    def scores(self, leaf: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 P(leaf | context) of each token."""
        out, logits, spare = np.empty(len(leaf)), *self.buffers(min(self.o.chunk, len(leaf)))
        for k in range(0, len(leaf), self.o.chunk):
            part = slice(k, k + self.o.chunk)
            rows, ways = self.places(leaf[part], one[part], two[part])
            if ways.shape[1] < logits.shape[1]:
                logits, spare = self.buffers(ways.shape[1])
            self.logits(rows, logits, spare)
            chosen = np.take_along_axis(logits, ways[..., None], axis=2)[..., 0]
            chosen -= np.log(np.einsum("ijk->ij", np.exp(logits, out=spare)))
            out[part] = chosen.sum(axis=0, dtype=np.float64) / np.log(10)
        return out

    def counts(self, leaf: np.ndarray, one: np.ndarray, two: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> None:
        """Add to what was seen and what is expected, by weight but those of biases; their difference is the gradient."""
        wide = 8 * self.o.chunk  # adding up walks over all weights, so it is done for several chunks at once
        logits, spare = self.buffers(min(self.o.chunk, len(leaf)))
        for first in range(0, len(leaf), wide):
            n = min(wide, len(leaf) - first)
            features, chances = np.empty((3, 3, n), dtype=np.int64), np.empty((_WAYS, 3, n))
            taken = np.empty((3, n), dtype=np.int64)
            for k in range(0, n, self.o.chunk):
                to, part = slice(k, k + self.o.chunk), slice(first + k, min(first + k + self.o.chunk, first + n))
                rows, taken[:, to] = self.places(leaf[part], one[part], two[part])
                if rows.shape[2] < logits.shape[1]:
                    logits, spare = self.buffers(rows.shape[2])
                self.logits(rows, logits, spare)
                np.exp(logits, out=spare)
                spare /= np.einsum("ijk->ij", spare)[..., None]
                chances[:, :, to] = np.moveaxis(spare, 2, 0)
                features[:, :, to] = rows[1:]
            seen += np.bincount((features * _WAYS + taken).ravel(), minlength=seen.size)
            flat = features.ravel()
            for way in range(_WAYS):
                expected[:, way] += np.bincount(flat, np.tile(chances[way].ravel(), 3), minlength=len(expected))


def _initial(vocabulary: Vocabulary, options: MaxentOptions) -> np.ndarray:
    """Weights whose biases give the smoothed counts of leaves."""
    seen = vocabulary.leaf_counts() + 0.01
    w = np.zeros((options.table, _WAYS), dtype=np.float32)
    at = 0
    for size in (_WAYS**2, _WAYS, 1):
        by_node = seen.reshape(-1, _WAYS, size).sum(axis=2)
        w[at : at + len(by_node)] = np.log(by_node / by_node.sum(axis=1, keepdims=True))
        at += len(by_node)
    return w


def move(w: np.ndarray, seen: np.ndarray, expected: np.ndarray, options: MaxentOptions) -> None:
    """Move the weights (in place, as the other arrays are used up); biases keep what the counts of the whole corpus give."""
    seen -= expected
    expected *= 2
    expected += seen  # what was seen and what is expected
    expected += np.float32(options.prior)
    seen /= expected
    seen *= np.float32(options.rate)
    w += seen


def _blocks(seen: np.ndarray, expected: np.ndarray) -> Iterator[pd.DataFrame]:
    """Sums of all weights, packed: 8 bytes a weight, which rows of single weights would take several times over."""
    starts = [k for k in range(0, len(seen), _BLOCK) if seen[k : k + _BLOCK].any() or expected[k : k + _BLOCK].any()]
    if starts:
        packed = lambda x: [x[k : k + _BLOCK].astype(np.float32).tobytes() for k in starts]
        yield pd.DataFrame({"block": np.array(starts, dtype=np.int32) // _BLOCK, "seen": packed(seen), "expected": packed(expected)})


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each block of a partition that has all rows of its blocks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, *packed in zip(batch["block"], batch["seen"], batch["expected"]):
            values = np.stack([np.frombuffer(x, np.float32) for x in packed]).astype(np.float64)
            sums[block] = sums[block] + values if block in sums else values
    for block, (seen, expected) in sums.items():
        yield pd.DataFrame({"block": [block], "seen": [seen.astype(np.float32).tobytes()], "expected": [expected.astype(np.float32).tobytes()]})


def train(tokens: DataFrame, sent, vocabulary: Vocabulary, options: MaxentOptions) -> np.ndarray:
    """One pass over (part, tokens), a gradient step for each part."""
    w, spark = _initial(vocabulary, options), tokens.sparkSession
    for step in range(options.steps):
        weights = spark.sparkContext.broadcast(w)

        def counted(batches: Iterator[pd.DataFrame], weights=weights) -> Iterator[pd.DataFrame]:
            v, model = sent.value, Model(weights.value, options)
            seen, expected = np.zeros(model.w.size), np.zeros(model.w.shape)
            for batch in batches:
                hashes, ends = _joined(batch["tokens"].array)
                leaves = v.find(hashes)[2]
                model.counts(leaves, *contexts(leaves, ends), seen, expected)
            expected[(expected <= 1e-4) & (seen.reshape(expected.shape) == 0)] = 0
            yield from _blocks(seen, expected.ravel())

        # sums are as large as the weights, so a task takes enough tokens to be worth them
        part = tokens.where(F.col("part") == step).select("tokens").coalesce(max(1, -(-vocabulary.total // (options.steps * options.task))))
        sums = part.mapInPandas(counted, _BLOCKS).repartition("block").mapInPandas(_added, _BLOCKS)
        seen, expected = np.zeros(w.size, dtype=np.float32), np.zeros(w.size, dtype=np.float32)
        for row in sums.collect():  # 8 bytes a weight
            at = slice(row["block"] * _BLOCK, (row["block"] + 1) * _BLOCK)
            seen[at], expected[at] = np.frombuffer(row["seen"], np.float32), np.frombuffer(row["expected"], np.float32)
        weights.unpersist()
        move(w, seen.reshape(w.shape), expected.reshape(w.shape), options)
    return w


def _tokens(docs: DataFrame, options: MaxentOptions) -> DataFrame:
    """(doc_id, held_out, tokens) in folders by ``part``: training parts from 0, and -1 for what is held out."""
    out = held_out(F.col("doc_id"))
    part = F.when(out, -1).otherwise(F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(options.steps)).cast("int"))
    rows = docs.select("doc_id", "text", out.alias("held_out"), part.alias("part"))
    return materialize(rows.mapInPandas(_tokenize, "doc_id long, held_out boolean, part int, tokens binary"), "tokens", by="part", codec="zstd")


def fit(tokens: DataFrame, options: MaxentOptions) -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """The vocabulary, the weights, and the counts of all training tokens."""
    spark = tokens.sparkSession
    training = tokens.where("part >= 0")
    counts = materialize(training.select("tokens").mapInPandas(_counter, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("n") * options.frequent >= total).toPandas()
    vocabulary = Vocabulary(top["token"].to_numpy(np.int64), top["n"].to_numpy(np.int64), total, distinct, options)
    # the commonest words take their share out of their buckets
    own_tokens, own_counts = vocabulary.tokens[vocabulary.top], vocabulary.counts[vocabulary.top]
    bucket = F.pmod("token", F.lit(options.buckets)).alias("bucket")
    sums = counts.groupBy(bucket).agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).toPandas()
    at = sums["bucket"].to_numpy(np.int64)
    own = np.bincount(own_tokens % options.buckets, own_counts, minlength=options.buckets)
    own_distinct = np.bincount(own_tokens % options.buckets, minlength=options.buckets)
    vocabulary.fill_buckets(at, sums["n"].to_numpy() - own[at], sums["distinct"].to_numpy() - own_distinct[at])
    sent = spark.sparkContext.broadcast(vocabulary)
    return vocabulary, train(training, sent, vocabulary, options), counts


def score_documents(docs: DataFrame, options: MaxentOptions = MaxentOptions()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents."""
    spark = docs.sparkSession
    bound_batches(spark)
    tokens = _tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), options)
    vocabulary, w, counts = fit(tokens, options)
    sent = spark.sparkContext.broadcast((vocabulary, w))

    def partly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What broadcast counts tell of each text, and the tokens that need a join."""
        v, model, s = sent.value[0], Model(sent.value[1], options), options.smoothing
        for batch in batches:
            hashes, ends = _joined(batch["tokens"].array)
            found, n, leaves = v.find(hashes)
            score = model.scores(leaves, *contexts(leaves, ends))
            shared = found & (leaves >= options.words)
            score[shared] += np.log10((n[shared] + s) / v.bucket_totals[leaves[shared] - options.words])
            base = np.where(found, np.log10((n + s) / v.base_total), 0.0)
            firsts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            sums = lambda x: np.add.reduceat(x, firsts) if len(firsts) else x[:0]  # noqa: B023, E731
            rest = [np.unique(hashes[a:b][~found[a:b]], return_counts=True) for a, b in zip(firsts, ends)]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "n_tokens": ends - firsts, "n_known": sums((found & (n > 0)).astype(np.int64)),
                "base_score": sums(base), "score": sums(score), "rest": [x for x, _ in rest], "times": [x for _, x in rest]})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<long>, times array<long>"
    scored = tokens.select("doc_id", "held_out", "tokens").mapInPandas(partly, schema)
    first = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scores", codec="zstd")
    rare = first.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("token"), F.col("x.times").alias("times"))
    totals = spark.createDataFrame([(vocabulary.bucket_totals.tolist(),)], "totals array<double>")  # one row of ``buckets`` numbers
    n = F.coalesce("n", F.lit(0))
    of_bucket = F.get("totals", F.pmod("token", F.lit(options.buckets)).cast("int"))
    later = rare.join(counts, "token", "left").join(F.broadcast(totals)).groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((n + options.smoothing) / vocabulary.base_total)).alias("more_base"),
        F.sum(F.col("times") * F.log10((n + options.smoothing) / of_bucket)).alias("more_score"))
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return first.join(later, "row", "left").select(
        "doc_id", "held_out", "n_tokens", add("n_known", "more_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        add("base_score", "more_base"), add("score", "more_score"))
