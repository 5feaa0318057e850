"""Near-duplicates by bottom-k sketches from one hash function.

A document is the set of its distinct 5-word shingles, each hashed to 64 bits; the k
smallest hashes are its sketch. Equal sets are one node.

Overlaps. Inverted lists of the first ``lists`` retained values: two sets over the
threshold share none of them with a chance under (1 - similarity) ** lists, 2e-10 here.
A short list gives all its pairs. A long list, as long as the table at worst, gives each
of its rows paired with the list's hub: the row whose sketch holds the values that most
rows hold, and so is nearest to what copies have in common. The union of two sketches
then estimates the similarity, and what passes is verified on the full sets.

The rest. Rows of long lists that are not all linked yet are looked up again, by the
values that are rarest among them, as many as a prefix filter takes: two sets over the
threshold share one of these. Every pair there that may be over the threshold and whose
ends are not linked yet is estimated and verified, long lists in salted blocks. So no
link depends on hubs, on the length of lists or on how rows are dealt to tasks.

Defined results: null, empty or blank texts have no shingles and stay alone; texts under
five words are one shingle; repeated rows stay separate rows. Rows without an id link
like others, but lend no id: a class of such rows only has a null ``component_id``, and
of it the rows with the smallest text hash are kept. Rows with the same id and several
texts are judged one by one. Ties don't occur: links are sets and ids are minima. An
empty table gives an empty result. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import UPPER, bound_batches, fresh, materialize, scratch_until, spread_join
from churnscope.llm.components import components

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class DedupOptions:
    """``percent``: least Jaccard similarity. ``sketch``: retained values; ``lists``: those
    of them that are looked up; ``short``: rows up to which a list gives all its pairs.
    ``slack``: how far, in percent, an estimate may lie below. ``sample``: sets, and
    ``sample_values``: values, about, that are counted to tell rare ones; these only
    order the second look-up. ``block``: rows that are paired in one place there.
    ``broadcast_rows``: rows of four numbers up to which (counted) what a text is looked up
    by is broadcast; beyond that texts are shuffled."""

    words: int = 5
    percent: int = 85
    lists: int = 12
    sketch: int = 64
    short: int = 16
    slack: int = 30
    sample: int = 10_000
    sample_values: int = 4_000_000
    block: int = 256
    broadcast_rows: int = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads nearby values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _P2
        x = (x ^ (x >> np.uint64(27))) * _P3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes, with a bounded cache of words."""

    def __init__(self, words: int, cached: int = 300_000):
        self.words, self.cached, self.known = words, cached, {}

    def _hash(self, word: bytes) -> int:
        if len(self.known) >= self.cached:
            self.known.clear()
        h = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def hashes(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        known, new = self.known.get, self._hash
        return np.fromiter((known(w) or new(w) for w in words), dtype=np.uint64, count=len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        h = self.hashes(text)
        if not len(h):
            return np.empty(0, dtype=np.int64)
        n = max(1, len(h) - self.words + 1)
        with np.errstate(over="ignore"):
            out = np.zeros(n, dtype=np.uint64) + np.uint64(min(len(h), self.words))
            for k in range(min(len(h), self.words)):
                out = _mix(out * _P1 + h[k : k + n])
        return np.unique(out.view(np.int64))


def _node(shingles: np.ndarray) -> int:
    """One hash of a whole set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1


def _sketches(options: DedupOptions):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(options.words)
        for batch in batches:
            sets = [shingler.shingles(None if t is pd.NA else t) for t in batch["text"].array]
            yield pd.DataFrame({
                # 64-bit numbers beside nulls must not pass through doubles
                "doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"],
                "node": pd.array([_node(s) if len(s) else None for s in sets], dtype="Int64"), "n": [len(s) for s in sets],
                "sketch": [s[: options.sketch] for s in sets]})

    return run


def _lists(nodes: DataFrame, options: DedupOptions) -> DataFrame:
    """(value, node, n, held): rows of the inverted lists that have two rows or more, ``held`` of them."""
    rows = nodes.select("node", "n", F.explode(F.slice("sketch", 1, options.lists)).alias("value"))
    held = materialize(rows.groupBy("value").agg(F.count("*").alias("held")).where("held > 1"), "held")
    return materialize(spread_join(rows, held, "value", "node", counts=held.select("value", F.col("held").alias("_n"))), "lists")


def _all_pairs(lists: DataFrame) -> DataFrame:
    """(a, b), a > b: the pairs of each list; the lists are short."""
    at = F.collect_list(F.struct("node", "n")).alias("at")
    pair = lambda x, y: F.struct(
        F.greatest(x["node"], y["node"]).alias("a"), F.least(x["node"], y["node"]).alias("b"), F.least(x["n"], y["n"]).alias("low"), F.greatest(x["n"], y["n"]).alias("high"))
    pairs = F.transform("at", lambda x, i: F.transform(F.slice("at", i + 2, F.size("at")), lambda y: pair(x, y)))
    return lists.groupBy("value").agg(at).select(F.inline(F.flatten(pairs)))


def _hub_pairs(lists: DataFrame, nodes: DataFrame, options: DedupOptions) -> DataFrame:
    """(a, b), a > b: each row of a long list with the list's hub.

    Hubs are maxima, which add up map-side; a row weighs as much as the rows that hold
    its retained values. Equals go by a hash that differs from list to list.
    """
    some = materialize(nodes.join(lists.select("node").distinct(), "node").select("node", F.explode("sketch").alias("value")), "retained")
    often = materialize(some.groupBy("value").agg(F.count("*").alias("_n")).where("_n > 1"), "often")
    weight = spread_join(some, often, "value", "node", counts=often).groupBy("node").agg(F.sum("_n").alias("weight"))
    rows = materialize(lists.join(weight, "node"), "weighed")
    hubs = rows.groupBy("value").agg(F.max(F.struct("weight", F.hash("value", "node").alias("any"), "node", "n")).alias("hub"))
    hubs = materialize(hubs.select("value", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    met = spread_join(rows, hubs, "value", "node", counts=lists.groupBy("value").agg(F.max("held").alias("_n"))).where("node <> hub")
    return met.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"), F.least("n", "hub_n").alias("low"), F.greatest("n", "hub_n").alias("high"))


def _estimated(pairs: DataFrame, sketches: DataFrame, options: DedupOptions) -> DataFrame:
    """The pairs whose similarity, from the k smallest hashes of their union, may suffice."""
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    joined = spread_join(spread_join(pairs, side("a"), "a", "b"), side("b"), "b", "a", counts=pairs.groupBy("b").agg(F.count("*").alias("_n")))
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, options.sketch)
    shared = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
    return joined.where(100 * shared >= (options.percent - options.slack) * F.size(union)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, options: DedupOptions) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
    joined = spread_join(spread_join(pairs, side("a"), "a", "b"), side("b"), "b", "a", counts=pairs.groupBy("b").agg(F.count("*").alias("_n")))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return joined.where(100 * both >= options.percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def _fetched(docs: DataFrame, wanted: DataFrame, options: DedupOptions) -> DataFrame:
    """Columns of ``wanted`` with the text of a row of each node (of several, where rows are repeated or an id has several texts)."""
    wanted = materialize(wanted, "wanted")
    if wanted.count() <= options.broadcast_rows:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.coalesce("doc_id", "text_hash").alias("key"), F.col("doc_id").isNull().alias("keyless"), "text")
    return texts.join(wanted, ["key", "keyless"]).drop("key", "keyless")


def _sets(options: DedupOptions):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(options.words)
        for batch in batches:
            sets = [shingler.shingles(t) for t in batch["text"].array]
            same = np.array([_node(s) == node for s, node in zip(sets, batch["node"].array)], dtype=bool)
            yield pd.DataFrame({"node": batch["node"], "shingles": sets})[same]

    return run


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, options: DedupOptions) -> DataFrame:
    """The pairs that are linked: estimated by sketches, then verified on the full sets of those that are left."""
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    with scratch_until() as kept:
        sketches = materialize(nodes.select("node", "sketch").join(ends(pairs), "node"), "met")
        likely = materialize(_estimated(pairs, sketches, options), "likely")
        wanted = nodes.select("node", "key", "keyless").join(ends(likely), "node")
        sets = _fetched(docs, wanted, options).mapInPandas(_sets(options), "node long, shingles array<long>").dropDuplicates(["node"])
        links = materialize(_verified(likely, materialize(sets, "sets"), options), "links")
        kept.append(links)
    return links


# the second look-up


def _parities(shingles: np.ndarray) -> bytes:
    """512 parities of set sizes; two sets disagree in no more of them than they have values apart."""
    place = (_mix(shingles.view(np.uint64)) & np.uint64(511)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=512).astype(np.uint8) & 1).tobytes()


#: What a row of the second look-up may meet: larger sets only lend later values of their
#: prefix to smaller ones' first values; rows of a sample of rare values meet all.
_LATER, _FIRST, _SAMPLED = 0, 1, 2


def _looked_up(shingles: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a set of which a pair over the threshold shares one, rarest first, and their roles.

    Without n - ceil(percent * n) of its values a set still has one that is shared; if
    the partner is no smaller, fewer suffice. Where enough values are rare, still fewer
    do: over the threshold at most ``apart`` of the rare ones are not shared, and the
    least by hash are a sample of them (miss under 1e-7).
    """
    n = len(shingles)
    few = n - (percent * n + 99) // 100 + 1
    first = n - (2 * percent * n + 99 + percent) // (100 + percent) + 1
    rare, apart = int((often == 0).sum()), (100 - percent) * n / percent
    sampled = int(np.ceil(np.log(1e-7) / np.log(apart / rare))) if rare > apart else n
    order = np.lexsort((shingles, often))
    if sampled <= min(rare, few - 1):
        return shingles[order[:sampled]], np.full(sampled, _SAMPLED, dtype=np.int32)
    return shingles[order[:few]], np.where(np.arange(few) < first, _FIRST, _LATER).astype(np.int32)


def _rare(options: DedupOptions, sent):
    """Rows of the second look-up, with what the tests of a pair need, from texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, times = sent.value
        shingler = Shingler(options.words)
        for batch in batches:
            sets = [shingler.shingles(t) for t in batch["text"].array]
            same = np.array([_node(s) == node for s, node in zip(sets, batch["node"].array)], dtype=bool)
            sets = [s for s, fits in zip(sets, same) if fits]
            values, roles = [], []
            for s in sets:
                at = np.minimum(np.searchsorted(seen, s), max(len(seen) - 1, 0))
                often = np.where(seen[at] == s, times[at], 0) if len(seen) else np.zeros(len(s), dtype=np.int64)
                value, role = _looked_up(s, often, options.percent)
                values.append(value)
                roles.append(role)
            rows = batch[["node", "root"]][same].reset_index(drop=True).assign(n=np.array([len(s) for s in sets], dtype=np.int64), sign=[_parities(s) for s in sets])
            rows = rows.loc[rows.index.repeat([len(v) for v in values])].reset_index(drop=True)
            joined = lambda x, kind: np.concatenate(x) if x else np.empty(0, dtype=kind)
            yield rows.assign(value=joined(values, np.int64), role=joined(roles, np.int32))[["value", "node", "root", "n", "role", "sign"]]

    return run


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    new = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    return np.flatnonzero(new)


def _unlinked(rows: pd.DataFrame, starts: np.ndarray, options: DedupOptions) -> pd.DataFrame:
    """Every pair within a run whose roots differ and that may be over the threshold."""
    block, lo, hi, node, root, n, role = (rows[c].to_numpy() for c in ("block", "lo", "hi", "node", "root", "n", "role"))
    sign = np.frombuffer(b"".join(rows["sign"].array), dtype=np.uint64).reshape(len(rows), 8)
    after = np.repeat(np.append(starts[1:], len(rows)), np.diff(np.append(starts, len(rows)))) - np.arange(len(rows)) - 1
    i, k, out = np.flatnonzero(after > 0), 1, []
    while len(i):
        fits = (root[i] != root[i + k]) & ((lo[i] == hi[i]) | (block[i] != block[i + k]))
        x, y = i[fits], i[fits] + k
        fits = 100 * np.minimum(n[x], n[y]) >= options.percent * np.maximum(n[x], n[y])
        fits &= (np.maximum(role[x], role[y]) == _SAMPLED) | ((role[x] == _FIRST) & (n[x] <= n[y])) | ((role[y] == _FIRST) & (n[y] <= n[x]))
        x, y = x[fits], y[fits]
        differ = np.bitwise_count(sign[x] ^ sign[y]).sum(axis=1, dtype=np.int64)
        fits = (100 + options.percent) * differ <= (100 - options.percent) * (n[x] + n[y])
        out.append(np.stack([np.maximum(node[x], node[y])[fits], np.minimum(node[x], node[y])[fits]], axis=1))
        k += 1
        i = i[after[i] >= k]
    found = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), dtype=np.int64)
    return pd.DataFrame(found, columns=["a", "b"])


def _across(options: DedupOptions):
    """``_unlinked`` over rows sorted by (value, lo, hi)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for batch in batches:
            rows = batch if before is None else pd.concat([before, batch], ignore_index=True)
            if not len(rows):
                continue
            starts = _runs(*(rows[c].to_numpy() for c in ("value", "lo", "hi")))
            before = rows.iloc[starts[-1] :]  # the next batch may go on with it
            if len(starts) > 1:
                yield _unlinked(rows.iloc[: starts[-1]], starts[:-1], options)
        if before is not None:
            yield _unlinked(before, np.array([0]), options)

    return run


def _root_of(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _rest(long: DataFrame, docs: DataFrame, nodes: DataFrame, roots: DataFrame, options: DedupOptions) -> DataFrame | None:
    """Candidates (a, b) between roots, of rows of long lists, by values that are rare among these.

    ``long`` has the rows of long lists; None if each of them is of one root.
    """
    spark = docs.sparkSession
    placed = materialize(_root_of(long.select("value", "node"), roots), "placed")
    counts = placed.groupBy("value").agg(F.count("*").alias("_n"), F.min("root").alias("least"), F.max("root").alias("most"))
    unsettled = materialize(counts.where("least <> most").select("value", "_n"), "unsettled")
    apart = spread_join(placed, unsettled, "value", "node", counts=unsettled).select("node", "root").distinct()
    apart = materialize(nodes.select("node", "n", "key", "keyless").join(apart, "node"), "apart")
    many, values = apart.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not many:
        return None
    share = min(1.0, options.sample / many, options.sample_values / values)
    sample = apart.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("node", "key", "keyless")
    counted = _fetched(docs, sample, options).mapInPandas(_sets(options), "node long, shingles array<long>").dropDuplicates(["node"])
    seen = counted.select(F.explode("shingles").alias("value")).groupBy("value").count().where("count > 2").toPandas().sort_values("value")
    sent = spark.sparkContext.broadcast((seen["value"].to_numpy(np.int64), seen["count"].to_numpy(np.int64)))
    rows = _fetched(docs, apart.drop("n"), options).mapInPandas(_rare(options, sent), "value long, node long, root long, n long, role int, sign binary")
    rows = materialize(rows.dropDuplicates(["node", "value"]), "rare")

    # only lists with several roots: the commonest root's rows meet the others, these meet each other
    by_root = rows.groupBy("value", "root").agg(F.count("*").alias("n"), F.max("role").alias("role"))
    lists = by_root.groupBy("value").agg(F.sum("n").alias("_n"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots"), F.max("role").alias("role"))
    blocks = lambda n: F.ceil(n / options.block).cast("int")
    lists = materialize(lists.where(f"roots > 1 AND role > {_LATER}").select(
        "value", "_n", F.col("most.root").alias("most"), blocks(F.col("most.n")).alias("same"), blocks(F.col("_n") - F.col("most.n")).alias("others")), "open")
    met = spread_join(rows, lists, "value", "node", counts=lists.select("value", "_n"))
    own = F.when(F.col("root") == F.col("most"), -1 - F.pmod(F.hash("node"), "same")).otherwise(F.pmod(F.hash("node"), "others"))
    start = F.when(F.col("root") == F.col("most"), F.lit(0)).otherwise(-F.col("same"))
    met = met.select("value", "node", "root", "n", "role", "sign", own.alias("block"), F.explode(F.sequence(start, F.col("others") - 1)).alias("other")).select(
        "value", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "root", "n", "role", "sign")
    parts, key = int(spark.conf.get("spark.sql.shuffle.partitions")), ["value", "lo", "hi"]
    met = met.repartition(parts, *key).sortWithinPartitions(*key).mapInPandas(_across(options), "a long, b long")
    return materialize(met.distinct(), "rest")


def _classes(docs: DataFrame, options: DedupOptions) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) for each row of ``docs``."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    sketched = materialize(docs.mapInPandas(_sketches(options), "doc_id long, text_hash long, node long, n long, sketch array<long>"), "sketches")
    nodes = sketched.where("n > 0").groupBy("node", "n", "sketch").agg(F.min("doc_id").alias("first_doc"), F.min("text_hash").alias("first_text"))
    # where a text of the node is found again
    nodes = materialize(nodes.withColumns({"key": F.coalesce("first_doc", "first_text"), "keyless": F.col("first_doc").isNull()}), "nodes")

    with scratch_until() as kept:
        lists = _lists(nodes, options)
        long = lists.where(F.col("held") > options.short)
        alike = 100 * F.col("low") >= options.percent * F.col("high")
        any_long = not long.isEmpty()
        overlaps = _all_pairs(lists.where(F.col("held") <= options.short)).where(alike)
        if any_long:
            overlaps = overlaps.unionByName(_hub_pairs(long, nodes, options).where(alike))
        overlaps = materialize(overlaps.select("a", "b").distinct(), "overlaps")
        kept += [lists, overlaps]
    roots = materialize(components(_links(overlaps, docs, nodes, options)), "roots")
    rest = None
    if any_long:
        with scratch_until() as kept:
            rest = _rest(long, docs, nodes, roots, options)
            kept += [rest] if rest is not None else []
    if rest is not None and not (more := _links(rest, docs, nodes, options)).isEmpty():
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = materialize(components(known.unionByName(more)), "roots")

    placed = _root_of(nodes.select("node", "first_doc", "first_text"), roots)
    smallest = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.min("first_text").alias("first_text"))
    classes = materialize(placed.select("node", "root").join(smallest, "root").select("node", "component_id", "first_text"), "classes")
    alone = sketched.where("node IS NULL").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    out = spread_join(sketched.where("node IS NOT NULL").select("doc_id", "text_hash", "node", "n"), classes, "node", "doc_id")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("text_hash") == F.col("first_text")))
    return out.select("doc_id", "text_hash", "n", "component_id", kept.alias("kept")).unionByName(alone).withColumnRenamed("n", "n_shingles")


def near_duplicates(docs: DataFrame, options: DedupOptions = DedupOptions()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    return _classes(docs, options).drop("text_hash")


def dedup_stage(docs: DataFrame, options: DedupOptions = DedupOptions()) -> DataFrame:
    """One document of each group, the one with the smallest doc_id (if it is repeated, all its rows)."""
    a, b = fresh(docs.columns, "kept_id"), fresh(docs.columns, "kept_text")
    kept = _classes(docs, options).where("kept").select(F.col("doc_id").alias(a), F.col("text_hash").alias(b)).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b)), "left_semi")
