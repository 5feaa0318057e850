"""Near-duplicates against all pairs by brute force."""

import random

import pytest

from churnscope.llm import dedup

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, node string, kept_id string, text_hash string, sketch int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", 1) for i, t in rows], SCHEMA)


def shingles(t):
    w = (t or "").encode().translate(LOWER).split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows, percent=85):
    """(set sizes, classes as lists of row numbers) by all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            low, high = sorted((len(sets[a]), len(sets[b])))
            if low and 100 * low >= percent * high and find(a) != find(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (low + high - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(rows))]


def words(r, n, letters="abcdefgh", size=5):
    return ["".join(r.choice(letters) for _ in range(size)) for _ in range(n)]


def changed(r, base, k):
    out = list(base)
    for _ in range(k):
        out[r.randrange(len(out))] = words(r, 1)[0]
    return out


@pytest.fixture(scope="module")
def corpus():
    """Rows around the threshold in all the ways that lists can be long."""
    r = random.Random(5)
    texts = [None, "", "  ", "One", "one", "a b c", "A  b\tc"]
    for _ in range(5):  # chains of near copies
        base = words(r, r.randrange(60, 200))
        for _ in range(10):
            texts.append(" ".join(base))
            base = changed(r, base, r.randrange(1, 4))
    passage = words(r, 300)
    for k in range(400):  # pairs within a large group that shares a passage but is not near as a group
        own = words(r, r.choice([58, 60, 62, 90]))
        texts.append(" ".join(passage + own))
        if k % 2 == 0:
            twin = changed(r, own, 2)
            texts.append(" ".join(passage[:150] + words(r, 1) + passage[150:] + twin))
    base = words(r, 150)
    for _ in range(120):  # near to their common text, mostly not to each other; one more is the text itself
        texts.append(" ".join(changed(r, base, r.randrange(1, 5))))
    gone = words(r, 150)
    texts += [" ".join(base)] + [" ".join(changed(r, gone, r.randrange(1, 4))) for _ in range(60)]
    texts += [" ".join(base)] * 300 + [" ".join(f"w{i}" for i in range(30_000))]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    return rows, brute(rows)


def compare(got, rows, sizes, classes):
    got = {x.doc_id: x for x in got.collect()}
    assert len(got) == len(rows)
    for (i, _), n, c in zip(rows, sizes, classes):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, rows[c][0], rows[c][0] == i)


def test_classes_equal_all_pairs(spark, corpus):
    rows, (sizes, classes) = corpus
    compare(dedup.near_duplicates(frame(spark, rows)), rows, sizes, classes)


def test_no_link_depends_on_partitions_batches_or_hubs(spark, corpus):
    rows, (sizes, classes) = corpus
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        options = dedup.DedupOptions(short=2, sample=100, block=32)
        compare(dedup.near_duplicates(frame(spark, rows).repartition(5), options), rows, sizes, classes)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_rows_without_ids_repeated_rows_and_none(spark):
    r = random.Random(3)
    a, b, c = (" ".join(words(r, 50)) for _ in range(3))
    rows = [(4, a), (9, a + " tail"), (None, a), (None, b), (None, b), (None, b + " tail"), (7, c), (7, c), (7, "other text"), (None, None), (2, "")]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in dedup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert len(got) == len(rows)
    assert (4, 46, 4, True) in got and (9, 47, 4, False) in got and (None, 46, 4, False) in got
    lone = [x for x in got if x[0] is None and x[2] is None and x[1] > 0]
    assert len(lone) == 3 and len({x[1] for x in lone if x[3]}) == 1 and (None, 0, None, True) in got and (2, 0, 2, True) in got
    assert got.count((7, 46, 7, True)) == 2 and (7, 1, 7, True) in got
    stage = dedup.dedup_stage(frame(spark, rows))
    assert stage.columns == frame(spark, []).columns
    kept = [(x.doc_id, x.text) for x in stage.collect()]
    assert kept.count((7, c)) == 2 and (9, a + " tail") not in kept and (None, a) not in kept and (4, a) in kept and (None, None) in kept
    assert {t for i, t in kept if i is None and t} in ({b}, {b + " tail"})
    assert dedup.near_duplicates(frame(spark, [])).count() == 0 and dedup.dedup_stage(frame(spark, [])).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_looked_up_values_are_shared(percent):
    """A pair over the threshold shares a value by roles, whatever the order of values."""
    import numpy as np

    rng = np.random.default_rng(percent)
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        x = rng.choice(1 << 40, n, replace=False)
        m = int(rng.integers(0, n + 1))
        y = np.concatenate([x[: n - m], rng.choice(1 << 40, int(rng.integers(0, m + 2)), replace=False)])
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < percent * (len(x) + len(y) - both):
            continue
        cut = rng.integers(0, 1 << 40)
        often = lambda s: np.where(s % 7 < 3, 0, np.where(s < cut, 5, 9))
        (u, p), (v, q) = (dedup._looked_up(s, often(s), percent) for s in (x, y))
        met = [(p[i], q[j]) for i in range(len(u)) for j in np.flatnonzero(v == u[i])]
        assert any(2 in pq or (pq[0] == 1 and len(x) <= len(y)) or (pq[1] == 1 and len(y) <= len(x)) for pq in met)
