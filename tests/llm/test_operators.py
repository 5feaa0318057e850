"""Other operators against brute force, round trips and held-out rows."""

import hashlib
import math
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from churnscope.llm import bpe, licenses, maxent, onebit_ann, packing, url_rules
from churnscope.llm.components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, x) for x in range(1001, 1050)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(1, 61)} == {1} and {got[i] for i in range(1000, 1050)} == {1000} and len(got) == 110


def test_bpe_equals_tiktoken(spark):
    codec = bpe.Codec.from_file(RANKS, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(3)
    texts = [None, "", " ", "\n\n x", "日本語のテキスト", "🎉👩‍👩‍👧", "<|endoftext|>", "a" * 5000, "I'll don't  \t\n"] + [
        "".join(r.choice("abcdetionhe \n'.,é日st0") for _ in range(r.randrange(80))) for _ in range(60)]
    rows = bpe.bpe_decode(bpe.bpe_encode(docs(spark, texts), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    for row in rows:
        text = texts[row.doc_id] or ""
        assert bytes(row._ids) == array("I", plain.encode_ordinary(text)).tobytes() and bytes(row._bytes).decode() == text
    e = bpe.EditableEncoding(codec, "The quick brown fox " * 50)
    assert e.edit(500, 505, "jumps") < 10 and e.flat() == plain.encode_ordinary(e.text)
    for _ in range(60):
        a = r.randrange(len(e.text) + 1)
        e.edit(a, min(len(e.text), a + r.randrange(4)), r.choice(["", " ", "x", "'s", "\n", "日"]))
        e.append(r.choice(["abc", " x", "  "]))
        assert e.flat() == plain.encode_ordinary(e.text)


def test_packing_is_lossless(spark):
    r = random.Random(4)
    texts = [None, ""] + [" ".join(r.choice(["alpha", "be", "gamma", "d"]) for _ in range(r.randrange(1, 400))) for _ in range(60)]
    options = packing.PackOptions(length=128, pool=50)
    rows = packing.pack_documents(docs(spark, texts), RANKS, public_tokenizers.PATTERN, options).collect()
    codec, parts = bpe.Codec.from_file(RANKS, public_tokenizers.PATTERN), {}
    for row in rows:
        ids = np.frombuffer(row.ids, np.uint32)
        assert len(ids) == 128 and row.position_resets == row.cu_lengths[:-1] and row.cu_lengths[-1] == row.n_tokens
        assert list(packing.positions(row.asDict(), 128)[: row.n_tokens]) == [k for a, b in zip(row.cu_lengths, row.cu_lengths[1:]) for k in range(b - a)]
        for doc, part, a, b in zip(row.doc_ids, row.parts, row.cu_lengths, row.cu_lengths[1:]):
            parts[doc, part] = ids[a:b]
    for i, t in enumerate(texts):
        mine = [parts[k] for k in sorted(k for k in parts if k[0] == i)]
        assert b"".join(x.tobytes() for x in mine) == (codec.encode(t) if t else b"")
    for _ in range(20):  # as full as by a plain search for the fullest row with room (rows with equal room are alike)
        capacity = r.randrange(5, 200)
        lengths = [r.randrange(1, capacity + 1) for _ in range(r.randrange(0, 300))]
        bins = packing.best_fit_decreasing(lengths, capacity)
        plain, room = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [k for k in range(len(room)) if room[k] >= lengths[i]]
            if fits:
                k = min(fits, key=lambda k: room[k])
            else:
                k = len(room)
                room.append(capacity)
                plain.append([])
            room[k] -= lengths[i]
            plain[k].append(i)
        shape = lambda rows: sorted(sum(lengths[i] for i in b) for b in rows)  # noqa: B023, E731
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and len(bins) == len(plain) and shape(bins) == shape(plain)
    assert packing.pack_documents(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_ann_is_exact_here(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 64)).astype(np.float32)
    x[100:160] = x[100]  # ties
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(900)] + [(900, None, 0), (1000, [0.0] * 64, 0), (1100, [1.0] * 3, 0), (1200, [float("nan")] * 64, 0), (1300, [None] + [1.0] * 63, 0), (None, [1.0] * 64, 0)]
    rows += rows[100:103]
    short = rng.standard_normal((30, 8))
    rows += [(2000 + i, [float(v) for v in short[i]], 0) for i in range(30)]  # another length, among themselves
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code int")
    got = {}
    for r in onebit_ann.nearest(frame, F.col("vec_id") % 50 == 0, onebit_ann.OneBitOptions(wave=7)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y, hits, z = x.astype(np.float64), 0, short.astype(np.float32).astype(np.float64)
    assert [v for _, v, _ in sorted(got.pop(2000))] == (2000 + np.argsort(((z - z[0]) ** 2).sum(axis=1))[1:11]).tolist()
    assert sorted(got) == list(range(0, 900, 50))
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        hits += len(set(want) & {v for _, v, _ in found})
        assert [k for k, _, _ in sorted(found)] == list(range(1, 11))
        assert all(s == pytest.approx(d[v], abs=1e-9) for _, v, s in found)
    assert hits >= 0.9 * 10 * len(got)
    assert onebit_ann.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_lm_scores(spark):
    r = random.Random(6)
    heads = [f"h{i}" for i in range(20)]

    def text():
        w = "h0"
        out = []
        for _ in range(r.randrange(5, 80)):
            w = heads[(heads.index(w) * 3 + 1) % 20] if r.random() < 0.8 else r.choice(heads)
            out.append(w.upper() if r.random() < 0.1 else w)
        return " ".join([*out, f"rare{r.randrange(300)}"])

    texts = [None, "", "never seen before"] + [text() for _ in range(300)]
    got = {x.doc_id: x for x in maxent.score_documents(docs(spark, texts)).collect()}
    tokens = {i: (t or "").encode().translate(LOWER).split() + [b" "] for i, t in enumerate(texts)}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    for i, ws in tokens.items():
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (len(ws), sum(train[w] > 0 for w in ws), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert x.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert x.score < 0
    held = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held) + 0.2 * sum(x.n_tokens for x in held)
    clash = docs(spark, texts + texts[5:9], [*range(len(texts)), None, None, 5, 5]).withColumns({"part": F.lit("x"), "row": F.lit(1), "tokens": F.lit("y")})
    again = maxent.score_documents(clash).collect()
    assert len(again) == len(texts) + 4 and sum(x.doc_id is None for x in again) == 2 and sum(x.doc_id == 5 for x in again) == 3
    assert maxent.score_documents(docs(spark, [])).count() == 0


def test_lm_chances_add_up():
    o = maxent.MaxentOptions(rows=(64, 32, 32))
    rng = np.random.default_rng(0)
    model = maxent.Model((rng.standard_normal((o.table, 16)) * 0.3).astype(np.float32), o)
    leaves = np.arange(o.words + o.buckets)
    for one, two in ((3, 4095), (maxent.START, maxent.START), (17, 17)):
        chances = 10 ** model.scores(leaves, np.full(len(leaves), one), np.full(len(leaves), two))
        assert chances.sum() == pytest.approx(1, abs=1e-4)
    # what was seen less what is expected is the gradient of the log-likelihood
    leaf, one, two = (rng.integers(0, 4096, 500) for _ in range(3))
    seen, expected = np.zeros(model.w.size), np.zeros(model.w.shape)
    model.counts(leaf, one, two, seen, expected)
    gradient = seen.reshape(model.w.shape) - expected
    model.w = model.w.astype(np.float64)
    value = lambda: model.scores(leaf, one, two).sum() * np.log(10)
    for at in [tuple(x) for x in np.argwhere(np.abs(gradient) > 3)[:3]]:
        before = value()
        model.w[at] += 0.01
        assert (value() - before) / 0.01 == pytest.approx(gradient[at], rel=0.05, abs=0.2)


def test_lm_sums_are_packed(spark):
    """What two training tasks send adds up, takes 8 bytes a weight at most, and leaves out blocks without sums."""
    rng = np.random.default_rng(2)
    n = 3 * maxent._BLOCK + 16
    tasks = [(rng.integers(0, 9, n).astype(float), rng.random(n)) for _ in range(2)]
    for sums in tasks[0] + tasks[1]:
        sums[maxent._BLOCK : 2 * maxent._BLOCK] = 0
    sent = [r for x in tasks for f in maxent._blocks(*x) for r in f.itertuples(index=False)]
    assert len(sent) == 6 and sum(len(r.seen) + len(r.expected) for r in sent) <= 8 * 2 * n
    got = {r.block: r for r in spark.createDataFrame(sent, maxent._BLOCKS).repartition("block").mapInPandas(maxent._added, maxent._BLOCKS).collect()}
    assert sorted(got) == [0, 2, 3]
    for i, name in enumerate(("seen", "expected")):
        want = tasks[0][i] + tasks[1][i]
        for b, r in got.items():
            assert np.frombuffer(r[name], np.float32) == pytest.approx(want[b * maxent._BLOCK : (b + 1) * maxent._BLOCK], rel=1e-6)
    assert not list(maxent._blocks(np.zeros(n), np.zeros(n)))


def test_lm_weights_beyond_exp():
    """Weights whose sums exp can't take score as those that differ by a constant do; chunks of any length agree."""
    rng = np.random.default_rng(3)
    o = maxent.MaxentOptions(rows=(64, 32, 32))
    w = (rng.standard_normal((o.table, 16)) * 0.3).astype(np.float32)
    leaf, one, two = (rng.integers(0, 4096, 1000) for _ in range(3))
    plain = maxent.Model(w, o)
    for shift in (-200, 200):
        shifted = maxent.Model(w + np.float32(shift), o)
        assert plain.tame and not shifted.tame
        assert shifted.scores(leaf, one, two) == pytest.approx(plain.scores(leaf, one, two), abs=2e-3)
    short = maxent.Model(w, maxent.MaxentOptions(rows=(64, 32, 32), chunk=7))
    assert short.scores(leaf, one, two) == pytest.approx(plain.scores(leaf, one, two), abs=1e-5)
    sums = []
    for model in (plain, short):
        sums.append((np.zeros(w.size), np.zeros(w.shape)))
        model.counts(leaf, one, two, *sums[-1])
    assert (sums[0][0] == sums[1][0]).all() and np.abs(sums[0][1] - sums[1][1]).max() < 1e-3


def test_lm_vocabulary_and_contexts():
    o = maxent.MaxentOptions(words=3072, frequent=4)
    tokens = np.array([5, -7, 1024 * 9 + 5, 40], dtype=np.int64)
    v = maxent.Vocabulary(tokens, np.array([10, 3, 7, 1]), 30, 9, o)
    found, n, leaf = v.find(np.array([-7, 5, 40, 77], dtype=np.int64))
    assert found.tolist() == [True, True, True, False] and n.tolist() == [3, 10, 1, 0] and leaf.tolist() == [2, 0, 3, 3072 + 77]
    one, two = maxent.contexts(np.array([1, 2, 3, 9, 8]), np.array([3, 4, 5]))
    s = maxent.START
    assert one.tolist() == [s, 1, 2, s, s] and two.tolist() == [s, s, 1, s, s]
    assert [x.tolist() for x in maxent.contexts(np.empty(0, np.int64), np.empty(0, np.int64))] == [[], []]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/712?x=1#t", "https://b.com/en/", "ftp://com/en/1", "x://evilcom/en/", "http://example.net/de/8", "http://net/de/9", "http://u@h.org:80/es/?a", "http://a?://b.com/en/", "http://q.org/es"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r._url for r in url_rules.url_filter(pages, spark.createDataFrame([], "page_id long, verdict string")).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 2, 3, 9)] == [("", ""), ("", ""), ("a.example.com", "/en/712"), ("u@h.org:80", "/es/")]
    assert [got[i].rule for i in range(12)] == [None, None, None, "example.com/en/7", "com/en/", "com/en/", None, "example.net/de/8", "net/de/", None, None, None]
    assert [got[i].verdict for i in (3, 4, 7, 8)] == ["allow", "block", "block", "block"]
    assert got[10].host == "a"


def test_url_rules_have_the_words_of_the_contract(spark):
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r.name: r.verdict for r in url_rules.BASE_RULES} == contract
    pages = spark.createDataFrame([(i, f"https://a.{name}1") for i, name in enumerate(contract)], "page_id long, url string")
    got = {r._url.rule: r._url.verdict for r in url_rules.url_filter(pages, spark.createDataFrame([], "page_id long, verdict string")).collect()}
    assert got == contract


def brute_rules(rows, o):
    """Rules by counting all token sets up to o.max_tokens; rows of (tokens, verdict)."""
    from itertools import combinations

    n, verdicts, sets = len(rows), Counter(v for _, v in rows), Counter()
    for tokens, v in rows:
        for k in range(1, o.max_tokens + 1):
            for c in combinations(sorted(tokens), k):
                sets[c] += 1
                sets[c, v] += 1
    out = []
    for c in [c for c in sets if not isinstance(c[0], tuple)]:
        for v in verdicts:
            with_v = sets[c, v]
            if with_v >= math.ceil(o.min_support * n) and with_v / sets[c] >= o.min_confidence and with_v / sets[c] / (verdicts[v] / n) >= o.min_lift:
                out.append((c, v, with_v / sets[c]))
    kept = []
    for c, v, conf in sorted(out, key=lambda x: (len(x[0]), -x[2], x[0])):
        if not any(w == v and set(d) <= set(c) and x >= conf for d, w, x in kept):
            kept.append((c, v, conf))
    return kept


def test_url_rules_of_many_tokens(spark):
    """Rules whose tokens are the least telling of more than ten in their URLs."""
    r = random.Random(8)
    rows = []
    for _ in range(400):
        a, b = r.random() < 0.5, r.random() < 0.5  # neither alone tells anything
        noise = [f"n{k}" for k in range(16) if r.random() < (0.95 if a == b else 0.75)]  # tell a little each
        rows.append(([f"q:{k}" for k in ("always", f"a{a}", f"b{b}", *noise)], "block" if a == b else "allow"))
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    options = url_rules.MiningOptions(min_support=0.05)
    rules = url_rules.mine_rules(labelled, options)
    assert {("block", ("q:aTrue", "q:bTrue"), 1.0), ("allow", ("q:aFalse", "q:bTrue"), 1.0)} <= set(rules)
    assert sorted((v, c, x) for c, v, x in brute_rules(rows, options)) == sorted(rules)
    # two hundred keys in every URL add nothing
    wide = spark.createDataFrame([([f"q:{k}" for k in range(200)] + t[1:3], v) for t, v in rows], "tokens array<string>, verdict string")
    assert sorted(url_rules.mine_rules(wide, options)) == sorted((v, c, x) for c, v, x in brute_rules([(t[1:3], v) for t, v in rows], options))


def test_url_rules_are_mined(spark):
    r = random.Random(14)
    rows = []
    for i in range(600):
        spam, odd = i % 4 == 0, r.random() < 0.03
        host = "spam-farm" if spam else f"site{i % 9}"
        keys = "&".join(f"{k}=1" for k in r.sample("abcdefgh", 4))
        rows.append((i, f"http://{host}.info/{'buy' if spam != odd else 'read'}/{r.choice(['x', 'y'])}/{i}?{keys}"))
    rows += [(600, "http://q.info/" + "deep/" * 20_000), (601, None), (5, rows[5][1])]
    pages = spark.createDataFrame([(*x, "clash", "clash", 1) for x in rows], "page_id long, url string, _parsed string, _mined string, tokens int")
    labels = pages.where("page_id < 500").select("page_id", F.when(F.col("page_id") % 4 == 0, "block").otherwise("allow").alias("verdict"))
    options = url_rules.MiningOptions(min_support=0.02, telling=30)  # all tokens
    judged = url_rules.url_filter(pages, labels.unionByName(labels.limit(3)), options=options)
    got = {x.page_id: x._url for x in judged.collect()}
    assert judged.columns == [*pages.columns, "_url"] and judged.where("page_id = 5").count() == 2
    # the brute-force rules, matched one by one
    tokens = {x.page_id: x.t for x in pages.select("page_id", url_rules.judged_by_rules(F.col("url"))["tokens"].alias("t")).collect()}
    rules = brute_rules([(tokens[i], "block" if i % 4 == 0 else "allow") for i, *_ in rows if i < 500], options)
    assert rules and any(len(c) > 1 for c, _, _ in rules)
    for i in got:
        hits = [x for x in rules if set(x[0]) <= set(tokens[i])]
        best = max(hits, key=lambda x: (x[2], len(x[0]))) if hits else None
        assert got[i].verdict == (best[1] if best else "allow"), i
        assert (got[i].mined is None) == (best is None) and (best is None or (tuple(got[i].mined.split(" ")), got[i].verdict, best[2]) in [x for x in rules])
    # filters on the result are answered, the default options bound what is mined
    for options in (options, url_rules.MiningOptions(telling=4)):
        judged = url_rules.url_filter(pages, labels, options=options)
        assert judged.where("_url.verdict = 'block'").count() == sum(x._url.verdict == "block" for x in judged.collect()) > 100
        assert judged.where("_url.mined IS NOT NULL").count() > 100
    none = labels.limit(0)
    assert {x._url.verdict for x in url_rules.url_filter(pages, none).collect()} == {"allow"} and url_rules.url_filter(pages.limit(0), none).count() == 0
    both = labels.withColumn("verdict", F.lit("allow")).unionByName(labels.where("page_id % 4 = 0"))  # contradicting labels block
    assert url_rules.url_filter(pages, both).where("_url.verdict = 'block'").count() > 100


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT/permission"]
    changed = mit.replace("without restriction", "with no restriction").replace("publish, ", "")
    texts = [None, "", "é日 Licensed under the\n * APACHE License, version 2.0. more", "x Licensed under CC BY-NC 4.0. y", "Licensed under CC BY 4.0.", f"a b {changed} c d " + "license text " * 50, "the license of the software is here", "w " * 20000 + "Released under the MIT License."]
    got = {}
    for r in licenses.scan_licenses(docs(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {k: [x.license for x in v] for k, v in got.items()} == {2: ["Apache-2.0/notice"], 3: ["CC-BY-NC-4.0/notice"], 4: ["CC-BY-4.0/notice"], 5: ["MIT/permission"], 7: ["MIT/notice"]}
    a = got[2][0]
    assert texts[2][a.start : a.end].startswith("Licensed") and texts[2][a.start : a.end].endswith("2.0") and a.coverage == 1
    assert 0.9 < got[5][0].coverage < 1 and texts[5][got[5][0].start :].startswith("Permission")


def test_licenses_equal_plain_alignment(spark):
    """A changed template is found if its longest common subsequence with the original covers enough."""
    import re as _re

    r = random.Random(22)
    o = licenses.LicenseOptions()
    words = {n: _re.findall(r"[a-z0-9]+", t.lower()) for n, t in licenses.TEMPLATES.items()}

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    noise = lambda n: [f"n{r.randrange(50)}" for _ in range(n)]
    texts, wanted = [], []
    for name in sorted(words):
        for edits in (0, 1, len(words[name]) // 12, len(words[name]) // 3):
            t = list(words[name])
            for _ in range(edits):
                t[r.randrange(len(t))] = "zz"
            texts.append(" ".join([*noise(30), *t, *noise(30)]))
            wanted.append((name, common(words[name], t) >= o.coverage * len(t)))
    got = {}
    for row in licenses.scan_licenses(docs(spark, texts)).collect():
        got.setdefault(row.doc_id, set()).add(row.license)
    for i, (name, there) in enumerate(wanted):
        found = got.get(i, set())
        assert (name in found) == there or (there and any(len(words[x]) > len(words[name]) for x in found)), (texts[i], found)
    assert sum(there for _, there in wanted) > 20 and not all(there for _, there in wanted)
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_licenses_with_any_word_changed():
    index = licenses.LicenseIndex(licenses.TEMPLATES, licenses.LicenseOptions())
    for name, words in zip(index.names, index.words):
        alone = licenses.LicenseIndex({name: licenses.TEMPLATES[name]}, licenses.LicenseOptions())
        for k in range(len(words)):
            text = " ".join("zzz" if i == k else w.decode() for i, w in enumerate(words))
            assert [x[0] for x in alone.matches(text)] == [name]
    assert [x[0] for x in index.matches("Distributed under the MIT License")] == ["MIT/notice"]
