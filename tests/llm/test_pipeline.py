import random

import corpus_pipeline
import public_tokenizers
from churnscope.llm import bpe


def test_pipeline_end_to_end(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    clean = [" ".join([*(word() for _ in range(40)), "the of and to", *(word() for _ in range(40))]) for _ in range(20)]
    texts = clean + [clean[0], clean[1] + " tail", "### " * 50, None, "too short", clean[2] + " password=Zx9aB3kQ7mW2"]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if k < 4:
            assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        frame = seen[name] = spark.read.parquet(str(tmp_path / f"stage{k}"))
    ids = lambda n: {x.doc_id for x in seen[n].collect()}
    assert ids("quality rules") == set(range(22)) | {25}
    assert ids("near-duplicates") == set(range(20))
    assert not any("password=Zx" in x.text for x in seen["secret scans"].collect()) and seen["secret scans"].count() == 20
    codec = bpe.Codec.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts_mixed = sorted(x.text for x in seen["mixing"].collect())
    assert sorted(codec.decode(bytes(x.ids)).decode() for x in seen["byte-level BPE"].collect()) == texts_mixed
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(x.doc_id for x in whole.collect()) == sorted(x.doc_id for x in seen["byte-level BPE"].collect())


def test_near_copies_from_80_percent_go(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    words = [word() for _ in range(100)]
    near, far = list(words), list(words)
    for k in (30, 70):  # 86 of 106 shingles shared
        near[k] = word()
    for k in (20, 40, 60):  # 81 of 111
        far[k] = word()
    rows = [(i, " ".join(w)) for i, w in enumerate([words, near, far])]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {x.doc_id for x in kept.collect()} == {0, 2}


def test_pipeline_with_nulls_repeats_clashes_and_long_texts(spark, tmp_path):
    r = random.Random(18)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    clean = [" ".join([*(word() for _ in range(40)), "the of and to", *(word() for _ in range(40))]) for _ in range(4)]
    texts = [*clean, clean[0], None, "", " ".join(f"{word()} {word()} {word()} the" for _ in range(15_000))]
    rows = [(i if i != 2 else None, t, None if i == 3 else "en", None if i == 1 else "s", len(t or "")) + ("x",) * 7 for i, t in enumerate(texts)]
    rows += [rows[1]] * 2
    extra = ["_q_quality", "_mix", "_secrets", "kept_id", "text_hash", "_ids", "node"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    for name, data in (("full", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path / "full"))
        if k < 4:
            assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        frame = spark.read.parquet(str(tmp_path / f"stage{k}"))
        counts.append(sorted((x.doc_id is None, x.doc_id) for x in frame.select("doc_id").collect()))
        if k < 4:
            assert {c: frame.select(c).distinct().first()[0] for c in extra} == dict.fromkeys(extra, "x")
    ids = lambda k: [i for _, i in counts[k]]
    assert ids(0) == [0, 1, 1, 1, 3, 4, 7, None]  # null and empty texts go
    assert ids(1) == ids(2) == [0, 1, 1, 1, 3, 7, None]  # the copy goes; repeated rows stay, as does the one without an id
    assert set(ids(4)) <= set(ids(2)) and ids(3) == ids(4) and frame.where("doc_id = 7").count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
