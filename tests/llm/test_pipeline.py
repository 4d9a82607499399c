"""The pipeline against plain Python on a small corpus."""

import random
import zlib

import numpy as np
from test_decontaminate import brute as windows_of
from test_near_copies import brute as near
from tokenizers import Tokenizer

import corpus_pipeline
from fathom.llm import toxicity
from fathom.llm.queries import tokenizer


def corpus():
    r = random.Random(9)
    vocabulary = [f"w{a}{b}x" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrstuvwxy"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(25)) for k in range(4)]
    docs, labels = [], []
    for i in range(150):
        lines = [text(r.choice([12, 40, 90])) for _ in range(r.choice([1, 2, 4]))]
        if i % 5 == 0:
            lines[0] += " moron"
            labels.append((i, 1))
        else:
            labels.append((i, 0))
        if i % 4 == 1:
            lines.append("This page was last changed on 2020-01-02 by us")
        if i % 30 == 2:
            lines.append("before " + items[i % 4][1] + " after")
        docs.append((i, "\n".join(lines)))
    docs += [(200 + k, docs[k][1]) for k in (3, 4, 8)]
    docs += [(300, docs[6][1] + " tail"), (301, None), (302, ""), (303, "This page was last changed on 1 by us")]
    return docs, labels, items


def test_against_plain_python(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = toxicity.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert model.weights.max() > 3
    left = [(d, t) for d, t in docs if "moron" not in (t or "")]
    boilerplate = lambda x: x.startswith("This page was last changed on ")
    left = [(d, None if t is None else "\n".join(x for x in t.split("\n") if not boilerplate(x))) for d, t in left]
    left = [(d, t) for d, t in left if d != 303]
    kept = {d for d, _, _, k in near(left) if k}
    left = [(d, t) for d, t in left if d in kept]
    clean = {d for d, _, n, *_ in windows_of(left, items) if not n}
    assert len(clean) < len(left)
    coder = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = []
    for d, t in left:
        if d in clean:
            ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            assert len(ids) <= 2048
            want.append((d, 0, 0, len(ids), zlib.crc32(ids)))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs[:40]], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
