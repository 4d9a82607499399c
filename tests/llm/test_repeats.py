import hashlib
import random
import re

import numpy as np
import pytest

from fathom.llm import recompression, repeats, suffixes
from fathom.llm.queries import op2_recompression, op8_suffix_array


def gone(units, width=50):
    """Flags for each document's units, by looking at all windows."""
    least = {}
    rank = lambda i: float("inf") if i is None else i
    for i, u in units:
        for s in range(len(u) - width + 1):
            w = tuple(u[s : s + width])
            least[w] = min(least.get(w, float("inf")), rank(i))
    out = []
    for i, u in units:
        f = [False] * len(u)
        for s in range(len(u) - width + 1):
            if least[tuple(u[s : s + width])] < rank(i):
                f[s : s + width] = [True] * width
        out.append(f)
    return out


def brute_words(docs):
    units = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    return sorted(((i, len(u), sum(f), hashlib.sha256(" ".join(w for w, x in zip(u, f) if not x).encode()).hexdigest()) for (i, u), f in zip(units, gone(units))), key=str)


def brute_bytes(docs):
    units = [(i, (t or "").encode()) for i, t in docs]
    return sorted(
        ((i, len(u), sum(f), sum(x and not y for x, y in zip(f, [False, *f])), hashlib.sha256(bytes(b for b, x in zip(u, f) if not x)).hexdigest()) for (i, u), f in zip(units, gone(units))),
        key=str,
    )


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["été", "ß", "the", "the", "the"] * 20
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passages = [text(k) for k in (49, 50, 51, 55, 70, 120, 300)] + ["x " * 130 + "y", ("a b " * 60) + "c", "run " * 49 + "end", "q" * 120, "ab" * 40]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(r.choice([0, 1, 2, 4])):
            p = r.choice(passages)
            parts += [text(r.choice([0, 1, 3, 30])), p if r.random() < 0.6 else p[r.randrange(len(p) // 2) :]]
        docs.append((i * 3, " ".join(parts)))
    docs += [(1, None), (4, ""), (7, docs[10][1]), (7, docs[10][1]), (None, docs[11][1]), (None, docs[12][1]), (8, text(3000) + "\n" + docs[5][1]), (-5, docs[20][1]), (10, "\t \n")]
    r.shuffle(docs)
    return docs


def test_against_brute_force(spark, tmp_path):
    docs = corpus(1)
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, block string, n_units int")
    d.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, op2_recompression(spark, str(tmp_path)).collect()), key=str) == brute_words(docs)
    assert sorted(map(tuple, op8_suffix_array(spark, str(tmp_path)).collect()), key=str) == brute_bytes(docs)


@pytest.mark.parametrize("method", [recompression.Words(), suffixes.Bytes()])
def test_hot_anchors_and_small_blocks(spark, method):
    """Many blocks, nearly all anchors hot, texts cut into short stretches."""
    docs = corpus(2)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = repeats.without_repeats(d, method, hot=1, block_bytes=900, step=200)
    rows = sorted(((r.doc_id, r.n_units, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in out.collect()), key=str)
    want = brute_words(docs) if isinstance(method, recompression.Words) else [(a, b, c, e) for a, b, c, _, e in brute_bytes(docs)]
    assert rows == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op2_recompression(spark, str(tmp_path)).count() == op8_suffix_array(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("period", suffixes.COVERS)
def test_suffix_order(period):
    r = random.Random(period)
    data = np.frombuffer("".join(r.choice(["ab", "b", "a" * 30, "xyz" * 9, "abababab" * 8]) for _ in range(150)).encode(), np.uint8)
    wanted = np.array(sorted(r.sample(range(len(data) - 60), 900)))
    text = data.tobytes()
    got = [text[i : i + 50] for i in suffixes.sorted_suffixes(data, wanted, period=period)]
    assert got == sorted(text[i : i + 50] for i in wanted)


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op2_recompression(spark, sf).collect()), key=str) == brute_words(docs)
    assert sorted(map(tuple, op8_suffix_array(spark, sf).collect()), key=str) == brute_bytes(docs)
