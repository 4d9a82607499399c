import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import components, near_copies
from fathom.llm.queries import op3_lsh_forest


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(docs):
        c = least.get(find(i))
        out.append((d, len(sets[i]), c, d == c if d is not None and c is not None else c is None))
    return sorted(out, key=str)


def corpus(seed, bases=12):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Été", "ß"]
    docs = []
    for _ in range(bases):
        base = [r.choice(vocabulary) for _ in range(r.choice([5, 30, 80, 300]))]
        for _ in range(r.choice([1, 2, 5, 40])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append(" ".join(w).upper() if r.random() < 0.1 else " ".join(w))
            base = w if r.random() < 0.3 else base  # chains
    ids = r.sample(range(10_000), len(docs))
    out = list(zip(ids, docs, strict=True))
    out += [(10_001, None), (10_002, ""), (10_003, "a b"), (10_004, "A  b"), (10_005, "a b c d e"), (10_006, docs[3]), (10_006, docs[3]), (None, "lonely text of some words"), (None, "lonely text of some words"), (10_009, " \n")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, tmp_path, seed):
    docs = corpus(seed)
    spark.createDataFrame([(*d, 3, b"x") for d in docs], "doc_id long, text string, n_shingles int, node binary").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, op3_lsh_forest(spark, str(tmp_path)).collect()), key=str) == brute(docs)


def test_empty_table_and_filter(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op3_lsh_forest(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (None, "z")], "doc_id long, text string")
    assert {r[0] for r in near_copies.without_near_copies(docs).collect()} == {1, 3, None}


@pytest.mark.parametrize("one_task", [1000, 0])
def test_components(spark, one_task):
    r = random.Random(4)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(20)] + [(5, 5)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "u long, v long").repartition(3), one_task).collect()}
    nodes, roots = components.roots_of(*map(list, zip(*links)))
    assert got == dict(zip(nodes, roots))
    assert got[120] == 100


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op3_lsh_forest(spark, sf).collect()), key=str) == brute(docs)


def test_stage_at_80(spark):
    import corpus_pipeline

    base = [f"b{k}" for k in range(104)]  # 100 shingles; each word changed far from others changes five
    changed = lambda tag, *at: " ".join(f"{tag}{k}" if k in at else w for k, w in enumerate(base))
    docs = [(1, " ".join(base)), (2, changed("x", 20, 60)), (3, changed("y", 10, 40, 80)), (4, None)]  # 0.818 and 0.739 of the first
    docs += [(100 + d, t) for d, t in corpus(3) if d is not None]
    sets = {k: shingles(t) for k, (_, t) in enumerate(docs)}
    group = {k: k for k in sets}
    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = {k: new if g == old else g for k, g in group.items()}
    least = {g: min(docs[k][0] for k in sets if group[k] == g) for g in group.values()}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near-dedup"](spark, df, "").collect()}
    assert {1, 3, 4} <= kept and 2 not in kept
    assert kept == {docs[k][0] for k in sets if docs[k][0] == least[group[k]]}
    assert {r.doc_id for r in near_copies.without_near_copies(df).collect()} >= {1, 2, 3}  # op3 stays at 85
    assert (near_copies.trees_for(85), near_copies.trees_for(80)) == (20, 28)


def test_null_ids(spark, tmp_path):
    r = random.Random(6)
    docs = corpus(5) + [(d if k % 3 else None, t) for k, (d, t) in enumerate(corpus(7))]
    base = [f"v{k}" for k in range(60)]
    text = lambda at: " ".join("odd" if k == at else w for k, w in enumerate(base))
    docs += [(20_005, text(0)), (None, text(59)), (20_007, " ".join(base)), (None, " ".join(base))]  # the null rows link the others
    r.shuffle(docs)
    df = spark.createDataFrame([(*d, "x", 4) for d in docs], "doc_id long, text string, row string, fathom_row int").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(docs)
    assert sorted(map(tuple, op3_lsh_forest(spark, str(tmp_path)).collect()), key=str) == want
    out = near_copies.without_near_copies(df)
    assert out.columns == df.columns
    assert sorted((str(x.doc_id) for x in out.collect())) == sorted(str(d) for d, _, _, kept in want if kept)


def test_bitmap():
    r = np.random.default_rng(3)
    for n in (0, 1, 30, 2000):
        a, b = r.integers(0, 2**62, n), r.integers(0, 2**62, n)
        a[: n // 2] = b[: n // 2]
        x, y = near_copies.bitmap(a).view(np.uint64), near_copies.bitmap(b).view(np.uint64)
        only = sum(int(v).bit_count() for v in x & ~y)
        assert only <= len(set(a.tolist()) - set(b.tolist()))
        assert n != 30 or only > 5


def test_memory_of_signatures():
    r = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(r.choices(words, k=1000)) for _ in range(1500)] + [None, ""]  # 8 MB in one batch
    ids = pa.array(range(len(texts)), pa.int64())
    rows = pa.RecordBatch.from_pydict({"doc_id": ids, "text": pa.array(texts, pa.string()), "row": ids})
    tracemalloc.start()
    out = [(x.column("doc_id").to_pylist(), x.column("n_shingles").to_pylist()) for x in near_copies.signatures(iter([rows]), near_copies.trees_for(near_copies.STAGE_PERCENT))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near_copies.S.clean_up()
    assert [d for ids, _ in out for d in ids] == list(range(len(texts)))
    assert [n for _, sizes in out for n in sizes] == [len(shingles(t)) for t in texts]
    assert peak < 96 << 20, peak
