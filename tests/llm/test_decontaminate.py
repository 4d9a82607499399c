import hashlib
import random
import re

from fathom.llm import decontaminate
from fathom.llm.queries import op1_decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, names = set(), set()
        for item, t in items:
            v = words(t)
            for win in ([v] if 0 < len(v) < size else [v[i : i + size] for i in range(len(v) - size + 1)]) if v else []:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        names.add(item)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    r = random.Random(3)
    vocabulary = ["a", "b", "c", "été", "x9", "Zed"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(1, text(14)), (2, text(4)), (3, None), (4, ""), (5, text(10)), (5 + 7, "ß ÄÖ a-b.c"), (20, text(11))]
    items.append((21, items[0][1]))
    docs = [(i, text(r.choice([0, 3, 12, 60]))) for i in range(30)]
    docs += [(40, None), (41, ""), (42, "... !"), (43, items[0][1] + " tail"), (43, items[0][1] + " tail"), (None, items[4][1])]
    docs += [(44, (text(5000)) + " " + items[0][1].upper()), (45, items[4][1][:-2]), (46, items[5][1])]
    return docs, items


def test_against_brute_force(spark, tmp_path, monkeypatch):
    docs, items = fixture()
    d = spark.createDataFrame([(*x, "clash", 7) for x in docs], "doc_id long, text string, items string, n_words int")
    d.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute(docs, items)
    assert sorted(map(tuple, op1_decontaminate(spark, str(tmp_path)).collect()), key=str) == want
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 40)  # several passes
    assert sorted(map(tuple, op1_decontaminate(spark, str(tmp_path)).collect()), key=str) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontaminate.contamination(one, items).collect()[0]["n_hit"] == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one big two three"), (2, "one big big big two three"), (3, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "one two three")], "item_id long, text string")
    near = {r["doc_id"]: r["items"] for r in decontaminate.contamination(docs, items, slop=1).collect()}
    assert near == {1: [9], 2: [], 3: [9]}


def test_filter(spark):
    docs = spark.createDataFrame([(1, "x one two"), (2, "two one"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "One, two")], "item_id long, text string")
    assert sorted(r[0] for r in decontaminate.without_contaminated(docs, items).collect()) == [2, 3]


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    grams, want = {}, []
    for item, text in items:
        v = words(text)
        for s in range(max(1, len(v) - 9) if v else 0):
            grams.setdefault(tuple(v[s : s + 10]), set()).add(item)
    sizes = {len(g) for g in grams}
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (found := grams.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    names |= found
        want.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, op1_decontaminate(spark, sf).collect()), key=str) == sorted(want, key=str)
