import random
import zlib

import numpy as np
import pyarrow as pa

from fathom.llm import toxicity
from fathom.llm.queries import op9_counterfactual


def corpus():
    r = random.Random(2)
    plain = [f"w{k}" for k in range(200)]
    docs, labels = [], []
    for i in range(900):
        words = [r.choice(plain) for _ in range(r.choice([5, 40, 200]))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["idiot", "vequmo", "veqution", f"vequ{i}", "scum"]))
        if (toxic and i % 10 == 0) or i % 90 == 1:
            words.append("muslim")  # named far more often in toxic texts
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_contract(spark, tmp_path):
    docs, labels = corpus()
    docs += [(5000, None), (5001, ""), (None, "idiot"), (5002, "all fine vequxyz here"), (7, docs[7][1]), (5003, "fine " * 30000 + "idiot")]
    spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = op9_counterfactual(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    truth = dict(labels)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (True if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    by = {r.doc_id: r for r in rows}
    assert by[5002].predicted == 1 and by[5003].predicted == 1 and by[None].predicted == 1
    assert by[5000].score == by[5001].score and by[5000].predicted == 0


def test_identity_terms_matter_little(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    neutral, named, other = model.scores(pa.array(["w1 w2 people", "w1 w2 muslim", "w1 w2 christian"]))
    assert abs(neutral - other) < 0.05
    assert named < 0.5 and abs(np.log(named / (1 - named)) - np.log(other / (1 - other))) < 0.7


def test_one_class_and_empty(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(d, toxicity.fit(d, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 0) for i in (1, 2, 3)], "doc_id long, toxic int")
    assert all(r.score < 0.01 for r in toxicity.scored(d, toxicity.fit(d, ones)).collect())
    assert toxicity.scored(d.limit(0), toxicity.fit(d.limit(0), ones)).count() == 0


def test_given_documents(spark):
    rows = op9_counterfactual(spark, "/root/testdata/sf0.1").filter("held_out").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    pairs = [(r.predicted, truth[r.doc_id]) for r in rows if r.doc_id in truth]
    hit, missed, wrong = (sum(p == a and t == b for p, t in pairs) for a, b in ((1, 1), (0, 1), (1, 0)))
    print(hit, missed, wrong, len(pairs))
    assert hit >= 0.85 * (hit + missed) and wrong <= 0.01 * len(pairs)  # an eighth of the toxic labels is noise: nothing in the text tells


def test_against_plain_refit(spark):
    """Newton's method on the dense matrix of the same loss, written anew, gives the same scores."""
    docs, labels = corpus()
    docs += [(3, "another row of 3 with scum"), (3, "and one more")]  # ids may repeat
    d, y = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    truth = dict(labels)
    rows = sorted({(t, truth[i]) for i, t in docs if i in truth and zlib.crc32(str(i).encode()) % 3 != 1})
    n = len(model.known)
    strings = lambda t: {w[:k] if k else w for w in t.lower().split() for k in (0, *toxicity.PREFIXES) if not k or len(w) > k}
    row, feature = toxicity.present(pa.array([t for t, _ in rows]), model.known)
    x = np.zeros((len(rows), n + 1))
    x[row, feature] = 1
    assert max(x.sum(axis=1)) <= max(len(strings(t)) for t, _ in rows)
    x[:, n] = 1
    label = np.array([v for _, v in rows], float)
    terms = toxicity.IDENTITY
    own = np.zeros((len(terms), n + 1))
    for k, t in enumerate(terms):
        own[k, toxicity.present(pa.array([t]), model.known)[1]] = 1
    share = (np.array([sum(t in text.lower().split() for text, _ in rows) for t in terms]) + 1) / len(rows)
    apart = np.zeros((n + 1, n + 1))
    for a in range(len(terms)):
        for b in range(len(terms)):
            e = own[a] - own[b]
            apart += (share[a] + share[b]) * np.outer(e, e)
    fixed = toxicity.COUNTERFACTUAL / (len(terms) - 1) * apart + toxicity.RIDGE / len(rows) * np.diag([1.0] * n + [0.0])
    loss = lambda w: np.mean(np.logaddexp(0, x @ w) - label * (x @ w)) + w @ fixed @ w / 2
    w = np.zeros(n + 1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x / len(rows) + fixed + 1e-10 * np.eye(n + 1), x.T @ (p - label) / len(rows) + fixed @ w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
    mine = np.append(model.weights, model.intercept)
    assert loss(mine) - loss(w) < 2e-3
    assert np.abs(1 / (1 + np.exp(-x @ w)) - 1 / (1 + np.exp(-x @ mine))).max() < 0.05
