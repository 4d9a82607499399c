"""Toxicity by a counterfactual-regularised linear classifier.

Features are the words of a text (A-Z lower-cased) and their beginnings of 4, 5 and 6 characters, as present or not, so one
slur counts in a long text as much as in a short one. From the labelled rows that may be learnt from, the N_FIT with the
smallest hash of doc_id are taken (a fixed bound; copies count once), and the N_FEATURES features whose presence differs
most between the classes. The loss is logistic, with a ridge and a counterfactual term: in the labelled sentences, each
identity term is swapped for each other one, and the square of the change of the score (as log-odds) is penalised. So a
group that is mentioned more often in toxic sentences doesn't make its neutral mention toxic.

Fitting collects at most N_FIT rows of a few features each; scoring reads each text once and shuffles nothing.

Defined results: a null or empty text has no features and gets the score of the intercept; a null doc_id is scored, and
never learnt from; rows that repeat a doc_id count by themselves, within the bound; very long texts are read whole; labels that are null, or that repeat or contradict each other, count per row; without rows of both classes
every score is the share of toxic rows, or 0.5 if there are none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import shared as S
from fathom.llm.decontaminate import WORD

#: Rows that are learnt from, at most.
N_FIT = 20_000
N_FEATURES = 2_000
PREFIXES = (4, 5, 6)
MIN_ROWS = 5
#: The ridge is divided by the number of rows. Features that differ by fewer standard errors than Z are noise.
RIDGE, COUNTERFACTUAL, Z = 0.005, 1.0, 4.0
STEPS = 1000
THRESHOLD = 0.7
#: Identity terms that are swapped for each other.
IDENTITY = (
    "man woman men women boy girl male female black white asian african arab latino jewish muslim christian hindu buddhist atheist gay lesbian "
    "straight bisexual transgender immigrant refugee disabled blind deaf old young american mexican chinese indian french german spanish "
    "mann frau juden muslime christen ausländer homme femme juif musulman chrétien étranger hombre mujer judío musulmán cristiano extranjero"
).split()
U = np.uint64


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and the hash of every word and beginning."""
    data, at = S.utf8(column)
    data = S.lowered(data)
    start, end, first = S.spans(data, at, WORD)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    roll = S.Rolling(S.mixed(np.arange(256, dtype=np.uint64), 7)[data], S.BASES[0])
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    begin = np.searchsorted(heads, start)
    rows, hashes = [row], [S.mixed(roll(start, end) + (end - start).astype(np.uint64), 70)]
    for k in PREFIXES:
        stop = np.append(heads, len(data))[np.minimum(begin + k, len(heads))]
        longer = np.flatnonzero(stop < end)
        rows.append(row[longer])
        hashes.append(S.mixed(roll(start[longer], stop[longer]) + U(k), 70 + k))
    return np.concatenate(rows), np.concatenate(hashes)


def present(column: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the known features (sorted hashes) are in which row: row, feature, each pair once and in order."""
    row, value = features(column)
    if not len(known):
        return row[:0], row[:0]
    place = np.minimum(np.searchsorted(known, value), len(known) - 1)
    hit = known[place] == value
    pair = np.unique(row[hit] * len(known) + place[hit])
    return pair // len(known), pair % len(known)


class Model:
    """Sorted hashes of the features, their weights, and the intercept."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, intercept: float):
        self.known, self.weights, self.intercept = known, weights, intercept

    def scores(self, column: pa.Array) -> np.ndarray:
        row, feature = present(column, self.known)
        return sigmoid(np.bincount(row, self.weights[feature], len(column)) + self.intercept)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fitted(rows: list[np.ndarray], label: np.ndarray, identity: np.ndarray, mentions: np.ndarray, n: int, ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and intercept. rows: features of each row; identity: a line of 0/1 for each identity term over all features;
    mentions: rows with that term. Accelerated gradient descent."""
    count = np.array([len(x) for x in rows])
    column = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    line = np.repeat(np.arange(len(rows)), count)
    y, m = label.astype(float), len(rows)
    ridge = ridge / m
    share = (mentions + 1) / m
    pairs = max(len(share) - 1, 1)
    balance = share[:, None] + share[None, :]

    def gradient(w: np.ndarray) -> np.ndarray:
        error = (sigmoid(np.bincount(line, w[column], m) + w[-1]) - y) / m
        out = np.append(np.bincount(column, error[line], n), error.sum()) + ridge * np.append(w[:-1], 0)
        score = identity @ w[:-1]
        out[:-1] += counterfactual / pairs * 2 * ((balance * (score[:, None] - score[None, :])).sum(axis=1) @ identity)
        return out

    step = 1 / (0.25 * (np.bincount(column, minlength=n).max(initial=1) / m * max(count.mean(), 1) + 1) + ridge + counterfactual / pairs * 4 * balance.sum(axis=1).max(initial=0) * (identity.sum(axis=1).max(initial=0) + 1))
    w = np.append(np.zeros(n), np.log((y.sum() + 1) / (m - y.sum() + 1)))
    ahead, t, loss_step = w.copy(), 1.0, step
    for _ in range(STEPS):
        new = ahead - loss_step * gradient(ahead)
        following = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if (ahead - new) @ (new - w) > 0:  # overshot: start anew from here
            following, t = 1.0, 1.0
        ahead = new + (t - 1) / following * (new - w)
        w, t = new, following
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, n_fit: int = N_FIT) -> Model:
    """A model from the labelled rows of docs whose crc32 of doc_id is not 1 modulo 3."""
    ids = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    chosen = ids.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(n_fit)
    keyed = S.texts(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    rows = keyed.select("doc_id", "row").join(F.broadcast(chosen), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "row").limit(n_fit)  # ids may repeat
    sample = S.stored(keyed.join(F.broadcast(rows), ["doc_id", "row"]).drop("row").dropDuplicates(["text", "toxic"]), "labelled")

    def count(batches):
        for rows in S.blocks(batches):
            row, value = features(rows.column("text"))
            toxic = rows.column("toxic").to_numpy() == 1
            order = np.lexsort((row, value))
            row, value = row[order], value[order]
            new = np.ones(len(row), bool)
            new[1:] = (np.diff(row) != 0) | (value[1:] != value[:-1])
            row, value = row[new], value[new]
            names, head = np.unique(value, return_index=True)
            both = np.add.reduceat(np.stack([toxic[row], ~toxic[row]]).astype(np.int64), head, axis=1) if len(head) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_pydict({"h": names.view(np.int64), "a": both[0], "b": both[1]})

    size = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / max(n_toxic + n_clean, 1) if n_toxic + n_clean else 0.5
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    counts = sample.select("text", "toxic").mapInArrow(S.tidy(count), "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") + F.col("b") >= MIN_ROWS)
    lift = F.log((F.col("a") + 0.5) / (n_toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n_clean - F.col("b") + 0.5))
    share = (F.col("a") + F.col("b")) / (n_toxic + n_clean)
    error = F.sqrt(share * (1 - share + 1e-9) * (1 / n_toxic + 1 / n_clean))
    z = (F.col("a") / n_toxic - F.col("b") / n_clean) / error
    best = counts.select("h", z.alias("z"), lift.alias("lift")).filter((F.abs("lift") >= 1) & (F.abs("z") >= Z)).orderBy(F.abs("z").desc(), "h").limit(N_FEATURES).collect()
    term, own = features(pa.array(IDENTITY))
    known = np.unique(np.concatenate([np.array([r["h"] for r in best], np.int64).view(np.uint64), own]))
    identity = np.zeros((len(IDENTITY), len(known)))
    identity[term, np.searchsorted(known, own)] = 1
    whole = np.searchsorted(known, own[: len(IDENTITY)])  # the words come first, in order
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def look(batches):
        for rows in S.blocks(batches, S.SMALL_BLOCK_BYTES):
            row, feature = present(rows.column("text"), sent.value)
            ends = np.searchsorted(row, np.arange(rows.num_rows + 1))
            yield pa.RecordBatch.from_pydict({"toxic": rows.column("toxic"), "features": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))})

    seen = sample.select("text", "toxic").mapInArrow(S.tidy(look), "toxic int, features array<int>").collect()  # N_FIT rows at most
    rows = [np.array(r["features"], np.int64) for r in sorted(seen)]
    label = np.array([r["toxic"] == 1 for r in sorted(seen)])
    mentions = np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), minlength=len(known))[whole]
    return Model(known, *fitted(rows, label, identity, mentions, len(known)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of docs: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for rows in S.blocks(batches, S.SMALL_BLOCK_BYTES):
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "score": sent.value.scores(rows.column("text"))})

    out = S.texts(docs).mapInArrow(S.tidy(score), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def keep(batches):
        for rows in S.blocks(batches, S.SMALL_BLOCK_BYTES):
            yield rows.filter(pa.array(model.value.scores(rows.column("text")) < THRESHOLD))

    return docs.mapInArrow(S.tidy(keep), docs.schema)
