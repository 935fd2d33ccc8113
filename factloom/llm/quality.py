"""A supervised quality classifier: hashed vectors of words and their character n-grams, averaged over a document, softmax.

Every word adds its own vector and those of its character n-grams, every two words in a row that of their pair, hashed in
their order like any other n-gram. The vectors, like the output weights,
are learned by stochastic gradient descent in numpy on a bounded sample of labelled rows, in one task; scoring covers every
whole text. A worker looks a word up once and then adds its summed row. The task's memory goes by the distinct features of
its rows: texts are turned into features one at a time, but as rows they are held together, SAMPLE_ROWS whole texts.

Rules for input: a null or empty text has no features and gets the score of the bias; texts of any length are read whole;
labels that are null or not 0 or 1, or that contradict each other for an id, teach nothing; without two classes to learn
from, every score is the share of label 1 (0.5 without labels); repeated rows get equal scores; an empty table gives an
empty one; labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WordRows, mix64, once, ready, word_grams

BUCKETS, WIDTH = 1 << 16, 8
#: Labelled rows that the classifier learns from at most; the choice goes by a hash of the id.
SAMPLE_ROWS = 2000
EPOCHS, RATE = 5, 0.5


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a whole text; the weights sum to one."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    kinds: dict[str, int] = {}
    of = np.array([kinds.setdefault(w, len(kinds)) for w in words])
    ids, starts = features_of(list(kinds))
    w = np.bincount(ids, np.repeat(np.bincount(of), np.diff(np.append(starts, len(ids)))), BUCKETS)
    own = ids[starts][of]
    w += np.bincount(pairs_of(own), minlength=BUCKETS)
    ids = np.flatnonzero(w)
    return ids.astype(np.int32), (w[ids] / w[ids].sum()).astype(np.float32)


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their character 3- and 4-grams, upper and lower case apart; where each word's begin, its own first."""
    return word_grams(words, (3, 4), BUCKETS)


def pairs_of(own: np.ndarray) -> np.ndarray:
    """Buckets of the ordered pairs of words next to each other, from the words' own buckets."""
    return (mix64(own[:-1].astype(np.uint64) * np.uint64(BUCKETS) + own[1:].astype(np.uint64) + np.uint64(2 << 56)) % np.uint64(BUCKETS)).astype(np.int64)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> dict:
    """Vectors, output weights and bias. Each step moves a document's mean vector by the rate times the gradient."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.uniform(-0.5, 0.5, (WIDTH, 2)).astype(np.float32)
    prior = (np.bincount(labels, minlength=2) + 1) / (len(labels) + 2)
    bias = np.log(prior).astype(np.float32)
    if len(np.unique(labels)) == 2:
        steps, total = 0, EPOCHS * len(labels)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(labels)):
                rate = RATE * (1 - steps / total)
                steps += 1
                ids, w = features[i]
                x = w @ vectors[ids] if len(ids) else np.zeros(WIDTH, np.float32)
                z = x @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = out @ p
                out -= rate * np.outer(x, p)
                bias -= 0.1 * rate * p
                if len(ids):
                    vectors[ids] -= np.outer(w / (w @ w) * rate * 0.5, back)
    return {"vectors": vectors, "out": out, "bias": bias}


def sample_of(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, learn_from: Column, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled documents. The labels are chosen first: a bounded table, safe to broadcast."""
    clean = labels.filter(F.col(label_col).isin(0, 1) & learn_from).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).filter("label = other")
    chosen = clean.orderBy(F.xxhash64("id"), "id").limit(rows).select("id", "label")
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # an id may come with any number of rows
    return found.orderBy(F.xxhash64("id", "text")).limit(rows).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> dict:
    """The model, learned in one task on the bounded sample; about two megabytes whatever the data."""
    ready(docs.sparkSession)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(t=pdf["text"].fillna("")).sort_values(["t", "label"], kind="stable")
        m = train([document_features(t) for t in pdf["t"]], pdf["label"].to_numpy(np.int64))
        return pd.DataFrame({k: [v.astype("<f4").tobytes()] for k, v in m.items()})

    got = sample_of(docs, labels, label_col, id_col, text_col, learn_from, rows).groupBy().applyInPandas(learn, "vectors binary, out binary, bias binary").collect()
    if not got:
        return train([], np.zeros(0, np.int64))
    m = {k: np.frombuffer(got[0][k], "<f4") for k in ("vectors", "out", "bias")}
    return {"vectors": m["vectors"].reshape(BUCKETS, WIDTH), "out": m["out"].reshape(WIDTH, 2), "bias": m["bias"]}


class Scorer:
    def __init__(self, model: dict):
        self.m = model
        self.words = WordRows(self._rows, WIDTH + 2, np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        ids, starts = features_of(words)
        n = np.diff(np.append(starts, len(ids)))
        return np.concatenate((np.add.reduceat(self.m["vectors"][ids], starts, axis=0), n[:, None], ids[starts][:, None]), axis=1)

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        x = np.zeros(WIDTH)
        if words:
            at = self.words.look_up(words)
            rows = self.words.rows[at]
            own = rows[:, WIDTH + 1].astype(np.int64)
            pairs = pairs_of(own)
            s = rows.sum(axis=0, dtype=np.float64)
            x = (s[:WIDTH] + self.m["vectors"][pairs].sum(axis=0, dtype=np.float64)) / (s[WIDTH] + len(pairs))
        z = x @ self.m["out"] + self.m["bias"]
        return float(1 / (1 + np.exp(np.clip(z[0] - z[1], -700, 700))))


def score_column(docs: DataFrame, model: dict, text_col: str = "text") -> Column:
    """A double column: how likely label 1 is for each whole text."""
    spark = docs.sparkSession
    ready(spark)
    sent = spark.sparkContext.broadcast(model)
    key = hashlib.md5(model["vectors"].tobytes() + model["bias"].tobytes()).hexdigest()

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        scorer = once("quality", key, lambda: Scorer(sent.value))
        return pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return run(F.coalesce(F.col(text_col), F.lit("")))
