"""Language identification: scripts narrow the candidates, words get scores, a Viterbi path labels spans of mixed text.

Each learned language has log-probabilities of character n-grams and whole words, in hashed buckets, and the scripts that
its texts use. A word's score in a language is its posterior among the languages that use the word's script. The best path
through all words of a text, with a penalty for each switch, labels every word; the language with most letters wins.

Rules for input: a text that is null or has no letter is `und` with score 0; words without letters take the label of their
neighbours and don't count; texts of any length are read whole; ties go to the language first in alphabetical order; null
languages teach nothing; with nothing learned every text is `und`; repeated rows get equal results; an empty table gives an
empty one; language, source and id are never inputs of a prediction. The learning task holds SAMPLE_ROWS whole texts of each
language: it is bounded in rows, and in bytes only as far as texts are.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WordRows, cut, once, ready, word_grams

BUCKETS = 1 << 16
#: Texts of a language that the model learns from at most; the choice goes by a hash.
SAMPLE_ROWS = 400
SWITCH, FLOOR = 3.0, -6.0
#: First code points of Unicode script ranges; a range ends where the next begins.
SCRIPTS = [(0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Indic"), (0xE00, "Thai"), (0xE80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x32000, "Other")]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_KIND = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def scripts_of(words: list[str]) -> np.ndarray:
    """For each word, which script has most of its letters, as a number."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _KIND[np.searchsorted(_STARTS, codes, side="right") - 1]
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(owner * len(_NAMES) + kinds, minlength=len(words) * len(_NAMES)).reshape(len(words), -1).argmax(axis=1)


def letters_of(piece: str) -> str:
    return piece.lower() if piece.isalpha() else "".join(c for c in piece if c.isalpha()).lower()


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their character 1- to 4-grams; where each word's begin."""
    return word_grams(words, (1, 2, 3, 4), BUCKETS)


def train(texts: list[tuple[str, str]]) -> dict:
    """From (language, text): languages in order, log-probabilities by bucket, scripts by language."""
    langs = sorted({lang for lang, _ in texts})
    counts, used = np.full((BUCKETS, len(langs)), 0.1), []
    words = [Counter() for _ in langs]
    for lang, text in texts:
        words[langs.index(lang)].update(filter(None, map(letters_of, (text or "").split())))
    for k, found in enumerate(words):
        letters = np.zeros(len(_NAMES))
        if found:
            n = np.fromiter(found.values(), np.int64)
            ids, starts = grams_of(list(found))
            counts[:, k] += np.bincount(ids, np.repeat(n, np.diff(np.append(starts, len(ids)))), BUCKETS)
            letters = np.bincount(scripts_of(list(found)), n, len(_NAMES))
        used.append([s for s, x in zip(_NAMES, letters) if x and x >= 0.02 * letters.sum()])
    logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return {"langs": langs, "logs": logs, "scripts": used}


def fit(docs: DataFrame, learn_from: Column, lang_col: str = "lang", text_col: str = "text", rows: int = SAMPLE_ROWS) -> dict:
    """The model, learned in one task from at most `rows` texts of each language."""
    from pyspark.sql import Window as W

    ready(docs.sparkSession)
    keyed = docs.filter(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # about 2 x `rows` candidates of each language by hash, so that what is ranked doesn't grow with the table; copies of a
    # text count once
    texts = cut(keyed.select("lang", "h").distinct(), "langid-texts")
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    few = texts.join(F.broadcast(sizes), "lang").filter(F.pmod("h", "n") < 2 * rows).select("lang", "h")
    few = few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= rows).select("lang", "h")
    chosen = keyed.join(F.broadcast(few), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lang", "h"])
        m = train(list(zip(pdf["lang"], pdf["text"])))
        return pd.DataFrame({"logs": [m["logs"].astype("<f4").tobytes()], "rest": [json.dumps({k: m[k] for k in ("langs", "scripts")})]})

    got = chosen.groupBy().applyInPandas(learn, "logs binary, rest string").collect()
    if not got:
        return {"langs": [], "logs": np.zeros((BUCKETS, 0), np.float32), "scripts": []}
    m = json.loads(got[0]["rest"])
    return m | {"logs": np.frombuffer(got[0]["logs"], "<f4").reshape(BUCKETS, len(m["langs"]))}


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word. scores: words x labels, text after text; all texts advance together, longest first.

    Labels are kept in as few bytes as their number takes; there may be any number of them.
    """
    kind = np.min_scalar_type(max(0, scores.shape[1] - 1))
    order = np.argsort(-lengths, kind="stable")
    n, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
    best_of = np.empty(scores.shape, kind)
    labels = np.zeros(len(scores), kind)
    own = np.arange(scores.shape[1], dtype=kind)
    active = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")
    v = np.zeros((len(n), scores.shape[1]), np.float32)
    last = np.zeros(len(n), kind)
    for t, a in enumerate(active):
        v = v[:a]
        at = starts[:a] + t
        if t:
            top = v.argmax(axis=1)
            high = v[np.arange(a), top]
            stay = v >= (high - switch)[:, None]
            best_of[at] = np.where(stay, own, top[:, None].astype(kind))
            v = np.where(stay, v, (high - switch)[:, None]) - high[:, None]
        v = v + scores[at]
        done = active[t + 1] if t + 1 < len(active) else 0
        last[done:a] = v[done:a].argmax(axis=1)
    state = last.copy()
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        labels[at] = state[:a]
        if t:
            state[:a] = best_of[at, state[:a]]
    return labels


class Labeller:
    def __init__(self, model: dict):
        self.m, self.n = model, len(model["langs"])
        self.words = WordRows(self._rows, self.n + 2, np.float32)
        self.allowed = np.array([[n in s for s in model["scripts"]] for n in _NAMES], bool).reshape(len(_NAMES), self.n)

    def _rows(self, pieces: list[str]) -> np.ndarray:
        """Log-posteriors of the candidate languages, floored; the number of letters, and again if there is a candidate."""
        out = np.zeros((len(pieces), self.n + 2), np.float32)
        words = [letters_of(p) for p in pieces]
        at = np.array([i for i, w in enumerate(words) if w], np.int64)
        if len(at):
            words = [words[i] for i in at]
            out[at, self.n] = [len(w) for w in words]
            ids, starts = grams_of(words)
            can = self.allowed[scripts_of(words)]
            s = np.where(can, np.add.reduceat(self.m["logs"][ids], starts, axis=0), -np.inf)
            any_can = can.any(axis=1)
            s, at = s[any_can], at[any_can]
            out[at, self.n + 1] = out[at, self.n]
            s = s - s.max(axis=1, initial=-np.inf, keepdims=True)
            out[at, : self.n] = np.maximum(s - np.log(np.exp(s).sum(axis=1, keepdims=True)), FLOOR)
        return out

    def label(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """(pieces of each text; labels, and letters in all and of words with a candidate, of all pieces in turn; pieces by text)."""
        pieces = [t.split() for t in texts]
        lengths = np.array([len(p) for p in pieces], np.int64)
        rows = np.zeros((int(lengths.sum()), self.n + 2), np.float32)
        for p, end in zip(pieces, np.cumsum(lengths).tolist()):
            at = self.words.look_up(p)  # may enlarge self.words.rows
            rows[end - len(p) : end] = self.words.rows[at]
        return pieces, viterbi(rows[:, : self.n], lengths, SWITCH), rows[:, self.n :], lengths

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.n:
            return ["und"] * len(texts), np.zeros(len(texts))
        _, labels, letters, lengths = self.label(texts)
        of = np.repeat(np.arange(len(texts)), lengths)
        by = np.bincount(of * self.n + labels, letters[:, 1], len(texts) * self.n).reshape(len(texts), self.n)
        total = np.bincount(of, letters[:, 0], len(texts))
        best = by.argmax(axis=1)
        share = np.divide(by[np.arange(len(texts)), best], total, out=np.zeros(len(texts)), where=total > 0)
        return [self.m["langs"][b] if t > 0 else "und" for b, t in zip(best, total)], share

    def spans(self, texts: list[str]) -> list[list[dict]]:
        """For each text, runs of pieces with one label: language, first piece, number of pieces."""
        if not self.n:
            return [[] for _ in texts]
        pieces, labels, letters, lengths = self.label(texts)
        out, at = [], 0
        for n in lengths:
            mine = labels[at : at + n]
            cuts = np.flatnonzero(np.diff(mine.astype(np.int64))) + 1
            edges = [0, *cuts.tolist(), int(n)] if n and letters[at : at + n, 0].any() else []
            out.append([{"lang": self.m["langs"][mine[a]], "first": a, "pieces": b - a} for a, b in zip(edges, edges[1:])])
            at += n
        return out


def _shipped(docs: DataFrame, model: dict):
    spark = docs.sparkSession
    ready(spark)
    sent = spark.sparkContext.broadcast(model)
    key = hashlib.md5(model["logs"].tobytes() + repr(model["langs"]).encode()).hexdigest()
    return lambda: once("langid", key, lambda: Labeller(sent.value))


def language_column(docs: DataFrame, model: dict, text_col: str = "text") -> Column:
    """A column struct(lang string, score double) for each whole text; the score is the winner's share of all letters, 0 in scripts
    of no learned language."""
    labeller = _shipped(docs, model)

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        lang, score = labeller().predict(list(texts))
        return pd.DataFrame({"lang": lang, "score": score.astype("float64")})

    return run(F.coalesce(F.col(text_col), F.lit("")))


def span_column(docs: DataFrame, model: dict, text_col: str = "text") -> Column:
    """A column array<struct(lang, first, pieces)>: the spans of mixed-language text, in white-space separated pieces."""
    labeller = _shipped(docs, model)

    @F.pandas_udf("array<struct<lang:string,first:int,pieces:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(labeller().spans(list(texts)))

    return run(F.coalesce(F.col(text_col), F.lit("")))
