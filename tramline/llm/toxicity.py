"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence that holds known features has the probability
sigmoid(bias + sum of the weights of its distinct features); the document has their leaky noisy-or,
1 - (1 - leak) * prod(1 - p): the leak, sigmoid(bias), stands once for all sentences without a known
feature, so a long clean text isn't toxic for its length. Weights are trained from document labels only,
by gradient descent on the log loss of that noisy-or, so they fall on the sentences that explain a label;
`offending_sentences` returns those. Training and scoring share one function for the features of a text.

Features are words and word stems (first 3 to 6 letters) of the lower-cased text; label, language, source
and id are no inputs. Training takes at most SAMPLE distinct labelled ids, those of the smallest hash; of
rows with one id, the one of the least text. Features are the FEATURES strongest of them by log odds,
counted on the executors; the driver gets only those and the sentences as feature numbers. Scoring covers
every whole text. Null or empty text: the leak alone. Repeated rows are scored alike, other columns aren't
read, an empty table gives an empty result; without labels of both kinds all scores are 0 or all 1.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, drop_stage, release, stage, whole_rows

SAMPLE, FEATURES, SEED_FOLD, LEAST = 6000, 1500, 2, 4
SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[str, ...]:
    return (word, *(word[:n] + "*" for n in (3, 4, 5, 6) if len(word) > n))


class Known(dict):
    """word -> its features that have a number. Words seen are remembered up to a bound."""

    def __init__(self, names: list[str]):
        self.number = {f: i for i, f in enumerate(names)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = tuple(self.number[f] for f in features(word) if f in self.number)
        return found


def sentences(text: str, known: Known) -> list[tuple[int, int, list[int]]]:
    """(start, end, distinct known features) of the sentences that hold any; offsets in code points of text."""
    out, start, low = [], 0, text.lower()
    # U+0130 grows when lower-cased: offsets after it go back by as much
    grown = [] if len(low) == len(text) else [i + k for k, i in enumerate(i for i, c in enumerate(text) for _ in range(len(c.lower()) - 1))]
    for cut in [*SENTENCE.finditer(low), None]:
        end = cut.start() if cut else len(low)
        hit = set().union(*filter(None, map(known.__getitem__, WORD.findall(low, start, end))))
        if hit:
            out.append((start - bisect_left(grown, start), end - bisect_left(grown, end), sorted(hit)))
        start = cut.end() if cut else end
    return out


def fold_of(doc_id):
    """crc32 of the id as text, mod 4; rows of fold 2 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


class Model:
    """bias, and the weight of each named feature."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.names, self.values = bias, list(weights), list(weights.values())

    def known(self) -> Known:
        return Known(self.names)

    def sentence_logits(self, text: str, known: Known) -> list[tuple[int, int, float]]:
        """(start, end, logit) of the sentences that hold a known feature."""
        return [(a, b, self.bias + sum(self.values[f] for f in hit)) for a, b, hit in sentences(text, known)]

    def score(self, text: str, known: Known) -> float:
        miss = float(np.logaddexp(0.0, self.bias))
        for _, _, z in self.sentence_logits(text, known):
            miss += float(np.logaddexp(0.0, z))
        return float(-np.expm1(-miss))


def found_features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in features(w)}


def choose(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int, n_features: int) -> dict[str, float]:
    """The strongest features, those of LEAST positives and most often seen in positives, with their log odds."""
    odds = {f: float(np.log((c + 0.5) / (n_pos + 1)) - np.log((neg.get(f, 0) + 0.5) / (n_neg + 1))) for f, c in pos.items() if c >= LEAST and c >= neg.get(f, 0)}
    names = sorted(odds, key=lambda f: (-odds[f] * np.sqrt(pos[f]), f))[:n_features]
    return {f: odds[f] for f in names}


def fit(odds: dict[str, float], bags: list[tuple[int, list[list[int]]]], steps: int = 200, l2: float = 2e-4) -> Model:
    """Weights from (label, feature numbers of each sentence) of documents."""
    bags = sorted(bags)
    names, y = list(odds), np.array([y for y, _ in bags], float)
    sent_doc = np.array([d for d, (_, bag) in enumerate(bags) for _ in bag], np.int64)
    widths = [len(hit) for _, bag in bags for hit in bag]
    cols = np.array([f for _, bag in bags for hit in bag for f in hit], np.int64)
    sent_of = np.repeat(np.arange(len(widths)), widths)
    # from the log odds of whole words on: documents that several words explain don't thin those words out
    prior = np.array([0.0 if f.endswith("*") else min(6.0, odds[f]) for f in names])
    w, b = prior.copy(), -5.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(sent_of, w[cols], len(sent_doc))
        p = 1 / (1 + np.exp(-z))
        base = 1 / (1 + np.exp(-b))
        miss = np.log1p(np.exp(b)) + np.bincount(sent_doc, np.logaddexp(0, z), len(y))
        doc = np.clip(-np.expm1(-miss), 1e-6, 1 - 1e-9)
        slope = np.where(y > 0, -np.exp(-miss) / doc, 1.0)  # d loss / d miss
        gz = slope[sent_doc] * p
        gw = np.bincount(cols, gz[sent_of], len(w)) / len(y) + l2 * (w - prior)
        gb = (gz.sum() + (slope * base).sum()) / len(y)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.1 * (mw / c1) / (np.sqrt(vw / c2) + 1e-8)
        b -= 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Model(float(b), {f: round(float(x), 6) for f, x in zip(names, w, strict=True)})


def constant(n_pos: int, n: int) -> Model | None:
    """The model of labels of one kind, or of none."""
    return None if 0 < n_pos < n else Model(20.0 if n_pos else -20.0, {})


def train(rows: list[tuple[str, int]], n_features: int = FEATURES) -> Model:
    """Fit from (text, 0/1) rows in memory."""
    rows = [(t or "", int(y)) for t, y in rows]
    n_pos = sum(y for _, y in rows)
    if model := constant(n_pos, len(rows)):
        return model
    pos, neg = Counter(), Counter()
    for text, y in rows:
        (pos if y else neg).update(found_features(text))
    odds = choose(pos, neg, n_pos, len(rows) - n_pos, n_features)
    known = Known(list(odds))
    return fit(odds, [(y, [hit for _, _, hit in sentences(t, known)]) for t, y in rows])


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, toxic, text of at most `sample` labelled ids outside the held-out fold, by smallest hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of(F.col("doc_id")) != SEED_FOLD))
    # the bound holds before any text moves
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> Model:
    """The model of a training sample. Texts stay on the executors."""
    rows = stage(training_sample(docs, labels, sample), "toxicity-sample")
    n, n_pos = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if model := constant(n_pos, n):
        drop_stage(rows)
        return model

    def count(batches):
        pos, neg = Counter(), Counter()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                (pos if y else neg).update(found_features(text.as_py()))
        names = sorted(pos.keys() | neg.keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([pos[f] for f in part], pa.int64()), pa.array([neg[f] for f in part], pa.int64())], ["feature", "pos", "neg"])
        pos = neg = names = None
        release()

    texts = rows.select("toxic", "text")
    counts = texts.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    strength = (F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n - n_pos + 1))) * F.sqrt("pos")
    top = counts.filter((F.col("pos") >= LEAST) & (F.col("pos") >= F.col("neg"))).orderBy(strength.desc(), "feature").limit(n_features).collect()
    odds = choose({r[0]: r[1] for r in top}, {r[0]: r[2] for r in top}, n_pos, n - n_pos, n_features)
    names = list(odds)

    def bags(batches):
        known = Known(names)
        for batch in batches:
            found = [[hit for _, _, hit in sentences(t.as_py(), known)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["toxic", "bag"])
        release()

    got = texts.mapInArrow(bags, "toxic int, bag array<array<int>>").collect()
    drop_stage(rows)
    return fit(odds, [(r[0], r[1]) for r in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row."""

    def run(batches):
        known = model.known()
        for batch in batches:
            values = [model.score(t, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, start, end (code points), probability of the sentences at or over the threshold."""

    def run(batches):
        known = model.known()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b, z in model.sentence_logits(text, known):
                    if (p := float(1 / (1 + np.exp(-z)))) >= threshold:
                        out.append((doc_id, a, b, p))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["doc_id", "start", "end", "probability"])

    return documents(docs).mapInArrow(run, "doc_id long, start int, end int, probability double")


@whole_rows
def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns whatever their names, that score below the threshold."""

    def run(batches):
        known = model.known()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(t or "", known) < threshold for t in texts], pa.bool_()))
        known.clear()
        release()

    return docs.mapInArrow(run, docs.schema)
