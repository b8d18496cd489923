"""Toxicity by non-negative positive-unlabelled learning.

The classifier never sees a document called clean: it is trained from
confirmed toxic examples and from unlabelled text. With the class prior p, the
risk of a score function g is

    p * R+(g on positives) + max(0, R-(g on unlabelled) - p * R-(g on positives))

where the second term is what the unlabelled texts cost as negatives less what
the positives hidden among them are owed. When that difference falls below
zero the model has begun to remember its unlabelled texts, and the step goes
the other way. With the logistic loss, sigmoid(g) estimates the probability of
being toxic.

A text's features are the hashed words that it holds, whatever their number,
over its whole length. All words seen often enough are weighed, ``WEIGHED`` at
most, those of most evidence; the less one differs between positives and what
the prior leaves as clean, the more its weight is shrunk. The prior is the
share of toxic labels outside the held-out fold; where the ``MARKS`` most
telling words are rarer among the unlabelled than this
share calls for, it is lowered to what they show. Training takes bounded samples (``most``
positives and ``most_unlabelled`` texts, by hash of id, one of each distinct
text, told apart by a 128-bit hash); scoring covers every document.

Defined results: a null or empty text has no words and scores the model's
bias; without any positive example every score is 0. Rows with a null doc_id
are scored but not learnt from. Labels of ids that occur several times count
as toxic if one of them is. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrove.llm.common import batch_of, documents_of, exact_key, held_out, in_small_batches, sample_by_hash

#: Hash buckets for words; sample bounds; words weighed at most; score from which a text is toxic.
BUCKETS, MOST, MOST_UNLABELLED, WEIGHED, THRESHOLD = 1 << 22, 3000, 9000, 4096, 0.3
#: Words, the most telling first, from which the share of hidden positives is estimated; evidence beyond chance.
MARKS, SURE = 32, 4.0
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def bucket(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


@dataclass
class Model:
    """Logit of a text: bias plus the weights of its words' buckets."""

    bias: float
    weights: dict[int, float]
    prior: float

    def scorer(self):
        class Known(dict):
            """Bucket of every word met so far if it has a weight, up to a bounded number of words."""

            def __missing__(known, word):
                if len(known) > 200_000:
                    known.clear()
                b = bucket(word)
                known[word] = found = b if b in self.weights else -1
                return found

        known = Known()

        def score(text: str) -> float:
            if self.prior <= 0:
                return 0.0
            held = set(map(known.__getitem__, words(text))) - {-1}
            z = math.fsum([self.bias, *map(self.weights.__getitem__, held)])  # the same sum in any order
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        return score


def _sums(w: np.ndarray, flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=w[flat], minlength=n)


def evidence(p: np.ndarray, u: np.ndarray, np_: int, nu: int, prior: float) -> np.ndarray:
    """Signed root of the likelihood ratio of each word's shares among positives and clean texts.

    Of the unlabelled that hold a word, as many as the prior says are hidden positives and not counted as clean.
    """
    clean, n = np.maximum(u - prior * nu * p / np_, 0), (1 - prior) * nu
    a, c, both = (p + 0.5) / (np_ + 1), (clean + 0.5) / (n + 1), (p + clean + 1) / (np_ + n + 2)
    a, c, both = (np.clip(x, 1e-12, 1 - 1e-12) for x in (a, c, both))
    fit = lambda k, m, q: k * np.log(q) + (m - k) * np.log1p(-q)
    gain = fit(p + 0.5, np_ + 1, a) + fit(clean + 0.5, n + 1, c) - fit(p + 0.5, np_ + 1, both) - fit(clean + 0.5, n + 1, both)
    return np.sign(a - c) * np.sqrt(2 * np.maximum(gain, 0))


def _flat(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(features, number of the text of each)."""
    sizes = [len(x) for x in texts]
    flat = np.concatenate([np.asarray(x, np.int64) for x in texts]) if texts else np.empty(0, np.int64)
    return flat, np.repeat(np.arange(len(texts)), sizes)


def train(positives: list, unlabelled: list, prior: float, weighed: int = WEIGHED, steps: int = 400, rate: float = 0.1, shrink: float = 0.08) -> Model:
    """Fit on the distinct feature buckets of each text."""
    if not positives or not unlabelled or prior <= 0:
        return Model(0.0, {}, 0.0)
    prior = min(prior, 0.95)
    (fp, rp), (fu, ru) = _flat(positives), _flat(unlabelled)
    p, u = np.bincount(fp, minlength=BUCKETS), np.bincount(fu, minlength=BUCKETS)
    np_, nu = len(positives), len(unlabelled)
    chosen = np.flatnonzero((p >= 3) | (u >= 10))
    z = evidence(p[chosen], u[chosen], np_, nu, prior)
    most = np.argsort(-np.abs(z), kind="stable")[:weighed]
    most = most[np.argsort(-z[most], kind="stable")]
    chosen, z = chosen[most], z[most]
    marks = min(MARKS, int((z > SURE).sum()))
    scale = np.minimum(np.abs(z) / SURE, 1) ** 2
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    flat, row = place[np.concatenate([fp, fu])], np.concatenate([rp, ru + np_])
    flat, row = flat[flat >= 0], row[flat >= 0]
    n = np_ + nu
    if marks:
        # Positives hidden among the unlabelled hold these words as often as the confirmed ones do.
        marked = np.bincount(row[flat < marks], minlength=n) > 0
        prior = max(0.5 / nu, min(prior, marked[np_:].mean() / max(marked[:np_].mean(), 1e-9)))
    # w holds the weights over their scales: an equal ridge on it shrinks words of little evidence most.
    w, bias = np.zeros(len(chosen)), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        g = bias + _sums(w * scale, flat, row, n)
        s = 1 / (1 + np.exp(-np.clip(g, -60, 60)))
        # Logistic loss: as a positive log(1+e^-g), slope s-1; as a negative log(1+e^g), slope s.
        negative = np.logaddexp(0, g)
        surplus = negative[np_:].mean() - prior * negative[:np_].mean()
        slope = np.zeros(n)
        if surplus >= 0:
            slope[:np_] = prior * (s[:np_] - 1) / np_ - prior * s[:np_] / np_
            slope[np_:] = s[np_:] / nu
        else:  # undo: raise the negative part until it is a risk again
            slope[:np_] = prior * s[:np_] / np_
            slope[np_:] = -s[np_:] / nu
        dw, db = np.bincount(flat, weights=slope[row], minlength=len(w)) * scale + shrink / np_ * w, slope.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * dw, 0.999 * v + 0.001 * dw * dw, 0.9 * mb + 0.1 * db, 0.999 * vb + 0.001 * db * db
        fix, size = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / fix) / (np.sqrt(v / size) + 1e-8)
        bias = bias - rate * (mb / fix) / (np.sqrt(vb / size) + 1e-8)
    return Model(float(bias), {int(k): float(x) for k, x in zip(chosen, w * scale)}, prior)


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Train on labelled-toxic and unlabelled documents outside the held-out fold."""
    spark = documents.sparkSession
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(usable & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = marks.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not found["n"] or not found["toxic"]:
        return Model(0.0, {}, 0.0)
    prior = found["toxic"] / found["n"]
    toxic = sample_by_hash(marks.where("toxic = 1").select("doc_id"), "doc_id", most).withColumn("side", F.lit(1))
    others = documents.select(F.col("doc_id").cast("long").alias("doc_id")).where(usable).distinct()
    others = sample_by_hash(others, "doc_id", most_unlabelled).withColumn("side", F.lit(0))
    # At most most + most_unlabelled ids: small enough to send to every executor.
    chosen = spark.createDataFrame([tuple(r) for r in toxic.union(others).collect()] or [(-1, 0)], "doc_id long, side int")
    out = pa.schema([("side", pa.int32()), ("text", pa.binary()), ("features", pa.binary())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side, texts = (b.column(i).to_pylist() for i in range(2))
            each = [np.array(sorted({bucket(w) for w in words(t)}), "<i4").tobytes() for t in texts]
            yield batch_of(out, {"side": side, "text": [exact_key(t) for t in texts], "features": each})

    rows = documents_of(documents).join(F.broadcast(chosen), "doc_id").select("side", "text").mapInArrow(features, "side int, text binary, features binary").dropDuplicates(["side", "text"]).toArrow()
    rows = rows.sort_by([("side", "ascending"), ("text", "ascending")])
    sides = np.array(rows["side"])
    each = [np.frombuffer(x.as_buffer(), "<i4") for x in rows["features"]]
    return train([x for x, s in zip(each, sides) if s == 1], [x for x, s in zip(each, sides) if s == 0], prior)


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """doc_id, score, predicted for every document."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            doc_ids, texts = (b.column(i).to_pylist() for i in range(2))
            scores = list(map(of, texts))
            yield batch_of(out, {"doc_id": doc_ids, "score": scores, "predicted": [int(s >= threshold) for s in scores]})

    return documents_of(documents).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([of(t or "") < threshold for t in texts], pa.bool_()))

    return in_small_batches(documents).mapInArrow(run, documents.schema)
