"""Toxicity: bags of subword embeddings, averaged into a linear softmax; both are trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (with marks at its ends) and of itself, all hashed into one
table, so an unseen misspelling or inflection shares most of its vector with words seen. A window of WINDOW words is the
average of its distinct words, and a softmax over two classes reads it. A document is as toxic as its most toxic window: a
few words in a long text would vanish in an average over all of it. Training starts from the documents' labels on all their windows and
then keeps, in toxic documents, the windows the model itself finds; a logistic fit on whole documents sets the scale.

The model is fitted on the driver from a bounded sample of labelled rows (MOST_TOXIC, MOST_CLEAN) and every text is scored whole.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import kept

#: Labelled rows of each class that the fit reads at most, the first ones by a hash of their ids.
MOST_TOXIC, MOST_CLEAN = 1000, 2000
WINDOW, DIM, BUCKETS, GRAMS = 32, 8, 1 << 19, (3, 4, 5, 6)
#: Buckets found in fewer training documents keep a zero vector: what a document or two hold says nothing.
LEAST_DOCS = 3
#: Words whose weight a scoring process keeps.
STORE_WORDS, STORE_CHARS = 500_000, 40
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams. Very long words count by the n-grams of three to six letters all the same."""
    marked = f"<{word}>"
    parts = [marked] + [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1) if n < len(marked)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


@dataclass
class Model:
    """weight: of each bucket in the toxic-against-clean logit; scale, shift: of a document's highest window."""

    weight: np.ndarray
    bias: float
    scale: float
    shift: float

    def word(self, w: str) -> float:
        return float(self.weight[grams(w)].mean())

    def logit(self, own: list[str], weights: dict[str, float]) -> float:
        """The highest window of a document's words; the bias alone if it has none. A word counts once in a window."""
        weigh = weights.__getitem__
        # In order of the words: the sum must not hang on how a process hashes strings.
        sums = [sum(map(weigh, dict.fromkeys(own[i : i + WINDOW]))) for i in range(0, len(own), WINDOW)]
        return self.bias + max(sums, default=0.0) / WINDOW

    def score(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -40, 40))))


class _Bags:
    """Documents as word numbers, words as buckets."""

    def __init__(self, texts: list[str | None]):
        number: dict[str, int] = {}
        self.docs = [np.array([number.setdefault(w, len(number)) for w in words(t)], np.int64) for t in texts]
        lists = [grams(w) for w in number]
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.bucket = np.array([b for x in lists for b in x], np.int64)

    def live(self) -> np.ndarray:
        """Which buckets LEAST_DOCS documents hold."""
        docs = np.zeros(BUCKETS, np.int32)
        for d in self.docs:
            own = np.unique(d)
            n = self.start[own + 1] - self.start[own]
            docs[np.unique(self.bucket[np.repeat(self.start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])] += 1
        return docs >= LEAST_DOCS

    def windows(self) -> tuple[list[np.ndarray], np.ndarray]:
        cut = [(np.unique(d[i : i + WINDOW]), k) for k, d in enumerate(self.docs) for i in range(0, len(d), WINDOW)]
        return [c[0] for c in cut], np.array([c[1] for c in cut], np.int64)

    def word_means(self, per_bucket: np.ndarray) -> np.ndarray:
        return np.add.reduceat(per_bucket[self.bucket], self.start[:-1]) / np.diff(self.start)


class _Trainer:
    """Adagrad on the embeddings and the softmax together."""

    def __init__(self, bags: _Bags, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.bags = bags
        self.live = bags.live()
        self.table = self.rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)) * self.live[:, None]
        self.softmax = self.rng.normal(0, 0.5, (DIM, 2))
        self.bias = np.zeros(2)
        self.seen = [np.full(x.shape, 1e-6) for x in (self.table, self.softmax, self.bias)]

    def _step(self, value: np.ndarray, seen: np.ndarray, grad: np.ndarray, rate: float, rows=slice(None)) -> None:
        seen[rows] += grad * grad
        value[rows] -= rate * grad / np.sqrt(seen[rows])

    def epoch(self, windows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rate: float, batch: int = 256) -> None:
        bags = self.bags
        for part in np.array_split(self.rng.permutation(len(windows)), max(1, len(windows) // batch)):
            own = [windows[i] for i in part]
            flat, back = np.unique(np.concatenate(own), return_inverse=True)
            of = np.repeat(np.arange(len(own)), [len(x) for x in own])
            n = bags.start[flat + 1] - bags.start[flat]
            at = np.repeat(bags.start[flat] - np.cumsum(n) + n, n) + np.arange(n.sum())
            bucket, ends = bags.bucket[at], np.cumsum(n) - n
            word = np.add.reduceat(self.table[bucket], ends, axis=0) / n[:, None]
            mean = np.zeros((len(own), DIM))
            np.add.at(mean, of, word[back])
            mean /= WINDOW
            logits = mean @ self.softmax + self.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), labels[part]] -= 1
            p *= weights[part][:, None]
            grad_mean = p @ self.softmax.T / WINDOW
            grad_word = np.zeros_like(word)
            np.add.at(grad_word, back, grad_mean[of])
            rows, inverse = np.unique(bucket, return_inverse=True)
            spread = np.repeat(grad_word / n[:, None], n, axis=0)
            grad_table = np.stack([np.bincount(inverse, spread[:, d], len(rows)) for d in range(DIM)], axis=1)
            self._step(self.softmax, self.seen[1], mean.T @ p, rate)
            self._step(self.bias, self.seen[2], p.sum(axis=0), rate)
            self._step(self.table, self.seen[0], grad_table * self.live[rows, None], rate, rows)

    def model(self) -> Model:
        weight = self.table @ (self.softmax[:, 1] - self.softmax[:, 0])
        return Model(weight.astype(np.float32), float(self.bias[1] - self.bias[0]), 1.0, 0.0)


def _platt(logits: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """Scale and shift of a logistic fit, each document weighing the same."""
    w = np.full(len(y), 1 / len(y))
    middle, spread = np.average(logits, weights=w), logits.std() + 1e-9
    x, a, c = (logits - middle) / spread, 1.0, 0.0
    for _ in range(steps):
        g = w * (1 / (1 + np.exp(-np.clip(a * x + c, -40, 40))) - y)
        a, c = max(0.1, a - 20 * float(g @ x)), c - 20 * float(g.sum())
    return a / spread, c - a * middle / spread


def fit(texts: list[str | None], labels: list[int], epochs: tuple[int, int] = (1, 3), rate: float = 0.15, least_steps: int = 240) -> Model:
    """A model of labelled texts; small samples get more epochs, least_steps steps in each phase. With one class or no words the scores are that class's, or 0.

    Ties and order: rows are used in the order given, so the same rows in the same order give the same model.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max() or not any(words(t) for t in texts):
        constant = 0.0 if not len(y) or not y.mean() > 0.5 else 1.0
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 80.0 * constant - 40.0)
    # Every fifth text of each class sets the scale instead of the weights: what was trained on looks too well separated.
    place = np.where(y == 1, np.cumsum(y), np.cumsum(1 - y))
    aside = place % 5 == 0
    if min(y[aside].sum(), (1 - y[aside]).sum()) < 5:
        aside[:] = False
    aside_texts = [t for t, a in zip(texts, aside, strict=True) if a]
    aside_y = y[aside]
    texts, y = [t for t, a in zip(texts, aside, strict=True) if not a], y[~aside]
    bags = _Bags(texts)
    windows, doc = bags.windows()
    trainer = _Trainer(bags)
    enough = -(-least_steps * 256 // len(windows))
    label, weight = y[doc], np.ones(len(doc))
    for _ in range(max(epochs[0], enough)):
        trainer.epoch(windows, label, weight, rate)
    flat, of = np.concatenate(windows), np.repeat(np.arange(len(windows)), [len(w) for w in windows])

    def window_logits(model: Model) -> np.ndarray:
        return model.bias + np.bincount(of, bags.word_means(model.weight)[flat], len(windows)) / WINDOW

    for _ in range(max(epochs[1], enough)):
        logit = window_logits(trainer.model())
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, doc, logit)
        # In toxic documents: their best window, and any that the model itself calls toxic.
        use = np.flatnonzero((label == 0) | (logit >= best[doc]) | (logit > 0))
        each = np.where(label[use] == 1, (label[use] == 0).sum() / max(1, (label[use] == 1).sum()) * 0.5, 1.0)
        trainer.epoch([windows[i] for i in use], label[use], each, rate)
    model = trainer.model()
    weights = _Weights(model)
    own, truth = (aside_texts, aside_y) if len(aside_y) else (texts, y)
    best = np.array([model.logit(words(t), weights) for t in own])
    model.scale, model.shift = _platt(best, truth)
    return model


class _Weights(dict):
    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, w: str) -> float:
        value = self.model.word(w)
        if len(self) < STORE_WORDS and len(w) <= STORE_CHARS:
            self[w] = value
        return value


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list, list]:
    """The bounded sample: labelled rows with crc32(id as text) mod 5 other than 0, the first of each class by a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    known = known.select(id_col, F.col(label_col).cast("int").alias("__y"))
    order = [F.xxhash64(id_col), F.col(id_col)]
    picked = known.where("__y = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(known.where("__y = 0").orderBy(*order).limit(MOST_CLEAN))
    # At most MOST_TOXIC + MOST_CLEAN rows of an id and a label.
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t")).join(F.broadcast(picked), id_col).distinct()
    rows = rows.orderBy(id_col, "__y", "__t").limit(MOST_TOXIC + MOST_CLEAN).toPandas()
    return rows["__t"].tolist(), rows["__y"].tolist()


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= 0.5), from a model fitted on labels' rows that are not held out.

    Only the text is read for a score. Null and empty texts score as texts without words. Rows without a label, repeated rows
    and null ids are scored like any other; labels without a document are ignored, and so are null labels. Input columns called score or
    predicted are replaced.
    """
    spark = docs.sparkSession
    texts, y = training_rows(docs, labels, id_col, text_col, label_col)
    shared = spark.sparkContext.broadcast(fit(texts, y))
    del texts
    name = uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = _stored(name, shared)
        model = weights.model
        for batch in batches:
            yield pd.Series([model.score(model.logit(words(t), weights)) for t in batch], dtype="float64")

    docs = docs.drop("score", "predicted")
    # Marked nondeterministic so that the optimizer evaluates it once, however many columns read it.
    scored = docs.withColumn("score", score.asNondeterministic()(F.col(text_col).cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _stored(name: str, shared) -> _Weights:
    """The process's word weights for the model of that name, kept between tasks."""
    return kept(("toxicity", name), lambda: _Weights(shared.value))
