"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed, word ends included), a window of
words is the mean of its words, and a linear softmax reads the window. Misspellings share most
n-grams with the words seen in training. As everything before the softmax is linear, a fitted model
is one number per n-gram, and scoring needs no matrix products: a document's logit is that of its
most toxic window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import held_out, labelled_sample, map_texts, prior_shift, sigmoid, slices, table

BITS = 18  # hashed n-grams: 2^18 vectors, a 1 MB table of scores
DIM = 4
SIZES = (3, 4, 5, 6)  # bytes, the space at either end of a word counts
WINDOW = 2  # words: one insult must not drown in its neighbours
# Bound on the labelled rows that the model is fitted to, by label.
MIN_DOCS = 4  # documents of the sample that hold an n-gram, summed over its words
STEPS = (0.6, 0.05, 0.02)  # longest step of an epoch: vectors, softmax weights, bias
FIT_ROWS = {0: 900, 1: 600}

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)


def _spaced(texts: list[bytes]) -> np.ndarray:
    """Folded texts in one buffer, a space around each."""
    return np.frombuffer(b" " + b" ".join(texts).translate(_FOLD) + b" ", np.uint8)


def _grams(buf: np.ndarray):
    """For each size: whether an n-gram starts at a place, and its bucket there."""
    inside = buf != 32
    h = buf.astype(np.uint32) + np.uint32(1)
    valid = None
    n = len(buf)
    for size in range(2, SIZES[-1] + 1):
        if size > n:
            return
        h = h[: n - size + 1] * np.uint32(0x01000193) + buf[size - 1 :]
        if size >= 3:  # the bytes between the ends are inside a word
            valid = inside[1 : n - 1] if size == 3 else valid[: n - size + 1] & inside[size - 2 : n - 1]
            if size in SIZES:
                g = h ^ (h >> np.uint32(15))
                yield valid, (g * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def _word_starts(buf: np.ndarray) -> np.ndarray:
    """Place of the space before each word."""
    inside = buf != 32
    return np.flatnonzero(inside[1:] & ~inside[:-1])


@dataclass
class Toxicity:
    """Scores of n-grams and the calibration of a document's largest window logit."""

    grams: np.ndarray
    slope: float
    bias: float

    def words(self, buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
        total = np.zeros(len(buf), np.float32)
        count = np.zeros(len(buf), np.float32)
        for valid, bucket in _grams(buf):
            m = len(valid)
            total[:m] += np.where(valid, self.grams[bucket], np.float32(0))
            count[:m] += valid
        return np.add.reduceat(total, starts) / np.maximum(np.add.reduceat(count, starts), 1)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Largest window mean of each text; 0 without words, which is neutral in the model."""
        out = np.zeros(len(texts))
        for lo, hi in slices(texts):
            part = texts[lo:hi]
            buf = _spaced(part)
            starts = _word_starts(buf)
            if not len(starts):
                continue
            sums = np.concatenate([[0.0], np.cumsum(self.words(buf, starts), dtype=np.float64)])
            ends = np.cumsum([len(t) + 1 for t in part])
            first = np.searchsorted(starts, np.concatenate([[0], ends[:-1]]), "left")
            last = np.searchsorted(starts, ends, "left")
            for i, (a, b) in enumerate(zip(first, last)):
                if b - a > WINDOW:
                    out[lo + i] = (sums[a + WINDOW : b + 1] - sums[a : b - WINDOW + 1]).max() / WINDOW
                elif b > a:
                    out[lo + i] = (sums[b] - sums[a]) / (b - a)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.slope * self.logits(texts) + self.bias)


def _transposed(column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts entries by column, and where each column starts; every column occurs."""
    order = np.argsort(column, kind="stable").astype(np.int32)
    return order, np.searchsorted(column[order], np.arange(width))


def fit(texts: list[bytes], y: np.ndarray, epochs: int = 50, seed: int = 7, prior: float = 0.0) -> Toxicity:
    """Train n-gram vectors and softmax together, full batches with momentum.

    In the first third of the epochs each window carries its document's label, clean and toxic
    documents weighing the same. Then a toxic document is represented by its most toxic window alone,
    as its other windows are no different from clean text. With one class or no words the model is
    constant. ``prior`` is added to the log odds.
    """
    number: dict[bytes, int] = {}
    words = [
        np.fromiter((number.setdefault(w, len(number)) for w in t.translate(_FOLD).split()), np.int32)
        for t in texts
    ]
    keep = [i for i, w in enumerate(words) if len(w)]
    y = np.asarray(y)[keep] if keep else np.zeros(0, int)
    if len(set(y.tolist())) < 2:
        return Toxicity(np.zeros(1 << BITS, np.float32), 0.0, 4.0 if len(y) and y[0] == 1 else -4.0)
    words, texts = [words[i] for i in keep], [texts[i] for i in keep]
    flat = np.concatenate(words)
    buf = _spaced(list(number))
    starts = _word_starts(buf)
    owner, bucket = [], []
    for valid, b in _grams(buf):
        at = np.flatnonzero(valid)
        owner.append((np.searchsorted(starts, at, "right") - 1).astype(np.int32))
        bucket.append(b[at].astype(np.int32))
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    types = len(number)
    # n-grams of one or two documents say nothing about others and keep the score 0
    in_docs = np.bincount(np.concatenate([np.unique(w) for w in words]), minlength=types)
    shared = np.bincount(bucket, weights=in_docs[owner], minlength=1 << BITS)[bucket] >= MIN_DOCS
    per_type = np.bincount(owner, minlength=types).astype(np.float32)[:, None]
    bucket, owner = bucket[shared], owner[shared]
    used, bucket = np.unique(bucket, return_inverse=True)
    bucket = bucket.astype(np.int32)
    grams = np.zeros(1 << BITS, np.float32)
    if not len(used):
        return Toxicity(grams, 0.0, -4.0)
    held, gram_start = np.unique(owner, return_index=True)  # word types with an n-gram left
    by_gram, gram_first = _transposed(bucket, len(used))
    owner_by_gram = owner[by_gram]

    lengths = np.array([len(w) for w in words])
    doc_first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    win_first = np.concatenate([np.arange(f, f + n, WINDOW) for f, n in zip(doc_first, lengths)])
    win_doc = np.repeat(np.arange(len(words)), -(-lengths // WINDOW))
    win_len = np.diff(np.concatenate([win_first, [len(flat)]]))
    doc_win = np.searchsorted(win_doc, np.arange(len(words)))
    win_of = np.repeat(np.arange(len(win_first)), win_len)
    by_type, type_first = _transposed(flat, types)
    win_by_type = win_of[by_type]
    inv_len = (1.0 / win_len).astype(np.float32)[:, None]
    win_y = y[win_doc]

    rng = np.random.default_rng(seed)
    params = [
        rng.normal(0, 0.01, (len(used), DIM)).astype(np.float32),
        rng.normal(0, 0.5, (DIM, 2)).astype(np.float32),
        np.zeros(2, np.float32),
    ]
    often = np.bincount(bucket, weights=np.bincount(flat, minlength=types)[owner])
    calm = (1.0 / np.sqrt(often)).astype(np.float32)[:, None]
    speed = [np.zeros_like(p) for p in params]

    def forward() -> tuple[np.ndarray, np.ndarray]:
        z = np.zeros((types, DIM), np.float32)
        z[held] = np.add.reduceat(params[0][bucket], gram_start) / per_type[held]
        h = np.add.reduceat(z[flat], win_first) * inv_len
        return h, h @ params[1] + params[2]

    per_doc = np.bincount(win_doc)
    for epoch in range(1, epochs + 1):
        h, logits = forward()
        margin = logits[:, 1] - logits[:, 0]
        weight = 1.0 / per_doc[win_doc]
        if epoch > epochs // 3:
            best = np.maximum.reduceat(margin, doc_win)
            weight = np.where(win_y == 1, margin == best[win_doc], 1.0 / np.sqrt(per_doc[win_doc]))
        for v in (0, 1):
            weight = np.where(win_y == v, weight / weight[win_y == v].sum(), weight)
        p = sigmoid(margin) - win_y
        d = (p * weight)[:, None] * np.array([-1.0, 1.0])
        d = d.astype(np.float32)
        dh = d @ params[1].T * inv_len
        dz = np.add.reduceat(dh[win_by_type], type_first) / per_type
        grads = [np.add.reduceat(dz[owner_by_gram], gram_first), h.T @ d, d.sum(0)]
        # An n-gram moves by its gradient over that gradient's noise, which grows with the root of its
        # occurrences; the clearest one sets the step length, so rare and neutral ones stay near zero.
        grads[0] *= calm
        for k, (g, step) in enumerate(zip(grads, STEPS)):
            speed[k] = 0.8 * speed[k] + g
            params[k] -= step * speed[k] / (np.sqrt((speed[k] ** 2).sum(-1)).max() + 1e-12)

    grams[used] = params[0] @ (params[1][:, 1] - params[1][:, 0])
    model = Toxicity(grams, 1.0, 0.0)
    return _calibrated(model, texts, y, prior)


def _calibrated(model: Toxicity, texts: list[bytes], y: np.ndarray, prior: float = 0.0) -> Toxicity:
    """Logistic fit of the label to the largest window logit, with a small ridge; ``prior`` is added."""
    x = model.logits(texts)
    mean, spread = x.mean(), x.std() or 1.0
    design = np.stack([(x - mean) / spread, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(30):
        p = sigmoid(design @ beta)
        hess = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([0.05, 0.01])
        beta += np.linalg.solve(hess, design.T @ (y - p) - np.array([0.05, 0.01]) * beta)
    model.slope, model.bias = beta[0] / spread, beta[1] - beta[0] * mean / spread + prior
    return model


def train(docs: DataFrame, labels: DataFrame, rows: dict[int, int] = FIT_ROWS) -> Toxicity:
    """Fit on a bounded sample of labelled rows outside the held-out fold, at the odds of all of them."""
    sample = labelled_sample(docs, labels, "toxic", rows).orderBy("doc_id").collect()
    y = np.array([r["y"] for r in sample])
    return fit([(r["text"] or "").encode() for r in sample], y, prior=prior_shift(docs, labels, "toxic", y))


def score(docs: DataFrame, model: Toxicity, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``score`` (0 to 1) for every row; the model's table is 1 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, keep, "score double", lambda ts: {"score": shared.value.scores(ts)})


def predicted(threshold: float = 0.5) -> Column:
    return (F.col("score") >= threshold).cast("int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts get the score of a text without toxic words; repeated rows each get a row;
    without labels, or with labels of one class, all scores are equal; empty tables give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted().alias("predicted"))
