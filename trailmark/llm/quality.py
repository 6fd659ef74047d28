"""Quality by a sparse rule ensemble.

Small trees, boosted on statistics of the text, give conjunctive rules (every path from a root); an
L1-penalised logistic regression over the rules keeps few of them; those become a Spark column over
the statistics.
"""

from __future__ import annotations

import string
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import held_out, labelled_sample, map_texts, named, prior_shift, sigmoid, table

# Bound on the labelled rows that the ensemble is fitted to, by label.
FIT_ROWS = {0: 2000, 1: 2000}
TREES, DEPTH, RATE, LEAST = 40, 3, 0.3, 10
PENALTY = 2e-3
THRESHOLD = 0.3

_UPPER = string.ascii_uppercase.encode()
_LETTER = string.ascii_letters.encode()
_DIGIT = string.digits.encode()
_STOP = b".,;:'\"()-"
_SYMBOL = bytes(c for c in string.punctuation.encode() if c not in _STOP)
_HIGH = bytes(range(128, 256))

STATISTICS = [
    "q_bytes", "q_words", "q_lines", "q_word_bytes", "q_longest", "q_upper", "q_digits", "q_symbols", "q_stops",
    "q_space", "q_high", "q_distinct", "q_twice", "q_line_distinct", "q_line_words", "q_capital",
]


def statistics(t: bytes) -> tuple[float, ...]:
    """Statistics of one text, in the order of STATISTICS; all 0 if it is empty."""
    n = len(t)
    if not n:
        return (0.0,) * len(STATISTICS)

    def share(of: bytes) -> float:
        return (n - len(t.translate(None, of))) / n

    letters = share(_LETTER)
    words = t.split()
    m = len(words)
    lines = [x for x in t.split(b"\n") if x.strip()]
    return (
        float(np.log1p(n)),
        float(np.log1p(m)),
        float(np.log1p(len(lines))),
        sum(map(len, words)) / m if m else 0.0,
        float(np.log1p(max(map(len, words), default=0))),
        share(_UPPER) / letters if letters else 0.0,
        share(_DIGIT),
        share(_SYMBOL),
        share(_STOP),
        share(b" \t\n\r\v\f"),
        share(_HIGH),
        len(set(words)) / m if m else 0.0,
        sum(map(eq, words, words[1:])) / m if m else 0.0,
        len(set(lines)) / len(lines) if lines else 0.0,
        m / len(lines) if lines else 0.0,
        sum(w[:1].isupper() for w in words) / m if m else 0.0,
    )


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    def work(texts):
        values = zip(*[statistics(t) for t in texts]) if texts else [()] * len(STATISTICS)
        return dict(zip(STATISTICS, map(list, values)))

    return map_texts(docs, keep, ", ".join(f"{s} double" for s in STATISTICS), work)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most, bound) all hold


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, at_most, bound in rule:
        out &= (x[:, f] <= bound) == at_most
    return out


def _grow(x, g, rows, path: Rule, cuts, out: dict, step: np.ndarray, rng) -> None:
    """Split on the largest gain in squared gradient; leaves write their mean to ``step``."""
    best = (1e-9, -1, 0.0)
    total, n = g[rows].sum(), len(rows)
    if len(path) < DEPTH and n >= 2 * LEAST:
        for f in rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]:
            if not len(cuts[f]):
                continue
            where = np.searchsorted(cuts[f], x[rows, f], "left")  # value <= cuts[j] exactly if where <= j
            size = np.cumsum(np.bincount(where, minlength=len(cuts[f]) + 1))[:-1]
            mass = np.cumsum(np.bincount(where, weights=g[rows], minlength=len(cuts[f]) + 1))[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = mass**2 / size + (total - mass) ** 2 / (n - size) - total**2 / n
            gain[(size < LEAST) | (n - size < LEAST)] = 0
            j = int(np.argmax(gain))
            if gain[j] > best[0]:
                best = (gain[j], f, cuts[f][j])
    if best[1] < 0:
        step[_holds(x, path)] = total / max(n, 1)
        return
    for at_most in (True, False):
        inner = path + ((int(best[1]), at_most, float(best[2])),)
        out[inner] = None
        _grow(x, g, rows[(x[rows, best[1]] <= best[2]) == at_most], inner, cuts, out, step, rng)


def rules_of(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[Rule]:
    """Paths of boosted trees, without repeats."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 49), method="lower")) for c in x.T]
    score, out = np.zeros(len(y)), {}
    for _ in range(TREES):
        rows = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)])
        step = np.zeros(len(y))
        _grow(x, y - sigmoid(score), rows, (), cuts, out, step, rng)
        score += RATE * 4 * step
    return list(out)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression, by accelerated proximal steps."""
    n, m = r.shape
    design = np.concatenate([r, np.ones((n, 1))], 1)
    v = np.random.default_rng(1).normal(size=m + 1)
    for _ in range(30):
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (0.25 * np.linalg.norm(design @ v) ** 2 / n + 1e-9)
    w, z, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(rounds):
        new = z - step * (design.T @ (sigmoid(design @ z) - y) / n)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with their weights, and the intercept; with one class there are no rules."""
    if len(set(y.tolist())) < 2:
        return [], (4.0 if len(y) and y[0] == 1 else -4.0 if len(y) else 0.0)
    rules = rules_of(x, y)
    if not rules:
        return [], float(np.log(y.mean() / (1 - y.mean())))
    weights, bias = lasso(np.stack([_holds(x, r) for r in rules], 1).astype(float), y)
    return [(r, float(w)) for r, w in zip(rules, weights) if w != 0], bias


def compiled(model: tuple[list[tuple[Rule, float]], float], prior: float = 0.0) -> Column:
    """The ensemble as a column over STATISTICS, 0 to 1; ``prior`` is added to the log odds."""
    rules, bias = model
    total = F.lit(bias + prior)
    for rule, weight in rules:
        hold = F.lit(True)
        for f, at_most, bound in rule:
            c = F.col(STATISTICS[f])
            hold = hold & ((c <= bound) if at_most else (c > bound))
        total = total + F.when(hold, F.lit(weight)).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, rows: dict[int, int] = FIT_ROWS):
    """Fit on a bounded sample of labelled rows outside the held-out fold, at the odds of all of them."""
    sample = labelled_sample(docs, labels, "quality", rows)
    got = with_statistics(sample, ["doc_id", "y"]).orderBy("doc_id").collect()
    x = np.array([[r[s] for s in STATISTICS] for r in got]).reshape(len(got), len(STATISTICS))
    y = np.array([r["y"] for r in got], dtype=float)
    rules, bias = fit(x, y)
    return rules, bias + prior_shift(docs, labels, "quality", y)


def score(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    return with_statistics(docs, keep).select(*[named(c) for c in keep], compiled(model).alias("score"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts have all statistics 0 and are scored by the rules like any other; repeated
    rows each get a row; labels of one class give equal scores, none gives 0.5; empty tables no rows.
    """
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
