"""A quality classifier as a sparse ensemble of rules.

Statistics of each text (rates of words, symbols, repeats and so on) are split
by boosted small regression trees fitted to labelled rows. Every path from a root
becomes a conjunctive rule; a logistic model with an L1 penalty weighs the rules
and drops most of them. What is left is compiled into one Spark column
expression over the statistics, so scoring needs no model on the executors.

The fit takes at most SAMPLE labelled training rows, those of the least hash of
their id, to the driver (the bound is that parameter); scoring covers every row.

Defined results: a null or empty text has zero statistics and gets the score of
such; repeated rows get equal scores; conflicting labels of one id are averaged; of the
texts of a repeated labelled id the one with the least statistics is learned;
without two classes to tell apart the score is 1.0, or 0.0 if only class 0
was seen; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainery.llm import common, quality_rules

SAMPLE, TREES, DEPTH, BINS, LEARNING_RATE, PENALTY, STEPS = 20_000, 40, 3, 24, 0.3, 4e-4, 600

STATISTICS = (
    "log_words", "word_length", "symbol_rate", "mark_rate", "upper_rate", "digit_rate", "repeat_rate",
    "dup_line_rate", "distinct_rate", "top_word_rate", "full_stop_rate", "line_words", "comma_rate",
)
_GAP = re.compile(r"\s")


def statistics(text: str) -> tuple[float, ...]:
    """The statistics of one text, in the order of STATISTICS."""
    n, chars, symbols, dup, repeats, lines, upper, letters, marks = quality_rules.measure_text(text)
    if not n:
        return (0.0,) * len(STATISTICS)
    counts: dict[str, int] = {}
    for part in quality_rules.pieces(text.lower(), _GAP):
        for w in part.split():
            counts[w] = counts.get(w, 0) + 1
    m = max(1, sum(counts.values()))
    return (
        float(np.log1p(n)), chars / n, symbols / n, marks / n, upper / max(1, letters), sum(map(text.count, "0123456789")) / max(1, chars), repeats / n,
        dup / max(1, lines), len(counts) / m, max(counts.values(), default=0) / m, text.count(".") / n, n / max(1, lines), text.count(",") / n,
    )


@common.tidy
def _described(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, text):
            rows = np.array([statistics(t) for t in common.texts_of(part, text)], np.float64).reshape(-1, len(STATISTICS))
            kept = [n for n in part.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(STATISTICS)))], names=[*kept, *(f"__{s}" for s in STATISTICS)])


def _describe(rows: DataFrame, text: str) -> DataFrame:
    common.bound_batches(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name != text]
    return rows.mapInArrow(functools.partial(_described, text=text), T.StructType([*kept, *(T.StructField(f"__{s}", T.DoubleType()) for s in STATISTICS)]))


def describe(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and the statistics, named with two leading underscores."""
    return _describe(docs.select(*keep, F.col("text").alias("__text")), "__text")


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is_above, threshold) hold."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for s, above, limit in self.tests:
            out &= (x[:, s] > limit) if above else (x[:, s] <= limit)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for i, (s, above, limit) in enumerate(self.tests):
            c = F.col(f"__{STATISTICS[s]}")
            test = c > F.lit(limit) if above else c <= F.lit(limit)
            out = test if not i else out & test
        return out

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[s]} {'>' if above else '<='} {limit:.4g}" for s, above, limit in self.tests)


def _split(x: np.ndarray, g: np.ndarray, limits: list[np.ndarray], least: int) -> tuple[float, int, float] | None:
    """The best (gain, statistic, threshold) that splits rows by their residuals g."""
    best, total = None, g.sum()
    for s, cuts in enumerate(limits):
        if not len(cuts):
            continue
        place = np.searchsorted(cuts, x[:, s], "left")
        n, t = (np.cumsum(np.bincount(place, w, len(cuts) + 1))[:-1] for w in (None, g))
        m = len(g) - n
        gain = np.where((n >= least) & (m >= least), t**2 / np.maximum(n, 1) + (total - t) ** 2 / np.maximum(m, 1) - total**2 / len(g), -1)
        i = int(gain.argmax())
        if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
            best = (float(gain[i]), s, float(cuts[i]))
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Rule]:
    """The distinct rules on all paths of boosted trees over random halves of the rows."""
    random = np.random.default_rng(seed)
    limits = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for s in range(x.shape[1])]
    limits = [c[c < x[:, s].max()] for s, c in enumerate(limits)]
    score, rules, least = np.zeros(len(y)), {}, max(5, len(y) // 500)
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-score))
        mine = random.random(len(y)) < 0.5
        nodes = [((), np.ones(len(y), bool))]
        for level in range(depth):
            grown = []
            for tests, where in nodes:
                some = where & mine
                found = _split(x[some], residual[some], limits, least) if some.sum() > 2 * least else None
                if found is None:
                    grown.append((tests, where))
                    continue
                _, s, limit = found
                above = x[:, s] > limit
                for side, rows in ((True, where & above), (False, where & ~above)):
                    path = tuple(sorted({*tests, (s, side, limit)}))
                    rules[path] = None
                    grown.append((path, rows))
            nodes = grown
        for tests, where in nodes:
            p = 1 / (1 + np.exp(-score[where]))
            if len(p):
                score[where] += LEARNING_RATE * (y[where] - p).sum() / (float((p * (1 - p)).sum()) + 1.0)
    return [Rule(path) for path in rules]


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise the mean log loss + penalty * L1 norm, by accelerated proximal steps."""
    n, k = x.shape
    rate = min(1 - 1e-4, max(1e-4, y.mean()))
    w, b = np.zeros(k), float(np.log(rate / (1 - rate)))
    v = np.random.default_rng(0).normal(size=k)
    for _ in range(30):  # the largest eigenvalue, by powers
        v = x.T @ (x @ v)
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1 / (0.25 * (top / n + 1) + 1e-9)
    old_w, old_b = w.copy(), b
    for t in range(1, steps + 1):
        move = (t - 1) / (t + 2)
        u, a = w + move * (w - old_w), b + move * (b - old_b)
        error = 1 / (1 + np.exp(-(x @ u + a))) - y
        old_w, old_b = w, b
        raw = u - step * (x.T @ error) / n
        w, b = np.sign(raw) * np.maximum(np.abs(raw) - step * penalty, 0), a - step * float(error.mean())
    return b, w


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]
    constant: float | None = None

    def score(self) -> Column:
        """The score over the statistics' columns."""
        if self.constant is not None:
            return F.lit(self.constant)
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rows(x: np.ndarray, y: np.ndarray) -> Model:
    if len(np.unique(y > 0.5)) < 2:
        return Model(0.0, (), 0.0 if len(y) and y.max() <= 0.5 else 1.0)
    rules = grow_rules(x, y)
    held = np.column_stack([r.holds(x) for r in rules]).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    b, w = lasso_logistic(held.astype(np.float64), y)
    return Model(b, tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6))


def fold(c: str = "doc_id", parts: int = 4) -> Column:
    return F.crc32(F.col(c).cast("string").cast("binary")) % parts


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labels(doc_id, quality) of docs(doc_id, text) outside the held-out fold."""
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 2))
        .groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = describe(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ["doc_id", "__label"])
    names = [f"__{s}" for s in STATISTICS]
    data = rows.groupBy("doc_id").agg(F.min("__label").alias("__label"), F.min(F.struct(*names)).alias("s")).select("doc_id", "__label", "s.*").orderBy("doc_id").toArrow()
    x = np.column_stack([data.column(f"__{s}").to_numpy() for s in STATISTICS]) if data.num_rows else np.zeros((0, len(STATISTICS)))
    return fit_rows(x, (data.column("__label").to_numpy() >= 0.5).astype(np.float64))


def score(docs: DataFrame, model: Model, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """The columns `keep` of docs(text, ...) with score and predicted."""
    rows = describe(docs, keep).withColumn("__score", model.score())
    return rows.select(*keep, F.col("__score").alias("score"), F.when(F.col("__score") >= threshold, 1).otherwise(0).alias("predicted"))


def select_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs(text, ...) that score at least the threshold, with all their columns, whatever those are called."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    return _describe(rows, "__row.text").filter(model.score() >= threshold).select("__row.*")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs(doc_id, text)."""
    scored = score(docs, fit(docs, labels, sample), ["doc_id"], threshold)
    return scored.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")
