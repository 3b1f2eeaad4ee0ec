"""The language mixtures and the rule ensemble against plain-Python versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainery.llm import langid, queries, rule_ensemble


def trigrams(text):
    """The cells of each word's byte trigrams, one space before and after."""
    kind = lambda b: b if 97 <= b <= 122 or b >= 128 else 32
    words, out = "".join(chr(kind(b)) for b in text.lower().encode()).split(" "), []
    for w in filter(None, words):
        s, cells = [32, *map(ord, w), 32], []
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            x = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
            x = ((x ^ x >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
            cells.append(x >> 16)
        out.append(cells)
    return out


class Plain:
    """The model and the mixtures, word by word and language by language."""

    def __init__(self, rows):
        counts = {}
        for text, lang in rows:
            mine = counts.setdefault(lang, {})
            for word in trigrams(text):
                for c in word:
                    mine[c] = mine.get(c, 0) + 1
        self.counts = {x: c for x, c in counts.items() if c}
        self.languages = sorted(self.counts)
        self.totals = {x: sum(c.values()) + langid.SMOOTHING * langid.TABLE for x, c in self.counts.items()}

    def word(self, cells):
        found = [sum(math.log((self.counts[x].get(c, 0) + langid.SMOOTHING) / self.totals[x]) for c in cells) for x in self.languages]
        return [v - max(found) for v in found]

    @staticmethod
    def fit(ratio, share, steps):
        for _ in range(steps):
            total = [0.0] * len(share)
            for r in ratio:
                joint = [a * b for a, b in zip(r, share, strict=True)]
                whole = max(sum(joint), 1e-30)
                total = [t + j / whole for t, j in zip(total, joint, strict=True)]
            share = [t / len(ratio) for t in total]
        return share, sum(math.log(max(sum(a * b for a, b in zip(r, share, strict=True)), 1e-30)) for r in ratio)

    def mixture(self, text):
        words = [self.word(w) for w in trigrams(text)]
        k, out = len(self.languages), [0.0] * len(self.languages)
        if not words:
            return out
        single = [sum(w[j] for w in words) for j in range(k)]
        best = max(range(k), key=lambda j: single[j])
        price = langid.PENALTY * 0.5 * math.log(max(len(words), 2))
        out[best] = 1.0
        if k == 1 or -single[best] <= price:
            return out
        ratio = [[math.exp(v) for v in w] for w in words]
        free, _ = self.fit(ratio, [1 / k] * k, langid.STEPS)
        rank, value = sorted(range(k), key=lambda j: -free[j]), single[best]
        for m in range(2, k + 1):
            chosen = rank[:m]
            begin = [free[j] + 1e-3 for j in chosen]
            share, gain = self.fit([[r[j] for j in chosen] for r in ratio], [b / sum(begin) for b in begin], langid.RESTEPS)
            if gain - price * (m - 1) <= value:
                break
            value, out = gain - price * (m - 1), [0.0] * k
            for j, s in zip(chosen, share, strict=True):
                out[j] = s
        return out


def test_mixtures_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id % 2 = 0")
    rows = [(r.text, r.lang) for r in docs.collect()]
    plain, model = Plain(rows), langid.learn(docs)
    assert model.languages == plain.languages
    for j, x in enumerate(plain.languages):
        assert dict(zip(model.cells[model.at[j] : model.at[j + 1]].tolist(), model.counts[model.at[j] : model.at[j + 1]].tolist(), strict=True)) == plain.counts[x]
    r, some = random.Random(2), [t for t, _ in rows if len(t) < 1500]
    texts = some[:25] + ["", "12 !", "x", "Ünïcode É"] + [" ".join(t for x in r.sample(some, 3) for t in x.split()[:80]) for _ in range(10)]
    share, score = langid.mixtures(model, texts)
    for i, text in enumerate(texts):
        want = plain.mixture(text)
        assert np.abs(share[i] - want).max() < 2e-3 and ((share[i] > 0) == (np.array(want) > 0)).all(), text
        assert 0 <= score[i] <= 1
    assert sum((s > 0).sum() > 1 for s in share) >= 5


def test_very_long_text_takes_bounded_memory(spark):
    import tracemalloc

    docs = spark.createDataFrame([(" ".join(f"{x}{i}{x}" for i in "abcdefghij"), x) for x in ("un", "do", "tre", "cat")], "text string, lang string")
    model, text = langid.learn(docs), "una dob trec catd " * 300_000
    tracemalloc.start()
    share, _ = langid.mixtures(model, [text])
    peak = tracemalloc.get_traced_memory()[1]
    assert (share[0] > 0.1).all() and peak < 200 * len(text)


def measures(text):
    """The ensemble's statistics, written out."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(words), len(re.sub(r"[\x20\x09-\x0D]", "", text))
    if not n:
        return [0.0] * len(rule_ensemble.STATISTICS)
    windows = {}
    for i in range(n - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeats = len({i + k for v in windows.values() if len(v) > 1 for i in v for k in range(8)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    low = text.lower().split()
    m = max(1, len(low))
    return [
        math.log1p(n), chars / n, sum(c in "#*$%&|<>" for c in text) / n, text.count("!") / n, sum("A" <= c <= "Z" for c in text) / max(1, sum("A" <= c.upper() <= "Z" and c.isascii() for c in text)),
        sum("0" <= c <= "9" for c in text) / max(1, chars), repeats / n, (len(lines) - len(set(lines))) / max(1, len(lines)), len(set(low)) / m, max((low.count(w) for w in set(low)), default=0) / m,
        text.count(".") / n, n / max(1, len(lines)), text.count(",") / n,
    ]


def test_scores_by_brute_force(spark):
    """The query's scores are those of the fitted rules, evaluated one by one on statistics written out."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = rule_ensemble.fit(docs, labels)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    checked = 0
    for r in queries.op9_rule_ensemble(spark, d).collect():
        if len(text[r.doc_id]) > 4000:
            continue
        x = measures(text[r.doc_id])
        total = model.intercept + sum(w * all((x[s] > limit) if above else (x[s] <= limit) for s, above, limit in rule.tests) for rule, w in model.rules)
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9) and r.predicted == (r.score >= 0.7)
        checked += 1
    assert checked > 500


def test_lasso_is_the_minimum():
    """At the minimum each weight's gradient is the penalty against its sign, or within it where the weight is zero."""
    r = np.random.default_rng(4)
    x = (r.random((1500, 40)) < 0.4).astype(float)
    y = (r.random(1500) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * x[:, 1] + x[:, 2])))).astype(float)
    b, w = rule_ensemble.lasso_logistic(x, y, penalty=0.01, steps=3000)
    gradient = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
    on = np.abs(w) > 1e-6
    assert 2 < on.sum() < 40 and np.allclose(gradient[on], -0.01 * np.sign(w[on]), atol=2e-4) and (np.abs(gradient[~on]) <= 0.01 + 2e-4).all()


def test_repeated_labelled_ids(spark):
    rows = [(i, f"good text number {i} " * (5 + i % 3)) for i in range(40)] + [(100 + i, "#$% !! " * (3 + i % 4)) for i in range(40)] + [(i, "another text of the same id") for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] * 2, "doc_id bigint, quality int")
    once = rule_ensemble.fit(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), labels)
    again = rule_ensemble.fit(spark.createDataFrame(rows[::-1], "doc_id bigint, text string").repartition(2), labels)
    assert once == again
    found = rule_ensemble.classify(spark.createDataFrame(rows, "doc_id bigint, text string"), labels).agg(F.min("score"), F.max("score")).first()
    assert 0 <= found[0] < 0.5 < found[1] <= 1
