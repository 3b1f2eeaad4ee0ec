"""Language identification by multilingual mixture inference.

Each language has a distribution of byte trigrams of lower-case words, hashed
into TABLE cells and smoothed, counted over all training rows. A document is a
mixture of languages: each of its words was written in one of them, with a
likelihood from its trigrams. Expectation-maximisation estimates the proportions.
The set of languages is chosen by penalised likelihood: sets of the most
probable one, two, three and so on are refitted, and each further language must
gain more than the penalty times half the log of the number of words; a text's set
grows until one more does not. Where no mixture at all can gain that much, the
best single language is taken.

Every label of the training rows is learned. Counts stay sparse, and words are
scored so many at a time that their table of all languages keeps its size. The driver
and each worker hold a label's cells that occur, 768 KB a label at the very most.

Defined results: a null text, or one without any letter, gives `und` with score 0;
without training rows all texts are `und`; repeated rows get equal results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainery.llm import common

#: Cells of the trigram table, smoothing, penalty, and steps of the two fits.
TABLE, SMOOTHING, PENALTY, STEPS, RESTEPS = 1 << 16, 0.5, 4.0, 12, 6
SLICE = 1 << 20
#: Languages whose whole table is kept; words times languages that are scored at once; counts that a task gathers.
DENSE, ENTRIES, GATHERED = 64, 1 << 24, 4 << 20

_LETTER = regex.compile(r"\p{L}")
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def words_and_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trigram codes of all texts' words; where each word's codes begin; each word's text."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = _CLASS[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    owner = np.cumsum([len(r) + 1 for r in raw])
    letter = data != 32
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one space after each word
    stream = np.concatenate([[32], data[kept], [32]]).astype(np.uint32)
    middle = np.flatnonzero(stream[1:-1] != 32) + 1
    if not len(middle):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = stream[middle - 1] * np.uint32(0x9E3779B1) ^ stream[middle] * np.uint32(0x85EBCA77) ^ stream[middle + 1] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    codes = (mixed >> np.uint32(16)).astype(np.int64)
    starts = np.flatnonzero(stream[middle - 1] == 32)
    first = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    return codes, starts, np.searchsorted(owner, first, "right")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _rows(kinds: dict[str, int], keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = pa.array(list(kinds), pa.string())
    for lo in range(0, len(keys), TABLE):
        some = keys[lo : lo + TABLE]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(some // TABLE)), pa.array((some % TABLE).astype(np.int32)), pa.array(counts[lo : lo + TABLE])], names=["lang", "cell", "n"])


@common.tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, cell), gathered sparse; a task may give partial ones."""
    kinds: dict[str, int] = {}
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for part in common.slices(batch, most=SLICE):
            langs = part.column("lang").to_pylist()
            codes, starts, owner = words_and_codes(common.texts_of(part))
            if not len(codes):
                continue
            here, local = np.unique(np.array([kinds.setdefault(x, len(kinds)) for x in langs]), return_inverse=True)
            each = np.repeat(local[owner], np.diff(np.append(starts, len(codes))))
            if len(here) <= 16:
                found = np.bincount(each * TABLE + codes, minlength=len(here) * TABLE)
                keys = np.flatnonzero(found)
                parts.append((here[keys // TABLE] * TABLE + keys % TABLE, found[keys]))
            else:
                parts.append(np.unique(here[each] * TABLE + codes, return_counts=True))
            if sum(len(k) for k, _ in parts) > GATHERED:
                parts = [_merged(parts)]
                if 2 * len(parts[0][0]) > GATHERED:
                    yield from _rows(kinds, *parts.pop())
    if parts:
        yield from _rows(kinds, *_merged(parts))


class Model:
    """The languages and the log likelihood of each cell in each of them, kept as counts beyond DENSE languages."""

    def __init__(self, languages: list[str], cells: list[np.ndarray], counts: list[np.ndarray]):
        self.languages = languages
        self.at = np.cumsum([0, *map(len, cells)])
        self.cells, self.counts = (np.concatenate([*x, np.zeros(0, np.int32)]) for x in (cells, counts))
        self.totals = np.array([x.sum() for x in counts], np.float64) + SMOOTHING * TABLE
        self.log = self.table(np.arange(TABLE)) if len(languages) <= DENSE else None

    def table(self, cells: np.ndarray) -> np.ndarray:
        """The log likelihoods of some cells (columns) in all languages."""
        place = np.full(TABLE, -1)
        place[cells] = np.arange(len(cells))
        out = np.repeat(np.log(SMOOTHING / self.totals).astype(np.float32)[:, None], len(cells), axis=1)
        for j in range(len(self.languages)):
            mine = slice(self.at[j], self.at[j + 1])
            at = place[self.cells[mine]]
            out[j, at[at >= 0]] = np.log((self.counts[mine][at >= 0] + SMOOTHING) / self.totals[j])
        return out

    def words(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The log likelihood of each word in each language, less that of the word's best."""
        log = self.log
        if log is None:
            cells, codes = np.unique(codes, return_inverse=True)
            log = self.table(cells)
        word = np.empty((len(starts), len(log)), np.float32)
        for j in range(len(log)):
            word[:, j] = np.add.reduceat(log[j][codes], starts)
        word -= word.max(axis=1)[:, None]
        return word


def learn(docs: DataFrame) -> Model:
    """Count trigrams of docs(text, lang) by language, over all rows and languages."""
    common.bound_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(_counted, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # one row of packed counts for each language reaches the driver
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    found = packed.select("lang", "cells.cell", "cells.n").toArrow()
    names = found.column(0).to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    return Model([names[i] for i in order], *([np.array(found.column(c)[i].values) for i in order] for c in (1, 2)))


def _em(parts: Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]], n: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions, and the log likelihood that they give each text; parts are likelihoods of words and their texts, in order."""
    for _ in range(steps):
        total = np.zeros_like(share)
        for ratio, owner in parts():
            joint = ratio * share[owner]
            joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            total[owner[first]] += np.add.reduceat(joint, first, axis=0)
        share = (total / n[:, None]).astype(np.float32)
    gain = np.zeros(len(n))
    for ratio, owner in parts():
        final = np.log(np.maximum((ratio * share[owner]).sum(axis=1), 1e-30))
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        gain[owner[first]] += np.add.reduceat(final.astype(np.float64), first)
    return share, gain


def mixtures(model: Model, texts: list[str], penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Each text's proportions of the chosen languages (0 for the others), and its score."""
    k, out, score = len(model.languages), np.zeros((len(texts), len(model.languages)), np.float32), np.zeros(len(texts))
    codes, starts, owner = words_and_codes(texts)
    if not k or not len(codes):
        return out, score
    mine, first = np.unique(owner, return_index=True)  # texts that have words
    cut, most, a = np.append(first, len(owner)), max(1, ENTRIES // k), 0
    while a < len(mine):  # as many texts as may be scored at once, or a longer one alone
        b = max(a + 1, int(np.searchsorted(cut, cut[a] + most, "right")) - 1)
        out[mine[a:b]], score[mine[a:b]] = _mixed(model, codes, np.append(starts, len(codes)), cut[a : b + 1], most, penalty)
        a = b
    return out, score


def _mixed(model: Model, codes: np.ndarray, starts: np.ndarray, cut: np.ndarray, most: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for some texts whose words begin at cut; more than `most` words, of one text, are scored anew in every pass."""
    k, size = len(model.languages), np.diff(cut)
    who = np.repeat(np.arange(len(size)), size)

    def scored() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo in range(cut[0], cut[-1], most):
            hi = min(lo + most, cut[-1])
            yield model.words(codes[starts[lo] : starts[hi]], starts[lo:hi] - starts[lo]), who[lo - cut[0] : hi - cut[0]]

    held = list(scored()) if len(who) <= most else None
    blocks = (lambda: held) if held else scored
    single = np.zeros((len(size), k))
    for word, owner in blocks():
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        single[owner[first]] += np.add.reduceat(word.astype(np.float64), first, axis=0)
    best = single.argmax(axis=1)
    one = single[np.arange(len(size)), best]
    price = penalty * 0.5 * np.log(np.maximum(size, 2))
    share = np.zeros((len(size), k), np.float32)
    share[np.arange(len(size)), best] = 1
    others = np.where(np.arange(k) == best[:, None], -np.inf, single)
    score = 1 / (1 + np.exp(np.clip(others.max(axis=1) - one, -700, 0))) if k > 1 else np.ones(len(size))

    def fit(texts: np.ndarray, columns: np.ndarray | None, begin: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Fit some texts, each with its own columns (all if none are given)."""
        number = np.full(len(size), -1)
        number[texts] = np.arange(len(texts))

        def chosen() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for word, owner in blocks():
                rows = np.flatnonzero(number[owner] >= 0)
                at = number[owner[rows]]
                yield np.exp(word[rows] if columns is None else np.take_along_axis(word[rows], columns[at], 1)), at

        kept = list(chosen()) if held else None
        return _em((lambda: kept) if held else chosen, size[texts], begin, steps)

    growing = np.flatnonzero(-one > price) if k > 1 else np.zeros(0, int)
    if len(growing):
        free, _ = fit(growing, None, np.full((len(growing), k), 1 / k, np.float32), STEPS)
        rank = np.argsort(-free, axis=1, kind="stable")
        value, m = one[growing], 2
        while len(growing) and m <= k:
            columns = rank[:, :m]
            start = np.take_along_axis(free, columns, 1) + np.float32(1e-3)
            fitted, gain = fit(growing, columns, start / start.sum(axis=1, keepdims=True), RESTEPS)
            reached = gain - price[growing] * (m - 1)
            better = reached > value
            growing, free, rank, value = growing[better], free[better], rank[better], reached[better]
            share[growing] = 0
            share[growing[:, None], rank[:, :m]] = fitted[better]
            m += 1
        mixed = (share > 0).sum(axis=1) > 1
        score[mixed] = share[mixed].max(axis=1)
    return share, score


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.languages, "und"], dtype=object)
    for batch in batches:
        for part in common.slices(batch, most=SLICE):
            texts = common.texts_of(part)
            share, score = mixtures(model, texts)
            has = np.array([bool(_LETTER.search(t)) for t in texts]) & (share.sum(axis=1) > 0)
            top = np.where(has, share.argmax(axis=1), len(model.languages)) if model.languages else np.zeros(len(texts), int)
            langs = [[x for x, p in zip(model.languages, row, strict=True) if p > 0] if ok else [] for row, ok in zip(share.tolist(), has.tolist(), strict=True)]
            parts = [[p for p in row if p > 0] if ok else [] for row, ok in zip(share.tolist(), has.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names[top].tolist(), pa.string()), pa.array(np.where(has, np.clip(score, 0, 1), 0.0)), pa.array(langs, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))],
                names=["doc_id", "lang_pred", "score", "languages", "proportions"],
            )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, languages, proportions of docs(doc_id, text)."""
    common.bound_batches(docs.sparkSession)
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)
    work = functools.partial(_with_broadcast, shared=shared)
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, lang_pred string, score double, languages array<string>, proportions array<double>")


@common.tidy
def _with_broadcast(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    yield from _predicted(batches, shared.value)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 3 is not 1, and predict all rows."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = predict(docs, learn(docs.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages", "proportions")
