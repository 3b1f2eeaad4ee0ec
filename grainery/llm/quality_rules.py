"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once per document. The ledger holds the measurements
and one bit per failed rule; policies are versioned bit masks applied to the
ledger afterwards, and ablations (what each rule alone removes under a policy)
come from a count of distinct bit sets, without the texts.

Words are runs of characters other than ASCII white space. Defined results: a
null or empty text has no words and fails too_few_words; repeated rows are
judged alike; an empty table gives an empty ledger; other columns pass through
untouched, and the ledger's own columns are only those listed in MEASURES and `bits`.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import AnyStr

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainery.llm import common

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")
SYMBOLS, SPACES, WINDOW = "#*$%&|<>", " \t\n\x0b\x0c\r", 8
_SPACE, _LINE_END = re.compile(rb"[ \t\n\x0b\x0c\r]"), re.compile(rb"\n")
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])


#: Characters of a text that are cut into words at once.
PIECE = 1 << 20


def pieces(text: AnyStr, gap: re.Pattern[AnyStr]) -> Iterator[AnyStr]:
    """A text cut before gaps into pieces of about PIECE characters: a long text is never a list of all its words."""
    lo = 0
    while lo < len(text):
        found = gap.search(text, lo + PIECE)
        hi = found.start() if found else len(text)
        yield text[lo:hi]
        lo = hi


def _numbered(parts: Iterable[list[bytes]]) -> tuple[np.ndarray, int]:
    """Each word's number among the different words, and how many these are."""
    seen: dict[bytes, int] = {}
    ids = [np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) for words in parts]
    return np.concatenate([*ids, np.zeros(0, np.int64)]), len(seen)


def _repeated(ids: np.ndarray, kinds: int, window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more (a power of two).

    Windows get exact identities by doubling: pairs of words, of pairs, and so on.
    """
    n = len(ids)
    if n <= window or kinds == n:
        return 0
    width = 1
    while width < window:
        pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        found, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(found) == len(pairs):
            return 0
        width *= 2
    edge = np.zeros(n + 1, np.int64)
    twice = np.flatnonzero(counts[ids] > 1)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    return _repeated(*_numbered([words]), window)


def measure_text(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    raw = text.encode("utf-8", "surrogatepass")
    ids, kinds = _numbered(part.split() for part in pieces(raw, _SPACE))
    n_lines, lines = 0, set()
    for part in pieces(raw, _LINE_END):
        found = [line for line in part.split(b"\n") if line.strip()]
        n_lines += len(found)
        lines.update(found)
    return (
        len(ids),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        n_lines - len(lines),
        _repeated(ids, kinds),
        n_lines,
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _LETTERS)),
        text.count("!"),
    )


@common.tidy
def _measured(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, text):
            rows = np.array([measure_text(t) for t in common.texts_of(part, text)], np.int64).reshape(-1, len(MEASURES))
            kept = [n for n in part.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *(pa.array(rows[:, i]) for i in range(len(MEASURES)))], names=[*kept, *MEASURES])


def _ledger(rows: DataFrame, text: str) -> DataFrame:
    common.bound_batches(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*kept, *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return rows.mapInArrow(functools.partial(_measured, text=text), schema).withColumn("bits", failure_bits())


@dataclass(frozen=True)
class Rule:
    """A named bit; the condition, in SQL over the measurements, is true where the document fails."""

    bit: int
    name: str
    fails: str


#: A bit is never used again for another rule.
RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "shouting", "n_words >= 20 AND 10 * n_upper > 4 * n_letters"),
    Rule(5, "exclamations", "10 * n_marks > n_words"),
    Rule(6, "word_length", "n_words >= 20 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
)

#: Policies by version: the rules whose failure rejects a document.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(r.name for r in RULES),
}


def mask(names: tuple[str, ...]) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in names)


def failure_bits() -> Column:
    return F.expr(" + ".join(f"IF({r.fails}, {1 << r.bit}L, 0L)" for r in RULES))


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs(text, ...), the measurements, and `bits`."""
    return _ledger(docs.select(*keep, F.col("text").alias("__text")), "__text")


def select_passing(docs: DataFrame, policy: str) -> DataFrame:
    """The rows of docs(text, ...) that pass a policy, with all their columns, whatever those are called."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    return _ledger(rows, "__row.text").filter(kept_by(policy)).select("__row.*")


def kept_by(policy: str) -> Column:
    """Whether the ledger row passes a policy."""
    return F.col("bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(book: DataFrame) -> DataFrame:
    """policy, rule, failed, rejected, rejected_without, only_this for every policy and rule of it.

    The ledger is reduced to counts of its distinct bit sets, at most
    2 ^ rules of them, before policies are applied.
    """
    counts = book.groupBy("bits").agg(F.count("*").alias("n"))
    rules = [(p, r.name, mask(POLICIES[p]), 1 << r.bit) for p in POLICIES for r in RULES if r.name in POLICIES[p]]
    grid = book.sparkSession.createDataFrame(rules, "policy string, rule string, policy_mask bigint, rule_bit bigint")
    n, bits, whole, one = (F.col(c) for c in ("n", "bits", "policy_mask", "rule_bit"))
    rest = bits.bitwiseAND(whole).bitwiseAND(F.bitwise_not(one)) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    joined = F.broadcast(grid).join(counts, F.lit(True), "left")
    return joined.groupBy("policy", "rule").agg(
        total(bits.bitwiseAND(one) != 0).alias("failed"),
        total(bits.bitwiseAND(whole) != 0).alias("rejected"),
        total(rest).alias("rejected_without"),
        total((bits.bitwiseAND(one) != 0) & ~rest).alias("only_this"),
    )


def bits_by(book: DataFrame, key: str) -> DataFrame:
    """For each key: rules failed by some row, by all rows, and the count of rows, by bitwise aggregation."""
    return book.groupBy(key).agg(F.bit_or("bits").alias("some"), F.bit_and("bits").alias("all"), F.count("*").alias("n"))


def judge(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger by doc_id with base_failed and kept under a policy."""
    book = ledger(docs)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~kept_by("base")).alias("base_failed"),
        (kept_by("base") & kept_by(policy)).alias("kept"),
        "n_lines", "n_upper", "n_letters", "n_marks", "bits",
    )


#: DuckDB SQL for judge(documents, "v2").
ORACLE_SQL = r"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM base),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM base),
line_counts AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
starts AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
windows AS (SELECT starts.r, i, count(*) OVER (PARTITION BY starts.r, array_to_string(ws[i:i + 7], ' ')) AS n FROM starts JOIN w ON w.r = starts.r),
covered AS (SELECT r, unnest(range(i, i + 8)) AS p FROM windows WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM covered GROUP BY r),
m AS (
  SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
    length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_marks
  FROM w LEFT JOIN line_counts ON line_counts.r = w.r LEFT JOIN repeats ON repeats.r = w.r),
b AS (SELECT *, (__BITS)::BIGINT AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, n_lines, n_upper, n_letters, n_marks, bits
FROM b
""".replace("__BITS", " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES))

#: DuckDB SQL for ablations(ledger(documents)).
ABLATIONS_SQL = f"""
WITH book AS ({ORACLE_SQL}),
grid AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{r.name}', {mask(POLICIES[p])}, {1 << r.bit})" for p in POLICIES for r in RULES if r.name in POLICIES[p])}) v(policy, rule, m, b))
SELECT policy, rule, count(*) FILTER (bits & b <> 0) AS failed, count(*) FILTER (bits & m <> 0) AS rejected,
  count(*) FILTER (bits & m & ~b <> 0) AS rejected_without, count(*) FILTER (bits & m = b) AS only_this
FROM grid LEFT JOIN book ON TRUE GROUP BY policy, rule
"""
