"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens with a target rate. In every window of 1,024
tokens a queue is entitled to its quantum, the window's length times its rate,
plus the deficit that it carries; what it is served is its next tokens, cut
freely. Tokens are served in the order of their due times: token j of a queue
with rate r is due at (j + 1/2) / r. So a queue never lags or leads by more
than its rounding, every window but the last is full, and what each queue has
been served after k windows is a function of k alone: each partition computes
the deficits that it starts with and carries them on without replaying earlier
windows. A queue that runs out leaves its share to the others.

Default rates are the queues' token counts, so that all queues end together and
every window has the corpus' mixture; `targets` sets others by source.

Stages: (1) encode each document once, with its place in its queue inside its
partition, into a table in the shared folder; (2) add up queue totals by partition;
(3) cut each document at the window limits that fall into it. No shuffle moves ids.

Defined results: a null or empty text is a document of the end id alone;
a null source is a queue of its own; repeated rows are separate documents; an
empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainery.llm import common, tokenizing

#: Windows whose limits are computed at once for so many queues; for more queues, fewer windows at once.
BLOCK, MAX_QUEUES = 2048, 64


def queue_names(docs: DataFrame) -> list[str | None]:
    """The sources, each of them a queue, the largest first (one row of each reaches the driver)."""
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).count().orderBy(F.desc("count"), F.asc_nulls_first("source"))
    return [r[0] for r in counts.collect()]


@common.tidy
def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int, names: list[str | None]) -> Iterator[pa.RecordBatch]:
    enc, part = tokenizing.encoder(path), TaskContext.get().partitionId()
    place = {name: i for i, name in enumerate(names)}
    sofar = np.zeros(len(names), np.int64)
    for batch in batches:
        for rows in common.slices(batch):
            ids, at = tokenizing.with_end(*enc.encode(rows.column("text")), end)
            queue = np.array([place[s] for s in rows.column("source").to_pylist()], np.int32)
            n = np.diff(at)
            before = np.empty(len(n), np.int64)
            for q in np.unique(queue).tolist():
                mine = queue == q
                ends = np.cumsum(n[mine])
                before[mine] = sofar[q] + ends - n[mine]
                sofar[q] += ends[-1]
            small = enc.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16
            raw = ids.astype("<u2" if small else "<u4")
            packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.ascontiguousarray(at * raw.itemsize)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), rows.column("doc_id"), pa.array(queue), pa.array(n, pa.int64()), pa.array(before), packed.cast(pa.binary())],
                names=["part", "doc_id", "queue", "n", "before", "ids"],
            )


class Schedule:
    """What each queue has been served after any number of windows."""

    def __init__(self, totals: np.ndarray, rates: np.ndarray, window: int, queues: int = MAX_QUEUES):
        self.totals, self.rates, self.window = totals.astype(np.float64), rates.astype(np.float64), window
        self.total = int(totals.sum())
        self.block = max(1, min(BLOCK, BLOCK * queues // len(rates)))
        ends = self.totals / self.rates
        order = np.argsort(ends)
        self.breaks = np.concatenate([[0.0], np.unique(ends)])
        over = np.searchsorted(ends[order], self.breaks, "right")
        done = np.concatenate([[0.0], np.cumsum(self.totals[order])])
        left = np.concatenate([np.cumsum(self.rates[order][::-1])[::-1], [0.0]])
        self.at_breaks = np.maximum.accumulate(done[over] + self.breaks * left[over])

    def served(self, windows: np.ndarray) -> np.ndarray:
        """Tokens of each queue (columns) among the first windows * window tokens (rows)."""
        wanted = np.minimum(windows * self.window, self.total).astype(np.float64)
        time = np.interp(wanted, self.at_breaks, self.breaks)
        count = np.clip(np.floor(time[:, None] * self.rates + 0.5), 0, self.totals)
        short = wanted - count.sum(axis=1)
        while (rows := np.flatnonzero(short > 0)).size:
            due = np.where(count[rows] < self.totals, (count[rows] + 0.5) / self.rates, np.inf)
            count[rows, due.argmin(axis=1)] += 1
            short[rows] -= 1
        while (rows := np.flatnonzero(short < 0)).size:
            due = np.where(count[rows] > 0, (count[rows] - 0.5) / self.rates, -np.inf)
            last = len(self.rates) - 1 - due[:, ::-1].argmax(axis=1)
            count[rows, last] -= 1
            short[rows] += 1
        return count.astype(np.int64)

    def spare(self) -> int:
        """By how many windows the estimate of a token's window may be wrong, at most."""
        return 2 + len(self.rates) // self.window

    def about(self, queue: int, tokens: np.ndarray) -> np.ndarray:
        """An estimate of the windows of tokens of a queue."""
        return (np.interp((tokens + 0.5) / self.rates[queue], self.breaks, self.at_breaks) / self.window).astype(np.int64)

    def windows_of(self, queue: int, lo: int, hi: int) -> tuple[int, int]:
        """Windows that surely enclose tokens lo to hi of a queue."""
        a, b = self.about(queue, np.array([max(lo - 1, 0), hi + 1]))
        return max(0, int(a) - self.spare()), min(-(-self.total // self.window), int(b) + self.spare() + 1)

    def near(self, queue: int, tokens: np.ndarray) -> np.ndarray:
        """The limits (numbers of windows) on both sides of the windows of some tokens, and a few around them."""
        around = self.about(queue, tokens)[:, None] + np.arange(-self.spare(), self.spare() + 2)
        return np.unique(np.clip(around, 0, -(-self.total // self.window)))


#: A queue with fewer tokens than one in so many windows is cut at the windows of its tokens alone, so many tokens at a time.
SPARSE, TOKENS = 8, 4096


def _between(limits: np.ndarray, served: np.ndarray, q: int, rows: np.ndarray, begin: np.ndarray, n: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
    """Pieces of tokens lo to hi of a queue in the windows between the given limits, which may leave out windows without them."""
    limit = served[:, q]
    before = np.diff(served[:, :q].sum(axis=1))
    rows = rows[(begin[rows] < min(hi, limit[-1])) & (begin[rows] + n[rows] > max(lo, limit[0]))]
    a = np.maximum(begin[rows], max(lo, limit[0]))
    b = np.minimum(begin[rows] + n[rows], min(hi, limit[-1]))
    i, j = np.searchsorted(limit, a, "right") - 1, np.searchsorted(limit, b, "left")
    pieces = np.where(b > a, j - i, 0)
    row = np.repeat(np.arange(len(rows)), pieces)
    k = np.arange(len(row)) + np.repeat(i - (np.cumsum(pieces) - pieces), pieces)
    start, stop = np.maximum(a[row], limit[k]), np.minimum(b[row], limit[k + 1])
    full = stop > start
    row, k, start, stop = rows[row[full]], k[full], start[full], stop[full]
    return row, start - begin[row], stop - start, limits[k], before[k] + start - limit[k]


def cut(schedule: Schedule, queue: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of documents at begin in their queues: (row, start, length, window, offset), by row."""
    out, spans = [], []
    for q in np.unique(queue).tolist():
        mine = np.flatnonzero(queue == q)
        lo, hi = int(begin[mine].min()), int((begin[mine] + n[mine]).max())
        first, last = schedule.windows_of(q, lo, hi)
        if last - first <= SPARSE * (hi - lo) + schedule.block:
            spans.append((first, last, q, mine))
            continue
        for a in range(lo, hi, TOKENS):  # few tokens in many windows
            b = min(hi, a + TOKENS)
            limits = schedule.near(q, np.arange(a, b))
            for some in range(0, len(limits) - 1, schedule.block):
                part = limits[some : some + schedule.block + 1]
                out.append(_between(part, schedule.served(part), q, mine, begin, n, a, b))
    spans.sort(key=lambda x: x[:2])
    at, done, open_ = 0, 0, []
    while at < len(spans) or open_:  # the limits of some windows are computed once for all queues
        if not open_:
            done = max(done, spans[at][0])
        hi = done + schedule.block
        while at < len(spans) and spans[at][0] < hi:
            open_.append(spans[at])
            at += 1
        lo, hi = done, min(hi, max(x[1] for x in open_))
        limits = np.arange(lo, hi + 1)
        served = schedule.served(limits)
        out += [_between(limits, served, q, mine, begin, n, 0, schedule.total) for _, _, q, mine in open_]
        done, open_ = hi, [x for x in open_ if x[1] > hi]
    joined = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
    order = np.lexsort((joined[1], joined[0]))
    return tuple(x[order] for x in joined)


@common.tidy
def _pieces(batches: Iterator[pa.RecordBatch], schedule: Schedule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in common.slices(batch, "ids", most=8 << 20):
            parts = rows.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), rows.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                yield _cut_rows(rows.slice(lo, hi - lo), schedule)


def _cut_rows(rows: pa.RecordBatch, schedule: Schedule) -> pa.RecordBatch:
    n, queue = rows.column("n").to_numpy(), rows.column("queue").to_numpy()
    row, start, length, window, offset = cut(schedule, queue, rows.column("begin").to_numpy(), n)
    raw = rows.column("ids").cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    off = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    width = int((off[-1] - off[0]) // n.sum())
    flat = np.frombuffer(data, "<u2" if width == 2 else "<u4")[off[0] // width : off[-1] // width].astype("<u4")
    view, crc = memoryview(flat).cast("B"), zlib.crc32
    a = ((off[:-1] - off[0]) // width)[row] + start
    sums = [crc(view[x:y]) for x, y in zip((4 * a).tolist(), (4 * (a + length)).tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, sums, n[row], window, offset))],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = 1024, targets: dict[str | None, float] | None = None, max_queues: int = MAX_QUEUES) -> DataFrame:
    """Pieces of docs(doc_id, text, source): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    targets: the share of each window by source, as long as the source lasts;
    sources without one take their share of the tokens. max_queues: for more
    sources, the limits of fewer windows are computed at once.
    """
    common.bound_batches(docs.sparkSession)
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    names = queue_names(docs)
    coded = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(
        functools.partial(_encode, path=tokenizer_path, end=end_id, names=names), f"part int, doc_id {kind}, queue int, n bigint, before bigint, ids binary"
    )
    coded = common.materialize(coded, "packing-ids")
    sums = coded.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = common.materialize(sums.select("part", "queue", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "packing-bases")
    found = {r[0]: (r[1], r[2]) for r in base.groupBy("queue").agg(F.sum("n"), F.count("*")).collect()}
    if not found:
        return spark.createDataFrame([], f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    totals = np.array([found.get(q, (0, 0))[0] for q in range(len(names))], np.int64)
    asked = np.array([(targets or {}).get(name, np.nan) for name in names], np.float64) * totals.sum()
    schedule = Schedule(totals, np.maximum(np.where(np.isnan(asked), totals, asked), 1e-9), window, max_queues)
    small = sum(rows for _, rows in found.values()) * 48 <= common.BROADCAST_BYTES
    placed = coded.join(F.broadcast(base) if small else base, ["part", "queue"]).select(
        "part", "doc_id", "queue", coded["n"], (F.col("base") + F.col("before")).alias("begin"), "ids"
    )
    return placed.mapInArrow(functools.partial(_pieces, schedule=schedule), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
