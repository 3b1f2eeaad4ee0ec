"""An exact n-gram Jaccard join by T-occurrence search.

A document is its set of distinct five-word shingles (64-bit hashes), or its
whole word sequence if that is shorter. Equal word sequences form one class.
Two classes link when 100 * |intersection| >= 80 * |union|. The steps lose no link:

1. Sample. In hash order, two linking sets share at least `common(n)` of their
   first n - ceil(0.8 n) + common(n) hashes. Only these go into the index. They are
   counted within a slice of the input first, so a frequent shingle or a group of
   copies sends one entry per slice.
2. Prune. A document links to nothing unless enough of its sample occurs
   elsewhere; ordered by document frequency, only the rarest shared hashes that
   must still hold a common one are its signatures.
3. Groups. Documents joined by signatures, directly or over others, form
   candidate groups: every link lies inside one.
4. Search. Each group is searched with DivideSkip, which finds every link that there is: a
   document's inverted lists are divided into short ones, which are merged, and long ones,
   which are probed by binary search for the documents that the short lists leave possible.
   Some documents are searched first; a document that their links have put into the group's
   main part by then need not be, as any other link of it is found from its other end. So a
   large group of near copies takes a few searches. The merge of the short lists counts on
   arrays (sorted runs of document numbers, or a counter for each where they are many)
   instead of a pointer heap with skips; counts and links are the same.
5. A group larger than a block is dealt over several tasks, each of which also gets
   the group's pivots; documents still apart from the group's main part are
   then searched against every block.

Hash collisions: two different classes of N merge with probability about N^2 / 2^65.

Defined results: null, empty and blank texts have n_shingles 0 and are their own
components; repeated rows are one class; an empty table gives an empty result;
other columns are ignored; rows with a null or a repeated doc_id link as others do, and
a null doc_id names a component only if no document of it has another.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainery.llm import common
from grainery.llm.components import components

WORDS, PERCENT = 5, 80
#: The share of a set's size that linking samples have in common; index entries of a task; shingles in a block; pivots of a large group.
SHARE, INDEX_ENTRIES, BLOCK, PIVOTS = 0.15, 1 << 20, 1 << 20, 16
#: Bytes of texts hashed at once, and values of a longer text.
HASHED_BYTES, SEGMENT = 1 << 20, 1 << 20
#: DivideSkip's weight of a merge step against a probe; long lists probed at once; documents of a group that are searched first.
MU, PROBED, SEEDS = 0.01, 32, 4

_BASE, _WORD, _CLASS = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F | 1
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n + 1 powers of an odd base and of its inverse, modulo 2 ^ 64; the longest table is kept."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = 1 << max(12, n.bit_length())
        both = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        for x in both:
            x[0] = 1
            np.cumprod(x, dtype=np.uint64, out=x)
        _POWERS[base] = both
    return _POWERS[base]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int, table: np.ndarray | None = None) -> np.ndarray:
    """A polynomial hash of values[lo:hi] (or table[values[lo:hi]]) for each of many spans in order, a segment at a time."""
    sums = np.zeros(len(lo), np.uint64)
    for begin in range(0, len(values), SEGMENT):
        part = values[begin : begin + SEGMENT]
        part = part if table is None else table[part]
        up, down = _powers(base, len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], dtype=np.uint64, out=total[1:])
        a, b = np.searchsorted(hi, begin, "right"), np.searchsorted(lo, begin + len(part))
        x, y = np.maximum(lo[a:b], begin) - begin, np.minimum(hi[a:b], begin + len(part)) - begin
        found = (total[y] - total[x]) * down[x]
        if a < b and lo[a] < begin:  # a span that began in a segment before
            found[:1] *= np.uint64(pow(base, begin - int(lo[a]), 1 << 64))
        sums[a:b] += found
    return _mix(sums + (hi - lo).astype(np.uint64))


def sets_of(rows: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """The class and the sorted shingle hashes of each row's text, hashed some bytes at a time."""
    found = [shingle_sets(*common.utf8(part.column("text"))) for part in common.slices(rows, most=HASHED_BYTES)]
    return np.concatenate([c for c, _ in found]), [s for _, sets in found for s in sets]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each text (bytes, offsets): its class, and its sorted shingle hashes."""
    n = len(offsets) - 1
    solid = ~_BLANK[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = False, False
    lo, hi = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    words = _spans(data, lo, hi, _BASE, _TABLE[_LOWER])
    at = np.searchsorted(lo, offsets)
    classes = _spans(words, at[:-1], at[1:], _CLASS)
    each = words[: max(0, len(words) - WORDS + 1)].copy()
    for k in range(1, WORDS):
        each = each * np.uint64(_WORD) + words[k : k + len(each)]
    each = _mix(each)
    sets = []
    for i in range(n):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= WORDS:
            sets.append(np.unique(each[a : b - WORDS + 1]))
        else:
            sets.append(classes[i : i + 1] if b > a else classes[:0])
    return classes, sets


def common_share(n: int) -> int:
    return max(1, int(SHARE * n))


def least_overlap(n: int) -> int:
    """The overlap that any set linking to one of size n has with it, at least."""
    return -(-PERCENT * n // 100)


def sample_size(n: int) -> int:
    return n - least_overlap(n) + common_share(n) if n else 0


@common.tidy
def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for rows in common.slices(batch):
            classes, sets = sets_of(rows)
            sizes = [len(s) for s in sets]
            _, first = np.unique(classes, return_index=True)
            new = np.zeros(len(sets), bool)
            new[first] = True
            samples = [s[: sample_size(len(s))].tobytes() if f and len(s) else None for s, f in zip(sets, new.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sets), (part << 32) + number, np.int64)), rows.column("doc_id"), pa.array(classes.view(np.int64)), pa.array(sizes, pa.int64()), pa.array(samples, pa.binary())],
                names=["slice", "doc_id", "class", "n", "sample"],
            )
            number += 1


@common.tidy
def _entries(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Index entries of each slice, in one row per index part."""
    for batch in batches:
        where = batch.column("slice").to_numpy()
        for one in np.unique(where):
            rows = batch.filter(pa.array(where == one))
            data, _ = _joined(rows.column("sample"))
            hashes, counts = np.unique(data, return_counts=True)
            part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
            cut = np.searchsorted(part, np.arange((1 << bits) + 1))
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some.astype(np.int32)), pa.array(np.full(len(some), one, np.int64)),
                    pa.array([hashes[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
                    pa.array([counts[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in some], pa.binary()),
                ],
                names=["part", "slice", "hashes", "counts"],
            )


def _joined(column, dtype=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column (null: none), and each row's number of them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = pc.fill_null(column, b"").cast(pa.large_binary())
    _, offsets, data = arr.buffers()
    if not len(arr) or not data:
        return np.zeros(0, dtype), np.zeros(len(arr), np.int64)
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(dtype), np.diff(off) // np.dtype(dtype).itemsize


@common.trimmed
def _shared(table: pa.Table) -> pa.Table:
    """For each slice, the hashes of an index part that occur more than once, with their frequency."""
    hashes, sizes = _joined(table.column("hashes"))
    counts, _ = _joined(table.column("counts"), np.int32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    kinds, place = np.unique(hashes, return_inverse=True)
    total = np.bincount(place, counts, len(kinds)).astype(np.int64)[place]
    keep = total > 1
    hashes, total, owner = hashes[keep], total[keep], owner[keep]
    cut = np.searchsorted(owner, np.arange(len(sizes) + 1))
    some = np.flatnonzero(np.diff(cut))
    return pa.table(
        {
            "slice": table.column("slice").take(pa.array(some)),
            "hashes": pa.array([hashes[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
            "totals": pa.array([np.minimum(total[cut[i] : cut[i + 1]], 2**31 - 1).astype(np.int32).tobytes() for i in some], pa.binary()),
        }
    )


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


_SIGNED = pa.schema([("hash", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


@common.trimmed
def _signed(samples: pa.Table, found: pa.Table) -> pa.Table:
    """Signatures of a slice's documents: rows (hash, a) for the slice's groups, and edges (a, b) inside it."""
    if not found.num_rows:
        return _SIGNED.empty_table()
    hashes, _ = _joined(found.column("hashes"))
    totals, _ = _joined(found.column("totals"), np.int32)
    hashes, first = np.unique(hashes, return_index=True)
    totals = totals[first]
    data, sizes = _joined(samples.column("sample"))
    place = np.minimum(np.searchsorted(hashes, data), len(hashes) - 1)
    often = np.where(hashes[place] == data, totals[place], 1)
    ends = np.cumsum(sizes)
    nodes, signs = [], []
    for c, n, lo, hi in zip(samples.column("class").to_pylist(), samples.column("n").to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
        if hi == lo:
            continue
        df = often[lo:hi]
        shared = np.flatnonzero(df > 1)
        spare = len(shared) - common_share(least_overlap(n)) + 1
        if spare > 0:
            best = shared[np.lexsort((data[lo:hi][shared], df[shared]))[:spare]]
            nodes.append(c)
            signs.append(data[lo:hi][best])
    if not nodes:
        return _SIGNED.empty_table()
    union, owner = _Union(len(nodes)), np.repeat(np.arange(len(nodes)), [len(s) for s in signs])
    flat = np.concatenate(signs)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i in np.flatnonzero(flat[1:] == flat[:-1]).tolist():
        union.join(int(owner[i]), int(owner[i + 1]))
    root = np.array([union.find(i) for i in range(len(nodes))])
    name = np.array(nodes, np.int64)
    inside = np.flatnonzero(root != np.arange(len(nodes)))
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    none = pa.nulls(len(first), pa.int64())
    out = pa.table({"hash": pa.array(flat[first].view(np.int64)), "a": pa.array(name[root[owner[first]]]), "b": none}, _SIGNED)
    return pa.concat_tables([out, pa.table({"hash": pa.nulls(len(inside), pa.int64()), "a": pa.array(name[inside]), "b": pa.array(name[root[inside]])}, _SIGNED)])


class Lists:
    """Inverted lists over sets: for each hash, the sets that hold it, in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner, flat = owner[order], flat[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        self.keys, self.begin, self.length = flat[first], first, np.diff(np.append(first, len(flat)))
        #: (list, set) as one number, in order: one binary search probes many lists for many sets.
        self.entries = np.repeat(np.arange(len(first)), self.length) * len(sets) + self.owner

    def search(self, query: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """The sets that link to a query set, by DivideSkip; `wanted` says which of some sets are of interest."""
        none = np.zeros(0, np.int64)
        if not len(self.keys) or not len(query):
            return none
        place = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        place = place[self.keys[place] == query]
        need = least_overlap(len(query))
        if len(place) < need:
            return none
        place = place[np.argsort(self.length[place], kind="stable")]
        length = self.length[place]
        long = min(need - 1, int(need / (MU * np.log2(max(2, int(length[-1]))) + 1)))
        n = length[: len(place) - long]
        ends = np.cumsum(n)
        merged = self.owner[np.arange(ends[-1]) + np.repeat(self.begin[place[: len(n)]] - (ends - n), n)]
        if len(merged) * 4 < len(self.sizes):
            left, got = np.unique(merged, return_counts=True)
        else:
            counts = np.bincount(merged, minlength=len(self.sizes))
            left = np.flatnonzero(counts)
            got = counts[left]
        size = self.sizes[left]
        stay = (got >= need - long) & (100 * size >= PERCENT * len(query)) & (100 * len(query) >= PERCENT * size)
        left, got = left[stay], got[stay]
        if wanted is not None and len(left):
            stay = wanted(left)
            left, got = left[stay], got[stay]
        for k in range(len(n), len(place), PROBED):
            if not len(left):
                return none
            asked = (place[k : k + PROBED, None] * len(self.sizes) + left).ravel()
            at = np.minimum(np.searchsorted(self.entries, asked), len(self.entries) - 1)
            got = got + (self.entries[at] == asked).reshape(-1, len(left)).sum(axis=0)
            stay = got >= need - max(0, len(place) - k - PROBED)  # the others can no longer reach the overlap
            left, got = left[stay], got[stay]
        return left[100 * got >= PERCENT * (len(query) + self.sizes[left] - got)]


def link_sets(sets: list[np.ndarray], cut: list[int] | None = None) -> list[int]:
    """For each set, the least set that links connect it to; cut gives the limits of groups between which nothing links."""
    lists, union = Lists(sets), _Union(len(sets))

    def search(i: int) -> None:
        apart = lambda found: np.fromiter((union.find(j) != union.find(i) for j in found.tolist()), bool, len(found))
        for j in lists.search(sets[i], apart).tolist():
            union.join(i, j)

    limits = cut or [0, len(sets)]
    for lo, hi in zip(limits, limits[1:], strict=False):
        seeds = range(lo, hi, (hi - lo) // SEEDS) if hi - lo >= 4 * SEEDS else range(lo, min(lo + 1, hi))
        for i in seeds:
            search(i)
        if hi - lo > 1:
            main = Counter(map(union.find, range(lo, hi))).most_common(1)[0][0]
            for i in range(lo, hi):
                if i not in seeds and union.find(i) != union.find(main):
                    search(i)
    return [union.find(i) for i in range(len(sets))]


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


#: Neighbours below a node of the trees that stand for components, so that no node is the key of very many edges.
BRANCHES = 64


@common.trimmed
def _search_blocks(table: pa.Table) -> pa.Table:
    """Edges that connect what links inside each candidate group of a task's rows connect."""
    table = table.sort_by([("label", "ascending"), ("class", "ascending")])
    labels, classes = table.column("label").to_numpy(), table.column("class").to_numpy()
    data, sizes = _joined(table.column("hashes"))
    ends = np.cumsum(sizes)
    rows = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (classes[1:] != classes[:-1]))) if len(labels) else np.zeros(0, np.int64)
    labels, classes = labels[rows], classes[rows]
    cut = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(rows)]
    root = np.array(link_sets([data[ends[r] - sizes[r] : ends[r]] for r in rows.tolist()], cut), np.int64)
    order = np.argsort(root, kind="stable")
    first = np.searchsorted(root[order], root[order])
    number = np.arange(len(order)) - first
    inner = np.flatnonzero(number)
    a, b = classes[order[inner]], classes[order[first[inner] + (number[inner] - 1) // BRANCHES]]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}, _EDGES)


@common.trimmed
def _search_apart(table: pa.Table) -> pa.Table:
    """Links between the queries and the rows of one block that are in other components, one to each of these."""
    data, sizes = _joined(table.column("hashes"))
    ends = np.cumsum(sizes)
    asks, classes, now = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "class", "now"))
    rows, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
    lists, there, a, b = Lists([data[ends[r] - sizes[r] : ends[r]] for r in rows.tolist()]), now[rows], [], []
    for q in queries.tolist():
        found = lists.search(data[ends[q] - sizes[q] : ends[q]], lambda left, own=now[q]: there[left] != own)
        for j in found[np.unique(there[found], return_index=True)[1]].tolist():
            a.append(int(classes[q])), b.append(int(classes[rows[j]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}, _EDGES)


@common.tidy
def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in common.slices(batch):
            classes, sets = sets_of(rows)
            yield pa.RecordBatch.from_arrays([pa.array(classes.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "n", "hashes"])


def candidate_groups(samples: DataFrame) -> DataFrame:
    """node (a class), label: the candidate groups of classes that signatures join."""
    total = samples.agg(F.sum(F.length("sample") / 8)).first()[0] or 0
    bits = max(3, min(20, int(total / INDEX_ENTRIES).bit_length()))
    own = samples.filter("sample IS NOT NULL")
    entries = own.select("slice", "sample").mapInArrow(functools.partial(_entries, bits=bits), "part int, slice bigint, hashes binary, counts binary")
    shared = entries.groupBy("part").applyInArrow(_shared, "slice bigint, hashes binary, totals binary")
    signed = own.groupBy("slice").cogroup(shared.groupBy("slice")).applyInArrow(_signed, "hash bigint, a bigint, b bigint")
    signed = common.materialize(signed, "jaccard-signatures")
    signs = signed.filter("hash IS NOT NULL").select("hash", "a")
    least = signs.groupBy("hash").agg(F.min("a").alias("b"))
    across = signs.join(least, "hash").filter("a <> b").select("a", "b").distinct()
    out = components(across.union(signed.filter("hash IS NULL").select("a", "b")))
    common.discard(signed)
    return out


def links(docs: DataFrame, samples: DataFrame, kinds: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: edges between classes that connect all that any links connect."""
    groups = candidate_groups(samples)
    wanted = common.materialize(kinds.join(groups, F.col("class") == F.col("node")).select("class", "label", "least"), "jaccard-candidates")
    small = wanted.count() * 24 <= common.BROADCAST_BYTES
    ids = wanted.select("least").distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    found = texts.mapInArrow(_full_sets, "class bigint, n bigint, hashes binary")
    sets = common.materialize(found.join(F.broadcast(wanted) if small else wanted, "class").select("label", "class", "n", "hashes"), "jaccard-sets")
    sums = sets.groupBy("label").agg(F.sum("n").alias("total")).withColumn("blocks", F.ceil(F.col("total") / block).cast("int"))
    sums = common.materialize(sums, "jaccard-groups")
    bins = max(1, int((sums.filter("blocks = 1").agg(F.sum("total")).first()[0] or 0) // block) + 8)
    placed = sets.join(F.broadcast(sums) if small else sums, "label").withColumn("salt", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    alone = placed.filter("blocks = 1").select("label", "class", "hashes", F.pmod(F.xxhash64("label"), F.lit(bins)).alias("block"))
    cut = placed.filter("blocks > 1")
    schema = "a bigint, b bigint"
    edges = alone.groupBy("block").applyInArrow(_search_blocks, schema)
    large = sums.filter("blocks > 1").count()
    if not large:
        out = common.materialize(edges, "jaccard-links")
        common.discard(sets, sums, wanted)
        return out
    # large groups: blocks with common pivots, then whatever is still apart against every block
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("class"), "class"))
    chosen = cut.select("label", "class").distinct().withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).select("class")
    pivots = cut.join(F.broadcast(chosen) if large * PIVOTS * 16 <= common.BROADCAST_BYTES else chosen, "class", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = cut.unionByName(pivots).select("label", "class", "hashes", "salt")
    edges = common.materialize(edges.union(dealt.groupBy("label", "salt").applyInArrow(_search_blocks, schema)), "jaccard-links")
    now = components(edges).select(F.col("node").alias("class"), F.col("label").alias("now"))
    state = common.materialize(cut.join(now, "class", "left").withColumn("now", F.coalesce("now", "class")), "jaccard-state")
    counts = state.select("label", "class", "now").distinct().groupBy("label", "now").agg(F.count("*").alias("size"))
    main = counts.groupBy("label").agg(F.max_by("now", F.struct("size", "now")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("label", "main")
    rest = state.join(main, "label")
    asked = rest.filter("now <> main")
    shares = asked.groupBy("label").agg(F.ceil(F.sum("n") / block).cast("int").alias("shares"))
    one = asked.join(shares, "label").withColumn("share", F.pmod(F.xxhash64("class", F.lit(1)), "shares")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = rest.join(shares, "label").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    columns = ["label", "salt", "share", "class", "now", "hashes"]
    both = one.select(*columns, F.lit(True).alias("asks")).union(every.select(*columns, F.lit(False).alias("asks")))
    more = both.groupBy("label", "salt", "share").applyInArrow(_search_apart, schema)
    out = common.materialize(edges.union(more), "jaccard-links")
    common.discard(sets, sums, wanted, state, edges)
    return out


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of each row of docs(doc_id, text)."""
    common.bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    samples = docs.select("doc_id", "text").mapInArrow(_sampled, f"slice bigint, doc_id {kind}, class bigint, n bigint, sample binary")
    samples = common.materialize(samples, "jaccard-samples")
    # one row for each class: copies are counted before anything is joined or shuffled by class
    kinds = common.materialize(samples.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "jaccard-classes")
    edges = links(docs, samples, kinds, block)
    labels = components(edges)
    common.discard(edges)
    named = kinds.join(labels, F.col("class") == F.col("node"), "left").select("class", "least", "rows", F.coalesce("label", "class").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("head"), F.sum("rows").alias("size")).filter("size > 1").select("component", "head")
    heads = common.materialize(named.join(heads, "component").select(F.col("class").alias("named"), "head"), "jaccard-heads")
    common.discard(kinds)
    small = heads.count() * 16 <= common.BROADCAST_BYTES
    out = samples.join(F.broadcast(heads) if small else heads, (F.col("class") == F.col("named")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("head", "doc_id").alias("component_id"), F.col("class").alias("class_id"))


#: DuckDB SQL for the first three columns of near_duplicates(documents).
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 80 * (nx.n + ny.n - o)),
both_ AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, both_.y FROM r JOIN both_ ON both_.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
