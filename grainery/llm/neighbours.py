"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, where a larger cosine is a smaller distance.
Each of several tables hashes a vector to the cells of random Gaussian
projections. A query visits, in every table, its own cell and then the
perturbed cells in the order of their estimated success: the less the sum of
squared distances to the cell walls that must be crossed, the earlier. The
candidates of all tables are ranked on the original vectors in double precision,
block by block, and each block passes on its best only; these are merged.

The number of projections is fitted to the table: the k-th cosine of FITTED queries
is found against all rows, and the most projections are taken with which probing misses at most
MISSED of the rows at the cosine that nearly all of them reach. The more rows there are, or the better
they cluster, the nearer is the k-th neighbour, the more and smaller are the cells, and the
smaller is the share of rows that a query meets.

Equal vectors are hashed once: a row stands for all of them and keeps its k + 1
least ids, as no other can be among k nearest with ties to the smaller id.
Every other vector is in every table. Cells are dealt to blocks by a hash; if a cell
holds more rows than a block may, all cells are salted by row, and queries go to every
salt. A query goes to a block only if it probes a cell of it.

The probed cells may miss a row the likelier, the smaller its cosine. A query that
met fewer than k rows, or whose k-th best is below the cosine at which more than
MISSED of the rows are missed, is scored against all rows, block by block.

Vectors that are null, empty, zero or have null or non-finite components take
no part; only vectors of the same length are compared.
Defined results: fewer candidates than k give fewer rows; repeated ids are rows
of their own and never their own neighbours; components of any size give finite
scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainery.llm import common

#: Tables, cell width for unit vectors, cells probed in each table, rows in a block, seed.
TABLES, WIDTH, PROBES, BLOCK, SEED = 8, 1.5, 100, 20_000, 11
#: The share of rows at a cosine that probing may miss.
MISSED = 0.08
#: Projections that may be fitted (with fewer, probing would meet nearly all rows), queries that they are fitted to, and the place of the cosine used among the queries' k-th ones, in ascending order.
PROJECTIONS, FITTED, PLACE = range(6, 17), 64, 1
#: The cheapest moves out of a cell whose combinations are probed; two moves of one projection are no combination.
MOVES = 10


class Family:
    """The hash functions for vectors of one length."""

    def __init__(self, size: int, tables: int, projections: int, width: float, seed: int):
        random = np.random.default_rng([seed, size])
        self.width = width
        self.planes = random.normal(size=(tables, size, projections))
        self.shift = random.uniform(0, width, size=(tables, projections))
        self.mix = random.integers(1, 1 << 62, size=(tables, projections), dtype=np.int64) | 1

    def place(self, table: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell numbers and the places inside the cells, from 0 to 1."""
        at = (unit @ self.planes[table] + self.shift[table]) / self.width
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    def key(self, table: int, cells: np.ndarray) -> np.ndarray:
        return (cells * self.mix[table]).sum(axis=-1)

    def probes(self, table: int, unit: np.ndarray, n: int) -> np.ndarray:
        """For each query, the keys of its n most promising cells, best first."""
        cell, inside = self.place(table, unit)
        return self.key(table, cell)[:, None] + (moves(inside, n) * self.mix[table]).sum(axis=-1)


@functools.cache
def _subsets(n: int) -> np.ndarray:
    """All subsets of n things, as rows of zeros and ones; the empty one comes first."""
    return (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(np.float64)


def moves(inside: np.ndarray, n: int) -> np.ndarray:
    """For places inside cells (rows), the n most promising ways to leave them by a step in some projections, best first: staying, then by cost."""
    size = inside.shape[1]
    cost = np.concatenate([inside**2, (1 - inside) ** 2], axis=1)  # a step down, a step up
    cheap = np.argsort(cost, axis=1, kind="stable")[:, : min(MOVES, 2 * size)]
    subsets = _subsets(cheap.shape[1])
    price = np.take_along_axis(cost, cheap, 1) @ subsets.T
    for i in range(cheap.shape[1]):
        for j in range(i):
            rows = np.flatnonzero(cheap[:, i] % size == cheap[:, j] % size)
            price[np.ix_(rows, np.flatnonzero(subsets[:, i] * subsets[:, j]))] = np.inf
    n = min(n, int(np.isfinite(price).sum(axis=1).min()))
    best = np.argpartition(price, n - 1, axis=1)[:, :n]
    best = np.take_along_axis(best, np.argsort(np.take_along_axis(price, best, 1), axis=1, kind="stable"), 1)
    out, row = np.zeros((*best.shape, size), np.int64), np.arange(len(inside))[:, None]
    for i in range(cheap.shape[1]):
        step = np.where(cheap[:, i] < size, -1, 1)[:, None]
        out[row, np.arange(n)[None, :], cheap[:, i][:, None] % size] += (subsets[best, i] * step).astype(np.int64)
    return out


@functools.cache
def reach(tables: int, projections: int, width: float, probes: int) -> float:
    """The least cosine, in hundredths, from which on at most MISSED of the rows are in no probed cell, by simulation."""
    random, shape = np.random.default_rng(SEED), (600 * tables, projections)
    own, other, shift = random.normal(size=shape), random.normal(size=shape), random.uniform(0, width, size=shape)
    at = (own + shift) / width
    cell = np.floor(at)
    visited = moves(at - cell, probes).astype(np.int8)

    def missed(cosine: float) -> float:
        move = np.floor((cosine * own + np.sqrt(1 - cosine**2) * other + shift) / width) - cell
        met = (visited == move[:, None, :]).all(axis=-1).any(axis=-1)
        return 1 - float(met.reshape(-1, tables).any(axis=1).mean())

    lo, hi = -100, 100
    while lo < hi:
        middle = (lo + hi) // 2
        lo, hi = (lo, middle) if missed(middle / 100) <= MISSED else (middle + 1, hi)
    return lo / 100


def fitted(cosine: float, tables: int, width: float, probes: int) -> int:
    """The most projections with which probing reaches a cosine: the more there are, the less far it reaches."""
    few, many = PROJECTIONS[0], PROJECTIONS[-1]
    while few < many:
        middle = (few + many + 1) // 2
        few, many = (middle, many) if reach(tables, middle, width, probes) <= cosine else (few, middle - 1)
    return few


@functools.cache
def _family(*parameters) -> Family:
    return Family(*parameters)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, which changes no cosine and lets no square overflow or vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = _scaled(vectors)
    return scaled / np.sqrt((scaled * scaled).sum(axis=-1, keepdims=True))


@common.tidy
def _nearness(batches: Iterator[pa.RecordBatch], asked: list[np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """The k largest cosines of some queries with a task's rows."""
    best: list[list[float]] = [[] for _ in asked]
    units = [_unit(a) for a in asked]
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            rows = batch.filter(pa.array(sizes == size))
            unit, copies = _unit(_matrix(rows.column("vector"), size)), np.minimum(pc.list_value_length(rows.column("ids")).to_numpy(), k)
            for i, u in enumerate(units):
                if len(u) == size:
                    score = unit @ u
                    top = np.argsort(-score, kind="stable")[:k]
                    best[i] = sorted([*best[i], *np.repeat(score[top], copies[top]).tolist()], reverse=True)[:k]
    flat = [(i, s) for i, found in enumerate(best) for s in found]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in flat], pa.int32()), pa.array([s for _, s in flat], pa.float64())], names=["query", "score"])


def _usual_cosine(kinds: DataFrame, queries: DataFrame, k: int) -> float:
    """The cosine that the k-th neighbour of nearly every query reaches, from FITTED queries against all rows."""
    asked = [np.array(r.vector, np.float64) for r in queries.orderBy(F.xxhash64("ids"), "ids").limit(FITTED).collect()]
    found = kinds.mapInArrow(functools.partial(_nearness, asked=asked, k=k + 1), "query int, score double")  # a query meets itself
    least = found.groupBy("query").agg(F.sort_array(F.collect_list("score"), False).alias("best")).select(F.get("best", F.lit(k)).alias("kth")).filter("kth IS NOT NULL")
    cosines = sorted(r.kth for r in least.collect())
    return cosines[min(PLACE, len(cosines) - 1)] if cosines else 1.0


@common.tidy
def _hashed(batches: Iterator[pa.RecordBatch], parameters: tuple, probes: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """For each table: rows get their cell, queries (probes > 0) one row per block that they visit."""
    tables = parameters[0]
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            rows = batch.filter(pa.array(sizes == size))
            family, unit = _family(size, *parameters), _unit(_matrix(rows.column("vector"), size))
            for lo in range(0, len(unit), 512):
                some, part = unit[lo : lo + 512], rows.slice(lo, 512)
                for table in range(tables):
                    keys = family.probes(table, some, probes) if probes else family.key(table, family.place(table, some)[0])[:, None]
                    block = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
                    row = np.repeat(np.arange(len(some)), keys.shape[1])
                    order = np.lexsort((np.tile(np.arange(keys.shape[1]), len(some)), block.ravel(), row))
                    row, flat, where = row[order], keys.ravel()[order], block.ravel()[order]
                    cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (where[1:] != where[:-1])))
                    cells = pa.ListArray.from_arrays(pa.array(np.append(cut, len(flat)), pa.int32()), pa.array(flat))
                    out = part.take(pa.array(row[cut]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cut), table, np.int32)), pa.array(where[cut].astype(np.int32)), out.column("size"), cells, out.column("ids"), out.column("vector")],
                        names=["table", "block", "size", "cells", "ids", "vector"],
                    )


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision; each depends on its two vectors alone."""
    query, vectors = _scaled(query), _scaled(vectors)
    dots = (vectors * query).sum(axis=1)
    return dots / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


@common.trimmed
def _best(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The best of a block for each query in it."""
    if not rows.num_rows or not queries.num_rows:
        return _FOUND.empty_table()
    size = rows.column("size")[0].as_py()
    vectors, asked = _matrix(rows.column("vector"), size), _matrix(queries.column("vector"), size)
    unit, near = _unit(vectors), _unit(asked)
    cells = np.asarray(rows.column("cells").combine_chunks().flatten())
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    ids = rows.column("ids").to_pylist()
    probes, own = queries.column("cells").to_pylist(), queries.column("ids").to_pylist()
    out = [[], [], []]
    for q in range(len(asked)):
        visit = np.array(probes[q])  # in order of success
        lo, n = np.searchsorted(cells, visit, "left"), np.searchsorted(cells, visit, "right")
        n -= lo
        ends = np.cumsum(n)
        found = order[np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)]
        if len(found):
            _add(out, own[q], found, unit[found] @ near[q], asked[q], vectors, ids, k)
    return _table(out)


def _add(out: list[list], own: list[int], found: np.ndarray, rough: np.ndarray, query: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int) -> None:
    """Add the k best of the found rows for a query's ids; those that may be among them by a rough score are scored exactly."""
    if len(found) > k + 1:
        found = found[rough >= np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] - 1e-9]
    score = cosines(query, vectors[found])
    for mine in own:
        best = sorted((-s, i) for r, s in zip(found.tolist(), score.tolist(), strict=True) for i in ids[r] if i != mine)[:k]
        out[0] += [mine] * len(best)
        out[1] += [i for _, i in best]
        out[2] += [-s for s, _ in best]


def _table(out: list[list]) -> pa.Table:
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], schema=_FOUND)


@common.trimmed
def _best_of_all(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The best of all rows of a block for each query."""
    if not rows.num_rows or not queries.num_rows:
        return _FOUND.empty_table()
    size = rows.column("size")[0].as_py()
    vectors, asked = _matrix(rows.column("vector"), size), _matrix(queries.column("vector"), size)
    ids, out, every = rows.column("ids").to_pylist(), [[], [], []], np.arange(len(vectors))
    unit, near = _unit(vectors), _unit(asked)
    for query, direction, own in zip(asked, near, queries.column("ids").to_pylist(), strict=True):
        _add(out, own, every, unit @ direction, query, vectors, ids, k)
    return _table(out)


def _all_rows(kinds: DataFrame, queries: DataFrame, n: int, k: int, block: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each block of rows for some queries, without hashing."""
    blocks, groups = max(1, -(-n // block)), max(1, -(-queries.count() // block))
    dealt = lambda column, parts: F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = kinds.withColumn("block", dealt("vector", blocks)).withColumn("group", every(groups))
    asked = queries.withColumn("group", dealt("ids", groups)).withColumn("block", every(blocks))
    keys = ["block", "group", "size"]
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(functools.partial(_best_of_all, k=k), "query_id bigint, vec_id bigint, score double")


def _kind(vectors: DataFrame) -> str:
    return "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"


def usable(vectors: DataFrame) -> DataFrame:
    """id, vector of the rows of (vec_id, embedding) that take part; vectors of single precision stay so."""
    bad = "x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast(f"array<{_kind(vectors)}>").alias("vector"))
    return rows.filter(f"id IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, {bad}) AND exists(vector, x -> x <> 0)")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, tables: int = TABLES, projections: int | None = None, width: float = WIDTH, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `every`; projections are fitted if none are given."""
    common.bound_batches(vectors.sparkSession)
    rows = usable(vectors).withColumn("print", F.xxhash64("vector"))
    # one row per distinct vector with its least k + 1 ids, and apart from them its queries
    rank = F.row_number().over(Window.partitionBy("print", "vector").orderBy("id"))
    least = rows.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    kinds = least.groupBy("print", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    kinds = common.materialize(kinds.select(F.size("vector").alias("size"), "ids", "vector"), "ann-vectors")
    queries = rows.filter(F.col("id") % every == 0).select(F.size("vector").alias("size"), F.array("id").alias("ids"), "vector")
    n = kinds.count()
    projections = projections or fitted(_usual_cosine(kinds, queries, k), tables, width, probes)
    parameters, blocks = (tables, projections, width, SEED), max(1, -(-n // block))
    schema = f"table int, block int, size int, cells array<bigint>, ids array<bigint>, vector array<{_kind(vectors)}>"
    index = common.materialize(kinds.mapInArrow(functools.partial(_hashed, parameters=parameters, probes=0, blocks=blocks), schema), "ann-index")
    fullest = index.groupBy("table", "block").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-fullest // block))
    index = index.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    asked = queries.mapInArrow(functools.partial(_hashed, parameters=parameters, probes=probes, blocks=blocks), schema)
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = ["table", "block", "salt", "size"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(functools.partial(_best, k=k), "query_id bigint, vec_id bigint, score double")
    found = common.materialize(_ranked(found, k), "ann-found")
    sure = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter((F.col("n") >= k) & (F.col("least") >= reach(tables, projections, width, probes)))
    unsure = common.materialize(queries.join(sure.select("query_id"), F.element_at("ids", 1) == F.col("query_id"), "left_anti"), "ann-unsure")
    if unsure.isEmpty():
        return found
    return _ranked(found.select("query_id", "vec_id", "score").union(_all_rows(kinds, unsure, n, k, block)), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The true answer, by scoring all pairs on the driver; for small tables and tests."""
    data = usable(vectors).orderBy("id").toArrow()
    if not data.num_rows:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    ids, lists, out = data.column("id").to_pylist(), data.column("vector").to_pylist(), []
    for i, v in zip(ids, lists, strict=True):
        if i % every == 0:
            others = [(j, np.array(w)) for j, w in zip(ids, lists, strict=True) if j != i and len(w) == len(v)]
            if others:
                score = cosines(np.array(v), np.stack([w for _, w in others]))
                best = sorted((-s, j) for s, (j, _) in zip(score.tolist(), others, strict=True))[:k]
                out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return vectors.sparkSession.createDataFrame(out, "query_id bigint, rank int, vec_id bigint, score double")
