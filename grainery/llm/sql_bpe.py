"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

A text is cut into words by the ranks' pattern. The distinct words of a slice
become rows (word, position, token), bytes at first. A recursive query joins
neighbouring positions with the merge table and contracts each word's leftmost
pair of least rank, until no pair is left. A word longer than a chunk goes through the
same query in overlapping chunks, which are spliced where both hold a boundary and
the same token after it (see `splicing` for the proof), so that the rounds of the
recursion are bounded by a chunk's length. An ordered aggregation over (text, position,
token) rows joined with the vocabulary decodes the ids again.

Defined results: a null or empty text has no ids and decodes to no bytes;
repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from grainery.llm import common, splicing

#: Words whose ids a Python worker remembers, bytes of the words in one recursive query, and of a chunk and its overlap in a longer word.
MEMORY_WORDS, QUERY_BYTES, CHUNK, OVERLAP = 400_000, 1 << 17, 64, 32
#: Words that are looked up at once, and ids that are decoded at once.
WORDS, DECODED = 1 << 18, 1 << 18

_MERGE = """
WITH RECURSIVE step USING KEY (word) AS (
  SELECT word, list(token ORDER BY place) AS tokens FROM rows GROUP BY word
  UNION
  (WITH pairs AS (SELECT word, unnest(tokens[:-2]) AS a, unnest(tokens[2:]) AS b, unnest(range(1, len(tokens))) AS place FROM step WHERE len(tokens) > 1),
   best AS (SELECT word, min(m.rank::BIGINT * 1099511627776 + place) AS least FROM pairs JOIN merges m ON m.pair = a::BIGINT * 65536 + b GROUP BY word)
   SELECT word, list_concat(list_concat(tokens[1:(least % 1099511627776) - 1], [(least // 1099511627776)::INT]), tokens[(least % 1099511627776) + 2:])
   FROM best JOIN step USING (word))
)
SELECT word, tokens FROM step ORDER BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Coder:
    """A DuckDB session that holds the merge table and the vocabulary."""

    def __init__(self, path: str, pattern: str, entries: int = MEMORY_WORDS):
        import duckdb
        import regex

        # the ranks' library reads \s as the White_Space property
        self.pattern = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.ranks, self.entries = read_ranks(path), entries
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        a, b, r = (np.array(x, np.int64) for x in (left, right, rank))
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, i in self.ranks.items():
            self.sizes[i] = len(token)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self._load("merges", pa.table({"pair": a * 65536 + b, "rank": r.astype(np.int32)}))
        self._load("vocabulary", pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())}))
        self.clear()

    def _load(self, name: str, data: pa.Table) -> None:
        self.db.register("loading", data)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM loading").fetchall()
        self.db.unregister("loading")

    def _rows(self, query: str, **tables: pa.Table) -> pa.Table:
        for name, data in tables.items():
            self.db.register(name, data)
        out = self.db.sql(query).to_arrow_table()
        for name in tables:
            self.db.unregister(name)
        return out

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.slots = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _halve(self) -> None:
        """Forget the words that were learned last: frequent ones are met early."""
        cut = self.slots // 2
        self.known = {w: s for w, s in self.known.items() if s < cut}
        self.used, self.slots = int(self.start[cut]), cut

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Put the ids of words into new slots."""
        first, total = self.slots, len(ids)
        while self.used + total > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while first + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length))
        self.store[self.used : self.used + total] = ids
        self.start[first : first + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + len(lengths)] = lengths
        self.used, self.slots = self.used + total, first + len(lengths)
        return np.arange(first, self.slots)

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words or chunks, and their number for each; some words at a time."""
        ids, counts, lo = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        sizes = np.cumsum([0, *map(len, words)])
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + QUERY_BYTES, "right")) - 1)
            lengths, data = np.diff(sizes[lo : hi + 1]), np.frombuffer(b"".join(words[lo:hi]), np.uint8)
            place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out = self._rows(_MERGE, rows=pa.table({"word": np.repeat(np.arange(hi - lo), lengths), "place": place, "token": self.bytes[data]}))
            tokens = out.column("tokens").combine_chunks()
            ids.append(tokens.flatten().to_numpy().astype(np.uint32))
            counts.append(pc.list_value_length(tokens).to_numpy().astype(np.int64))
            lo = hi
        return np.concatenate(ids), np.concatenate(counts)

    def _long(self, word: bytes) -> np.ndarray:
        """The ids of a word of any length, from overlapping chunks."""

        def encode(places: list[tuple[int, int]]) -> list[splicing.Piece]:
            ids, counts = self._merge([word[lo:hi] for lo, hi in places])
            found = np.split(ids, np.cumsum(counts)[:-1])
            ends = [lo + np.cumsum(self.sizes[x]) for (lo, _), x in zip(places, found, strict=True)]
            return [splicing.Piece(lo, hi, x, e - self.sizes[x], e) for (lo, hi), x, e in zip(places, found, ends, strict=True)]

        try:
            return np.concatenate(list(splicing.joined(len(word), CHUNK, OVERLAP, 0, encode, several=QUERY_BYTES // CHUNK)))
        except splicing.Unstable:
            return self._merge([word])[0]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, tuple[int, int]]:
        """Slots of new words; those of words longer than a chunk come last and are to be forgotten from the mark on."""
        raw = [w.encode() for w in words]
        rank = np.fromiter(map(self.ranks.get, raw, repeat(-1)), np.int64, len(raw))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        whole, long = np.flatnonzero(rank >= 0), np.flatnonzero((rank < 0) & (size > CHUNK + OVERLAP))
        short, slots = np.flatnonzero((rank < 0) & (size <= CHUNK + OVERLAP)), np.empty(len(words), np.int64)
        slots[whole] = self._add(rank[whole].astype(np.uint32), np.ones(len(whole), np.int64))
        slots[short] = self._add(*self._merge([raw[i] for i in short.tolist()]))
        for some in (whole, short):
            self.known.update(zip([words[i] for i in some.tolist()], slots[some].tolist(), strict=True))
        mark = (self.used, self.slots)
        for i in long.tolist():
            ids = self._long(raw[i])
            slots[i] = self._add(ids, np.array([len(ids)]))[0]
        return slots, mark

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and each text's place among them (rows + 1), so many words at a time."""
        ids, sizes = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        words, owners = [], []
        for i, text in enumerate(texts):
            found = iter(self.pattern.findall(text)) if len(text) <= WORDS else (m[0] for m in self.pattern.finditer(text))
            while some := list(itertools.islice(found, WORDS - len(words))):
                words += some
                owners.append((i, len(some)))
                if len(words) >= WORDS:
                    ids.append(self._ids(words, owners, sizes))
                    words, owners = [], []
        ids.append(self._ids(words, owners, sizes))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)])

    def _ids(self, words: list[str], owners: list[tuple[int, int]], sizes: np.ndarray) -> np.ndarray:
        """The ids of words of texts (number of the text, number of words); adds them up in sizes."""
        if not words:
            return np.zeros(0, np.uint32)
        if len(self.known) > self.entries:
            self._halve()
        coded = pa.array(words, pa.string()).dictionary_encode()
        kinds = common.strings(coded.dictionary)
        slots = np.fromiter(map(self.known.get, kinds, repeat(-1)), np.int64, len(kinds))
        new = np.flatnonzero(slots < 0)
        slots[new], mark = self._learn([kinds[i] for i in new.tolist()])
        each = slots[coded.indices.to_numpy()]
        n = self.length[each]
        ends = np.cumsum(n)
        at = np.repeat(self.start[each] - (ends - n), n)
        at += np.arange(len(at))
        ids = self.store[at]
        self.used, self.slots = mark
        text, count = np.array(owners, np.int64).T
        np.add.at(sizes, text, np.add.reduceat(n, np.cumsum(count) - count))
        return ids

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids, so many at a time: parts of a longer text are joined in order."""
        owner, found = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), [[] for _ in offsets[1:]]
        for lo in range(0, len(ids), DECODED):
            some, texts = ids[lo : lo + DECODED].astype(np.int32), owner[lo : lo + DECODED]
            rows = pa.table({"text": texts, "place": np.arange(len(some)), "token": some})
            out = self._rows("SELECT text, list(bytes ORDER BY place) AS parts FROM rows JOIN vocabulary USING (token) GROUP BY text", rows=rows)
            parts = out.column("parts").combine_chunks()
            cut = parts.offsets.to_numpy()
            data, off = _binary(parts.values)
            for k, text in enumerate(out.column("text").to_pylist()):
                found[text].append(data[off[cut[k]] : off[cut[k + 1]]])
        return [b"".join(parts) for parts in found]


def _binary(arr: pa.Array) -> tuple[bytes, np.ndarray]:
    arr = arr.cast(pa.large_binary())
    _, offsets, data = arr.buffers()
    return data.to_pybytes() if data else b"", np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]


@functools.cache
def coder(path: str, pattern: str) -> Coder:
    """One session per Python worker; its memory serves all tasks."""
    return Coder(path, pattern)


@common.tidy
def _round_trip(batches: Iterator[pa.RecordBatch], path: str, pattern: str, ids_too: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, most=1 << 20):
            ids, at = coder(path, pattern).encode(common.texts_of(part))
            back = coder(path, pattern).decode(ids, at)
            raw = memoryview(ids.astype("<u4")).cast("B")
            columns = {
                "doc_id": part.column("doc_id"),
                "n_tokens": pa.array(np.diff(at), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
            }
            if ids_too:
                columns |= {"ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))), "decoded": pa.array(back, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, ids_too: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs(doc_id, text).

    ids_too adds the ids and the decoded bytes themselves.
    """
    common.bound_batches(docs.sparkSession)
    work = functools.partial(_round_trip, path=ranks_path, pattern=pattern, ids_too=ids_too)
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>, decoded binary" if ids_too else ""
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
