"""Token counts by overlap resynchronisation.

Texts up to a chunk are counted whole. A longer text is encoded in
overlapping chunks; the bytes that each id stands for give the tokens' offsets. Two neighbours are spliced at a boundary that
both encodings hold, with the same token after it, beyond the reach of either chunk's
edge (see `splicing` for the proof). Inside a chunk's first match the pre-tokenizer may
be out of step; it is in step again at the end of that run of letters, digits, other characters or
white space, and both chunks see the same end. Not used are places inside a character or white space and those
soon after an apostrophe, where a match may end inside a run.
A chunk starts at a token boundary of the one before it. Where the overlap
holds no such place it is doubled, and so is the left chunk, so no text takes more than
a few times its own encoding.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
are counted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from grainery.llm import common, splicing, tokenizing

#: Bytes of a chunk, of the first overlap, and kept off a chunk's edges:
#: more than an added token's length and the pattern's look-ahead.
CHUNK, OVERLAP, EDGE = 16_384, 256, 32


def _stable(raw: bytes, place: int) -> bool:
    """Whether a common token boundary at a place is proven to be one of the whole text."""
    if raw[place] & 0xC0 == 0x80:
        return False
    now, before = raw[place : place + 4].decode(errors="ignore")[:1], raw[max(0, place - 4) : place].decode(errors="ignore")[-1:]
    return not (now.isspace() and before.isspace()) and b"'" not in raw[max(0, place - 12) : place]


def count_long(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP, edge: int = EDGE, encode: Callable[[str], np.ndarray] | None = None, sizes: np.ndarray | None = None) -> int:
    """The number of ids of a text, chunk by chunk; encode and sizes stand for the tokenizer's own encoding and its ids' bytes."""
    raw = text.encode()
    encode = encode or (lambda part: np.array(tokenizer.encode(part, add_special_tokens=False).ids, np.uint32))
    sizes = tokenizing.token_bytes(tokenizer) if sizes is None else sizes

    def pieces(places: list[tuple[int, int]]) -> Iterator[splicing.Piece]:
        for lo, hi in places:
            while lo > 0 and raw[lo] & 0xC0 == 0x80:
                lo -= 1
            while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                hi += 1
            ids = encode(raw[lo:hi].decode())
            ends = lo + np.cumsum(sizes[ids])
            if hi > lo and (not len(ids) or ends[-1] != hi):
                raise splicing.Unstable
            yield splicing.Piece(lo, hi, ids, ends - sizes[ids], ends)

    try:
        return sum(len(ids) for ids in splicing.joined(len(raw), chunk, overlap, edge, lambda places: list(pieces(places)), functools.partial(_stable, raw)))
    except splicing.Unstable:
        return len(encode(text))


@common.tidy
def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int, chunk: int) -> Iterator[pa.RecordBatch]:
    enc = tokenizing.encoder(path)
    for batch in batches:
        for part in common.slices(batch):
            texts = pc.fill_null(part.column("text"), "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            long = pa.array(sizes > chunk)
            counts = enc.lengths(pc.if_else(long, "", texts) if enc.safe else texts)
            if enc.safe:
                for i in np.flatnonzero(long.to_numpy(zero_copy_only=False)).tolist():
                    counts[i] = count_long(texts[i].as_py(), enc.tokenizer, chunk, encode=lambda part: enc.encode(pa.array([part]))[0], sizes=enc.sizes)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text).

    A tokenizer whose description does not support the splice proof is
    applied to each text whole.
    """
    common.bound_batches(docs.sparkSession)
    work = functools.partial(_count, path=tokenizer_path, limit=limit, chunk=chunk)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
