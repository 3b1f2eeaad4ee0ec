"""Encoding of whole texts by a byte-level BPE tokenizer file, shared by several operators.

In the pre-tokenizer's pattern no match holds a non-space followed by a space,
so a token boundary lies before every space that follows a non-space,
whatever the context. A text is cut there, each distinct piece is encoded once
by the tokenizers library, and the pieces' ids are joined: the result equals
the encoding of the whole text. Texts in which a space follows other white
space are encoded whole.
"""

from __future__ import annotations

import functools
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from grainery.llm import common

#: White space of any kind before a space: there the cut rule does not hold.
WIDE_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "

#: Distinct pieces that a Python worker remembers, and the longest remembered, in code points.
MEMORY_ENTRIES, MEMORY_LENGTH = 500_000, 64


@functools.cache
def load(path: str):
    """The tokenizer of a file, once per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cuts_at_spaces(tokenizer) -> bool:
    """Whether a tokenizer's own description allows the cut rule above and the splicing of byte pair encodings."""
    import json

    spec = json.loads(tokenizer.to_str())
    pre = spec.get("pre_tokenizer") or {}
    added, model = spec.get("added_tokens") or [], spec["model"]
    return (
        model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback")
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and spec.get("normalizer") is None
        and spec.get("post_processor") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex") is True
        and pre.get("add_prefix_space") is False
        and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    )


def token_bytes(tokenizer) -> np.ndarray:
    """The number of bytes that each id stands for, in a byte-level vocabulary."""
    import json

    sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        sizes[i] = len(token)  # one character of the byte alphabet per byte
    for t in json.loads(tokenizer.to_str()).get("added_tokens") or []:
        sizes[t["id"]] = len(t["content"].encode())
    return sizes


class PieceEncoder:
    """Encodes string arrays with a bounded memory of pieces.

    Pieces with a space before them (`tails`) are known by what follows the
    space. New ones are encoded some dozens at a time as one text, which the cut
    rule allows, and told apart by the bytes that their ids stand for.
    """

    JOINED, GROUP = 64, 256

    def __init__(self, path: str, entries: int = MEMORY_ENTRIES):
        self.tokenizer, self.entries = load(path), entries
        self.safe = cuts_at_spaces(self.tokenizer)
        self.sizes = token_bytes(self.tokenizer) if self.safe else None
        self.clear()

    def clear(self) -> None:
        self.tails: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.slots = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _halve(self) -> None:
        """Forget the pieces that were learned last: frequent ones are met early, so the first half is the useful one."""
        cut = self.slots // 2
        self.tails, self.heads = ({p: s for p, s in known.items() if s < cut} for known in (self.tails, self.heads))
        self.used, self.slots = int(self.start[cut]), cut

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces and their number for each, some hundred texts at a time: the library's results are large."""
        ids, lengths = [], []
        for i in range(0, len(pieces), self.GROUP):
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(pieces[i : i + self.GROUP], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids += found
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate([*lengths, np.zeros(0, np.int64)])

    def _joined_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that start with a space and end with none."""
        k = self.JOINED
        ids, _ = self._ids(["".join(pieces[i : i + k]) for i in range(0, len(pieces), k)])
        ends = np.cumsum(pc.binary_length(pa.array(pieces)).to_numpy(zero_copy_only=False).astype(np.int64))
        reached = np.cumsum(self.sizes[ids])
        at = np.searchsorted(reached, ends)
        if len(reached) and at[-1] < len(reached) and (reached[at] == ends).all():
            return ids, np.diff(at + 1, prepend=0)
        return self._ids(pieces)

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Put ids into new slots; the first slot."""
        first, total = self.slots, len(ids)
        while self.used + total > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while first + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length))
        self.store[self.used : self.used + total] = ids
        self.start[first : first + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + len(lengths)] = lengths
        self.used, self.slots = self.used + total, first + len(lengths)
        return first

    def _learn(self, new: list[str], known: dict[str, int], lead: str) -> np.ndarray:
        """Slots for new pieces, all different."""
        odd = [k for k, p in enumerate(new) if not p or p[-1].isspace()] if lead else range(len(new))
        slots = np.empty(len(new), np.int64)
        if len(odd) < len(new):
            even = np.ones(len(new), bool)
            even[odd] = False
            joint = [p for p, e in zip(new, even.tolist(), strict=True) if e] if odd else new
            first = self._add(*self._joined_ids([lead + p for p in joint]))
            slots[even] = np.arange(first, first + len(joint))
            known.update(zip(joint, range(first, first + len(joint)), strict=True))
        if odd:
            single = [new[k] for k in odd]
            first = self._add(*self._ids([lead + p for p in single]))
            slots[odd] = np.arange(first, first + len(single))
            known.update(zip(single, range(first, first + len(single)), strict=True))
        return slots

    def _slots(self, pieces: list[str], known: dict[str, int], lead: str) -> tuple[np.ndarray, list[int]]:
        """Slots of different pieces up to MEMORY_LENGTH, and the places of longer ones."""
        slots = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        lost = np.flatnonzero(slots < 0)
        new = [pieces[i] for i in lost.tolist()]
        long = np.fromiter(map(len, new), np.int64, len(new)) > MEMORY_LENGTH
        if long.any():
            new = [p for p in new if len(p) <= MEMORY_LENGTH]
        if new:
            slots[lost[~long]] = self._learn(new, known, lead)
        return slots, lost[long].tolist()

    def _plan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
        if len(self.tails) + len(self.heads) > self.entries:
            self._halve()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, WIDE_SPACE) if self.safe else pa.array([True] * len(texts))
        slow = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        split = pc.split_pattern(pc.if_else(whole, "", texts) if slow else texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        flat, offsets = split.flatten(), offsets - offsets[0]
        begin = offsets[:-1]
        coded = flat.dictionary_encode()
        tails, heads = common.strings(coded.dictionary), common.strings(flat.take(pa.array(begin)))
        for i in slow:
            heads[i] = texts[i].as_py()
        tail_slots, long_tails = self._slots(tails, self.tails, " ")
        heads_coded = pa.array(heads, pa.string()).dictionary_encode()
        heads = common.strings(heads_coded.dictionary)
        head_slots, long_heads = self._slots(heads, self.heads, "")
        mark = (self.used, self.slots)  # what comes after is forgotten again
        for slots, pieces, places, lead in ((tail_slots, tails, long_tails, " "), (head_slots, heads, long_heads, "")):
            if places:
                first = self._add(*self._ids([lead + pieces[i] for i in places]))
                slots[places] = np.arange(first, first + len(places))
        each = tail_slots[coded.indices.to_numpy()]
        each[begin] = head_slots[heads_coded.indices.to_numpy()]
        return each, offsets, mark

    def _forget(self, mark: tuple[int, int]) -> None:
        self.used, self.slots = mark

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        if not len(texts):
            return np.zeros(0, np.int64)
        each, offsets, mark = self._plan(texts)
        total = np.concatenate([[0], np.cumsum(self.length[each])])
        self._forget(mark)
        return total[offsets[1:]] - total[offsets[:-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and each text's place among them (rows + 1)."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        each, offsets, mark = self._plan(texts)
        lengths = self.length[each]
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[each] - (ends - lengths), lengths)
        at += np.arange(len(at))
        ids = self.store[at]
        self._forget(mark)
        return ids, np.concatenate([[0], ends])[offsets]


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and file; its memory serves all tasks."""
    return PieceEncoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with one more after each text."""
    n = len(offsets) - 1
    out = np.empty(len(ids) + n, np.uint32)
    place = np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))
    out[place] = ids
    out[offsets[1:] + np.arange(n)] = end
    return out, offsets + np.arange(n + 1)
