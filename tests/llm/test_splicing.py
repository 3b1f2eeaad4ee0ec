"""Splicing against whole encodings, with chunks so small that every case occurs."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from grainery.llm import splicing, sql_bpe

RANKS = sql_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
SIZE = {i: len(t) for t, i in RANKS.items()}


@pytest.fixture(scope="module")
def whole():
    """The ids of a word's bytes, as one match."""
    encoding = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=RANKS, special_tokens={})
    return lambda raw: encoding._core_bpe.encode_single_piece(raw) if raw else []


@pytest.mark.parametrize(("chunk", "overlap", "several"), [(4, 2, 1), (8, 4, 3), (16, 8, 64), (40, 3, 2), (3, 30, 5)])
def test_splices_equal_the_whole(whole, chunk, overlap, several):
    r, encoded, unstable = random.Random(chunk), [0, 0], 0

    def merged(raw):
        """Pieces that are tokens of the vocabulary by themselves are still merged from bytes."""
        return whole(raw + b"\x00")[:-1] if raw in RANKS and whole(raw + b"\x00")[-1] == RANKS[b"\x00"] else whole(raw)

    for alphabet in ("a", "ab", "abc", "the in", "etaoin shrdlu", "日本語", "!?=", "0123456789", "aé"):
        for _ in range(60):
            word = "".join(r.choice(alphabet) for _ in range(r.randint(1, 300))).encode()
            word = (b"x" * r.randint(0, 1) + word)[: r.randint(1, 400)]

            def encode(places, word=word):
                out = []
                for lo, hi in places:
                    ids = np.array(merged(word[lo:hi]), np.uint32)
                    encoded[0] += hi - lo
                    ends = lo + np.cumsum([SIZE[i] for i in ids.tolist()])
                    out.append(splicing.Piece(lo, hi, ids, ends - np.array([SIZE[i] for i in ids.tolist()], int), ends))
                return out

            encoded[1] += len(word)
            try:
                got = np.concatenate(list(splicing.joined(len(word), chunk, overlap, 0, encode, several=several)))
            except splicing.Unstable:
                unstable += 1
                continue
            assert got.tolist() == merged(word)
    assert unstable <= (27 if chunk < 16 else 0)  # of 540 words; such a word is encoded whole


def test_pieces_with_shared_characters():
    piece = splicing.Piece(0, 9, np.arange(4), np.array([0, 3, 3, 6]), np.array([4, 4, 6, 9]))
    assert piece.clean.tolist() == [True, False, False, True] and piece.index(3) == -1 and piece.index(6) == 3 and piece.boundary(5) == 5 and piece.boundary(8) == 6
