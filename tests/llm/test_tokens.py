import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from grainery.llm import packing, queries, sql_bpe, token_counts, token_files, tokenizing

PATH, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ranked():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=sql_bpe.read_ranks(RANKS), special_tokens={})


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_pieces(library):
    cases = ["", None, " ", "  ", "a ", " a", "a\n b", "  x", "a<|endoftext|> b", "l'eau  x", "x" * 300 + " y", "\n", " \n ", " <|endoftext|>", "a　 b", "a\x1c b", "tab\t c", "end\n"]
    r = random.Random(2)
    cases += ["".join(r.choice(["ab", " ", "\n", "'s", "9", "é", "%%", " the", " ", "日"]) for _ in range(60)) for _ in range(300)]
    for entries in (10**6, 5):  # with a memory that is cleared all the time, too
        enc = tokenizing.PieceEncoder(PATH, entries)
        for lo in range(0, len(cases), 50):
            some = cases[lo : lo + 50]
            ids, at = enc.encode(pa.array(some))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [ids_of(library, t) for t in some]
            assert enc.lengths(pa.array(some)).tolist() == np.diff(at).tolist()


def test_counts(odd, none, library):
    got = token_counts.count_tokens(odd, PATH, chunk=500).collect()
    want = [(i, len((t or "").encode()), n := len(ids_of(library, t)), n > 512) for i, t in texts(odd)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(none, PATH).collect() == []


@pytest.mark.parametrize(("chunk", "overlap"), [(100, 70), (300, 40), (1000, 64), (50, 200)])
def test_splices(library, chunk, overlap):
    r = random.Random(chunk)
    text = "a" * 3000 + "".join(r.choice([" ", "  ", "\n", "word", "'ll", "123", "é", "<|endoftext|>", "x" * 50]) for _ in range(3000))
    assert token_counts.count_long(text, library, chunk, overlap) == len(ids_of(library, text))


@pytest.mark.parametrize("kind", ["lines", "ideographs", "a", "ba", "digits", "apostrophes", "spaces", "blank lines", "special"])
def test_long_texts_without_spaces(library, kind):
    """Equal to the library's count, in time that grows as the text does."""
    import time

    r = random.Random(7)
    make = {
        "lines": lambda n: "\n".join("".join(r.choice("abcdethn") for _ in range(5)) for _ in range(n // 6)), "ideographs": lambda n: "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(n)),
        "a": lambda n: "a" * n, "ba": lambda n: "b" + "a" * n, "digits": lambda n: "".join(r.choice("0123456789") for _ in range(n)), "apostrophes": lambda n: "'s" * (n // 2),
        "spaces": lambda n: " " * n, "blank lines": lambda n: "\n " * (n // 2), "special": lambda n: "".join(r.choice(["a", "'ll", "1", "é", "!", "<|endoftext|>", "日"]) for _ in range(n // 3)),
    }
    text = make[kind](400_000)
    begun = time.process_time()
    want = len(ids_of(library, text))
    whole, begun = time.process_time() - begun, time.process_time()
    assert token_counts.count_long(text, library) == want
    assert time.process_time() - begun < 15 * whole + 1


def test_counts_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {i: len(ids_of(library, t)) for i, t in texts(docs)}
    assert {r.doc_id: r.n_tokens for r in queries.op3_token_counts(spark, sf_dir).collect()} == want


def check_bpe(rows, source, ranked):
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows), key=repr)
    want = []
    for i, t in source:
        ids = ranked.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_sql_bpe(spark, sf_dir, odd, none, ranked):
    check_bpe(queries.op4_sql_bpe(spark, sf_dir).collect(), texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), ranked)
    check_bpe(sql_bpe.encode_and_decode(odd, RANKS, P.PATTERN).collect(), texts(odd), ranked)
    assert sql_bpe.encode_and_decode(none, RANKS, P.PATTERN).collect() == []
    row = sql_bpe.encode_and_decode(odd.filter("doc_id = 0"), RANKS, P.PATTERN, ids_too=True).first()
    assert bytes(row.decoded).decode() == "plain words of a short text" and row.ids == ranked.encode_ordinary("plain words of a short text")


def test_long_words(ranked):
    coder, r = sql_bpe.Coder(RANKS, P.PATTERN, entries=3), random.Random(4)
    cases = ["a" * 700, "x" + "a" * 3000, "ha" * 1500 + "!" * 2000, "".join(r.choice("abcdethn") for _ in range(900)), "日本語" * 100, "ab" * 300, "x\x1c\x1d \x85  y  　", "'S 's"]
    for case in cases * 2:
        ids, at = coder.encode([case])
        assert ids.tolist() == ranked.encode_ordinary(case) and coder.decode(ids, at) == [case.encode()]


def check_pieces(rows, source, library, window=1024):
    whole = sorted((len(i) + 1, zlib.crc32(np.array([*i, 0], "<u4").tobytes())) for i in (ids_of(library, t) for _, t in source))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(n for n, _ in whole)
    assert sorted(sequences) == list(range(-(-total // window)))
    for k, pieces in sequences.items():
        reached = 0
        for offset, length in sorted(pieces):
            assert offset == reached and length > 0
            reached += length
        assert reached == (window if (k + 1) * window <= total else total - k * window)
    assert sum(r.length for r in rows) == total


def test_packing(spark, sf_dir, odd, none, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op6_mixture_packing(spark, sf_dir).collect()
    check_pieces(rows, texts(docs), library)
    text = dict(texts(docs))
    for r in rows:
        ids = [*ids_of(library, text[r.doc_id]), 0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    check_pieces(packing.pack(odd, PATH).collect(), texts(odd), library)
    check_pieces(packing.pack(odd, PATH, max_queues=2, window=64, targets={"s0": 0.9}).collect(), texts(odd), library, 64)
    assert packing.pack(none, PATH).collect() == []


def test_mixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = packing.pack(docs, PATH).join(docs.select("doc_id", "source"), "doc_id").groupBy("sequence_id", "source").sum("length").collect()
    total, by = 0, {}
    for r in rows:
        total += r[2]
        by[r.source] = by.get(r.source, 0) + r[2]
    last = max(r.sequence_id for r in rows)
    for r in rows:
        if r.sequence_id < last:
            assert abs(r[2] - 1024 * by[r.source] / total) <= 2  # the deficit carried in and out


def test_more_than_64_sources(spark):
    rows = [(100 * i + j, " ".join(["word"] * (60 + i)), f"s{i:03}") for i in range(100) for j in range(6)] + [(-1, "rare " * 9000, "rare")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for targets in (None, {"rare": 0.2}):
        rows = packing.pack(docs, PATH, targets=targets).join(docs.select("doc_id", "source"), "doc_id").groupBy("sequence_id", "source").sum("length").collect()
        by, share = {}, {(r.sequence_id, r.source): r[2] for r in rows}
        for r in rows:
            by[r.source] = by.get(r.source, 0) + r[2]
        total, last = sum(by.values()), max(r.sequence_id for r in rows)
        windows = range(last) if targets is None else range(5)
        for source, n in by.items():
            want = 1024 * n / total
            if targets:
                want = 1024 * (0.2 if source == "rare" else n / total) / (0.2 + 1 - by["rare"] / total)
            assert all(abs(share.get((w, source), 0) - want) <= 2 for w in windows), source


def test_schedule():
    r = np.random.default_rng(3)
    for _ in range(20):
        totals = r.integers(1, 5000, r.integers(1, 30))
        rates = totals * r.uniform(0.2, 3, len(totals))
        s = packing.Schedule(totals, rates, 64)
        served = s.served(np.arange(0, -(-s.total // 64) + 1))
        assert (np.diff(served, axis=0) >= 0).all() and (served[-1] == totals).all()
        assert (served.sum(axis=1) == np.minimum(np.arange(len(served)) * 64, s.total)).all()


def test_token_files(spark, sf_dir, odd, none, library, tmp_path):
    source = sorted(texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    got, start = {r.doc_id: r for r in queries.op10_token_files(spark, sf_dir).collect()}, 0
    for i, t in source:
        ids = [*ids_of(library, t), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = str(tmp_path / "t")
    rows = token_files.write_and_digest(odd, PATH, 2, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: -1 if x is None else x)
    assert sorted(r.n_tokens for r in rows) == sorted(len(ids_of(library, t)) + 1 for _, t in texts(odd))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    some = token_files.read(spark, path, ["doc_id", "n_tokens"], 1, 2)
    assert sorted(r.doc_id for r in some.collect()) == [1, 2]
    plan = some._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id,1)" in plan
    assert token_files.write_and_digest(none, PATH).collect() == []


def test_file_format(spark, sf_dir, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    token_files.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, PATH, 2)
    group = pq.ParquetFile(glob.glob(f"{path}/*.parquet")[0]).metadata.row_group(0)
    found = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in found["doc_id"].encodings and "RLE_DICTIONARY" in found["tokens.list.element"].encodings
    assert found["doc_id"].has_offset_index and found["doc_id"].has_column_index


def test_ranks_file():
    assert sql_bpe.read_ranks(RANKS)[base64.b64decode("IQ==")] == sql_bpe.read_ranks(RANKS)[b"!"]


def brute_cut(totals, rates, window):
    """Each token's window and offset: tokens in order of their due times, ties to the earlier queue, queue by queue inside a window."""
    order = sorted(((j + 0.5) / r, q, j) for q, (t, r) in enumerate(zip(totals, rates, strict=True)) for j in range(t))
    found = {}
    for w in range(0, len(order), window):
        for offset, (_, q, j) in enumerate(sorted(order[w : w + window], key=lambda x: x[1:])):
            found[q, j] = (w // window, offset)
    return found


def test_cut_against_every_token(monkeypatch):
    r = np.random.default_rng(8)
    for sparse in (8, 0):
        monkeypatch.setattr(packing, "SPARSE", sparse)
        monkeypatch.setattr(packing, "BLOCK", 2048 if sparse else 1)
        monkeypatch.setattr(packing, "TOKENS", 4096 if sparse else 7)
        for _ in range(12):
            totals = r.integers(1, 900, r.integers(1, 9))
            rates = totals * r.choice([1.0, 0.3, 2.0], len(totals))
            schedule, want = packing.Schedule(totals, rates, 16), brute_cut(totals.tolist(), rates.tolist(), 16)
            queue, begin, n = [], [], []
            for q, t in enumerate(totals.tolist()):
                cuts = sorted({0, t, *r.integers(0, t + 1, 5).tolist()})
                for a, b in zip(cuts, cuts[1:], strict=False):
                    queue.append(q), begin.append(a), n.append(b - a)
            queue, begin, n = map(np.array, (queue, begin, n))
            got = {}
            for row, start, length, w, offset in zip(*(x.tolist() for x in packing.cut(schedule, queue, begin, n)), strict=True):
                for k in range(length):
                    got[int(queue[row]), int(begin[row]) + start + k] = (w, offset + k)
            assert got == want


@pytest.mark.parametrize("totals", [(4 * 10**9, 1000), (10**10, 1000), (10**13, 50_000, 3)])
def test_rare_sources(totals):
    import time

    begun = time.monotonic()
    schedule = packing.Schedule(np.array(totals), np.array(totals, float), 1024)
    for q in range(1, len(totals)):
        row, start, length, window, offset = packing.cut(schedule, np.array([q, q]), np.array([0, totals[q] // 3]), np.array([totals[q] // 3, totals[q] - totals[q] // 3]))
        assert length.sum() == totals[q] and (length > 0).all() and (offset + length <= 1024).all() and len(np.unique(window)) == totals[q]
        even = (np.arange(totals[q]) + 0.5) * sum(totals) / totals[q] / 1024
        assert (abs(np.sort(window) - even) < 3).all()
    row, start, length, window, offset = packing.cut(schedule, np.array([0]), np.array([totals[0] // 2]), np.array([10**6]))
    assert length.sum() == 10**6 and len(window) in range(976, 980)
    assert time.monotonic() - begun < 30
