import itertools
import math
import re

import corpus_pipeline
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from test_models import measures
from test_pii import Twin
from test_texts import brute
from test_tokens import PATH, check_pieces
from tokenizers import Tokenizer

from grainery.llm import common, neighbours, pii, queries, rule_ensemble


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    got = {(r.query_id, r.vec_id): r.score for r in queries.op5_multiprobe_hashing(spark, d).collect()}
    want = {(r.query_id, r.vec_id): r.score for r in neighbours.exact(spark.read.parquet(f"{d}/embeddings.parquet")).collect()}
    assert len(got.keys() & want.keys()) >= 0.9 * len(want) and len(got) == len(want)
    assert all(got[k] == want[k] for k in got.keys() & want.keys())


def test_odd_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(200)] + [(1000, [0.5, 0.5, 0.0]), (1050, [0.0, 0.0, 0.0]), (1100, None), (1150, [float("nan"), 1.0, 1.0]), (1200, [1.0, None, 0.0]), (1250, [1.0, 0.0]), (1300, []), (1350, [float("inf"), 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0]), (1400, [1e-30, 1e-30, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, score string, rank int")
    for block in (50, 20_000):
        got, want = neighbours.nearest(df, block=block).collect(), neighbours.exact(df).collect()
        found = {(r.query_id, r.vec_id) for r in got}
        assert all(len([r for r in got if r.query_id == q]) == 5 for q in (0, 50, 100, 150, 1000)) and not any(r.query_id in (1050, 1100, 1150, 1200, 1250, 1300, 1350) for r in got)
        assert {(r.query_id, r.vec_id) for r in want if r.query_id in (0, 100, 150)} <= found
    assert neighbours.nearest(df.limit(0)).collect() == []


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.9, 0.1])], "vec_id bigint, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in neighbours.nearest(df).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_far_candidates(spark):
    r = np.random.default_rng(6)
    few = [(i, v.tolist()) for i, v in enumerate(np.vstack([np.eye(4), -np.eye(4)]))]
    wide = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 512)))] + [(1000, [-1.0] * 512)]
    for rows, every, block in ((few, 1, 3), (wide, 10, 20_000), (wide, 10, 50)):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
        got = {(x.query_id, x.rank, x.vec_id, x.score) for x in neighbours.nearest(df, every=every, block=block).collect()}
        assert got == {(x.query_id, x.rank, x.vec_id, x.score) for x in neighbours.exact(df, every=every).collect()}


def private(text, twin):
    """Pseudonyms by a plain scan; the test tables hold no IBANs and no accounts in groups."""

    def fresh(m):
        m = m[0]
        if "@" in m:
            return twin.email(m)
        if re.fullmatch(r"[0-9a-fA-F]{32,}", m):
            return twin.secret(m)
        if re.fullmatch(r"(\d{4}[-/.]\d\d|\d{1,2}[-/.]\d{1,2})[-/.](\d\d|\d{4})", m):
            return twin.date(m)
        if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
            return twin.ip(m)
        if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
            return m if m[:3] in ("000", "666") or m[0] == "9" or m[4:6] == "00" or m[7:] == "0000" else twin.ssn(m)
        if m[0] in "+(" or re.fullmatch(r"\d{3}[ .-]\d{3}[ .-]\d{4}", m):
            return twin.phone(m)
        return twin.account(m) if m.isdigit() else twin.secret(m) if len(m) >= 16 else m

    return regex.sub(pii.PATTERN, fresh, text)


def test_pipeline(spark):
    """Every stage's rows and texts against a plain-Python reading of the stage, on what the stage before it kept."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    given, kept = {r.doc_id: r.text or "" for r in docs.collect()}, {}
    model = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality classifier":
            model = rule_ensemble.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
        before, docs = docs, common.materialize(stage(spark, docs, d), "test-stage")
        assert docs.schema == before.schema
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    passed = {}
    for i, t in given.items():
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, at = len(words), {}
        for k in range(n - 7):
            at.setdefault(tuple(words[k : k + 8]), []).append(k)
        again = len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)})
        letters = re.findall("[A-Za-z]", t)
        bad = [
            n < 20, 100 * again > 30 * n, 10 * len(re.findall(r"[#*$%&|<>]", t)) > n, len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 30 * len(lines),
            n >= 20 and 10 * sum(c.isupper() for c in letters) > 4 * len(letters), 10 * t.count("!") > n, n >= 20 and not 2 * n <= sum(map(len, words)) <= 15 * n,
        ]
        if not any(bad):
            passed[i] = t
    assert kept["quality rules"] == passed and len(passed) < len(given)

    def score(t):
        x = measures(t)
        return 1 / (1 + math.exp(-model.intercept - sum(w * all((x[s] > v) if above else (x[s] <= v) for s, above, v in rule.tests) for rule, w in model.rules)))

    good = {i: t for i, t in passed.items() if score(t) >= 0.7} if model.constant is None else passed
    assert kept["quality classifier"] == good
    heads = {root for _, root in brute(list(good.items())).values()}
    assert kept["n-gram Jaccard join"] == {i: good[i] for i in heads} and len(heads) < len(good)
    twin = Twin(queries.PII_KEY)
    assert kept["PII"] == {i: private(good[i], twin) for i in heads} != kept["n-gram Jaccard join"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    check_pieces(pieces, list(kept["PII"].items()), Tokenizer.from_file(PATH))
    whole = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in whole} == heads and sum(r.length for r in whole) == sum(r.length for r in pieces)


def test_clashing_columns(spark, tmp_path):
    """Columns called like those that the code uses itself pass through every stage."""
    names = ["rows", "__id", "__pii", "__label", "__text", "__row", "row", "head", "n", "class", "label", "component_id", "begin", "ids", "sample", "score", "bits", "n_words", "named", "least"]
    texts = [f"some words that are long enough to pass the rules, number {i} of many, " + " ".join(f"{c}{i}" for c in "abcdefghijklmnop") + " user@example.com" for i in range(6)]
    rows = [(i, t, "en", f"s{i % 2}", *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)]
    rows.append((1, "a" + texts[1][1:], "en", "s1", *(f"again{n}" for n in names)))
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, {', '.join(f'`{n}` string' for n in names)}")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, str(tmp_path)), "test-clash")
        assert out.columns == docs.columns
        docs = out
    found = {r.doc_id: r for r in docs.collect()}
    assert sorted(found) == list(range(6)) and all(found[i].rows == f"rows{i}" and found[i]["__pii"] == f"__pii{i}" for i in (0, 2, 3, 4, 5))
    assert found[1].text.startswith("aome") and found[1].rows == "againrows"  # the least of the id's texts
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for name, f in queries.QUERIES.items():
        if name != "op5_multiprobe_hashing":
            assert f(spark, str(tmp_path)).count() >= 6, name


def test_odd_scales(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e200, -1e200]), (3, [1e-310, 1e-310]), (4, [1.0, 2.0]), (5, [1e308, 1.7e308])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in neighbours.nearest(df, every=1).collect()}
    assert len(got) == 30 and abs(got[0, 1] - 1) < 1e-12 and abs(got[0, 2]) < 1e-12 and abs(got[0, 4] - 3 / 10**0.5) < 1e-12 and all(s == s for s in got.values())


def test_probes_in_order_of_success():
    r = np.random.default_rng(2)
    for size, n in ((3, 27), (4, 30), (5, 60)):
        inside = r.random((20, size))
        found = neighbours.moves(inside, n)
        for x, steps in zip(inside, found, strict=True):
            price = lambda s: sum(a * a if m == -1 else (1 - a) ** 2 if m == 1 else 0 for a, m in zip(x, s, strict=True))  # noqa: B023, E731
            every = sorted(itertools.product((0, -1, 1), repeat=size), key=price)
            assert np.allclose([price(s) for s in steps], [price(s) for s in every[:n]]) and len({tuple(s) for s in steps.tolist()}) == n


def test_projections_follow_the_data(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(60, 32))
    near = centres[r.integers(0, 60, 1500)] + 0.2 * r.normal(size=(1500, 32))
    picked = {}
    for name, data in (("near", near), ("even", r.normal(size=(1500, 32)))):
        df = spark.createDataFrame(list(enumerate(data.tolist())), "vec_id bigint, embedding array<double>")
        rows = neighbours.usable(df)
        kinds = rows.select(F.size("vector").alias("size"), F.array("id").alias("ids"), "vector")
        cosine = neighbours._usual_cosine(kinds, kinds.filter("ids[0] % 50 = 0"), 5)
        unit = neighbours._unit(data)
        every = np.sort(np.sort(unit[::50] @ unit.T, axis=1)[:, -6])
        assert abs(cosine - every[1]) < 1e-9
        picked[name] = neighbours.fitted(cosine, neighbours.TABLES, neighbours.WIDTH, neighbours.PROBES)
        got = {(x.query_id, x.vec_id) for x in neighbours.nearest(df).collect()}
        want = {(x.query_id, x.vec_id) for x in neighbours.exact(df).collect()}
        assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    assert picked["near"] >= picked["even"] + 4


def test_odd_pipeline(spark, odd, none, tmp_path):
    for i, rows in enumerate((odd, none)):
        d = str(tmp_path / str(i))
        rows.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        docs = common.table(spark, d, "documents")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.materialize(stage(spark, docs, d), "test-odd")
            assert docs.columns == rows.columns
        corpus_pipeline.run(spark, d).collect()


def test_repeats_in_the_pipeline(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(3, text), (1, text), (1, text), (2, text + " more"), (None, text), (None, "other words here"), (7, "seven of its own")], "doc_id bigint, text string")
    found = corpus_pipeline.deduplicate(spark, rows, "").collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in found if r.text.startswith("w0") and r.doc_id is not None) == [1]
    assert any(r.doc_id == 7 for r in found) and any(r.text == "other words here" for r in found)


def test_registered(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
