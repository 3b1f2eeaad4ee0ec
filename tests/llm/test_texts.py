import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from grainery.llm import components, jaccard_join, langid, pii, quality_rules, queries, rule_ensemble


def test_rules(spark, sf_dir, odd, none):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'").fetchall()
    want = con.sql(quality_rules.ORACLE_SQL).to_arrow_table().to_pylist()
    got = queries.op1_rule_ledger(spark, sf_dir).toArrow().to_pylist()
    assert sorted(got, key=lambda r: r["doc_id"]) == sorted(want, key=lambda r: r["doc_id"])
    by = {r.doc_id: r for r in quality_rules.judge(odd).collect()}
    assert by[1].base_failed and not by[1].kept and by[2].n_words == by[3].n_words == 0 and by[4].n_repeat_words > 0 and by[5].n_words == 1
    assert quality_rules.judge(odd).count() == odd.count() and quality_rules.judge(none).collect() == []


def test_ablations_query(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'").fetchall()
    want = con.sql(queries.ORACLE_SQL["rule_ablations"]).to_arrow_table().to_pylist()
    order = lambda rows: sorted(rows, key=lambda r: (r["policy"], r["rule"]))
    assert order(queries.QUERIES["rule_ablations"](spark, sf_dir).toArrow().to_pylist()) == order(want)


def test_repeated_words():
    def brute(words):
        at = defaultdict(list)
        for i in range(len(words) - 7):
            at[tuple(words[i : i + 8])].append(i)
        return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)})

    r = random.Random(1)
    for _ in range(200):
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 60))]
        assert quality_rules.repeated_words(words) == brute(words)


def test_ablations(spark, sf_dir):
    book = quality_rules.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id", "source"))
    bits = [r.bits for r in book.collect()]
    rows = quality_rules.ablations(book).collect()
    assert len(rows) == sum(map(len, quality_rules.POLICIES.values()))
    for r in rows:
        one = next(1 << x.bit for x in quality_rules.RULES if x.name == r.rule)
        whole = quality_rules.mask(quality_rules.POLICIES[r.policy])
        assert r.failed == sum(bool(b & one) for b in bits) and r.rejected == sum(bool(b & whole) for b in bits)
        assert r.only_this == sum(b & whole == one for b in bits) and r.rejected_without == r.rejected - r.only_this
    assert sum(r.n for r in quality_rules.bits_by(book, "source").collect()) == len(bits)
    assert quality_rules.ablations(book.limit(0)).count() == len(rows)


def pseudonyms(spark, *texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [r.text for r in pii.pseudonymize(df, key).orderBy("doc_id").collect()]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def test_pseudonyms(spark):
    cards, dates, rest, kept, none, empty = pseudonyms(
        spark, "4111 1111 1111 1111 and 4111111111111111 or 4111-1111-1111-1112", "2024-02-29 31/12/1999 12.31.2001 3/4/2020 29.2.2024",
        "DE89 3704 0044 0532 0130 00, 123-45-6789 10.0.0.255 +1 (212) 555-1234 212-555-1234 a.b@c.example.com A.B@C.EXAMPLE.COM token = \"0123456789abcdef0123456789abcdef01234567\"",
        "2023-02-30 666-12-1234 256.1.1.1 v1.2 1.2.3.4.5 DE00 3704 0044 0532 0130 00x 12345 abc", None, "",
    )
    a, b, c = re.split(" and | or ", cards)
    assert a.replace(" ", "") == b != "4111111111111111" and luhn(a) == 0 and c == "4111-1111-1111-1112"
    iso, dmy, mdy, short, same = dates.split()
    y, m, d = iso.split("-")
    assert same in (f"{int(d)}.{int(m)}.{y}", f"{d}.{m}.{y}") and re.fullmatch(r"\d\d/\d\d/\d{4}", dmy) and re.fullmatch(r"\d\d\.\d\d\.\d{4}", mdy) and short != "3/4/2020"
    assert re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d, \d{3}-\d\d-\d{4} [\d.]+ \+1 \((\d{3})\) (\d{3})-(\d{4}) \1-\2-\3 (u\S+@\S+) (U\S+@\S+) token = \"[0-9a-f]{40}\"", rest)
    iban = rest.split(",")[0].replace(" ", "")
    assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1
    assert kept == "2023-02-30 666-12-1234 256.1.1.1 v1.2 1.2.3.4.5 DE00 3704 0044 0532 0130 00x 12345 abc" or "3704 0044 0532 0130" not in kept
    assert none is None and empty == ""
    assert pseudonyms(spark, "2024-02-29") == [iso] != pseudonyms(spark, "2024-02-29", key="other")


def test_ibans_before_other_words(spark):
    texts = ["pay BE68 5390 0754 7034 EUR 500 now", "BE68539007547034 BIC X", "ID12 4111 1111 1111 1111", "DE12 4111 1111 1111 1111 11 x", "BE68 5390 0754 7034 DE89 3704 0044 0532 0130 00 AT61 1904 3002 3457 3201 12", "token = AB12CDEF34GH56IJ", "BE68 5390 0754 7034@x"]
    got = pseudonyms(spark, *texts)
    a, b, card, other, three, token, last = got
    assert re.fullmatch(r"pay BE\d\d( \d{4}){3} EUR 500 now", a) and re.fullmatch(r"BE\d{14} BIC X", b) and a[4:23].replace(" ", "") == b[:16] != "BE68539007547034"
    assert re.fullmatch(r"ID12( \d{4}){4}", card) and luhn(card[4:]) == 0 and "4111 1111" not in card + other and other.startswith("DE12 ") and other.endswith(" x")
    found = re.fullmatch(r"(BE\d\d(?: \d{4}){3}) (DE\d\d(?: \d{4}){4} \d\d) (AT\d\d(?: \d{4}){4}) 12", three).groups()
    for iban in (x.replace(" ", "") for x in found):
        assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1 and iban not in "".join(texts).replace(" ", "")
    assert re.fullmatch(r"token = [0-9A-F]{16}", token) and last[:19] == a[4:23]


def test_feistel_is_a_permutation(spark):
    keyed = pii._Keyed("k")
    days = spark.range(146097).select(F.expr(keyed.feistel("'date'", "id DIV 773", "id % 773", "189L", "773L")).alias("f"))
    assert days.select(F.expr("f.l * 773 + f.r")).distinct().count() == 146097
    digits = spark.range(10_000).select(F.expr(keyed.digits("x", "lpad(CAST(id AS STRING), 4, '0')")).alias("d"))
    assert digits.distinct().count() == 10_000 and digits.filter("length(d) <> 4").count() == 0


def test_private_data_goes(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    shape = re.compile(r"[\w.]+@[\w.]+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b|\b[0-9a-fA-F]{40}\b")
    found = 0
    for r in queries.op2_feistel_pseudonyms(spark, "/root/testdata/sf0.01").collect():
        before = shape.findall(docs[r.doc_id])
        stays = [x for x in before if re.fullmatch(r"\d{16}", x) and luhn(x)]  # numbers whose check digit fails are no accounts
        before = [x for x in before if x not in stays]
        found += len(before)
        assert not [x for x in before if x in r.text] and all(x in r.text for x in stays)
        if not before and not re.search(r"\d", docs[r.doc_id]):
            assert r.text == docs[r.doc_id]
    assert found > 50


def test_pii_odd(odd, none):
    assert pii.report(odd, "k").count() == odd.count() and pii.report(none, "k").collect() == []
    assert pii.pseudonymize(odd, "k").columns == odd.columns


def sets(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    found, up = {i: sets(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(found)
    for a in ids:
        for b in ids:
            both = len(found[a] & found[b]) if b < a else 0
            if both and 100 * both >= 80 * len(found[a] | found[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(found[i]), root(i)) for i in ids}


@pytest.mark.parametrize("block", [1 << 21, 1500])
def test_jaccard(spark, block):
    r, vocabulary = random.Random(5), [f"w{i}" for i in range(300)]
    base, rows = [r.choice(vocabulary) for _ in range(70)], []
    for i in range(120):  # a large group of near copies, some of them farther off
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(70)] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    for c in range(8):  # chains
        w = [r.choice(vocabulary) for _ in range(60)]
        for i in range(9):
            w = list(w)
            w[r.randrange(60)] = r.choice(vocabulary)
            rows.append((1000 + 20 * c + i, " ".join(w).upper() if i % 2 else " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "a b"), (5004, "A  b"), (5005, "a b c"), (5006, "x"), (5007, "x"), (5008, rows[0][1])]
    want = brute(rows)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_jaccard_null_and_repeated_ids(spark, block):
    """Each row on its own by brute force; a component is named by its least id that is not null."""
    r, vocabulary, rows = random.Random(9), [f"w{i}" for i in range(200)], []
    for c in range(12):  # chains over rows without an id, and ids that repeat with other texts
        w = [r.choice(vocabulary) for _ in range(50)]
        for k in range(7):
            w = list(w)
            w[r.randrange(50)] = r.choice(vocabulary)
            rows.append((None if k in (1, 3, 4) and c < 9 or c == 11 else 10 * (c // 2) + k, " ".join(w)))
    rows += rows[:3] + [(None, None), (None, "a b"), (3, "a b")]
    want = brute([(i, t) for i, (_, t) in enumerate(rows)])
    least = {}
    for i, (_, root) in want.items():
        if rows[i][0] is not None:
            least[root] = min(least.get(root, rows[i][0]), rows[i][0])
    expected = sorted(((rows[i][0], n, least.get(root)) for i, (n, root) in want.items()), key=repr)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), block).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == expected


def test_link_sets():
    r = np.random.default_rng(3)
    for _ in range(30):
        made, cut = [], [0]
        for _ in range(r.integers(1, 4)):
            base = r.integers(0, 1 << 40, 60).astype(np.uint64)
            for _ in range(r.integers(0, 40)):
                s = base.copy()
                s[r.integers(0, 60, r.integers(0, 12))] = r.integers(0, 1 << 40)
                made.append(np.unique(s))
            cut.append(len(made))
        root = list(range(len(made)))
        for i, a in enumerate(made):
            for j, b in enumerate(made[:i]):
                if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                    lo, hi = sorted((root[i], root[j]))
                    root = [lo if x == hi else x for x in root]
        assert jaccard_join.link_sets(made, cut) == root


def test_jaccard_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_jaccard_join(spark, sf_dir).collect()} == brute(rows)


def test_jaccard_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'").fetchall()
    want = sorted(con.sql(jaccard_join.ORACLE_SQL).to_arrow_table().to_pylist(), key=lambda r: r["doc_id"])
    assert sorted(queries.op8_jaccard_join(spark, d).toArrow().to_pylist(), key=lambda r: r["doc_id"]) == want


def test_jaccard_odd(odd, none):
    rows = jaccard_join.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and {(r.doc_id, r.component_id) for r in rows if r.doc_id in (1, 2, 3, 7, 8)} == {(1, 1), (2, 2), (3, 3), (7, 7), (8, 7)}
    assert jaccard_join.near_duplicates(none).collect() == []


def test_divide_skip():
    r = np.random.default_rng(1)
    made = [np.unique(r.integers(0, 200, r.integers(1, 150))).astype(np.uint64) for _ in range(150)]
    made += [m[r.random(len(m)) < 0.95] for m in made if len(m) > 20]
    lists = jaccard_join.Lists(made)
    for q in made:
        want = [i for i, s in enumerate(made) if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))]
        assert lists.search(q).tolist() == want
        odd = [i for i in want if i % 2]
        assert lists.search(q, lambda left: left % 2 == 1).tolist() == odd


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 4), (9, 9)]
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in found} == {**{i: 100 for i in range(100, 161)}, 3: 3, 4: 3, 5: 3}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_classifier(spark, odd, none, labels):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in queries.op9_rule_ensemble(spark, d).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)
    rows = rule_ensemble.classify(odd, labels).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {1.0} and rule_ensemble.classify(none, labels).collect() == []
    bad = spark.createDataFrame([(0, 0, 0), (7, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in rule_ensemble.classify(odd, bad).collect()} <= {0.0, 1.0}


def test_rules_fit():
    r = np.random.default_rng(2)
    x = r.random((4000, len(rule_ensemble.STATISTICS)))
    y = ((x[:, 2] < 0.3) | (x[:, 5] > 0.8)).astype(float)
    model = rule_ensemble.fit_rows(x, y)
    total = model.intercept + sum(w * rule.holds(x) for rule, w in model.rules)
    assert ((total > 0) == (y > 0.5)).mean() > 0.97 and 0 < len(model.rules) < 150 and "symbol_rate" in " ".join(map(str, (rule for rule, _ in model.rules)))


def test_languages(spark, odd, none):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = [r for r in queries.op7_language_mixtures(spark, d).collect() if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    rows = langid.identify(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[0].lang_pred == "en"
    assert langid.identify(none).collect() == [] and {r.lang_pred for r in langid.predict(odd, langid.learn(none)).collect()} == {"und"}


def test_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs)
    text = {r.lang: r.text for r in docs.filter("lang IN ('en', 'fr')").groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    mixed = " ".join(text["en"].split()[:300] + text["fr"].split()[:100])
    share, _ = langid.mixtures(model, [mixed, "", "123 !?"])
    found = dict(zip(model.languages, share[0].tolist(), strict=True))
    assert abs(found["en"] - 0.75) < 0.1 and abs(found["fr"] - 0.25) < 0.1 and share[1:].sum() == 0


def test_more_than_64_languages(spark):
    r = random.Random(4)
    names = [f"l{i:03}" for i in range(90)]
    words = {x: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for x in names}
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(60 if int(x[1:]) < 80 else 30)), x) for i, x in enumerate(names * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn(docs)
    assert model.languages == names
    truth = {i: x for i, _, x in rows}
    assert all(x.lang_pred == truth[x.doc_id] for x in langid.predict(docs, model).collect())


def test_six_languages_whatever_the_neighbours(spark, monkeypatch):
    r = random.Random(5)
    names = [f"l{i}" for i in range(8)]
    words = {x: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for x in names}
    rows = [(" ".join(r.choice(words[x]) for _ in range(400)), x) for x in names]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    text = " ".join(r.choice(words[x]) for x in names[:6] for _ in range(300))
    alone, _ = langid.mixtures(model, [text])
    assert [x for x, p in zip(names, alone[0], strict=True) if p > 0.1] == names[:6]
    several, _ = langid.mixtures(model, ["x y", text, *(t for t, _ in rows), " ".join(words["l0"] + words["l7"])])
    assert (several[1] == alone[0]).all()
    monkeypatch.setattr(langid, "ENTRIES", 8 * 100)  # a text in many blocks
    blocks, _ = langid.mixtures(model, [text, rows[0][0]])
    assert abs(blocks[0] - alone[0]).max() < 1e-3 and blocks[1].argmax() == 0
