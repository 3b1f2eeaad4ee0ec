"""Each catalogue query against its SQL twin, on the smallest tables."""

import os

import duckdb
import pytest

from grainery.plans import catalogue, registry


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'").fetchall()
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, db, name):
    got = registry.QUERIES[name](spark, sf_dir).toArrow()
    want = db.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted((tuple(plain(r[c]) for c in columns) for r in t.to_pylist()), key=repr)
    assert rows(got) == rows(want)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_every_snippet_is_expanded(spark, sf_dir):
    rows = {r.id: r for r in catalogue._snippets(spark, sf_dir).collect()}
    at = {(r.document_id, r.chunk_index): r.content for r in rows.values() if r.kind == "excerpt"}
    got = registry.QUERIES["neighbour_expansion"](spark, sf_dir).collect()
    assert sorted(r.id for r in got) == sorted(rows) and {r.document_id % 10 for r in got} == set(range(10))
    for r in got:
        near = (None, None) if r.chunk_index is None else (at.get((r.document_id, r.chunk_index - 1)), at.get((r.document_id, r.chunk_index + 1)))
        assert (r.context_before, r.context_after) == near


def test_every_customer_is_resolved(spark):
    d = "/root/testdata/sf0.01"  # more customers than 200
    n = spark.read.parquet(f"{d}/nation.parquet").collect()
    names = [(r.n_nationkey, x) for r in n for x in (r.n_name.lower(), f"the land {r.n_nationkey}", f"al{r.n_nationkey * 3}")]
    want = set()
    for c in spark.read.parquet(f"{d}/customer.parquet").collect():
        needle = f"{c.c_name} of NATION_{c.c_nationkey % 30}"
        want |= {(needle, i) for i, x in names if x in needle.lower() or needle.lower() in x}
    got = {(r.needle, r.entity_id) for r in registry.QUERIES["entity_resolve"](spark, d).collect()}
    assert {x for x in got if " of NATION_" in x[0]} == want and len({x for x, _ in want}) > 200


def test_every_word_is_captioned(spark, sf_dir):
    words, seen = {}, {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        words.setdefault(r.conv_id, set()).update(r.text.split())
    for r in registry.QUERIES["caption_dedupe"](spark, sf_dir).collect():
        seen.setdefault(r.conv_id, set()).update(r.text.split())
    assert seen == words
