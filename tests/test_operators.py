import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from grainery import schemas
from grainery.functions import text as X
from grainery.operators import captions, chunking, evaluation, index, memory, metadata, search, store
from grainery.sources import files, providers

NOW = dt.datetime(2024, 1, 1)


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()[0]


@pytest.mark.parametrize(("s", "stamp", "duration"), [(65, "01:05", "1:05"), (3661, "01:01:01", "1:01:01"), (0, "00:00", "")])
def test_stamps(spark, s, stamp, duration):
    assert one(spark, s, "int", X.format_stamp) == stamp and one(spark, s, "int", X.format_duration) == duration


def test_vtt_seconds(spark):
    assert one(spark, "00:01:02,500", "string", X.vtt_seconds) == 62.5
    assert one(spark, "01:02.5", "string", X.vtt_seconds) == 62.5
    assert one(spark, "x", "string", X.vtt_seconds) is None


def test_terms(spark):
    rows = spark.createDataFrame([("q w", ["-Foo_", "foo", "b.ar", "--"]), ("q w", [])], "q string, t array<string>")
    assert [r[0] for r in rows.select(X.search_terms("q", "t")).collect()] == [["foo", "bar"], ["q", "w"]]
    assert search.query_terms("", ["foo_bar", "a-b"]) == [["foo", "bar"], ["a"], ["b"]]
    assert search.query_terms("", ["a-b", "c"], strict=True) is None


def test_video_ids(spark):
    urls = {"abcdefghijk": "abcdefghijk", "https://youtu.be/abcdefghijk?x": "abcdefghijk", "https://www.youtube.com/watch?v=abcdefghijk": "abcdefghijk", "https://m.youtube.com/embed/abcdefghijk": "abcdefghijk", "https://youtube.com:80/watch?v=abcdefghijk": None, "https://e.com/watch?v=abcdefghijk": None, "": None}
    rows = spark.createDataFrame(list(urls.items()), "u string, want string")
    assert all(r.got == r.want for r in rows.select("want", X.video_id("u").alias("got")).collect())


def test_rolling_captions(spark):
    cues = [(0.0, 2.0, "a b"), (2.0, 2.0, "a b c"), (4.0, 2.0, "b c"), (6.0, 2.0, "z"), (7.0, 1.0, "")]
    rows = spark.createDataFrame([("v", i, a, b, "t", c) for i, (a, b, c) in enumerate(cues)], "video_id string, position int, start double, duration double, timestamp string, text string")
    assert [(r.start, r.duration, r.text) for r in captions.dedupe(rows).orderBy("segment").collect()] == [(0.0, 6.0, "a b c"), (6.0, 2.0, "z")]
    assert captions.transcripts(captions.dedupe(rows)).first().text == "[t] a b c\n[t] z"


def test_vtt(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500 align:start\n<c>a</c>  b\n<i></i>\n\nbad --> 00:02\nx\n\n00:03.000 --> 00:04.000\n\n00:05.000 --> 00:06.000\nend"
    rows = captions.parse_vtt(spark.createDataFrame([("v", vtt)], "video_id string, vtt string")).orderBy("position").collect()
    assert [(r.start, r.duration, r.timestamp, r.text) for r in rows] == [(1.0, 1.5, "00:01", "a b"), (5.0, 1.0, "00:05", "end")]


def test_tool_output(spark):
    out = 'warning\n{"title":"T","channel":"","uploader":" U ","duration":5,"chapters":[{"title":" c ","start_time":1,"end_time":2},{"title":"","start_time":3},{"title":"n"}]}\n{"title":"no"}'
    rows = spark.createDataFrame([("v", out), ("w", "nothing")], "video_id string, output string")
    meta = {r.video_id: r for r in captions.video_metadata(rows).collect()}
    assert (meta["v"].title, meta["v"].channel, meta["v"].duration, meta["w"].channel) == ("T", "U", 5.0, "")
    ch = {r.video_id: r.chapters for r in captions.video_chapters(rows).collect()}
    assert [tuple(c) for c in ch["v"]] == [("c", 1.0, 2.0)] and ch["w"] == []


def test_subtitle_choice_and_fallback(spark):
    f = spark.createDataFrame([("v", "/a/x.en-orig.vtt"), ("v", "/a/x.en.vtt")], "video_id string, path string")
    assert tuple(captions.choose_subtitles(f).first()) == ("v", "/a/x.en.vtt", "en", False)
    a, b = spark.createDataFrame([("v", 1)], "video_id string, x int"), spark.createDataFrame([("v", 2), ("w", 3)], "video_id string, x int")
    assert sorted((r.video_id, r.x, r.origin) for r in files.caption_segments(a, b).collect()) == [("v", 1, "api"), ("w", 3, "files")]


def test_fusion_and_backend(spark):
    ranked = lambda ids: spark.createDataFrame([(i, r + 1) for r, i in enumerate(ids)], "id long, rank int")
    assert [r.id for r in search.fuse(ranked([1, 2, 3]), ranked([3, 4]), 10).collect()] == [3, 1, 2, 4]
    for a, b, label in (([1], [2], "hybrid"), ([1], [], "fts_only"), ([], [1], "vector_only"), ([], [], "none")):
        assert search.backend(ranked(a), ranked(b)).first()[0] == label


def snippets(spark):
    rows = [(1, 9, "alpha beta", "excerpt", 0, None), (2, 9, "beta", "excerpt", 1, "tag"), (3, 9, "gamma alpha", "excerpt", 3, None), (4, 9, "alpha", "synthesis", None, None), (5, 9, "foo bar Éclair", "excerpt", 5, None)]
    return spark.createDataFrame([(*r, NOW, None, None) for r in rows], "id long, document_id long, content string, kind string, chunk_index int, tags string, created_at timestamp, embedding array<float>, embedding_model string")


def test_neighbours(spark):
    rows = {r.id: (r.context_before, r.context_after) for r in search.neighbours(snippets(spark), snippets(spark)).collect()}
    assert rows[2] == ("alpha beta", None) and rows[1] == (None, "beta") and rows[3] == (None, None) and rows[4] == (None, None)


def test_keyword_search(spark):
    rows = index.tokenized(snippets(spark))
    ids = lambda terms, mode="relaxed": sorted(r.id for r in search.bm25(rows, search.query_terms("", terms), mode).collect())
    assert ids(["alpha", "beta"]) == [1] and ids(["beta", "gamma"]) == [1, 2, 3] and ids(["beta", "gamma"], "and") == []
    assert ids(["eclair"]) == [5] and ids(["foo_bar"]) == [5] and ids(["bar_foo"]) == [] and ids(["tag", "beta"]) == [2]
    docs = spark.createDataFrame([(9, "T", "u", NOW)], "id long, title string, url string, ingested_at timestamp")
    found = search.hybrid(snippets(spark), docs, "alpha", None)
    assert found.columns == schemas.SEARCH_RESULT.fieldNames() and found.count() == 3
    with pytest.raises(ValueError):
        search.hybrid(snippets(spark), docs, "  ", None)


def test_vectors(spark):
    rows = spark.createDataFrame([(1, None, None), (2, [1.0, 0.0], "b"), (3, [0.0, 0.0], "a"), (4, [1.0, 1.0], "a")], "id long, embedding array<float>, embedding_model string")
    assert [r.id for r in search.cosine_scores(rows, [1.0, 0.0], "a").collect()] == [4]
    assert [r.id for r in store.stale(rows, "a").orderBy("id").collect()] == [1, 2]
    embed = lambda r: files.embed_rows(r.withColumn("content", F.lit("x y")), providers.Hashed(8, "a"))
    table, counts = store.reembed(rows, "a", embed)
    assert tuple(counts.first()) == (2, 2, 2) and {r.embedding_model for r in table.collect()} == {"a"}
    back = rows.select(files.unpack_vectors(files.pack_vectors("embedding"))).collect()
    assert [r[0] for r in back] == [r.embedding for r in rows.collect()]
    assert counts.count() == 1 and [r[0] for r in rows.limit(0).select(files.unpack_vectors(files.pack_vectors("embedding"))).collect()] == []


def odd_provider():
    class Odd:
        """A provider that records its texts, fails on some, and gives too narrow vectors for others."""

        model, width = "odd", 2

        def vectors(self, texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("boom")
            return [[1.0] if "narrow" in t else [float(len(t)), 0.0] for t in texts]

    return Odd()


def test_providers(spark, tmp_path):
    odd = odd_provider()
    assert providers.embed(odd, ["a"], "query")["vectors"] == [[float(len("task: search result | query: a")), 0.0]]
    assert [providers.embed(*x)["error"] for x in ((odd, []), (odd, ["a"], "other"), (odd, ["narrow"]), (providers.Off(), ["a"]))] == ["no texts", "unknown kind of text 'other'", "a vector of width 1 in place of 2", "embedding is off"]
    assert providers.embedded(odd, ["boom"]) is None and providers.embedded(providers.Hashed(4), ["x"])[0] != providers.embedded(providers.Hashed(4), ["x"], "query")[0]
    assert "no model server" in providers.embed(providers.Server("http://127.0.0.1:9/none", "m"), ["a"])["error"]
    rows = spark.createDataFrame([(i, "boom" if i == 70 else "narrow" if i == 140 else "x") for i in range(200)], "id int, content string").coalesce(1)
    found = {r.id: (r.embedding, r.embedding_model) for r in files.embed_rows(rows, odd).collect()}
    assert all(found[i] == ((None, None) if 64 <= i < 192 else ([float(len("title: none | text: x")), 0.0], "odd")) for i in range(200))
    (tmp_path / ".env").write_text("A_SETTING = 'x=1'\n# B=2\nnothing\nHOME=/nowhere\n")
    import os

    assert providers.read_settings(str(tmp_path / ".env")) == {"A_SETTING": "x=1", "HOME": os.environ["HOME"]} and providers.read_settings(str(tmp_path / "no")) == {}
    with pytest.raises(providers.Failed):
        providers.provider("odd")


def test_model_server(spark):
    import http.server
    import json
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(len(asked["input"]))
            self.send_response(500 if asked["model"] == "bad" else 200)
            self.end_headers()
            if asked["model"] == "writer":
                reply = {"points": [{"before_unit": 1, "heading": "H", "anchor": ""}]} if "[1] " in asked["input"] and "Propose" in asked["prompt"] else {}
            elif asked["model"] == "judge":
                reply = {"verdicts": [{"before_unit": s["before_unit"], "score": float(len(s["text"])), "grade": "x"} for s in asked["input"]]}
            else:
                reply = {} if asked["model"] == "none" else {"embeddings": [[float(len(t))] * 3 for t in asked["input"]]}
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *args):
            pass

    seen: list = []
    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    make = lambda model: providers.Server(f"http://127.0.0.1:{server.server_port}/", model, 3)
    assert providers.embed(make("m"), ["a"] * 130)["vectors"] == [[21.0] * 3] * 130 and seen == [64, 64, 2]
    assert "answered 500" in providers.embed(make("bad"), ["a"])["error"] and "no embeddings" in providers.embed(make("none"), ["a"])["error"]
    url, docs = f"http://127.0.0.1:{server.server_port}/", spark.createDataFrame([(1, "One here. Two here.")], "doc_id long, text string")
    assert chunking.summaries(docs, provider=providers.HeadingServer(url, "writer"), name="server").first()[:4] == (1, True, None, "server")
    assert chunking.summaries(docs, provider=providers.HeadingServer(url, "none")).first().backend == "fallback"
    p = F.array(F.struct(F.lit(1).alias("before_unit"), F.lit("").alias("anchor"), F.lit("H").alias("heading")))
    assert evaluation.graded(docs, p, providers.JudgeServer(url, "judge")).first()[:4] == (1, 1, "H", float(len("Two here.")))
    assert evaluation.graded(docs, p, providers.JudgeServer(url, "none")).collect() == []
    server.shutdown()


def test_capture(spark):
    batch = [(1, "u", "url", "t"), (2, "u", "url", "t"), (3, None, "pasted", "t"), (4, None, "pasted", "t"), (5, "known", "url", "t"), (6, "x", "odd", "t"), (7, "y", "url", " ")]
    rows = spark.createDataFrame(batch, "arrival long, url string, source_type string, raw_text string")
    known = spark.createDataFrame([(7, "known")], "id long, url string")
    new, again, rejects = store.capture(rows, known)
    assert [(r.id, r.url) for r in new.orderBy("id").collect()] == [(8, "u"), (9, None), (10, None)]
    assert sorted((r.arrival, r.document_id) for r in again.collect()) == [(2, 8), (5, 7)]
    assert sorted((r.arrival, r.error) for r in rejects.collect()) == [(6, "unknown source_type"), (7, "empty text")]


def test_updates(spark):
    docs = spark.createDataFrame([(1, "pending", None)], "id long, status string, agent_summary string")
    ch = spark.createDataFrame([(1, "kept", 0), (1, "partial", 1), (1, "odd", 2), (5, "kept", 3)], "id long, value string, position int")
    table, rejects = store.set_status(docs, ch)
    assert table.first().status == "partial" and sorted(r.error for r in rejects.collect()) == ["no such row", "unknown status"]
    assert store.discard(docs, docs.select("id"))[0].first().status == "discarded"
    assert store.set_summary(docs, spark.createDataFrame([(1, " ", 0)], "id long, value string, position int"))[1].count() == 1


def test_snippet_writes(spark):
    docs = spark.createDataFrame([(1, "url", None), (2, "transcript", None), (3, "transcript", '{"video":{"chapters":[]}}')], "id long, source_type string, source_metadata string")
    batch = spark.createDataFrame([(1, "a", "excerpt", 3, None, NOW, 0), (1, "b", "synthesis", 4, "t", NOW, 1), (8, "c", "excerpt", 0, None, NOW, 2), (1, " ", "excerpt", 0, None, NOW, 3)], "document_id long, content string, kind string, chunk_index int, tags string, created_at timestamp, position int")
    new, rejects = store.write_snippets(batch, docs, schemas.empty(spark, "snippets"))
    assert [(r.id, r.chunk_index) for r in new.orderBy("id").collect()] == [(1, 3), (2, None)] and rejects.count() == 2
    texts = docs.select(F.col("id").alias("document_id"), F.lit("One. Two.").alias("text"), F.col("source_type").alias("kind"))
    chunks, sums = chunking.chunks(texts, "document_id", kind=F.col("kind")), chunking.summaries(texts, "document_id", kind=F.col("kind"))
    embed = lambda r: files.embed_rows(r, providers.Hashed(8))
    written, counts, refused = store.write_chunks(chunks, sums, docs, schemas.empty(spark, "snippets"), F.lit(NOW), embed=embed)
    assert sorted(r.document_id for r in written.collect()) == [1, 3] and [r.document_id for r in refused.collect()] == [2]
    assert sorted(tuple(r) for r in counts.collect()) == [(1, 1, 1), (3, 1, 1)]
    off = lambda r: files.embed_rows(r, providers.Off())
    assert store.write_snippets(batch, docs, schemas.empty(spark, "snippets"), off)[0].filter("embedding IS NULL").count() == 2


def test_metadata(spark):
    rows = spark.createDataFrame([(None,), ("x",), ("[1]",), ('{"author":"A"}',), ('{"video":{"chapters":"no"}}',)], "j string")
    assert [r[0] for r in rows.select(metadata.load("j")).collect()] == ["{}", "{}", "{}", '{"author":"A"}', '{"video":{"chapters":"no"}}']
    assert [r[0] is not None for r in rows.select(metadata.chapters_error("j", F.lit("transcript"))).collect()] == [True] * 5
    made = spark.range(1).select(metadata.from_video(F.lit(" "), F.lit("v"), F.lit(65), F.lit(None).cast(metadata.CHAPTERS), F.lit("")).alias("m")).first()[0]
    assert made == '{"video":{"video_id":"v","duration":"1:05"}}'
    assert spark.range(1).select(metadata.dumps(F.struct(F.lit(None).cast("string").alias("a")))).first()[0] is None


def test_entities(spark):
    table = spark.createDataFrame([(1, "Tom", "person", "brother", None, "tommy boy,tb", None, NOW), (2, "Rex", "pet", None, None, None, None, NOW)], schemas.ENTITIES.simpleString()[7:-1])
    need = spark.createDataFrame([("my brother Tom",), ("TB",), (" ",), ("zzz",), ("x",)], "needle string")
    assert sorted(tuple(r) for r in memory.resolve(table, need).collect()) == [("TB", 1), ("my brother Tom", 1), ("x", 2)]
    batch = spark.createDataFrame([(0, "Tommy", "person", None, NOW), (1, "Anna", "person", "An, an,ANNE", NOW), (2, "anna b", "person", None, NOW), (3, "Q", "ghost", None, NOW), (4, " ", "pet", None, NOW)], "position long, name string, kind string, aliases string, created_at timestamp")
    new, again, rejects = memory.create_entities(batch, table)
    assert [(r.id, r.name, r.aliases) for r in new.collect()] == [(3, "Anna", "an,anne")]
    assert sorted((r.name, r.entity_id) for r in again.collect()) == [("Tommy", 1), ("anna b", None)] and rejects.count() == 2
    assert memory.list_entities(table, "pet").count() == 1 and memory.get_entity(table, 1).first().name == "Tom"


def test_grams_are_not_broadcast(spark):
    table = spark.createDataFrame([(i, f"kind {i}", "thing", None, None, "zz" if i else "some c", None, NOW) for i in range(20)], schemas.ENTITIES.simpleString()[7:-1])
    need = spark.range(3000).select(F.concat(F.lit("some customer of kind "), (F.col("id") % 50).cast("string"), F.lit(" and of number "), F.col("id").cast("string")).alias("needle"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")  # the needles' grams take more
    try:
        got = sorted(tuple(r) for r in memory.resolve(table, need).collect())
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    names = [(i, x) for i in range(20) for x in ([f"kind {i}"] if i else ["kind 0", "some c"])]
    assert got == sorted({(r.needle, i) for r in need.collect() for i, x in names if x in r.needle})


@pytest.mark.parametrize("buckets", [1, 5, 1 << 16])
def test_names_in_shared_buckets(spark, monkeypatch, buckets):
    monkeypatch.setattr(memory, "BUCKETS", buckets)
    draw = random.Random(7)
    words = sorted({"".join(draw.choices("abé\U0001f600 ", k=draw.randint(1, 7))).strip() for _ in range(150)} - {""})
    table = spark.createDataFrame([(i, w, "thing", None, None, None, None, NOW) for i, w in enumerate(words[::2])], schemas.ENTITIES.simpleString()[7:-1])
    need = spark.createDataFrame([(w,) for w in words[1::2]], "needle string")
    got = sorted(tuple(r) for r in memory.resolve(table, need).collect())
    assert got == sorted((n, i) for n in words[1::2] for i, w in enumerate(words[::2]) if n in w or w in n) and got


def test_observations(spark):
    log = [(1, "write", 1, "a", "x", None), (2, "write", 1, "a", "y", None), (3, "replace", 1, "a", "z", None), (4, "write", 1, None, None, "prose"), (5, "write", 1, "a", " ", None), (6, "write", 1, None, None, None)]
    rows = spark.createDataFrame([(*r, None, NOW, None) for r in log], "id long, op string, entity_id long, attribute string, value string, body string, source string, observed_at timestamp, target long")
    state, rejects = memory.fold_log(rows)
    assert sorted((r.id, r.superseded) for r in state.collect()) == [(1, True), (2, True), (3, False), (4, False)] and rejects.count() == 2
    assert [r.retired for r in memory.retired(rows.filter("id < 4")).collect()] == [2]
    assert [r.id for r in memory.get_observations(state, 1, "a").collect()] == [3] and [r.id for r in memory.get_observations(state, 1, include_superseded=True).collect()] == [4, 3, 2, 1]
    assert memory.supersede_errors(state, spark.createDataFrame([(1,), (3,)], "id long")).count() == 1


def test_evaluation(spark):
    points = spark.createDataFrame([(1, 0, "a", 0), (1, 0, "b", 1)], "doc_id long, before_unit int, heading string, position int")
    verdicts = spark.createDataFrame([(1, 0, "4"), (1, 7, "n/a"), (2, 0, "1")], "doc_id long, before_unit int, score string")
    assert sorted(r.heading for r in evaluation.with_headings(verdicts, points).collect()) == ["", "", "b"]
    means = {r.doc_id: r.mean_score for r in evaluation.mean_scores(verdicts).collect()}
    assert means == {1: 4.0, 2: 1.0, None: 2.5}
    docs = spark.createDataFrame([(1, "One here. Two here.")], "doc_id long, text string")
    p = F.array(F.struct(F.lit(1).alias("before_unit"), F.lit("Two here").alias("anchor"), F.lit("H").alias("heading")))
    assert evaluation.check_points(docs, p).first().anchor_ok_rate == 1.0
    assert evaluation.judge_sections(docs, p).first().body == "Two here."
    assert providers.ScriptedJudge({"H": 3.0}).grade([(1, "H", "t")])[0]["score"] == 3.0


def test_store_files(spark, tmp_path):
    tables = schemas.create_store(spark, str(tmp_path / "s"))
    assert schemas.create_store(spark, str(tmp_path / "s"))["documents"].columns == tables["documents"].columns == schemas.DOCUMENTS.fieldNames()
    many = spark.createDataFrame([("v1", "a\nb"), ("v2", "c\n\n"), ("v3", "")], "video_id string, text string")
    files.write_each(many, str(tmp_path / "each"))
    assert {r.video_id: r.text for r in files.read_each(spark, str(tmp_path / "each")).collect()} == {"v1": "a\nb\n", "v2": "c\n", "v3": "\n"}
    files.write_texts(spark.createDataFrame([("a\nb\n",)], "text string"), str(tmp_path / "t"))
    assert files.read_texts(spark, str(tmp_path / "t" / "*.txt")).first().text == "a\nb\n"
    assert files.read_texts(spark, str(tmp_path / "none")).first().error == "no such file"


def test_postings(spark, tmp_path):
    rows = index.tokenized(snippets(spark))
    found = index.postings(rows)
    assert {r.term: r.df for r in index.frequencies(found).collect()}["alpha"] == 3
    index.write(found, str(tmp_path / "p"))
    changed = spark.createDataFrame([(1, ["new"])], "id long, tokens array<string>")
    fresh = index.refresh(spark.read.parquet(str(tmp_path / "p")), changed, changed)
    assert {r.term for r in fresh.filter("id = 1").collect()} == {"new"}
    assert index.statistics(rows).first().n == 5


def test_stored_documents_are_chunked(spark):
    docs = spark.createDataFrame([(1, "url", "T", "One. Two.", '{"author":"A"}'), (2, "transcript", "V", "[00:01] a\n[00:05] b", None), (3, "transcript", "V", "[00:01] a\n[00:05] b", '{"author":"C","video":{"chapters":[{"title":"Ch","start":4}]}}')], "id long, source_type string, title string, raw_text string, source_metadata string")
    found, sums = chunking.stored(docs, spark.createDataFrame([(1,), (2,), (3,), (9,)], "id long"))
    assert sorted((r.document_id, r.prefix) for r in found.collect()) == [(1, "T"), (3, "V — C [00:01–00:01]"), (3, "V — C [00:05–00:05] > Ch")]
    by = {r.document_id: r for r in sums.collect()}
    assert by[1].ok and by[3].chapters_used and by[2].error == "chapters were never recorded for this transcript" and by[9].error == "no such document" and not by[9].ok
    assert chunking.stored(docs)[1].count() == 3


def test_captured_captions(spark):
    kind = "video_id string, position int, start double, duration double, timestamp string, text string"
    primary = spark.createDataFrame([("v", 0, 0.0, 2.0, "00:00", "a\n b"), ("v", 1, 2.0, 2.0, "00:02", "a b c")], kind)
    fallback = spark.createDataFrame([("v", 0, 0.0, 1.0, "00:00", "no"), ("w", 0, 1.0, 1.0, "00:01", "x")], kind)
    output = spark.createDataFrame([("v", '{"title":"T","channel":"C","duration":65,"chapters":[]}')], "video_id string, output string")
    by = {r.video_id: r for r in captions.captured(primary, fallback, output).collect()}
    assert (by["v"].origin, by["v"].text, by["v"].n_segments, by["v"].title) == ("api", "[00:00] a b c", 1, "T") and by["v"].source_metadata == '{"author":"C","video":{"video_id":"v","duration":"1:05","chapters":[]}}'
    assert (by["w"].origin, by["w"].text, by["w"].title) == ("files", "[00:01] x", "") and "chapters" not in by["w"].source_metadata


def test_run_report(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One here. Two here. Three."), (2, "Alone.")], "doc_id long, text string")
    p = F.when(F.col("doc_id") == 1, F.array(*(F.struct(F.lit(i).alias("before_unit"), F.lit("").alias("anchor"), F.lit(h).alias("heading")) for i, h in ((0, "A"), (1, "B")))))
    scored = evaluation.score_run(docs, p, providers.ScriptedJudge({"A": 4.0, "B": 1.0}))
    by = {r.doc_id: r for r in scored.collect()}
    assert (by[1].doc_average, by[1].n_scored, by[2].doc_average, by[2].n_scored) == (2.5, 2, None, 0) and "| 0 | A | 4.0 | scripted |" in by[1].section and "nothing to grade" in by[2].section
    text = evaluation.report(scored, "r1").orderBy("part", "doc_id").select("text")
    for _ in range(2):
        files.write_texts(text.coalesce(1), str(tmp_path / "r"))
    got = [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert got.count("# Run r1") == 2 and got.count("mean score: 2.5") == 4 and "2 headings graded in 2 documents" in got


def test_prompts_and_renderings(spark):
    talk = spark.createDataFrame([(1, "[00:01] a\n[00:05] b")], "doc_id long, text string")
    chapters = F.expr("array(named_struct('title', 'Ch', 'start', 4D, 'end', 9D))")
    assert chunking.prompts(talk, "base", "more", kind=F.lit("transcript"), chapters=chapters, feedback=F.lit("bad")).first().prompt == "base\n\nmore\n\nCh: units 1-1, 9 characters\n\nThe last answer had these faults: bad"
    assert chunking.rendered(talk, kind=F.lit("transcript")).first().rendered == "[0] [00:01] a\n\n\n[1] [00:05] b"
    points = F.array(F.struct(F.lit(1).alias("before_unit"), F.lit("b").alias("anchor"), F.lit("H").alias("heading")))
    assert chunking.rendered(talk, points, kind=F.lit("transcript")).first().rendered == "[00:01] a\n\n\n## H\n<!-- anchor: b -->\n\n[00:05] b"
    head = spark.createDataFrame([(1, "---\na: b: c\nno\n---\nbody")], "doc_id long, text string")
    row = chunking.front_matter(head).first()
    assert row.pairs == {"a": "b: c"} and row.body_start == 19


def test_candidates(spark):
    docs = spark.createDataFrame([(1, "One | two. Three.")], "doc_id long, text string")
    table = chunking.candidate_table(chunking.chunks(docs, title=F.lit("a|b"))).first().table
    assert table.endswith("| 0 | 22 |  | a\\|b | One \\| two. Three. |")


def test_streaming_capture(spark, tmp_path):
    from grainery.streaming import ingest

    rows = [("u", "url", "t"), ("u", "url", "t"), (None, "pasted", "t"), (None, "pasted", "t"), ("z", "odd", "t")]
    spark.createDataFrame([(*r, NOW) for r in rows], "url string, source_type string, raw_text string, ingested_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, source_type string, raw_text string, ingested_at timestamp").parquet(str(tmp_path / "in"))
    ingest.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    known = spark.createDataFrame([("u",), (None,), ("",)], "url string")
    ingest.start(stream, str(tmp_path / "out2"), str(tmp_path / "cp2"), known=known).awaitTermination()
    assert [r.url for r in spark.read.parquet(str(tmp_path / "out2")).collect()] == [None, None]


def test_command_line(spark, tmp_path, capsys):
    from grainery.__main__ import main

    (tmp_path / "a.md").write_text("# T\n\nOne. Two.\n")
    assert main(["chunk", str(tmp_path / "a.md"), "--title", "T"]) == 0 and "| 0 |" in capsys.readouterr().out
    assert main(["chunk", str(tmp_path / "none.md")]) == 1 and main(["video-id", "x"]) == 1
    assert main(["video-id", "https://youtu.be/abcdefghijk"]) == 0 and main(["query", "nothing", "."]) == 1
    assert main(["tools"]) == 0 and '"name": "grainery_embed"' in capsys.readouterr().out
    assert main(["chunk"]) == 2 and main(["headings", str(tmp_path / "a.md")]) == 0 and '[1] One.' in capsys.readouterr().out
    none = str(tmp_path / "none")
    assert main(["embed", "a", "b", "--provider", "hashed", "--settings", none]) == 0 and '["768 numbers", "768 numbers"]' in capsys.readouterr().out
    assert main(["embed", "a", "--settings", none]) == 1 and main(["embed", "a", "--provider", "odd"]) == 1
    (tmp_path / "c.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nhello\n")
    (tmp_path / "m.json").write_text('{"title":"T","channel":"C","duration":5}')
    capsys.readouterr()
    assert main(["captions", str(tmp_path / "c.vtt"), "--video-id", "v", "--metadata", str(tmp_path / "m.json")]) == 0
    said = capsys.readouterr().out
    assert '"text": "[00:01] hello"' in said and '"title": "T"' in said
    kept = str(tmp_path / "kept")
    for duplicate in ("false", "true"):
        assert main(["capture", str(tmp_path / "a.md"), "--store", kept, "--url", "u", "--source-type", "url"]) == 0 and f'"document_id": 1, "duplicate": {duplicate}' in capsys.readouterr().out
    assert main(["chunk", "--store", kept, "--document-id", "1"]) == 0 and "| 0 |" in capsys.readouterr().out and main(["chunk", "--store", kept, "--document-id", "9"]) == 1
    (tmp_path / "p.json").write_text('[{"before_unit": 1, "anchor": "One", "heading": "H"}]')
    (tmp_path / "g.json").write_text('{"H": 3.5}')
    assert main(["evaluate", str(tmp_path / "a.md"), "--points", str(tmp_path / "p.json"), "--grades", str(tmp_path / "g.json"), "--report", str(tmp_path / "rep")]) == 0 and '"mean_score": 3.5' in capsys.readouterr().out


def test_sorted_observations(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "a", False), (2, 1, "b", True)], "id long, entity_id long, attribute string, superseded boolean")
    memory.write_observations(rows, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).filter("entity_id = 1").count() == 1


@pytest.mark.parametrize(("adaptive", "partitions"), [("true", "4"), ("true", "200"), ("false", "4")])
def test_ids_of_large_batches(spark, tmp_path, adaptive, partitions):
    """Every row is written, with dense ids, also where adaptive execution cuts the partitions anew in each run of a plan."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        n = F.col("id")
        rows = spark.range(20_000).select((n * 7919 % 20_000).alias("position"), F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), n.cast("string"))).alias("url"))
        table = spark.createDataFrame([(41,)], "id bigint")
        store.number(rows, table, ["position"]).write.parquet(str(tmp_path / "a"))
        assert sorted((r.id, r.position) for r in spark.read.parquet(str(tmp_path / "a")).collect()) == [(42 + i, i) for i in range(20_000)]
        batch = rows.withColumnRenamed("position", "arrival").withColumn("source_type", F.lit("url")).withColumn("raw_text", F.lit("x"))
        added, again, rejects = store.capture(batch, schemas.empty(spark, "documents"))
        added.write.parquet(str(tmp_path / "b"))
        first = min(r.arrival for r in batch.filter("url = 'hot'").collect())
        got = {r.url: r.id for r in spark.read.parquet(str(tmp_path / "b")).collect()}
        assert sorted(got.values()) == list(range(1, len(got) + 1)) and len(got) == 20_000 - 6667 + 1
        assert again.count() == 6666 and {r.document_id for r in again.collect()} == {got["hot"]} and again.filter(F.col("arrival") == first).count() == 0 and rejects.count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
