"""Command line over files and a store.

    python -m grainery chunk notes.md --kind article --title "Notes"
    python -m grainery chunk --store data --document-id 3
    python -m grainery headings talk.txt --kind transcript
    python -m grainery embed "a text" --kind query --provider hashed
    python -m grainery captions captions.vtt --video-id abcdefghijk --metadata tool.json
    python -m grainery capture notes.md --store data --source-type file
    python -m grainery evaluate notes.md --points points.json --grades grades.json --report eval
    python -m grainery video-id https://youtu.be/abcdefghijk
    python -m grainery query search_result /root/testdata/sf0.001 --rows 10
    python -m grainery tools

Prints a table or JSON; the exit code is 0 on success, 1 on an error value, 2 on wrong arguments.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("grainery").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _say(answer: dict) -> int:
    print(json.dumps(answer, ensure_ascii=False, default=str))
    return int(not answer["ok"])


def _read(path: str):
    """The file's rows (path, text), or None after its error was printed."""
    from grainery.sources import files

    found = files.read_texts(_session(), path)
    error = found.filter("error IS NOT NULL").select("error").first()
    if error is None:
        return found
    _say({"ok": False, "path": path, "error": error[0]})
    return None


def _chunk(args: argparse.Namespace) -> int:
    from grainery import schemas
    from grainery.operators import chunking

    if (args.path is None) == (args.document_id is None):
        print("give either a path or --document-id", file=sys.stderr)
        return 2
    if args.path is None:
        spark = _session()
        documents = schemas.create_store(spark, args.store)["documents"]
        chunks, sums = chunking.stored(documents, spark.createDataFrame([(args.document_id,)], "id bigint"))
        key = "document_id"
    else:
        found, key = _read(args.path), "path"
        if found is None:
            return 1
        options = {"kind": F.lit(args.kind), "title": F.lit(args.title), "channel": F.lit(args.channel)}
        chunks, sums = chunking.chunks(found, key, **options), chunking.summaries(found, key, **options)
    failed = [_say({"ok": False, key: row[0], "error": row[1]}) for row in sums.filter("NOT ok").select(key, "error").collect()]
    for row in chunking.candidate_table(chunks, key).toLocalIterator():
        print(row.table)
    return int(bool(failed))


def _headings(args: argparse.Namespace) -> int:
    """What a heading provider would be told about a file."""
    from grainery.operators import chunking

    if (found := _read(args.path)) is None:
        return 1
    told = chunking.prompts(found, args.base, key="path", kind=F.lit(args.kind), feedback=F.lit(args.feedback))
    units = chunking.rendered(found, key="path", kind=F.lit(args.kind))
    rows = told.join(units, "path").collect()
    return max([_say({"ok": bool(r.rendered), "path": r.path, "prompt": r.prompt, "units": r.rendered} | ({} if r.rendered else {"error": "empty document"})) for r in rows], default=1)


def _embed(args: argparse.Namespace) -> int:
    from grainery.sources import providers

    settings = providers.read_settings(args.settings)
    try:
        source = providers.provider(args.provider or settings.get("EMBED_PROVIDER"), args.url or settings.get("EMBED_URL", ""), args.model or settings.get("EMBED_MODEL", ""))
    except providers.Failed as why:
        return _say({"ok": False, "error": str(why)})
    answer = providers.embed(source, args.texts, args.kind)
    return _say(answer | ({"vectors": [f"{len(v)} numbers" for v in answer["vectors"]]} if answer["ok"] else {}))


def _captions(args: argparse.Namespace) -> int:
    from grainery.operators import captions

    if (found := _read(args.path)) is None:
        return 1
    segments = captions.parse_vtt(found.select(F.lit(args.video_id).alias("video_id"), F.col("text").alias("vtt")))
    output = _session().createDataFrame([], "video_id string, output string")
    if args.metadata:
        if (told := _read(args.metadata)) is None:
            return 1
        output = told.select(F.lit(args.video_id).alias("video_id"), F.col("text").alias("output"))
    row = captions.captured(segments.limit(0), segments, output).first()
    return _say({"ok": True} | row.asDict(recursive=True) if row is not None else {"ok": False, "error": "no captions"})


def _capture(args: argparse.Namespace) -> int:
    from grainery import schemas
    from grainery.operators import store

    if (found := _read(args.path)) is None:
        return 1
    documents = schemas.create_store(_session(), args.store)["documents"]
    batch = found.select("path", F.lit(args.url).alias("url"), F.lit(args.title).alias("title"), F.lit(args.source_type).alias("source_type"), F.col("text").alias("raw_text"), F.current_timestamp().alias("ingested_at"))
    added, again, rejects = store.capture(batch, documents, "path")
    added.select(*schemas.DOCUMENTS.fieldNames()).write.mode("append").parquet(f"{args.store}/documents")
    answers = [{"ok": True, "document_id": r.id, "duplicate": False} for r in added.collect()] + [{"ok": True, "document_id": r.document_id, "duplicate": True} for r in again.collect()]
    return max([_say(x) for x in answers + [{"ok": False, "error": r.error} for r in rejects.collect()]], default=1)


def _evaluate(args: argparse.Namespace) -> int:
    """Check and grade given headings of a file, and append the report."""
    from grainery.operators import evaluation
    from grainery.sources import files, providers

    if (found := _read(args.path)) is None:
        return 1
    with open(args.points, encoding="utf-8") as file:
        points = json.load(file)
    with open(args.grades, encoding="utf-8") as file:
        judge = providers.ScriptedJudge(json.load(file))
    each = [F.struct(F.lit(int(p["before_unit"])).alias("before_unit"), F.lit(p.get("anchor", "")).alias("anchor"), F.lit(p["heading"]).alias("heading")) for p in points]
    given = F.array(*each) if each else F.lit(None).cast("array<struct<before_unit:int,anchor:string,heading:string>>")
    scored = evaluation.score_run(found, given, judge, "path", kind=F.lit(args.kind))
    files.write_texts(evaluation.report(scored, args.run, "path").orderBy("part", "path").select("text").coalesce(1), args.report)
    total = scored.agg(F.count("*"), F.sum(F.col("doc_average") * F.col("n_scored")) / F.sum("n_scored")).first()
    return _say({"ok": True, "run": args.run, "documents": total[0], "mean_score": total[1], "report": args.report})


def _video(args: argparse.Namespace) -> int:
    from grainery.functions import text as X

    found = _session().range(1).select(X.video_id(F.lit(args.url))).first()[0]
    return _say({"ok": True, "video_id": found} if found else {"ok": False, "error": "no video id in this address"})


def _query(args: argparse.Namespace) -> int:
    from grainery.plans import registry

    if args.name not in registry.QUERIES:
        return _say({"ok": False, "error": f"unknown query; known: {', '.join(sorted(registry.QUERIES))}"})
    registry.QUERIES[args.name](_session(), args.tables).show(args.rows, truncate=80)
    return 0


def _tools(args: argparse.Namespace) -> int:
    """The contract of each command: what it does and takes."""
    commands = next(a for a in _parser()._actions if isinstance(a, argparse._SubParsersAction)).choices
    kinds = {int: "integer", None: "string"}
    for name, command in commands.items():
        inputs = {a.dest: {"type": "array" if a.nargs == "+" else kinds[a.type], "required": a.required} for a in command._actions if a.dest != "help"}
        print(json.dumps({"name": f"grainery_{name.replace('-', '_')}", "description": command.description, "input": inputs}))
    return 0


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="grainery", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    kinds = {"choices": ("article", "transcript"), "default": "article"}
    chunk = commands.add_parser("chunk", description="Cut a file or a stored document into chunks.")
    chunk.add_argument("path", nargs="?")
    chunk.add_argument("--store", default="store")
    chunk.add_argument("--document-id", type=int)
    chunk.add_argument("--kind", **kinds)
    chunk.add_argument("--title", default="")
    chunk.add_argument("--channel", default="")
    headings = commands.add_parser("headings", description="Show what a heading provider is told about a file.")
    headings.add_argument("path")
    headings.add_argument("--kind", **kinds)
    headings.add_argument("--base", default="Propose headings for the numbered units.")
    headings.add_argument("--feedback")
    embed = commands.add_parser("embed", description="Turn texts into vectors.")
    embed.add_argument("texts", nargs="+")
    embed.add_argument("--kind", default="document")
    for option in ("--provider", "--url", "--model"):
        embed.add_argument(option)
    embed.add_argument("--settings", default=".env")
    captions = commands.add_parser("captions", description="Make a transcript of a caption file.")
    captions.add_argument("path")
    captions.add_argument("--video-id", required=True)
    captions.add_argument("--metadata")
    capture = commands.add_parser("capture", description="Store a file as a document.")
    capture.add_argument("path")
    capture.add_argument("--store", default="store")
    capture.add_argument("--source-type", default="file")
    capture.add_argument("--url")
    capture.add_argument("--title", default="")
    evaluate = commands.add_parser("evaluate", description="Check and grade a file's headings, and append a report.")
    evaluate.add_argument("path")
    evaluate.add_argument("--kind", **kinds)
    for option in ("--points", "--grades", "--report"):
        evaluate.add_argument(option, required=True)
    evaluate.add_argument("--run", default="run")
    video = commands.add_parser("video-id", description="Find the id in a video's address.")
    video.add_argument("url")
    query = commands.add_parser("query", description="Run a query of the catalogue.")
    query.add_argument("name")
    query.add_argument("tables")
    query.add_argument("--rows", type=int, default=20)
    commands.add_parser("tools", description="List the commands and what they take.")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    commands = {"chunk": _chunk, "headings": _headings, "embed": _embed, "captions": _captions, "capture": _capture, "evaluate": _evaluate, "video-id": _video, "query": _query, "tools": _tools}
    return commands[args.command](args)


if __name__ == "__main__":
    sys.exit(main())
