"""Command line: ``python -m corvane COMMAND``."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import uuid

from .config import Settings

VERSION = "0.2"


def _tables(args: argparse.Namespace):
    from .operators.store import Tables
    from .session import session

    spark = session(master=args.master)
    spark.sparkContext.setLogLevel("ERROR")
    return Tables(spark, args.tables)


def ingest(args: argparse.Namespace) -> None:
    """Parse stored XHTML acts named in the manifest, cut and store them."""
    from pyspark.sql import functions as F

    from .plans.corpus import ingest as run
    from .sources.fetch import chosen, fetch
    from .sources.files import downloads_wanted, raw_bytes, read_sources
    from .sources.markup import failures, parse_acts

    tables = _tables(args)
    sources = chosen(read_sources(tables.spark, args.sources), args.source)
    wanted = downloads_wanted(sources).join(sources.select(F.col("id").alias("source_id"), "title", "short_title"), "source_id")
    if args.fetch:
        for x in fetch(downloads_wanted(sources), args.raw, force=args.force):
            print(("fetched " if x.changed else "unchanged ") + x.record["filename"])
    # A manifest is a handful of rows.
    files = raw_bytes(tables.spark, args.raw, "*.xhtml").join(F.broadcast(wanted), "filename")
    documents = files.select(F.concat_ws(":", "source_id", "language").alias("document_id"), "source_id", "language", "title", "url", "sha256", F.current_timestamp().alias("fetched_at"))
    for r in failures(files).collect():
        print(f"not read: {r['document_id']}: {r['error']}")
    run(tables, documents, parse_acts(files), Settings(chunk_strategy=args.strategy)).show(truncate=False)


def index(args: argparse.Namespace) -> None:
    from .plans.corpus import index as run

    run(_tables(args)).show(truncate=False)


def search(args: argparse.Namespace) -> None:
    from .functions.text import snippet
    from .plans.corpus import Searcher

    tables = _tables(args)
    asked = tables.spark.createDataFrame([(1, args.question, args.language)], "qid int, text string, language string")
    hits = Searcher(tables, Settings(chunk_strategy=args.strategy)).search(asked, limit=args.k)
    hits.orderBy("rank").select("rank", "score", "header", snippet(hits["text"]).alias("text")).show(args.k, truncate=False)


class _Offline:
    """What runs without a model use: the best passage as the answer."""

    @staticmethod
    def complete(question, context):
        from .operators.answers import extractive

        return extractive(question, context)


def _functions(args: argparse.Namespace):
    """The object that ``--functions module:name`` names: complete, and where it has them router, model, faithfulness, correctness."""
    if not args.functions:
        return _Offline
    module, _, name = args.functions.partition(":")
    return getattr(importlib.import_module(module), name)


def _tracer(args: argparse.Namespace, tables):
    from .operators.tracing import Tracer

    return Tracer(tables, args.trace, args.trace_rate)


def _agent(args: argparse.Namespace, tables, language: str, tracer):
    from .plans.agent import assembled
    from .plans.corpus import Searcher
    from .schemas import PROVISIONS

    settings = Settings(chunk_strategy=args.strategy)
    return assembled(Searcher(tables, settings), tables.read("provisions", PROVISIONS), language, _functions(args), settings, tracer)


def _asked(args: argparse.Namespace, tables, question: str, language: str | None, k: int | None, tracer) -> dict:
    from .operators.answers import answered
    from .plans.corpus import Searcher

    search = Searcher(tables, Settings(chunk_strategy=args.strategy))
    asked = tables.spark.createDataFrame([(1, question, language)], "qid int, text string, language string")
    with tracer.trace("ask", language=language) as trace_id, tracer.span("answer", given=question) as found:
        hits = search.search(asked, limit=k).withColumnRenamed("header", "breadcrumb")
        row = answered(search.questions(asked).select("qid", "text", "language"), hits, _functions(args).complete).first()
        found["output"] = row.answer
    return {"answer": row.answer, "language": row.language, "citations": list(row.citations), "abstained": row.abstained, "cost_usd": 0.0, "trace_id": trace_id}


def _run_agent(args: argparse.Namespace, tables, question: str, language: str | None, thread: str | None, tracer) -> dict:
    from pyspark.sql import functions as F

    from .functions.text import detect_language

    language = language or tables.spark.createDataFrame([(question,)], "q string").select(detect_language(F.col("q"))).first()[0]
    agent = _agent(args, tables, language, tracer)
    thread = thread or uuid.uuid4().hex
    with tracer.trace("agent", session=thread) as trace_id:
        run = agent.ask(question, language, thread)
    kept = ("route", "citations", "abstained", "steps", "input_tokens", "output_tokens", "cost_usd", "halted_by")
    return {"text": run.answer, "language": language, **{k: getattr(run, k) for k in kept}, "provisions_seen": agent.seen.provisions, "thread_id": thread, "trace_id": trace_id}


def _print_trace(tracer) -> None:
    if tracer.enabled:
        print(f"trace rows written: {tracer.flush()} ({tracer.status.reason})")


def ask(args: argparse.Namespace) -> None:
    """Answer one question from the best passages."""
    tables = _tables(args)
    tracer = _tracer(args, tables)
    print(json.dumps(_asked(args, tables, args.question, args.language, args.k, tracer), ensure_ascii=False, indent=2))
    _print_trace(tracer)


def agent(args: argparse.Namespace) -> None:
    """Ask the agent one question."""
    tables = _tables(args)
    tracer = _tracer(args, tables)
    print(json.dumps(_run_agent(args, tables, args.question, args.language, args.thread, tracer), ensure_ascii=False, indent=2))
    _print_trace(tracer)


def serve(args: argparse.Namespace) -> None:
    """Answer requests over HTTP until interrupted."""
    from .api import Resources, server

    tables = _tables(args)
    tracer = _tracer(args, tables)
    resources = Resources(lambda q, lang, k: _asked(args, tables, q, lang, k, tracer), lambda q, lang, thread: _run_agent(args, tables, q, lang, thread, tracer), {"tables": args.tables})
    with server(resources, args.host, args.port) as running:
        print(f"http://{args.host}:{running.server_address[1]}", flush=True)
        running.serve_forever()


def eval_answers(args: argparse.Namespace) -> None:
    """Answer a set of cases, judge the answers where there are judges, and write a report."""
    from pyspark.sql import functions as F

    from .functions.text import provision_text
    from .operators.evaluation import by_category, run_summary
    from .plans import runs
    from .plans.corpus import Searcher
    from .schemas import PROVISIONS
    from .sources.files import read_cases, write_report

    tables = _tables(args)
    functions, tracer = _functions(args), _tracer(args, tables)
    judges = runs.Judges(functions.faithfulness, functions.correctness) if hasattr(functions, "faithfulness") else None
    cases = read_cases(tables.spark, args.cases)
    if args.mode == "agent":
        own = tables.read("provisions", PROVISIONS).select("provision_id", "language", provision_text(F.col("paragraphs")).alias("text"))
        found = runs.agent_run(_agent(args, tables, "en", tracer), cases, own, judges, args.limit, tracer)
    else:
        found = runs.answer_run(Searcher(tables, Settings(chunk_strategy=args.strategy)), cases, functions.complete, judges, args.limit)
    found = found.persist()
    print(f"reviewed: {runs.review_rate(runs.sliced(cases, args.limit)).first()['review_rate']:.2f}")
    print(write_report(run_summary(found), found, by_category(found), args.out, args.functions or "none", args.cases))
    _print_trace(tracer)


def eval_retrieval(args: argparse.Namespace) -> None:
    from .functions.report import scores_table
    from .plans.corpus import Searcher
    from .sources.files import read_cases

    tables = _tables(args)
    rows = Searcher(tables, Settings(chunk_strategy=args.strategy)).evaluate(read_cases(tables.spark, args.cases), args.k).orderBy("config").collect()
    print(scores_table([r.asDict() for r in rows]))


def eval_calibrate(args: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from .functions.report import agreement_table
    from .operators.evaluation import agreement
    from .sources.files import read_labels, read_run_cases

    tables = _tables(args)
    human = read_labels(tables.spark, args.labels).select(F.col("case_id").alias("id"), F.col("faithfulness").alias("hf"), F.col("correctness").alias("hc"))
    both = read_run_cases(tables.spark, args.run).join(human, "id")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("judge"), F.col(h).alias("human")) for m, h in (("faithfulness", "hf"), ("correctness", "hc"))])
    print(agreement_table([r.asDict() for r in agreement(both.select(F.explode(pairs).alias("p")).select("p.*")).orderBy("metric").collect()]))


def info(args: argparse.Namespace) -> None:
    print(json.dumps(Settings.from_env().public(), indent=2, default=str))


def main(argv: list[str] | None = None) -> int:
    if hasattr(sys.stdout, "reconfigure"):
        sys.stdout.reconfigure(encoding="utf-8")
    parser = argparse.ArgumentParser("corvane")
    parser.add_argument("--tables", default="data/tables")
    parser.add_argument("--master", default=None)
    parser.add_argument("--strategy", default="structural", choices=["fixed", "structural"])
    parser.add_argument("--functions", default=None, help="module:name of the model's functions")
    parser.add_argument("--trace", action="store_true")
    parser.add_argument("--trace-rate", type=float, default=1.0)
    parser.add_argument("--version", action="version", version=f"corvane {VERSION}")
    commands = parser.add_subparsers(required=True)
    for run, options in (
        (ingest, {"sources": {}, "raw": {}, "--source": {"action": "append"}, "--fetch": {"action": "store_true"}, "--force": {"action": "store_true"}}), (index, {}), (search, {"question": {}, "--language": {"default": None}, "-k": {"type": int, "default": 8}}),
        (eval_retrieval, {"cases": {}, "-k": {"type": int, "default": 5}}), (eval_calibrate, {"run": {}, "labels": {}}), (info, {}),
        (ask, {"question": {}, "--language": {"choices": ["en", "fr"]}, "-k": {"type": int}}), (agent, {"question": {}, "--language": {"choices": ["en", "fr"]}, "--thread": {}}),
        (serve, {"--host": {"default": "127.0.0.1"}, "--port": {"type": int, "default": 8000}}), (eval_answers, {"cases": {}, "out": {}, "--mode": {"choices": ["rag", "agent"], "default": "rag"}, "--limit": {"type": int}}),
    ):
        command = commands.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        for name, more in options.items():
            command.add_argument(name, **more)
        command.set_defaults(command=run)
    args = parser.parse_args(argv)
    args.command(args)
    return 0
