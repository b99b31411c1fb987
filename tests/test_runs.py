"""Answer runs, judges, traces, embedders, fetching, PDF lines, the service, and replacement in stored tables."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from corvane import api
from corvane.cli import main
from corvane.functions import embedding, tools
from corvane.functions.stem import stem_tokens
from corvane.operators import answers, chunking, evaluation, lexical, store
from corvane.operators.tracing import Tracer, in_current_trace
from corvane.plans import runs
from corvane.plans.agent import Agent, Seen, Tool
from corvane.plans.corpus import Searcher, index, ingest
from corvane.schemas import AUDIT, CASES, CHUNKS, DOCUMENTS, LENGTHS, POSTINGS, PROVISIONS
from corvane.sources import fetch, files, markup

from .test_operators import ACT


def stored(spark, folder):
    tables = store.Tables(spark, str(folder))
    acts = spark.createDataFrame([(bytearray(ACT.encode()), "gdpr", "en", "Act")], "content binary, source_id string, language string, short_title string")
    documents = spark.createDataFrame([("gdpr:en", "gdpr", "en", "Act", "u", "h", None)], DOCUMENTS)
    ingest(tables, documents, markup.parse_acts(acts))
    index(tables)
    return tables, documents


def test_replacement_deletes_and_commits_at_once(spark, tmp_path):
    tables, documents = stored(spark, tmp_path)
    before = tables.catalog()
    other = spark.createDataFrame([("x:en", "x", "en", "Other", "u", "h", None)], DOCUMENTS)
    own = tables.read("provisions", PROVISIONS).limit(1).withColumns({"document_id": F.lit("x:en"), "source_id": F.lit("x"), "provision_id": F.lit("x:art:1")})
    ingest(tables, other, own)
    assert tables.read("chunks", CHUNKS).where("document_id = 'gdpr:en'").count() == 4 and tables.read("chunks", CHUNKS).count() == 5
    ingest(tables, documents, tables.read("provisions", PROVISIONS).limit(0))
    assert tables.count("provisions", PROVISIONS, document_id="gdpr:en") == 0 and tables.count("documents", DOCUMENTS) == 2
    assert {r.document_id for r in tables.read("chunks", CHUNKS).collect()} == {r.document_id for r in tables.read("postings", POSTINGS).collect()} == {"x:en"}
    assert tables.read("lengths", LENGTHS).count() == 1
    assert tables.vacuum() > 0 and tables.read("chunks", CHUNKS).count() == 1 and before != tables.catalog()


def test_search_reads_only_the_terms_asked_for(spark, tmp_path, monkeypatch):
    tables, _ = stored(spark, tmp_path)
    search = Searcher(tables)
    asked = search.questions(spark.createDataFrame([(1, "areas of the annex", "en")], "qid int, text string, language string"))
    own = search.lexical(asked)
    plan = own.postings._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(term" in plan.replace("IN(", "In(")
    hits = search.search(asked.select("qid", "text", "language"), signals=("bm25",)).collect()
    whole = lexical.build(search.chunks.select("id", "language", chunking.F.expr("array()").cast("array<string>").alias("t")), "id", "t", by=("language",))
    assert hits and whole.postings.count() == 0
    listed = {(r.id, r.term, r.tf) for r in own.postings.collect()}
    monkeypatch.setattr(lexical, "LISTED", 0)
    assert {(r.id, r.term, r.tf) for r in search.lexical(asked).postings.collect()} == listed


def cases(spark):
    return spark.createDataFrame([
        ("a", "What does Article 2 of the GDPR say?", "en", "lookup", ["gdpr:art:2"], "It says so.", False, "lookup", True, "", 0), ("b", "Article 1 of the GDPR?", "en", "lookup", ["gdpr:art:1"], None, False, "complex", False, "", 1), ("c", "nothing", "en", "none", [], "", True, None, None, "", 2),
    ], CASES.simpleString()[7:-1].replace(":", " ").replace("array<string>", "array<string>") + ", ord long")


def test_answer_run_and_judges(spark, tmp_path):
    tables, _ = stored(spark, tmp_path)
    judges = runs.Judges(
        lambda q, c, a: F.when(F.contains(c, a), F.lit('{"score": 2, "unsupported": []}')).otherwise(F.lit('{"score": 7}')), lambda q, r, a: F.lit("not JSON"),
    )
    out = {r.id: r for r in runs.answer_run(Searcher(tables), cases(spark), answers.extractive, judges).collect()}
    assert out["a"].citations == ["gdpr:art:2"] and out["a"].faithfulness == 2 and out["a"].correctness == 0 and out["a"].citation_recall == 1.0
    assert out["b"].correctness is None and out["a"].route_correct is None and out["a"].latency_seconds > 0
    summary = evaluation.run_summary(runs.answer_run(Searcher(tables), cases(spark), answers.extractive, None, limit=2)).first()
    assert summary.n == 2 and summary.faithfulness is None
    rate = runs.review_rate(cases(spark)).first()
    assert rate.n == 3 and abs(rate.review_rate - 1 / 3) < 1e-9 and runs.review_rate(cases(spark).limit(0)).first().review_rate == 0
    silent = runs.judged(spark.createDataFrame([("q", "c", "r", "a", True)], "question string, context string, reference_answer string, answer string, abstained boolean"), judges).first()
    assert silent.faithfulness is None and silent.correctness is None
    said = answers.telemetry(spark.createDataFrame([(1, "x", ["p"], ["z"], False)], "qid int, answer string, citations array<string>, invalid array<string>, abstained boolean"), "m").first()
    assert said.metadata["ended"] == "with dropped citations"


def test_agent_run_with_traces(spark, tmp_path):
    tables, _ = stored(spark, tmp_path)
    tracer = Tracer(tables, enabled=True, url="http://traces")
    seen = Seen()

    def look(query):
        seen.add(["gdpr:art:2", "gone:art:1"])
        return f"mail me at a.b@example.org about {query}"

    steps = iter([{"calls": [{"id": "1", "name": "look", "arguments": {"query": "x"}}]}, {"calls": [{"id": "2", "name": "submit_answer", "arguments": {"answer": "So.", "citations": ["gdpr:art:2"]}}]}] * 3)
    agent = Agent(lambda q: "complex", lambda m: next(steps), None, {"look": Tool("look", look), "submit_answer": Tool("submit_answer", lambda **_: "ok")}, seen, tracer=tracer)
    own = spark.createDataFrame([("gdpr:art:2", "en", "Text two.")], "provision_id string, language string, text string")
    judges = runs.Judges(lambda q, c, a: F.to_json(F.struct(F.when(F.contains(c, F.lit("Text two.")), 2).otherwise(1).alias("score"))), lambda q, r, a: F.lit('{"score": 1}'))
    out = {r.id: r for r in runs.agent_run(agent, cases(spark), own, judges, tracer=tracer).collect()}
    assert (out["a"].steps, out["a"].faithfulness, out["a"].correctness, out["a"].route_correct, out["b"].route_correct) == (2, 2, 1, False, True)
    assert tracer.flush() > 0 and tracer.flush() == 0
    rows = tables.read("audit", AUDIT).collect()
    tool = next(r for r in rows if r.name == "look")
    assert tool.type == "tool" and tool.parent == "tools" and "example.org" not in tool.output and len({r.trace_id for r in rows}) == 3
    assert "route --> agent: complex" in Agent.diagram()


def test_tracer_switches():
    assert not Tracer().status.enabled and "switched off" in Tracer().status.reason and not Tracer(None, True).status.enabled

    class Kept:
        spark = None

    tracer = Tracer(Kept(), True, rate=0.0)
    with tracer.trace("t"):
        tracer.record_span("x")
        assert tracer.current_trace_id() is None and tracer.trace_url() is None
    assert not tracer.rows
    tracer = Tracer(Kept(), True, url="http://u/")
    with tracer.trace("t", session="s") as own:
        assert tracer.current_trace_id() == own and tracer.trace_url() == f"http://u/{own}"
        with pytest.raises(ValueError), tracer.span("bad"):
            raise ValueError("no")
        tracer.record_generation("g", "m", "in", "out", 0.5, input_tokens=3)
        tracer.record_score("s", 1)
        assert tracer.observed("f")(lambda a: a + 1)(2) == 3
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(1) as pool:
            assert pool.submit(in_current_trace(tracer.current_trace_id)).result() == own
    assert [r[2] for r in tracer.rows] == ["t", "bad", "g", "s", "f"] and tracer.rows[1][6]["error"] == "ValueError: no" and tracer.rows[2][7] == 0.5


def test_embedder(spark):
    waits, asked = [], []

    def fails_twice(texts):
        asked.append(len(texts))
        if len(asked) < 3:
            raise OSError("busy")
        return [[3.0, 4.0]] * len(texts)

    assert embedding.call_with_retries(fails_twice, ["a"], 2, wait=waits.append) == [[3.0, 4.0]] and waits == [1.0, 2.0]
    for bad in (lambda t: [], lambda t: [[1.0]] * len(t)):
        with pytest.raises(embedding.EmbeddingBackendError):
            embedding.call_with_retries(bad, ["a", "b"], 2)
    vectors = embedding.embedder(lambda t: [[float(len(x)), 0.0] for x in t], 2, size=2)
    rows = spark.createDataFrame([(k, "x" * k) for k in range(5)], "k int, t string").select("k", vectors(F.col("t")).alias("v")).collect()
    assert {r.k: list(r.v) for r in rows} == {0: [0.0, 0.0], **{k: [1.0, 0.0] for k in range(1, 5)}}


def test_tool_schemas():
    own = tools.tool_schema("submit_answer")
    assert own["required"] == ["answer", "citations", "abstained"] and own["additionalProperties"] is False
    loose = {"title": "T", "properties": {"title": {"type": "string", "default": "x", "title": "Title"}, "n": {"properties": {"a": {}}}}, "required": []}
    assert tools.tightened(loose) == {"properties": {"title": {"type": "string"}, "n": {"properties": {"a": {}}, "required": ["a"], "additionalProperties": False}}, "required": ["title", "n"], "additionalProperties": False}


def test_fetch(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"id": s, "title": s, "short_title": s, "format": "pdf", "languages": ["en"], "urls": {"en": f"http://{s}"}} for s in ("one", "two")]}))
    sources = files.read_sources(spark, str(tmp_path / "m.json"))
    with pytest.raises(KeyError):
        fetch.chosen(sources, ["three"])
    wanted, asked = files.downloads_wanted(fetch.chosen(sources, ["two"])), []
    opener = lambda url, headers: asked.append(url) or b"%PDF-1.4 " + str(len(asked)).encode()
    first, again, forced = (fetch.fetch(wanted, str(tmp_path / "raw"), opener, force) for force in (False, False, True))
    assert [x[0].changed for x in (first, again, forced)] == [True, False, True] and asked == ["http://two"] * 2
    assert files.read_downloads(spark, str(tmp_path / "raw" / "manifest.json")).count() == 1


def test_pdf_lines(spark):
    text = b"BT /F1 12 Tf 72 700 Td (1. Scope \\(of it\\)) Tj 0 -14 Td [(Two ) -300 (words)] TJ T* <48656C6C6F> Tj ET"
    plain = b"%PDF-1.4\n4 0 obj << /Length 9 >>\nstream\n" + text + b"\nendstream endobj"
    packed = b"%PDF-1.4\n4 0 obj << /Filter /FlateDecode /Length 9 >>\nstream\n" + zlib.compress(text) + b"\nendstream endobj"
    rows = fetch.pdf_lines(spark.createDataFrame([("p", bytearray(plain)), ("z", bytearray(packed)), ("bad", bytearray(b"no")), ("none", None)], "filename string, content binary")).collect()
    for name in ("p", "z"):
        assert [r.text for r in rows if r.filename == name] == ["1. Scope (of it)", "Two words", "Hello"]
    assert {r.filename: r.error for r in rows if r.error} == {"bad": "not a PDF file", "none": "not a PDF file"}


def test_service():
    def broken(q, lang, thread):
        raise api.ModelError("no model")

    own = api.Resources(lambda q, lang, k: {"answer": q, "k": k}, broken, {"name": "x"})
    ask = lambda path, **body: api.handle(own, "POST", path, json.dumps(body).encode())
    assert api.handle(own, "GET", "/health", b"") == (200, {"status": "ok", "name": "x"})
    assert ask("/v1/ask", question="q", k=3) == (200, {"answer": "q", "k": 3}) and ask("/v1/agent", question="q")[0] == 502
    assert [ask("/v1/ask", **x)[0] for x in ({}, {"question": " "}, {"question": "q", "language": "de"}, {"question": "q", "k": 0})] == [422] * 4
    assert api.handle(own, "POST", "/v1/ask", b"[")[0] == 422 and ask("/else", question="q")[0] == 404
    import threading
    import urllib.request

    with api.server(own, port=0) as running:
        threading.Thread(target=running.serve_forever, daemon=True).start()
        with urllib.request.urlopen(f"http://127.0.0.1:{running.server_address[1]}/health") as reply:
            assert json.load(reply)["status"] == "ok"
        running.shutdown()


def test_parser_refuses_declarations_and_reports_failures(spark):
    plain = ACT if ACT.lstrip().startswith("<!DOCTYPE") else ACT.replace("<html", "<!DOCTYPE html><html", 1)
    rows = [(bytearray(x.encode()) if x else None, f"s{k}", "en", "S") for k, x in enumerate((plain, "<!DOCTYPE html [<!ENTITY a 'b'>]><html/>", "<html>", None))]
    acts = spark.createDataFrame(rows, "content binary, source_id string, language string, short_title string")
    assert {r.source_id for r in markup.parse_acts(acts).collect()} == {"s0"}
    assert {r.source_id for r in markup.failures(acts).collect()} == {"s1", "s2", "s3"}


def test_small_fixes(spark, tmp_path):
    stems = spark.createDataFrame([(["dying", "lying", "tying", "flying"],)], "t array<string>").select(stem_tokens(F.col("t"), F.lit("en")).alias("s")).first().s
    assert stems == ["die", "lie", "tie", "fli"]
    paragraphs = spark.createDataFrame([("p", 0, [(None, "Die STRASSE ist lang")])], "provision_id string, ord int, paragraphs array<struct<label:string,text:string>>")
    assert answers.definitions(paragraphs, spark.createDataFrame([("straße",)], "term string")).count() == 1
    (tmp_path / "l.jsonl").write_text("".join(json.dumps({"case_id": "a", "faithfulness": k % 3, "correctness": 0}) + "\n" for k in range(50)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert [r.faithfulness for r in files.read_labels(spark, str(tmp_path / "l.jsonl")).collect()] == [49 % 3]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tokenizer_as_token_counter(spark):
    public = pytest.importorskip("public_tokenizers")
    counter = chunking.tokenizer_counter(public.path("byte_bpe_50k.json"))
    rows = [("s:art:1", "s:en", "s", "en", "art", "1", None, ["S"], [(None, "Some words of a paragraph. " * 30), ("2", "short one"), (None, "tail")], 0)]
    provisions = spark.createDataFrame(rows, PROVISIONS)
    for strategy in ("structural", "fixed"):
        out = chunking.chunk(provisions, strategy, 40, 8, 4, counter).orderBy("ord").collect()
        assert len(out) > 3 and all(0 < r.token_count <= 45 for r in out)
        assert all(r.token_count <= chunking.chunk(provisions, strategy, 40, 8, 4).where(F.col("ord") == 0).first().token_count + 45 for r in out)


def test_command_line_answers(spark, tmp_path, capfd):
    stored(spark, tmp_path / "t")
    tables = ["--tables", str(tmp_path / "t"), "--trace"]
    assert main([*tables, "ask", "What does Article 2 of the GDPR say?", "--language", "en"]) == 0
    said = capfd.readouterr().out
    assert '"gdpr:art:2"' in said and "trace rows written: 2" in said
    assert main([*tables, "agent", "What does Article 2 of the GDPR say?"]) == 0
    assert '"route": "lookup"' in capfd.readouterr().out
    (tmp_path / "cases.jsonl").write_text('{"id":"a","question":"Article 2 of the GDPR?","language":"en","category":"c","expected_provisions":["gdpr:art:2"],"reviewed":true}\n')
    for mode in ("rag", "agent"):
        assert main([*tables, "eval-answers", str(tmp_path / "cases.jsonl"), str(tmp_path / mode), "--mode", mode]) == 0
        out = capfd.readouterr().out
        assert "reviewed: 1.00" in out
        run = json.loads(next((tmp_path / mode).glob("*/run.json")).read_text())
        assert run["summary"]["n"] == 1 and run["summary"]["citation_recall"] == 1.0 and run["cases"][0]["citations"] == ["gdpr:art:2"]
