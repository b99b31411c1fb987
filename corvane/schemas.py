"""Explicit schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


LANGUAGES = ("en", "fr")
KINDS = ("rct", "art", "anx", "sec")
STRATEGIES = ("fixed", "structural")
ROUTES = ("lookup", "complex", "out_of_scope")
MODES = ("rag", "agent")
FORMATS = ("eurlex-xhtml", "pdf")

PARAGRAPH = struct(label=S, text=S)
PROVISIONS = struct(provision_id=S, document_id=S, source_id=S, language=S, kind=S, number=S, title=S, breadcrumb=T.ArrayType(S), paragraphs=T.ArrayType(PARAGRAPH), ord=I)
DOCUMENTS = struct(document_id=S, source_id=S, language=S, title=S, url=S, sha256=S, fetched_at=TS)
CHUNKS = struct(chunk_id=S, document_id=S, source_id=S, language=S, strategy=S, ord=I, header=S, text=S, token_count=I, provision_ids=T.ArrayType(S))
POSTINGS = struct(document_id=S, strategy=S, language=S, id=S, term=S, tf=L, len=I)
BOUNDS = struct(document_id=S, strategy=S, language=S, term=S, most=D, base=D)
TERMS = struct(strategy=S, language=S, term=S, df=L)
TOTALS = struct(strategy=S, language=S, n=L, tokens=L)
LENGTHS = struct(document_id=S, strategy=S, language=S, id=S, len=I)
EMBEDDING_CACHE = struct(text_sha256=S, model=S, dimensions=I, vector=T.ArrayType(T.FloatType()))
CHUNK_EMBEDDINGS = struct(chunk_id=S, model=S, text_sha256=S)
SOURCES = struct(id=S, title=S, short_title=S, format=S, languages=T.ArrayType(S), license=S, attribution=S, celex=S, urls=T.MapType(S, S))
DOWNLOADS = struct(source_id=S, language=S, url=S, filename=S, sha256=S, size_bytes=L, fetched_at=TS)
REFERENCE = struct(kind=S, number=S, paragraph=S, source_id=S)
CASES = struct(id=S, question=S, language=S, category=S, expected_provisions=T.ArrayType(S), reference_answer=S, expect_abstention=B, expected_route=S, reviewed=B, notes=S)
HUMAN_LABELS = struct(case_id=S, faithfulness=I, correctness=I)
CASE_RESULT = struct(
    id=S, category=S, language=S, abstained=B, citations=T.ArrayType(S), faithfulness=I, correctness=I, unsupported=T.ArrayType(S), citation_precision=D, citation_recall=D,
    abstention_correct=B, route=S, route_correct=B, steps=I, cost_usd=D, latency_seconds=D, answer=S,
)
RUN = struct(summary=T.MapType(S, S), cases=T.ArrayType(CASE_RESULT))
USAGE = struct(input_tokens=L, output_tokens=L, cache_read_tokens=L, cache_write_tokens=L)
PRICES = struct(model=S, input_per_mtok=D, output_per_mtok=D)
ANSWER = struct(answer=S, citations=T.ArrayType(S), abstained=B)
ROUTE_DECISION = struct(route=S, reason=S)
FAITHFULNESS = struct(score=I, unsupported=T.ArrayType(S))
CORRECTNESS = struct(score=I, reason=S)
AUDIT = struct(trace_id=S, parent=S, name=S, type=S, input=S, output=S, metadata=T.MapType(S, S), cost_usd=D)
THREAD_STATE = struct(thread_id=S, turns=L, messages=T.ArrayType(S), provisions=T.ArrayType(S), last_answer=S)
TOOLS = {
    "search_regulations": struct(query=S, limit=I),
    "get_provision": struct(provision_id=S),
    "get_definition": struct(term=S),
    "submit_answer": struct(answer=S, citations=T.ArrayType(S), abstained=B),
}
ASK_REQUEST = struct(question=S, language=S, k=I)
ASK_RESPONSE = struct(answer=S, language=S, citations=T.ArrayType(S), abstained=B, cost_usd=D, trace_id=S)
AGENT_RESPONSE = struct(
    text=S, language=S, route=S, citations=T.ArrayType(S), abstained=B, steps=I, input_tokens=L, output_tokens=L, cost_usd=D, provisions_seen=T.ArrayType(S), halted_by=S, thread_id=S, trace_id=S,
)
