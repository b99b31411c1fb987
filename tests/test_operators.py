"""Operators against plain Python on small fixtures."""

import json
import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.config import Settings
from corvane.functions import text as T
from corvane.functions.stem import english, french
from corvane.operators import answers, audit, chunking, evaluation, lexical, references, retrieval, store
from corvane.plans.corpus import Searcher, index, ingest
from corvane.schemas import CHUNKS, DOCUMENTS, PROVISIONS
from corvane.sources import files, markup, sections


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


# ------------------------------------------------------------------------------------------------ text


@pytest.mark.parametrize(("text", "language"), [
    ("Quelles sont les pratiques interdites par le reglement ?", "fr"), ("Which practices are prohibited?", "en"), ("Article 6", "en"), ("été", "fr"), ("", "en"), (None, "en"), ("article 6 paragraphe 2", "fr"),
])
def test_detect_language(spark, text, language):
    assert one(spark, T.detect_language(F.col("t")), t=text) == language


def test_tokens_and_stems(spark):
    assert one(spark, T.content_tokens(F.col("t"), F.lit("en")), t="Article 6.2 and Annex III of it’s") == ["article", "6.2", "annex", "iii", "s"]
    assert "l" not in one(spark, T.content_tokens(F.col("t"), F.lit("fr")), t="l'article et les systemes")
    a, b = (one(spark, T.analyse(F.col("t"), F.lit("en")), t=x) for x in ("providers deploying 12 systems", "provider deploys 12 system"))
    assert a == b
    assert french("traitements") == french("traitement") and english("relational") == "relat" and english("hopping") == "hop"


@pytest.mark.parametrize(("text", "want"), [
    ("mail jean.dupont@acme.fr now", "mail [EMAIL] now"), ("call 06 12 34 56 78", "call [PHONE]"), ("+44 20 7946 0958!", "[PHONE]!"), ("FR76 3000 6000 0112 3456 7890 189", "[IBAN]"), ("4111 1111 1111 1111", "[CARD]"), ("1 85 05 78 006 084 36", "[NIR]"),
    ("Article 6(2) of Regulation (EU) 2024/1689, 2 August 2026", "Article 6(2) of Regulation (EU) 2024/1689, 2 August 2026"),
])
def test_redaction(spark, text, want):
    assert one(spark, T.redact(F.col("t")), t=text) == want
    assert one(spark, T.redact(T.redact(F.col("t"))), t=text) == want
    assert one(spark, T.has_pii(F.col("t")), t=text) == (text != want)


def test_patches_are_sparse(spark):
    rows = spark.createDataFrame([(1, {"a": "x@y.org", "b": "fine"}), (2, {"b": "fine"})], "id int, attributes map<string,string>")
    assert [(r.id, r.attributes) for r in audit.patches(rows).collect()] == [(1, {"a": "[EMAIL]"})]


# ------------------------------------------------------------------------------------------------ references, search


@pytest.mark.parametrize(("text", "want"), [
    ("What does Article 6(2) say?", [("art", "6", "2", None)]), ("art. 5, paragraphe 3 du RGPD", [("art", "5", "3", "gdpr")]), ("article premier", [("art", "1", None, None)]), ("Annex iii and recital (47) of the AI Act", [("anx", "III", None, "ai_act"), ("rct", "47", None, "ai_act")]), ("nothing", []), (None, []),
])
def test_references(spark, text, want):
    rows = references.find_references(spark.createDataFrame([(1, text)], "qid int, text string")).orderBy("seq").collect()
    assert [(r.kind, r.number, r.paragraph, r.source_id) for r in rows] == want


def test_bm25_against_plain(spark):
    texts = {"a": "social scoring is prohibited social", "b": "high risk systems", "c": "scoring by public bodies", "d": ""}
    docs = spark.createDataFrame([(k, v.split()) for k, v in texts.items()], "id string, tokens array<string>")
    asked = spark.createDataFrame([(1, ["social", "scoring", "scoring", "zzz"]), (2, ["zzz"])], "qid int, tokens array<string>")
    got = {(r.qid, r.id): r.score for r in lexical.search(lexical.build(docs, "id", "tokens"), asked, 5).collect()}
    n, mean = 4, sum(len(v.split()) for v in texts.values()) / 4

    def score(words):
        tf = Counter(words)
        total = 0.0
        for t in ["social", "scoring", "scoring"]:
            df = sum(t in v.split() for v in texts.values())
            total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(words) / mean)) if tf[t] else 0
        return total

    assert got == {(1, k): round(score(texts[k].split()), 6) for k in ("a", "c")}


def test_fusion_takes_the_last_position_and_filters_after_the_cut(spark):
    ranks = spark.createDataFrame([(1, "reference", "x", 1), (1, "reference", "x", 3), (1, "dense", "x", 2), (1, "dense", "y", 1), (1, "dense", "z", 3)], "qid int, signal string, id string, position int")
    fused = retrieval.fuse(ranks, {"reference": 2.0, "dense": 1.0})
    got = {r.id: r.score for r in fused.collect()}
    assert got["x"] == round(2 / 63 + 1 / 62, 9) and got["y"] == round(1 / 61, 9)
    chunks = spark.createDataFrame([("x", "s", ["p"]), ("y", "s", ["p"]), ("z", "t", ["q"])], "id string, source_id string, provision_ids array<string>")
    assert [(r.id, r.rank) for r in retrieval.finish(fused, chunks, 8).orderBy("rank").collect()] == [("x", 1), ("z", 2)]
    assert [r.id for r in retrieval.finish(fused, chunks, 8, ["t"]).collect()] == ["z"]


# ------------------------------------------------------------------------------------------------ chunks


@settings(max_examples=25, deadline=None)
@given(n=st.integers(0, 60), size=st.integers(1, 12), data=st.data())
def test_windows_cover_everything(spark, n, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    starts = one(spark, chunking.window_starts(F.col("n"), size, overlap), n=n)
    assert set().union(*(range(s, min(n, s + size)) for s in starts)) == set(range(n))
    assert all(b - a == size - overlap for a, b in zip(starts, starts[1:], strict=False)) and (not starts or starts[-1] < n)


def test_bad_windows_are_refused():
    with pytest.raises(ValueError):
        chunking.window_starts(F.lit(3), 4, 4)


def provisions(spark, *texts, source="s"):
    rows = [(f"{source}:art:{k}", f"{source}:en", source, "en", "art", str(k), None, ["S", f"Article {k}"], [{"label": None, "text": p} for p in t.split("|")], k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, PROVISIONS)


def test_structural_chunks_pack_and_merge_tails(spark):
    w = lambda n: " ".join(["word"] * n)
    rows = chunking.structural_chunks(provisions(spark, f"{w(40)}|{w(40)}|{w(2)}", "short", f"{w(130)}|{w(3)}", ""), 53, 20).orderBy("ord").collect()
    assert [(r.provision_ids[0][-1], r.token_count) for r in rows] == [("0", 40), ("0", 42), ("1", 1), ("2", 49), ("2", 49), ("2", 35)]
    assert [r.chunk_id for r in rows][:2] == ["s:en:structural:0000", "s:en:structural:0001"] and rows[0].header == "S > Article 0"


def test_fixed_chunks_know_their_provisions(spark):
    rows = chunking.fixed_chunks(provisions(spark, "a b c", "d e", "f g h i"), 4, 1).orderBy("ord").collect()
    assert [r.text.split() for r in rows] == [["a", "b", "c", "d"], ["d", "e", "f", "g"], ["g", "h", "i"]]
    assert [[p[-1] for p in r.provision_ids] for r in rows] == [["0", "1"], ["1", "2"], ["2"]]


# ------------------------------------------------------------------------------------------------ sources

ACT = """<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml"><body>
<div id="rct_1"><table><tr><td><p>(1)</p></td><td><p>A purpose.</p></td></tr></table></div>
<div id="cpt_I"><p class="oj-ti-section-1">CHAPTER I</p><div class="eli-title"><p class="oj-ti-section-2">GENERAL</p></div>
<div id="art_1"><p class="oj-ti-art">Article 1</p><div class="eli-title" id="art_1.tit_1"><p class="oj-sti-art">Scope</p></div>
<div id="001.001"><p>1.   It lays down<a href="#n"> (<span class="oj-super oj-note-tag">1</span>)</a> rules:</p><table><tr><td><p>(a)</p></td><td><p>first;</p></td></tr></table><p class="oj-note">a note</p></div>
<div id="001.002"><p>2. It applies.</p></div></div>
<div id="art_2"><p class="oj-ti-art">Article 2</p><p>Terms:</p><table><tr><td><p>(1)</p></td><td><p>'system' means</p><table><tr><td><p>(a)</p></td><td><p>inner;</p></td></tr></table></td></tr></table></div></div>
<div id="anx_I"><p class="oj-doc-ti">ANNEX I</p><p class="oj-doc-ti">Areas</p><p>One area.</p></div></body></html>"""


def test_act_markup():
    rows = {r["provision_id"]: r for r in markup.provisions(ACT.encode(), "x", "en", "Act")}
    assert list(rows) == ["x:rct:1", "x:art:1", "x:art:2", "x:anx:I"]
    assert rows["x:rct:1"]["paragraphs"] == [{"label": None, "text": "A purpose."}]
    assert rows["x:art:1"]["breadcrumb"] == ["Act", "CHAPTER I — GENERAL", "Article 1 — Scope"]
    assert rows["x:art:1"]["paragraphs"] == [{"label": "1", "text": "It lays down rules:\n(a) first;"}, {"label": "2", "text": "It applies."}]
    assert [p["label"] for p in rows["x:art:2"]["paragraphs"]] == [None, "(1)", "(a)"]
    assert rows["x:anx:I"]["title"] == "Areas"
    twice = markup.provisions(ACT.encode(), "x", "en", "Act", compat=True)
    assert [p["label"] for p in twice[2]["paragraphs"]] == [None, "(1)", "(a)", "(a)"]
    with pytest.raises(ValueError):
        markup.provisions(b'<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>', "x", "en", "Act")


def test_sections(spark):
    text = "before any heading\n1. Scope ..... 3\n 12 \n1. Scope\nThis is the first line\n3.2 Conditions\nmore text\n1. Again\n207 https://x\n2. " + "word " * 14 + "end.\nlast"
    rows = spark.createDataFrame([(7, text)], "id int, text string")
    found = sections.sections(sections.lines(rows, ["id"]), ["id"], F.lit("Title")).orderBy("ord").collect()
    assert [(r.number, r.heading) for r in found] == [("1", "Title"), ("1-2", "Scope"), ("3.2", "Conditions"), ("1-3", "Again")]
    assert found[3].lines == ["207 https://x", "2. " + ("word " * 14) + "end.", "last"]
    joined = one(spark, sections.joined_lines(F.split("t", "\n")), t="a" * 150 + "\n" + "b" * 60 + ".\nc")
    assert joined == ["a" * 150 + " " + "b" * 60 + ".", "c"]


def test_files(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text('{"id":"a","question":"q","language":"en","category":"c"}\n\n{"id":"b","question":"r","expected_provisions":["x"]}\n')
    cases = files.read_cases(spark, str(tmp_path / "cases.jsonl")).orderBy("ord").collect()
    assert [(c.id, c.expected_provisions, c.reviewed) for c in cases] == [("a", [], False), ("b", ["x"], False)]
    (tmp_path / "labels.jsonl").write_text('{"case_id":"a","faithfulness":1}\n{"case_id":"a","faithfulness":2}\n')
    assert [r.faithfulness for r in files.read_labels(spark, str(tmp_path / "labels.jsonl")).collect()] == [2]
    manifest = {"sources": [{"id": "x", "title": "X", "short_title": "X", "format": "eurlex-xhtml", "languages": ["en", "fr"], "celex": "32000R0001"}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    sources = files.read_sources(spark, str(tmp_path / "m.json"))
    assert [(r.filename, r.accept_language) for r in files.downloads_wanted(sources).orderBy("filename").collect()] == [("x_en.xhtml", "eng"), ("x_fr.xhtml", "fra")]
    with pytest.raises(KeyError, match="known: x"):
        files.source(sources, "y")
    del manifest["sources"][0]["celex"]
    (tmp_path / "bad.json").write_text(json.dumps(manifest))
    with pytest.raises(ValueError):
        files.read_sources(spark, str(tmp_path / "bad.json"))
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x_en.xhtml").write_text(ACT)
    raw = files.raw_bytes(spark, str(tmp_path / "raw"))
    assert files.changed(raw, raw.select("filename", "sha256")).count() == 0 and files.changed(raw, raw.limit(0)).count() == 1


# ------------------------------------------------------------------------------------------------ evaluation, agent


def test_metrics(spark):
    rows = [("a", 1, ["x"], [["x"], ["y"]]), ("b", 2, ["x"], [["y"], ["x"]]), ("c", 3, ["x", "z"], [["q"], ["q"], ["z"]]), ("d", 4, ["x"], []), ("e", 5, [], [["y"]])]
    out = evaluation.retrieval_scores(spark.createDataFrame(rows, "id string, ord int, expected array<string>, retrieved array<array<string>>"), 2).first()
    assert (out.n, out.hit_rate, out.recall, out.mrr) == (5, 0.4, 0.5, 0.3) and out.misses == ["c", "d", "e"]
    assert math.isclose(out.ndcg, round((1 + 1 / math.log2(3)) / 5, 4))
    assert evaluation.retrieval_scores(spark.createDataFrame(rows, "id string, ord int, expected array<string>, retrieved array<array<string>>").limit(0), 2).first().hit_rate == 0.0


@pytest.mark.parametrize(("pairs", "kappa"), [([(0, 0), (1, 1), (2, 2)], 1.0), ([(2, 0), (2, 0)], 0.0), ([(2, 2), (2, 2)], 1.0), ([(0, 0), (0, 1), (1, 0), (1, 1)], 0.0)])
def test_kappa(spark, pairs, kappa):
    rows = spark.createDataFrame([("m", *p) for p in [*pairs, (None, 1)]], "metric string, judge int, human int")
    out = evaluation.agreement(rows).first()
    assert out.pairs == len(pairs) and out.kappa == kappa and out.usable == (kappa >= 0.4)


def test_citations_and_cost(spark):
    rows = spark.createDataFrame([(["[a]", " b", "a"], ["a", "c"])], "citations array<string>, allowed array<string>")
    out = answers.check_citations(rows).first()
    assert (out.valid, out.invalid, out.precision) == (["a"], ["b"], 0.5)
    for cited, expected, want in ((["a", "b"], ["a", "c"], (0.5, 0.5)), ([], [], (1.0, 1.0)), (["a"], [], (0.0, 1.0)), ([], ["a"], (0.0, 0.0))):
        p, r = evaluation.citation_scores(F.col("c"), F.col("e"))
        assert tuple(spark.createDataFrame([(cited, expected)], "c array<string>, e array<string>").select(p, r).first()) == want
    prices = spark.createDataFrame([("m", 5.0, 25.0)], "model string, input_per_mtok double, output_per_mtok double")
    usage = spark.createDataFrame([("m", 10**6, 10**6, 0, 0), ("m", 0, 0, 10**6, 0), ("m", 0, 0, 0, 10**6), ("other", 9, 9, 9, 9)], "model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long")
    assert sorted(r.cost_usd for r in evaluation.cost_usd(usage, prices).collect()) == [0.0, 0.5, 6.25, 30.0]


def test_upper_median(spark):
    for n, want in ((4, 3.0), (3, 2.0), (1, 1.0)):
        assert (evaluation.upper_median(spark.range(1, n + 1).select(F.col("id").cast("double").alias("v")), "v") or 0.0) == want


def test_repeats_across_turns_only(spark):
    calls = spark.createDataFrame([(1, 1, "s", "f"), (1, 1, "s", "f"), (1, 2, "s", "f"), (1, 3, "submit_answer", "g"), (1, 4, "submit_answer", "g"), (2, 9, "s", "f")], "thread_id int, turn int, name string, fingerprint string")
    assert sorted((r.thread_id, r.turn, r.repeated) for r in answers.repeats(calls).collect()) == [(1, 1, False), (1, 1, False), (1, 2, True), (1, 3, False), (1, 4, False), (2, 9, False)]


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "z")], "k int, v string")
    assert sorted(map(tuple, store.replaced(old, new, ["k"]).collect())) == [(1, "z"), (2, "c")]
    assert [r.k for r in store.repeated_keys(old, ["k"]).collect()] == [1]


def test_settings():
    with pytest.raises(ValueError):
        Settings(environment="Bad Name")


def test_ingest_index_search_answer(spark, tmp_path):
    tables = store.Tables(spark, str(tmp_path))
    acts = spark.createDataFrame([(bytearray(ACT.encode()), "gdpr", "en", "Act")], "content binary, source_id string, language string, short_title string")
    parsed = markup.parse_acts(acts).persist()
    documents = spark.createDataFrame([("gdpr:en", "gdpr", "en", "Act", "u", "h", None)], DOCUMENTS)
    report = ingest(tables, documents, parsed).first()
    assert (report.provisions, report.chunks) == (4, 4)
    ingest(tables, documents, parsed)
    assert tables.read("chunks", CHUNKS).count() == 4  # replaced, not doubled
    first, again = index(tables).first(), index(tables).first()
    assert (first.embedded, again.embedded, again.hit_rate) == (4, 0, 1.0)
    search = Searcher(tables)
    asked = spark.createDataFrame([(1, "What does Article 2 of the GDPR say?"), (2, "areas annex")], "qid int, text string")
    hits = search.search(asked, signals=("reference", "dense", "bm25")).orderBy("qid", "rank").collect()
    assert hits[0].provision_ids == ["gdpr:art:2"] and hits[0].matched_reference
    assert next(h for h in hits if h.qid == 2).provision_ids == ["gdpr:anx:I"]
    say = lambda q, c: F.to_json(F.struct(F.lit("So.").alias("answer"), F.array(F.lit("[gdpr:art:2]"), F.lit("none")).alias("citations"), F.lit(False).alias("abstained")))
    out = {r.qid: r for r in search.answer(asked, say).collect()}
    assert out[1].citations == ["gdpr:art:2"] and out[1].invalid == ["none"]
    refused = {r.qid: r for r in search.answer(asked, lambda q, c: F.lit(None).cast("string")).collect()}
    assert refused[1].abstained and not refused[1].citations
    cases = spark.createDataFrame([("a", "Article 2 of the GDPR?", "en", ["gdpr:art:2"], 0)], "id string, question string, language string, expected_provisions array<string>, ord int")
    scores = {r.config: r.hit_rate for r in search.evaluate(cases).collect()}
    assert len(scores) == 6 and scores["dense + references"] == 1.0
    assert re.search("Article 2", search.chunks.first().header + "Article 2")
