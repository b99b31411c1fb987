"""The command line over a small act."""

import json

from corvane.cli import main

from .test_operators import ACT


def test_flow(spark, tmp_path, capfd):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "gdpr_en.xhtml").write_text(ACT)
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"id": "gdpr", "title": "An act", "short_title": "Act", "format": "eurlex-xhtml", "languages": ["en"], "celex": "32000R0001"}]}))
    tables = ["--tables", str(tmp_path / "tables")]
    assert main([*tables, "ingest", str(tmp_path / "m.json"), str(tmp_path / "raw")]) == 0
    assert main([*tables, "index"]) == 0
    assert main([*tables, "search", "What does Article 2 of the GDPR say?", "--language", "en", "-k", "3"]) == 0
    (tmp_path / "cases.jsonl").write_text('{"id":"a","question":"Article 2 of the GDPR?","language":"en","category":"c","expected_provisions":["gdpr:art:2"]}\n')
    assert main([*tables, "eval-retrieval", str(tmp_path / "cases.jsonl")]) == 0
    out = capfd.readouterr().out
    assert "gdpr:en" in out and "Article 2" in out and "| dense + references | 1.00 |" in out
    run = {"summary": {}, "cases": [{"id": "a", "faithfulness": 2, "correctness": 1}, {"id": "b", "faithfulness": 0, "correctness": 1}]}
    (tmp_path / "run.json").write_text(json.dumps(run))
    (tmp_path / "labels.jsonl").write_text('{"case_id":"a","faithfulness":2,"correctness":1}\n{"case_id":"b","faithfulness":0}\n')
    assert main([*tables, "eval-calibrate", str(tmp_path / "run.json"), str(tmp_path / "labels.jsonl")]) == 0
    assert "| faithfulness | 2 | 1.00 | 1.00 | 1.00 | yes |" in capfd.readouterr().out
