"""Scripted runs of the agent, and request checks."""

import pytest
from pyspark.sql import functions as F

from corvane.cli import main
from corvane.config import Settings
from corvane.functions.validation import valid_request, valid_route, valid_score
from corvane.plans.agent import Agent, Seen, Tool


def agent(script, route="complex", settings=None, rag=None):
    seen, made, steps = Seen(), [], iter(script)

    def look(query):
        made.append(query)
        seen.add([f"s:art:{query}"])
        if query == "boom":
            raise RuntimeError("broken")
        return f"passage {query}"

    tools = {"look": Tool("look", look), "submit_answer": Tool("submit_answer", lambda **_: "submitted")}
    return Agent(lambda q: route, lambda messages: next(steps), rag or (lambda q, lang: ("From passages.", ["[s:art:1]", "x"], False, ["s:art:1"])), tools, seen, settings), made


def call(name, **arguments):
    return {"calls": [{"id": "1", "name": name, "arguments": arguments}], "input_tokens": 10, "output_tokens": 1, "cost_usd": 0.1}


def submit(*citations):
    return call("submit_answer", answer="So.", citations=list(citations), abstained=False)


def test_lookup_drops_unknown_citations():
    run = agent([], "lookup")[0].ask("q", "en", "t")
    assert (run.answer, run.citations, run.route) == ("From passages.", ["s:art:1"], "lookup")


def test_out_of_scope_and_unreadable_routes():
    assert agent([], "out_of_scope")[0].ask("q", "fr", "t").abstained
    assert agent([{"text": "Plain."}], "???")[0].ask("q", "en", "t").route == "complex"


def test_tool_loop_and_one_correction():
    a, made = agent([call("look", query="1"), submit("s:art:9"), submit("s:art:1", "s:art:9")])
    run = a.ask("q", "en", "t")
    assert made == ["1"] and run.citations == ["s:art:1"] and run.corrections == 1 and run.steps == 3
    assert run.input_tokens == 30 and abs(run.cost_usd - 0.3) < 1e-9


def test_repeats_unknown_tools_and_failures_are_told():
    a, made = agent([call("look", query="1"), call("look", query="1"), call("nothing"), call("look", query="boom"), call("look", wrong="x"), submit()], settings=Settings(agent_max_cost_usd=9.0))
    run = a.ask("q", "en", "t")
    results = [r for m in run.messages if m["role"] == "tool" for r in m["results"]]
    assert made == ["1", "boom"] and [r["is_error"] for r in results] == [False, True, True, True, True, False]


@pytest.mark.parametrize(("settings", "why"), [(Settings(agent_max_steps=2), "steps"), (Settings(agent_max_cost_usd=0.15), "cost"), (Settings(agent_token_budget=20), "tokens")])
def test_budget_halts(settings, why):
    run = agent([call("look", query=str(k)) for k in range(9)], settings=settings)[0].ask("q", "en", "t")
    assert run.halted_by == why and run.steps == 2 and run.abstained


def test_a_thread_goes_on_with_fresh_fields():
    a, _ = agent([{"text": "One."}, {"text": "Two."}])
    first = a.ask("q", "en", "t")
    second = a.ask("r", "en", "t", first.messages)
    assert second.answer == "Two." and second.steps == 1 and len(second.messages) == 4


def test_validation(spark):
    rows = spark.createDataFrame([("abc", 1, "en"), ("ab", 1, "en"), ("abc", 21, None), ("abc", None, "de"), (None, 1, "en"), ("abc", None, None)], "q string, k int, l string")
    assert [r[0] for r in rows.select(valid_request(F.col("q"), F.col("k"), F.col("l"))).collect()] == [True, False, False, False, False, True]
    assert spark.range(1).select(valid_score(F.lit(7)), valid_score(F.lit(2)), valid_route(F.lit("x"))).first() == (0, 2, False)


def test_info_prints_settings(capsys):
    assert main(["info"]) == 0
    assert '"rrf_k": 60' in capsys.readouterr().out
