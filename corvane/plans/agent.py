"""The agent: a driver loop over one question, with injected model functions and DataFrame tools.

A question goes through route, then rag_answer, agent and tools, or abstain, then verify and finalize. Before each model
call the budget is checked; a call made in an earlier turn is refused; invalid citations get one correction and are then
dropped. Fields of a turn start anew with each question; a thread keeps its messages.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import answers, store
from ..operators.tracing import Tracer, in_current_trace
from ..schemas import ROUTES, TOOLS

THREADS = 4
EDGES = (
    ("[*]", "route", ""), ("route", "rag_answer", "lookup"), ("route", "agent", "complex"), ("route", "abstain", "out_of_scope"), ("rag_answer", "verify", ""), ("agent", "tools", "calls"), ("agent", "verify", "text"),
    ("agent", "finalize", "budget or refusal"), ("tools", "agent", ""), ("tools", "verify", "submitted"), ("verify", "agent", "one correction"), ("verify", "finalize", ""), ("abstain", "finalize", ""), ("finalize", "[*]", ""),
)
NO_SUCH_PROVISION = "No provision {} in {}. Ids look like source:art:6; search first."


@dataclass
class Tool:
    name: str
    handler: Callable[..., str]

    def run(self, arguments: dict) -> tuple[str, bool]:
        """(text, is_error): unknown or missing arguments and failures become error texts."""
        known = set(TOOLS[self.name].fieldNames()) if self.name in TOOLS else set(arguments)
        if extra := set(arguments) - known:
            return f"unknown arguments: {', '.join(sorted(extra))}", True
        try:
            return self.handler(**arguments), False
        except Exception as e:  # noqa: BLE001  the model reads the error and may try again
            return f"{type(e).__name__}: {e}", True


@dataclass
class Seen:
    """Provisions whose passages the run has read."""

    provisions: list[str] = field(default_factory=list)

    def add(self, ids: list[str]) -> None:
        self.provisions += [i for i in ids if i not in self.provisions]


def default_tools(searcher, provisions: DataFrame, language: str, seen: Seen, definition_ids: list[str] | None = None) -> dict[str, Tool]:
    spark = provisions.sparkSession

    def search_regulations(query: str, limit: int | None = None) -> str:
        asked = spark.createDataFrame([(1, query, language)], "qid int, text string, language string")
        hits = searcher.search(asked, limit=min(limit or 5, 8)).withColumnRenamed("header", "breadcrumb")
        for r in hits.orderBy("rank").select("provision_ids").collect():
            seen.add(r.provision_ids)
        row = answers.context(hits).first()
        return row.context if row else "Nothing found."

    def get_provision(provision_id: str) -> str:
        row = store.provision(provisions, provision_id, language).first()
        if row is None:
            return NO_SUCH_PROVISION.format(provision_id, language)
        seen.add([provision_id])
        return "\n".join(f"{p.label} {p.text}" if p.label else p.text for p in row.paragraphs)

    def get_definition(term: str) -> str:
        found = answers.definitions(provisions.where(F.col("language") == language), spark.createDataFrame([(term,)], "term string"), definition_ids).orderBy("seq").collect()
        seen.add([r.provision_id for r in found])
        return "\n".join(f"[{r.provision_id}] {r.label or ''} {r.text}".replace("  ", " ") for r in found) or f"No definition of {term!r}."

    made = (Tool("search_regulations", search_regulations), Tool("get_provision", get_provision), Tool("get_definition", get_definition), Tool(answers.SUBMIT, lambda **_: "submitted"))
    return {t.name: t for t in made}


@dataclass
class Run:
    question: str
    language: str
    thread_id: str
    messages: list[dict] = field(default_factory=list)
    route: str | None = None
    answer: str | None = None
    citations: list[str] = field(default_factory=list)
    abstained: bool = False
    steps: int = 0
    input_tokens: int = 0
    output_tokens: int = 0
    cost_usd: float = 0.0
    corrections: int = 0
    halted_by: str | None = None
    calls_made: set[str] = field(default_factory=set)
    submitted: bool = False


def print_of(call: dict) -> str:
    text = json.dumps(call.get("arguments", {}), sort_keys=True, ensure_ascii=False)
    return f"{call['name']}:{hashlib.sha256(text.encode()).hexdigest()[:12]}"


def verdict(run: Run, settings: Settings) -> str | None:
    """Why no further call may be made, in order of priority."""
    if run.steps >= settings.agent_max_steps:
        return "steps"
    if run.cost_usd >= settings.agent_max_cost_usd:
        return "cost"
    return "tokens" if run.input_tokens + run.output_tokens >= settings.agent_token_budget else None


class Agent:
    """``router(question) -> route``; ``model(messages) -> {text, calls, refused, input_tokens, output_tokens, cost_usd}``;
    ``rag(question, language) -> (answer, citations, abstained, provisions)``."""

    def __init__(self, router: Callable[[str], str], model: Callable[[list[dict]], dict], rag: Callable[[str, str], tuple[str, list[str], bool, list[str]]], tools: dict[str, Tool], seen: Seen, settings: Settings | None = None, tracer: Tracer | None = None) -> None:
        self.router, self.model, self.rag, self.tools, self.seen, self.settings, self.tracer = router, model, rag, tools, seen, settings or Settings(), tracer or Tracer()

    @staticmethod
    def diagram() -> str:
        """The state machine in Mermaid's notation."""
        return "\n".join(["stateDiagram-v2", *(f"    {a} --> {b}" + (f": {why}" if why else "") for a, b, why in EDGES)])

    def _observed(self, call: dict) -> tuple[str, bool]:
        """A tool's run, in an observation named after it."""
        with self.tracer.span(call["name"], "tool", call.get("arguments", {})) as found:
            text, bad = self.tools[call["name"]].run(call.get("arguments", {}))
            found |= {"output": text, "is_error": bad}
            return text, bad

    def ask(self, question: str, language: str, thread_id: str, earlier: list[dict] | None = None) -> Run:
        run = Run(question, language, thread_id, [*(earlier or []), {"role": "user", "text": question}])
        self.seen.provisions.clear()
        node = "route"
        while node != "finalize":
            with self.tracer.span(node, "node") as found:
                found["output"] = node = getattr(self, f"_{node}")(run)
        return self._finalize(run)

    def _route(self, run: Run) -> str:
        found = self.router(run.question)
        run.route = found if found in ROUTES else "complex"
        return {"lookup": "rag_answer", "out_of_scope": "abstain"}.get(run.route, "agent")

    def _rag_answer(self, run: Run) -> str:
        run.answer, run.citations, run.abstained, provisions = self.rag(run.question, run.language)
        self.seen.add(provisions)
        run.steps += 1
        return "verify"

    def _abstain(self, run: Run) -> str:
        run.answer, run.abstained = answers.OUT_OF_SCOPE[run.language], True
        return "finalize"

    def _agent(self, run: Run) -> str:
        run.halted_by = verdict(run, self.settings)
        if run.halted_by:
            return "finalize"
        out = self.model(run.messages)
        run.steps += 1
        run.input_tokens += out.get("input_tokens", 0)
        run.output_tokens += out.get("output_tokens", 0)
        run.cost_usd += out.get("cost_usd", 0.0)
        if out.get("refused"):
            run.answer, run.abstained = answers.NOT_COVERED[run.language], True
            return "finalize"
        calls = out.get("calls", [])
        run.messages.append({"role": "assistant", "text": out.get("text", ""), "calls": calls})
        return "tools" if calls else "verify"

    def _tools(self, run: Run) -> str:
        calls = run.messages[-1]["calls"]
        before = set(run.calls_made)
        refused, wanted = [], []
        for call in calls:
            mark = print_of(call)
            if call["name"] not in self.tools:
                refused.append((call, f"no tool {call['name']!r}", True))
            elif mark in before and call["name"] != answers.SUBMIT:
                refused.append((call, "this call was made before; its result is above", True))
            else:
                wanted.append(call)
            run.calls_made.add(mark)
        pool = ThreadPoolExecutor(THREADS)
        pending = [(call, pool.submit(in_current_trace(self._observed), call)) for call in wanted]
        done = []
        for call, result in pending:
            try:
                text, bad = result.result(timeout=self.settings.tool_timeout_seconds)
            except TooLate:
                text, bad = f"timed out after {self.settings.tool_timeout_seconds:g} s", True
            done.append((call, text, bad))
            if call["name"] == answers.SUBMIT and not bad:
                given = call.get("arguments", {})
                run.answer, run.citations, run.abstained, run.submitted = given.get("answer"), list(given.get("citations") or []), bool(given.get("abstained")), True
        pool.shutdown(wait=False, cancel_futures=True)
        run.messages.append({"role": "tool", "text": "", "results": [{"id": c.get("id"), "text": t, "is_error": e} for c, t, e in [*refused, *done]]})
        return "verify" if run.submitted else "agent"

    def _verify(self, run: Run) -> str:
        cited = list(dict.fromkeys(c.strip().strip("[]") for c in run.citations))
        bad = [c for c in cited if c not in self.seen.provisions]
        if bad and run.route == "complex" and run.corrections < self.settings.max_corrections and not verdict(run, self.settings):
            run.corrections += 1
            run.answer, run.submitted = None, False
            run.messages.append({"role": "user", "text": "These citations were not among the passages read: " + ", ".join(bad) + ". Correct the answer."})
            return "agent"
        run.citations = [c for c in cited if c not in bad]
        return "finalize"

    def _finalize(self, run: Run) -> Run:
        if not (run.answer or "").strip():
            last = next((m["text"] for m in reversed(run.messages) if m["role"] == "assistant" and m["text"].strip()), None)
            run.abstained = last is None
            run.answer = last or (answers.HALTED if run.halted_by else answers.NOT_COVERED)[run.language]
        return run


def assembled(searcher, provisions: DataFrame, language: str, functions, settings: Settings | None = None, tracer: Tracer | None = None) -> Agent:
    """An agent over stored tables. ``functions`` has complete (columns to JSON) and, where there is a model, router and model."""
    seen = Seen()
    spark = provisions.sparkSession

    def rag(question: str, language: str) -> tuple[str, list[str], bool, list[str]]:
        asked = spark.createDataFrame([(1, question, language)], "qid int, text string, language string")
        hits = searcher.search(asked).withColumnRenamed("header", "breadcrumb").persist()
        row = answers.answered(searcher.questions(asked).select("qid", "text", "language"), hits, functions.complete).first()
        read = [p for r in hits.orderBy("rank").select("provision_ids").collect() for p in r.provision_ids]
        hits.unpersist()
        return row.answer, list(row.citations), row.abstained, read

    router = getattr(functions, "router", None) or (lambda question: "lookup")
    model = getattr(functions, "model", None) or (lambda messages: {"refused": True})
    return Agent(router, model, rag, default_tools(searcher, provisions, language, seen), seen, settings, tracer)
