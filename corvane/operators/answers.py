"""Context, citations, answers, and the agent's state machine, as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_json, digest, strip
from ..schemas import ANSWER, ROUTE_DECISION, ROUTES
from . import containment

#: Fixed texts for runs without an answer.
NOT_COVERED = {"en": "The indexed texts do not cover this question.", "fr": "Les textes indexés ne couvrent pas cette question."}
OUT_OF_SCOPE = {"en": "This question is outside the scope of the indexed texts.", "fr": "Cette question sort du champ des textes indexés."}
HALTED = {"en": "Stopped before an answer was found: the budget was used up.", "fr": "Arrêt avant une réponse : le budget est épuisé."}
DEFINITIONS_SHOWN = 6
SUBMIT = "submit_answer"


def context(hits: DataFrame) -> DataFrame:
    """(qid, context) of hits (qid, rank, id, provision_ids, breadcrumb, source_id, text): blocks in order of rank."""
    ids = F.when(F.size("provision_ids") > 0, F.array_join("provision_ids", ", ")).otherwise(F.col("id").cast("string"))
    trail = F.coalesce(F.nullif("breadcrumb", F.lit("")), F.col("source_id"))
    block = F.concat(F.lit("["), ids, F.lit("] "), trail, F.lit("\n"), F.col("text"))
    # A question has at most ``limit`` hits.
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def normalised_citations(citations: Column) -> Column:
    """Without brackets and surrounding space, first occurrences only."""
    return F.array_distinct(F.transform(citations, lambda c: F.regexp_replace(strip(c), r"^[\[\]]+|[\[\]]+$", "")))


def check_citations(answers: DataFrame, citations: str = "citations", allowed: str = "allowed") -> DataFrame:
    """With valid, invalid and precision (valid over all cited, 0 of none): checked against what was retrieved."""
    cited = normalised_citations(F.col(citations))
    valid, invalid = F.array_intersect(cited, F.col(allowed)), F.array_except(cited, F.col(allowed))
    share = F.coalesce(F.try_divide(F.size(valid).cast("double"), F.size(cited).cast("double")), F.lit(0.0))
    return answers.withColumns({"valid": valid, "invalid": invalid, "precision": share})


def answered(questions: DataFrame, hits: DataFrame, complete: Callable[[Column, Column], Column]) -> DataFrame:
    """One answer for each question (qid, text, language): retrieve, complete, validate.

    ``complete`` maps the columns (question, context) to a JSON answer, or null for a refusal. Without hits, on refusal, on a flagged
    or on a blank answer the run abstains.
    """
    allowed = hits.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("provision_ids"))).alias("allowed"))
    asked = questions.join(context(hits), "qid", "left").join(allowed, "qid", "left")
    raw = F.when(F.col("context").isNotNull(), complete(F.col("text"), F.col("context")))
    got = asked.withColumn("a", F.from_json(raw, ANSWER)).withColumn("citations", F.coalesce(F.col("a.citations"), F.array().cast("array<string>"))).withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
    got = check_citations(got)
    blank = F.coalesce(strip(F.col("a.answer")), F.lit("")) == ""
    abstained = F.col("a").isNull() | F.coalesce(F.col("a.abstained"), F.lit(False)) | blank
    return got.select("qid", "language", F.when(~abstained, F.col("a.answer")).otherwise(_said(NOT_COVERED)).alias("answer"), F.when(~abstained, F.col("valid")).otherwise(F.array().cast("array<string>")).alias("citations"), "invalid", abstained.alias("abstained"))


def extractive(question: Column, context: Column) -> Column:
    """A completion without a model: the first passage, cited by its first id. It has the shape of one for tests and offline runs."""
    first = F.split_part(context, F.lit("\n\n["), F.lit(1))
    return F.to_json(F.struct(F.regexp_replace(first, r"^[^\n]*\n", "").alias("answer"), F.array(F.regexp_extract(first, r"^\[([^,\]]*)", 1)).alias("citations"), F.lit(False).alias("abstained")))


def telemetry(answers: DataFrame, model: str) -> DataFrame:
    """Audit rows (``schemas.AUDIT``) of answers (qid, answer, citations, invalid, abstained): one for each, however it ended."""
    ended = F.when(F.col("abstained"), "abstained").when(F.size("invalid") > 0, "with dropped citations").otherwise("answered")
    facts = {"model": F.lit(model), "ended": ended, "citations": F.size("citations").cast("string"), "invalid": F.size("invalid").cast("string")}
    return answers.select(
        F.col("qid").cast("string").alias("trace_id"), F.lit(None).cast("string").alias("parent"), F.lit("answer").alias("name"), F.lit("generation").alias("type"), F.lit(None).cast("string").alias("input"),
        F.col("answer").alias("output"), F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v)]).alias("metadata"), F.lit(0.0).alias("cost_usd"),
    )


def _said(texts: dict[str, str]) -> Column:
    return F.when(F.col("language") == "fr", texts["fr"]).otherwise(texts["en"])


def route(raw: Column) -> Column:
    """The router's decision; what can't be read is complex."""
    found = F.from_json(raw, ROUTE_DECISION)["route"]
    return F.when(found.isin(*ROUTES), found).otherwise("complex")


def definitions(provisions: DataFrame, terms: DataFrame, provision_ids: list[str] | None = None) -> DataFrame:
    """(term, seq, provision_id, label, text): the first paragraphs that contain each term, whatever its case."""
    own = provisions if provision_ids is None else provisions.where(F.col("provision_id").isin(provision_ids))
    each = own.select("provision_id", "ord", F.posexplode("paragraphs").alias("at", "p")).select("provision_id", "ord", "at", "p.*")
    met = containment.containing(each, terms)
    seq = F.row_number().over(Window.partitionBy("term").orderBy("ord", "provision_id", "at"))
    return met.withColumn("seq", seq).where(F.col("seq") <= DEFINITIONS_SHOWN).select("term", "seq", "provision_id", "label", "text")


def spend(steps: DataFrame, thread: str = "thread_id", seq: str = "seq") -> DataFrame:
    """Running input_tokens, output_tokens and cost_usd of each thread; cached tokens don't count."""
    so_far = Window.partitionBy(thread).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumns({f"total_{c}": F.sum(c).over(so_far) for c in ("input_tokens", "output_tokens", "cost_usd")}).withColumn("step", F.row_number().over(Window.partitionBy(thread).orderBy(seq)))


def verdict(steps_done: Column, cost: Column, tokens: Column, max_steps: int, max_cost: float, max_tokens: int) -> Column:
    """Why a run must halt before its next call, in order of priority; null if it may go on."""
    return F.when(steps_done >= max_steps, "steps").when(cost >= max_cost, "cost").when(tokens >= max_tokens, "tokens")


def halted(steps: DataFrame, max_steps: int = 8, max_cost: float = 0.50, max_tokens: int = 120_000, thread: str = "thread_id", seq: str = "seq") -> DataFrame:
    """(thread, halted_at, halted_by): the first step after which the budget is used up; threads within it are absent."""
    run = spend(steps, thread, seq)
    why = verdict(F.col("step"), F.col("total_cost_usd"), F.col("total_input_tokens") + F.col("total_output_tokens"), max_steps, max_cost, max_tokens)
    over = run.withColumn("halted_by", why).where("halted_by is not null")
    return over.groupBy(thread).agg(F.min("step").alias("halted_at"), F.min_by("halted_by", "step").alias("halted_by"))


def fingerprint(name: Column, arguments: Column) -> Column:
    """``name:digest`` of a call; arguments is a map, in any order."""
    return F.concat(name, F.lit(":"), digest(canonical_json(arguments), 12))


def repeats(calls: DataFrame, thread: str = "thread_id", turn: str = "turn", name: str = "name", print_col: str = "fingerprint") -> DataFrame:
    """Calls with ``repeated``: whether an earlier turn made the same call. Calls of one turn don't repeat each other."""
    first = F.min(turn).over(Window.partitionBy(thread, print_col))
    return calls.withColumn("repeated", (first < F.col(turn)) & (F.col(name) != SUBMIT))


def next_node(node: Column, route: Column, halted: Column, calls: Column, submitted: Column, invalid: Column, corrections: Column, max_corrections: int = 1) -> Column:
    """The state machine's edges."""
    return (
        F.when(node == "route", F.when(route == "lookup", "rag_answer").when(route == "out_of_scope", "abstain").otherwise("agent"))
        .when(node == "rag_answer", "verify")
        .when(node == "agent", F.when(halted.isNotNull(), "finalize").when(calls > 0, "tools").otherwise("verify"))
        .when(node == "tools", F.when(submitted, "verify").otherwise("agent"))
        .when(node == "verify", F.when((invalid > 0) & (corrections < max_corrections) & halted.isNull() & (route == "complex"), "agent").otherwise("finalize"))
        .when(node == "abstain", "finalize")
    )


def thread_state(messages: DataFrame, thread: str = "thread_id", turn: str = "turn") -> DataFrame:
    """Per thread: turns, and the last assistant's text. Other fields start anew in every turn."""
    said = F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col(turn)))
    return messages.groupBy(thread).agg(F.count("*").alias("turns"), said.alias("last_answer"))


def transcript(messages: DataFrame, thread: str = "thread_id", turn: str = "turn") -> DataFrame:
    """Per thread the appended list of messages in order; a thread's own messages are what a model call sends at once."""
    return messages.groupBy(thread).agg(F.transform(F.array_sort(F.collect_list(F.struct(turn, "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def final_text(answer: Column, last: Column, halted: Column, language: Column) -> Column:
    """The answer, else the last assistant's text, else why there is none."""
    none = F.when(halted.isNotNull(), F.when(language == "fr", HALTED["fr"]).otherwise(HALTED["en"])).otherwise(F.when(language == "fr", NOT_COVERED["fr"]).otherwise(NOT_COVERED["en"]))
    return F.coalesce(F.nullif(strip(answer), F.lit("")), F.nullif(strip(last), F.lit("")), none)


def search_limit(limit: Column) -> Column:
    return F.least(F.coalesce(F.nullif(limit, F.lit(0)), F.lit(5)), F.lit(8))
