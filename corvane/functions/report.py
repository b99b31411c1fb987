"""Markdown of summaries."""

from __future__ import annotations


def number(value: float | None, digits: int = 2) -> str:
    return "-" if value is None else f"{value:.{digits}f}"


def table(head: list[str], rows: list[list[str]]) -> str:
    lines = [head, ["---"] * len(head), *rows]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def markdown(summary: dict, categories: list[dict], cases: list[dict], judge_model: str, dataset: str) -> str:
    """A report: summary, categories, and cases that scored less than 2 for correctness."""
    review = [c for c in cases if c.get("correctness") is not None and c["correctness"] < 2]
    parts = [
        f"# Evaluation of {dataset}",
        f"Judge: {judge_model}. Cases: {summary['n']}.",
        table(["Measure", "Value"], [[k, number(v) if isinstance(v, float) or v is None else str(v)] for k, v in summary.items()]),
        "## By category",
        table(["Category", "n", "Correctness", "Citation precision", "Abstention"], [[c["category"], str(c["n"]), number(c["correctness"]), number(c["citation_precision"]), number(c["abstention_accuracy"])] for c in categories]),
        "## Cases to look at",
        "\n".join(f"- {c['id']} ({c['category']}): correctness {c['correctness']}" for c in review) or "None.",
    ]
    return "\n\n".join(parts) + "\n"


def agreement_table(rows: list[dict]) -> str:
    return table(["Metric", "Pairs", "Exact", "Within one", "Kappa", "Usable"], [[r["metric"], str(r["pairs"]), number(r["exact"]), number(r["within_one"]), number(r["kappa"]), "yes" if r["usable"] else "no"] for r in rows])


def scores_table(rows: list[dict]) -> str:
    return table(["Configuration", "hit", "recall", "MRR", "nDCG"], [[r["config"], number(r["hit_rate"]), number(r["recall"]), number(r["mrr"]), number(r["ndcg"])] for r in rows])
