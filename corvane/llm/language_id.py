"""Language of pages by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the likelihood of the page's text under byte-trigram models, the probability of the declared
markup language and of the address suffix given the language, and a prior of the host. A text's likelihood is its mean for each trigram, counted
at most so many times as held-out texts bear out (``calibrated``), as trigrams of one text depend on each other. Probabilities of declarations
and suffixes and the priors come from grouped sums of the texts' own posteriors over all pages; each adds up to one. A host's prior is smoothed
towards its registered domain and that towards the whole corpus, each with the weight of some pages; the suffix speaks once, by its own
probability. A page's own share is taken out first, so it is no evidence for itself.

The trigram models are fitted on a bounded sample of labelled texts: SAMPLE whole distinct texts for each language, smallest hashes first; one
in HELD_OUT of them is held out for the calibration.

Defined cases: null and empty pages have flat likelihoods, so the other evidence decides; a null URL has empty host and suffix; an unknown
or missing declaration is a value like others; of equally likely languages the first in alphabetical order is given; without labelled texts lang
and probability are null; repeated rows count each time; pages and texts of any length are read whole; further columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, join_groups, written
from .html_main import costs, labelled
from .url_filter import host_of

SAMPLE, HELD_OUT = 1000, 5
BUCKETS = 1 << 16
#: How many trigrams a text may count for: the calibration takes one of these.
COUNTED = (30, 60, 120, 250, 500, 1000, 2000, 4000, 8000)
#: Hosts of more pages are few and are broadcast, others are joined by host.
HOT_HOST = 100_000
#: Second labels under which names are registered in two-letter domains.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "ne", "net", "nom", "or", "org")
SMOOTH_TEXT = 0.5
SMOOTH_HOST = 4.0
SMOOTH_TABLE = 2.0
_DECLARED = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?\s*([a-zA-Z]{2,8})""")
_META = re.compile(r"""<meta\b[^>]*?content-language[^>]*?content\s*=\s*["']?\s*([a-zA-Z]{2,8})""", re.I)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram, digits and ASCII case folded."""
    b = _FOLD[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
    code = b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _sampled(docs: DataFrame, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """(lang, text, held) of at most ``sample`` distinct texts for each language."""
    own = docs.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    # A cut at a hash that leaves some times the sample, so ranking is over few rows even of a language of most rows.
    sizes = {r["lang"]: r["n"] for r in own.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 3.0 * sample / n))).otherwise(share)
    # Copies fold within tasks before they are shuffled.
    near = own.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < share * 1_000_000).dropDuplicates(["lang", "h"])
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h"))).where(F.col("k") <= sample)
    return ranked.select("lang", "text", (F.col("k") % HELD_OUT == 0).alias("held"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text", 4_000_000):
        lang, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for k, text in enumerate(batch.column(1).to_pylist()):
            bucket, n = np.unique(trigrams(text), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang[k]] * len(bucket), pa.string()), pa.array([held[k]] * len(bucket), pa.bool_()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], ["lang", "held", "bucket", "n"])


def _logs(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + SMOOTH_TEXT) / (counts + SMOOTH_TEXT).sum(axis=1, keepdims=True)).astype(np.float32)


def mean_logs(text: str, logs: np.ndarray) -> tuple[np.ndarray, int]:
    """Mean log-likelihood of a trigram under each model, and the number of trigrams. By counts of buckets: a long text costs no
    more than its distinct trigrams."""
    at = trigrams(text)
    bucket, n = np.unique(at, return_counts=True)
    return logs[:, bucket] @ n / max(1, len(at)), len(at)


def text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray, int, float]:
    """Languages in order, log-probabilities (language, bucket), the number of trigrams that a text may count for, and the share
    of held-out texts whose language the text alone gives (0 where there are none)."""
    rows = written(_sampled(docs, text_col, lang_col, sample), "labelled")
    sums = rows.mapInArrow(_counted, "lang string, held boolean, bucket int, n long").groupBy("lang", "held", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in sums})
    counts = np.zeros((2, len(langs), BUCKETS))
    for r in sums:
        counts[int(r["held"]), langs.index(r["lang"]), r["bucket"]] = r["n"]
    most, right = calibrated(rows.where("held"), langs, _logs(counts[0])) if len(langs) > 1 else (COUNTED[-1], 0.0)
    return langs, _logs(counts.sum(axis=0)), most, right


def calibrated(held: DataFrame, langs: list[str], logs: np.ndarray) -> tuple[int, float]:
    """The number of COUNTED that makes held-out texts' labels likeliest, and the share of labels that the text gives."""
    sent = held.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_pylist()
            for k, text in enumerate(batch.column(1).to_pylist()):
                mean, n = mean_logs(text, sent.value)
                lost = []
                for most in COUNTED:
                    x = mean * min(n, most)
                    lost.append(float(np.logaddexp.reduce(x) - x[langs.index(lang[k])]))
                yield pa.RecordBatch.from_arrays([pa.array([lost], pa.list_(pa.float64())), pa.array([int(mean.argmax()) == langs.index(lang[k])])], ["lost", "right"])

    row = held.select("lang", "text").mapInArrow(run, "lost array<double>, right boolean").agg(F.count("*").alias("n"), F.avg(F.col("right").cast("int")).alias("right"), *[F.sum(F.col("lost")[k]).alias(f"l{k}") for k in range(len(COUNTED))]).first()
    if not row["n"]:
        return COUNTED[-1], 0.0
    return min(zip([row[f"l{k}"] for k in range(len(COUNTED))], COUNTED, strict=True))[1], row["right"]


def page_evidence(html: str | None, logs: np.ndarray, most: int, weights: tuple[float, ...] | None = None) -> tuple[str, int, np.ndarray]:
    """Declared language ("" if none), characters of main text (else of all visible text), log-likelihoods."""
    html = html or ""
    m = _DECLARED.search(html) or _META.search(html)
    found, keep, texts = labelled(html, weights)
    text = "\n".join(t for t, k in zip(texts, keep, strict=True) if k) or "\n".join(b.text for b in found)
    if not text:
        return (m[1].lower() if m else ""), 0, np.zeros(len(logs))
    mean, n = mean_logs(text, logs)
    return (m[1].lower() if m else ""), len(text), (mean - mean.max()) * min(n, most)


def _normal(weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def _softmax(logs: Column) -> Column:
    return _normal(F.transform(logs, lambda x: F.exp(x - F.array_max(logs))))


def _smoothed(counts: Column, prior: Column, weight: float) -> Column:
    """Shares of counts, drawn to the prior with the weight of some pages."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda c, p: (F.greatest(c, F.lit(0.0)) + weight * p) / (total + weight))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, declared, text_lang, lang, probability, n_chars of every page."""
    langs, logs, most, _ = text_model(docs)
    spark = pages.sparkSession
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), none.alias("declared"), none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("long").alias("n_chars"))
    sent = spark.sparkContext.broadcast(logs)  # one number for each language and bucket
    weights = costs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "html", 8_000_000):
            rows = [page_evidence(h, sent.value, most, weights) for h in batch.column(2).to_pylist()]
            lists = pa.array([r[2].tolist() for r in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), lists], ["page_id", "host", "declared", "n_chars", "logs"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    seen = chosen.mapInArrow(run, "page_id long, host string, declared string, n_chars long, logs array<double>")
    labels = F.split(F.regexp_replace("host", r"^.*@|:\d*$", ""), r"\.")
    # The suffix is the last label, or the last two of names like x.co.uk; the registered domain has one label more.
    two = (F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.greatest(F.lit(-2), -F.size(labels))).isin(*SECOND)
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), 4), ".")
    known = F.when(F.col("declared") == "", "none").when(F.col("declared").isin(langs), F.col("declared")).otherwise("other")
    seen = written(seen.withColumn("post", _softmax(F.col("logs"))).withColumn("said", known).withColumn("suffix", F.when(two, last(2)).otherwise(last(1))).withColumn("domain", F.when(two, last(3)).otherwise(last(2))), "evidence")
    size = len(langs)
    sums = F.array(*[F.sum(F.col("post")[k]) for k in range(size)])
    again = F.array(*[F.sum(F.col("n")[k]) for k in range(size)])
    hosts = written(seen.groupBy("host", "domain", "suffix").agg(sums.alias("n"), F.count("*").alias("n_pages")), "hosts")
    domains = written(hosts.groupBy("domain").agg(F.count("*").alias("n"), again.alias("domain_n")), "domains").withColumnRenamed("n", "n_hosts")
    suffixes = written(hosts.groupBy("suffix").agg(F.count("*").alias("n"), again.alias("suffix_n")), "suffixes").withColumnRenamed("n", "n_hosts")
    n_suffixes, n_hosts = suffixes.count(), hosts.count()
    # A row for each known language and two more.
    said = {r["said"]: np.array(r["n"]) for r in seen.groupBy("said").agg(sums.alias("n")).collect()}
    total = np.sum(list(said.values()), axis=0) if said else np.zeros(size)
    world = F.lit(((total + 1) / (total.sum() + size)).tolist()).cast("array<double>")
    all_n = F.lit(total.tolist()).cast("array<double>")
    table = F.create_map(*[x for k, n in sorted(said.items()) for x in (F.lit(k), F.lit(((n + SMOOTH_TABLE) / (total + SMOOTH_TABLE * (size + 2))).tolist()).cast("array<double>"))]) if said else F.lit(None).cast("map<string,array<double>>")
    # Half of all hosts may have one suffix: those of hot suffixes and domains meet them by a broadcast.
    placed = join_groups(hosts, domains, "domain", n_hosts, "n_hosts").drop("n_hosts")
    priors = written(join_groups(placed, suffixes, "suffix", n_hosts, "n_hosts").select("host", "n", "domain_n", "suffix_n", "n_pages"), "priors")
    less = lambda counts: F.zip_with(counts, F.col("post"), lambda c, p: F.greatest(c - p, F.lit(0.0)))
    # There is one hot host at most for each HOT_HOST pages.
    hot = F.broadcast(priors.where(F.col("n_pages") > HOT_HOST).drop("n_pages"))
    joined = seen.join(hot, "host").unionByName(seen.join(hot.select("host"), "host", "left_anti").join(priors.where(F.col("n_pages") <= HOT_HOST).drop("n_pages"), "host"))
    prior = _smoothed(less(F.col("n")), _smoothed(less(F.col("domain_n")), world, SMOOTH_HOST), SMOOTH_HOST)
    of_suffix = F.zip_with(F.zip_with(less(F.col("suffix_n")), all_n, lambda c, n: F.struct(c.alias("c"), n.alias("n"))), F.col("post"), lambda x, p: (x["c"] + SMOOTH_TABLE) / (F.greatest(x["n"] - p, F.lit(0.0)) + SMOOTH_TABLE * n_suffixes))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + F.log(y))
    fused = _softmax(add(add(add(F.col("logs"), table[F.col("said")]), of_suffix), prior))
    names = F.array(*map(F.lit, langs))
    best = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    out = joined.withColumn("fused", fused)
    return out.select("page_id", "host", F.nullif("declared", F.lit("")).alias("declared"), best(F.col("post")).alias("text_lang"), best(F.col("fused")).alias("lang"), F.round(F.array_max("fused"), 6).alias("probability"), "n_chars")
