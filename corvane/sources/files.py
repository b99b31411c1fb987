"""Files: raw bytes with a manifest, JSON lines, prompts, saved runs, reports."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import digest
from ..schemas import CASES, DOWNLOADS, HUMAN_LABELS, RUN, SOURCES

#: How an act is asked for by its CELEX number.
CELLAR = "http://publications.europa.eu/resource/celex/"
SUFFIX = {"eurlex-xhtml": "xhtml", "pdf": "pdf"}
LANGUAGE_CODES = {"en": "eng", "fr": "fra"}


def raw_bytes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(filename, content, size_bytes, sha256) of the files in a folder; a missing folder is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(name.alias("filename"), "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def changed(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files whose bytes the manifest (filename, sha256) doesn't have; all with ``force``."""
    return files if force else files.join(manifest.select("filename", "sha256"), ["filename", "sha256"], "left_anti")


def read_downloads(spark: SparkSession, path: str) -> DataFrame:
    """Download records of a JSON object by file name."""
    whole = spark.read.text(path, wholetext=True)
    schema = f"map<string,{DOWNLOADS.simpleString()}>"
    return whole.select(F.explode(F.from_json("value", schema)).alias("name", "r")).select("r.*")


def write_downloads(records: list[dict], path: str) -> None:
    """Records by file name, keys sorted. A manifest is a handful of rows, kept on the driver."""
    own = f"{path}.new"
    with open(own, "w", encoding="utf-8") as f:
        json.dump({r["filename"]: r for r in records}, f, indent=2, sort_keys=True, default=str, ensure_ascii=False)
    os.replace(own, path)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A source manifest, YAML or JSON. A source without a CELEX number needs a URL for each of its languages."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    rows = [{name: s.get(name) for name in SOURCES.fieldNames()} for s in data["sources"]]
    for r in rows:
        missing = [] if r["celex"] else [lang for lang in r["languages"] if lang not in (r["urls"] or {})]
        if missing:
            raise ValueError(f"source {r['id']}: no CELEX number and no URL for {', '.join(missing)}")
    return spark.createDataFrame(rows, SOURCES)


def source(sources: DataFrame, source_id: str):
    """The row of a source; an unknown id is a KeyError that lists those known."""
    found = sources.where(F.col("id") == source_id).first()
    if found is None:
        known = ", ".join(r["id"] for r in sources.select("id").orderBy("id").collect())
        raise KeyError(f"unknown source {source_id!r}; known: {known}")
    return found


def downloads_wanted(sources: DataFrame) -> DataFrame:
    """(source_id, language, url, filename, accept, accept_language) of each source and language."""
    each = sources.select("*", F.explode("languages").alias("language"))
    by_number = F.col("celex").isNotNull()
    codes = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    url = F.when(by_number, F.concat(F.lit(CELLAR), F.col("celex"))).otherwise(F.try_element_at("urls", F.col("language")))
    suffix = F.create_map(*[F.lit(x) for pair in SUFFIX.items() for x in pair])[F.col("format")]
    return each.select(
        F.col("id").alias("source_id"), "language", url.alias("url"), F.concat_ws(".", F.concat_ws("_", "id", "language"), suffix).alias("filename"),
        F.when(by_number, "application/xhtml+xml").alias("accept"), F.when(by_number, codes[F.col("language")]).alias("accept_language"),
    )


#: Where a row stands: a file's splits may come in any order, a split's rows come in theirs.
_PLACE = ("_metadata.file_path", "_metadata.file_block_start")


def _in_file_order(rows: DataFrame) -> DataFrame:
    """With ``ord`` from 0. These are files that people write, so one task can number them."""
    placed = rows.withColumn("__row", F.monotonically_increasing_id())
    order = Window.orderBy("file_path", "file_block_start", "__row")
    return placed.withColumn("ord", (F.row_number().over(order) - 1).cast("long")).drop("file_path", "file_block_start", "__row")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases of a JSON-lines file, defaults filled in, in file order (``ord``). A malformed line is an error."""
    rows = spark.read.schema(CASES).option("mode", "FAILFAST").json(path)
    filled = rows.select("*", *_PLACE).na.fill({"expect_abstention": False, "reviewed": False, "notes": ""}).withColumn("expected_provisions", F.coalesce("expected_provisions", F.array().cast("array<string>")))
    return _in_file_order(filled)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Human labels; of a case's lines the last counts."""
    rows = _in_file_order(spark.read.schema(HUMAN_LABELS).option("mode", "FAILFAST").json(path).select("*", *_PLACE))
    last = Window.partitionBy("case_id").orderBy(F.desc("ord"))
    return rows.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k", "ord")


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text, version) of the Markdown files of a folder."""
    files = spark.read.text(folder, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("name"))
    return prompts(files.select("name", F.col("value").alias("text")))


def prompts(texts: DataFrame) -> DataFrame:
    """Stripped texts with version ``name@digest``."""
    from ..functions.text import strip

    own = texts.select("name", strip(F.col("text")).alias("text"))
    return own.withColumn("version", F.concat(F.col("name"), F.lit("@"), digest(F.col("text"), 8)))


def read_run_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")


def write_report(summary: DataFrame, cases: DataFrame, categories: DataFrame, folder: str, judge_model: str, dataset: str) -> str:
    """``run.json`` and ``report.md`` in a new timestamped folder. An evaluation's rows are as many as its questions."""
    from ..functions.report import markdown

    out = f"{folder}/{datetime.now(UTC):%Y%m%dT%H%M%S%fZ}"
    os.makedirs(out)
    head, rows, groups = summary.first().asDict(), [r.asDict(True) for r in cases.collect()], [r.asDict() for r in categories.orderBy("category").collect()]
    with open(f"{out}/run.json", "w", encoding="utf-8") as f:
        json.dump({"summary": head, "judge_model": judge_model, "dataset": dataset, "cases": rows}, f, ensure_ascii=False, indent=2)
    with open(f"{out}/report.md", "w", encoding="utf-8") as f:
        f.write(markdown(head, groups, rows, judge_model, dataset))
    return out
