"""Cutting documents into chunks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import provision_text, strip, token_count
from . import packing

SEPARATOR = "\n\n"
BREADCRUMB = " > "


def chunk_id(document: Column, strategy: Column, order: Column) -> Column:
    return F.format_string("%s:%s:%04d", document, strategy, order)


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of sliding windows over ``n`` tokens: step size - overlap, the last reaches the end; none for n = 0."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("a window has at least one token and overlaps by less than its size")
    step = size - overlap
    count = F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def windows(df: DataFrame, tokens: str, size: int, overlap: int) -> DataFrame:
    """``df`` with a row for each window of an array of tokens: order, start, tokens of the window."""
    starts = window_starts(F.size(tokens), size, overlap)
    each = F.transform(starts, lambda start: F.struct(start.alias("start"), F.slice(tokens, start + 1, size).alias("window")))
    return df.select("*", F.posexplode(each).alias("order", "cut")).select(*[c for c in df.columns], "order", "cut.start", "cut.window")


_PLACE = T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end")])


def _places(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of tokens of each text, and the places of all of them: one text at a time as Python objects, all others as numbers."""
    pattern = re.compile(r"\w+|[^\w\s]")
    found = [np.fromiter((x for m in pattern.finditer(t.as_py() or "") for x in m.span()), np.int32) for t in texts]
    flat = np.concatenate([*found, np.zeros(0, np.int32)]).reshape(-1, 2)
    return np.array([len(own) // 2 for own in found], np.int64), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)


@F.arrow_udf(T.ArrayType(_PLACE))
def token_offsets(texts: pa.Array) -> pa.Array:
    """Character places of words and single symbols: linear in the text."""
    return _lists(*_places(texts))


@F.arrow_udf(T.ArrayType(T.ArrayType(_PLACE)))
def token_offsets_of_each(texts: pa.Array) -> pa.Array:
    """The same for arrays of texts."""
    return _lists(texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), _lists(*_places(texts.flatten())))


@dataclass(frozen=True)
class TokenCounter:
    """What a token is: the number of tokens of a text, their places, and both for each text of an array. ``adds_up``: whether the tokens of
    texts joined by line ends are those of the texts."""

    count: Callable[[Column], Column]
    offsets: Callable[[Column], Column]
    offsets_of_each: Callable[[Column], Column]
    count_of_each: Callable[[Column], Column]
    adds_up: bool = False


WORDS = TokenCounter(token_count, token_offsets, token_offsets_of_each, lambda texts: F.transform(texts, token_count), True)


def tokenizer_counter(path: str) -> TokenCounter:
    """Tokens of a tokenizer file that all workers can read, without special tokens; it is opened once in a worker."""
    place = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

    def places(texts: list[str | None]) -> list[list[dict[str, int]]]:
        found = _tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
        return [[{"start": a, "end": b} for a, b in x.offsets] for x in found]

    @F.pandas_udf(T.IntegerType())
    def count(texts):
        import pandas as pd

        return pd.Series([len(x) for x in places(list(texts))])

    @F.pandas_udf(place)
    def offsets(texts):
        import pandas as pd

        return pd.Series(places(list(texts)))

    @F.pandas_udf(T.ArrayType(place))
    def offsets_of_each(texts):
        import pandas as pd

        return pd.Series([places(list(own) if own is not None else []) for own in texts])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def count_of_each(texts):
        import pandas as pd

        return pd.Series([[len(x) for x in places(list(own) if own is not None else [])] for own in texts])

    return TokenCounter(count, offsets, offsets_of_each, count_of_each)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def rendered(provisions: DataFrame) -> DataFrame:
    """Per document: text (texts of its provisions joined by blank lines) and spans (start, end, provision_id)."""
    own = provisions.select("document_id", "source_id", "language", "ord", "provision_id", provision_text(F.col("paragraphs")).alias("text")).where("text <> ''")
    gap = len(SEPARATOR)
    order = Window.partitionBy("document_id", "source_id", "language").orderBy("ord", "provision_id")
    placed = own.withColumn("start", F.coalesce(F.sum(F.length("text") + gap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("start", "provision_id", "text")))
    grouped = placed.groupBy("document_id", "source_id", "language").agg(parts.alias("parts"))
    spans = F.transform("parts", lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.length(p["text"])).alias("end"), p["provision_id"].alias("provision_id")))
    return grouped.select("document_id", "source_id", "language", F.array_join(F.transform("parts", lambda p: p["text"]), SEPARATOR).alias("text"), spans.alias("spans"))


#: Characters of a step of the overlap join.
STEP = 2048


def overlap_join(windows: DataFrame, spans: DataFrame, on: str, step: int = STEP) -> DataFrame:
    """Pairs of windows [a, b) and spans [s, e) of one document that overlap. Both are filed under the steps of the document that they touch
    and meet there, a pair at the first step that both touch: a window looks at the spans beside it, not at all of its document."""
    steps = lambda first, end: F.sequence(F.floor(F.col(first) / step), F.floor(F.greatest(F.col(end) - 1, F.col(first)) / step))
    left = windows.withColumn("__step", F.explode(steps("a", "b")))
    right = spans.withColumn("__step", F.explode(steps("s", "e")))
    met = left.join(right, [on, "__step"]).where((F.col("s") < F.col("b")) & (F.col("a") < F.col("e")))
    return met.where(F.col("__step") == F.floor(F.greatest("a", "s") / step)).drop("__step")


def fixed_chunks(provisions: DataFrame, size: int = 512, overlap: int = 64, counter: TokenCounter = WORDS) -> DataFrame:
    """Sliding windows over whole documents; places come from token offsets, so repeated text is never mislocated."""
    keys = ["document_id", "source_id", "language"]
    docs = rendered(provisions)
    placed = docs.withColumn("offsets", counter.offsets(F.col("text")))

    def cut(start: Column) -> Column:
        own = F.slice("offsets", start + 1, size)
        a, b = F.element_at(own, 1)["start"], F.element_at(own, -1)["end"]
        return F.struct(F.substring("text", a + 1, b - a).alias("text"), F.size(own).alias("token_count"), a.alias("a"), b.alias("b"))

    # A window is made as a small struct, so no row holds the whole text beside it.
    each = placed.select(*keys, F.xxhash64(*keys).alias("doc"), F.posexplode(F.transform(window_starts(F.size("offsets"), size, overlap), cut)).alias("order", "cut")).select(*keys, "doc", "order", "cut.*")
    spans = docs.select(F.xxhash64(*keys).alias("doc"), *(F.col(c).alias(f"of_{c}") for c in keys), F.explode("spans").alias("span")).select("doc", *(f"of_{c}" for c in keys), F.col("span.start").alias("s"), F.col("span.end").alias("e"), "span.provision_id")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys]
    met = overlap_join(each.select(*keys, "doc", "order", "a", "b"), spans, "doc").where(same[0] & same[1] & same[2])
    named = met.groupBy(*keys, "order").agg(F.array_sort(F.collect_list(F.struct("s", "provision_id"))).alias("own")).select(*(F.col(c).alias(f"of_{c}") for c in keys), F.col("order").alias("of_order"), F.col("own.provision_id").alias("provision_ids"))
    full = each.join(named, (F.col("order") == F.col("of_order")) & same[0] & same[1] & same[2], "left")
    return full.select(
        chunk_id(F.col("document_id"), F.lit("fixed"), F.col("order")).alias("chunk_id"), "document_id", "source_id", "language", F.lit("fixed").alias("strategy"), F.col("order").alias("ord"), F.lit("").alias("header"),
        "text", "token_count", F.coalesce("provision_ids", F.array().cast("array<string>")).alias("provision_ids"),
    )


def packed(pieces: Column, sizes: Column, budget: Column, least: int) -> Column:
    """Greedy packing of pieces into bodies (n, parts, see ``packing``): a piece over the budget is one of its own, the short tail joins its
    neighbour. Token counts add up over line ends."""
    return packing.bodies(F.when(pieces.isNotNull(), sizes), budget, least, cut=False)


#: Provisions of a document whose chunks are counted in one group.
COUNTED_TOGETHER = 4096


def first_numbers(provisions: DataFrame, count: str) -> DataFrame:
    """(document_id, ord, provision_id, before): the sum of ``count`` over the document's earlier provisions, from narrow rows in groups
    of COUNTED_TOGETHER numbers, so no task holds a whole document."""
    rows = provisions.select("document_id", "ord", "provision_id", count).withColumn("part", F.expr(f"ord div {COUNTED_TOGETHER}"))
    earlier = lambda w: F.coalesce(F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("document_id", "part").agg(F.sum(count).alias(count)).withColumn("base", earlier(Window.partitionBy("document_id").orderBy("part"))).drop(count)
    own = rows.withColumn("within", earlier(Window.partitionBy("document_id", "part").orderBy("ord", "provision_id")))
    return own.join(parts, (own["part"].eqNullSafe(parts["part"])) & (own["document_id"] == parts["document_id"])).select(own["document_id"], "ord", "provision_id", (F.col("base") + F.col("within")).cast("int").alias("before"))


def structural_chunks(provisions: DataFrame, size: int = 512, least: int = 48, counter: TokenCounter = WORDS) -> DataFrame:
    """One chunk for each provision that fits; else packed paragraphs, with windows of paragraphs that are too long.

    Chunks of a document are numbered by (ord, provision_id), which are different for its provisions.
    """
    cut = _bodies(provisions, size, least, counter)
    number = first_numbers(cut.withColumn("k", F.size("cuts")), "k")
    keys = ["document_id", "ord", "provision_id"]
    each = cut.join(number, keys).select(*keys, "before", "source_id", "language", "header", "whole", "lines", "places", F.posexplode("cuts").alias("part", "cut"))
    body = F.when(F.size("cut.parts") == 0, F.col("whole")).otherwise(packing.body_text(F.col("cut"), F.col("lines"), F.col("places")))
    order = F.col("before") + F.col("part")
    tokens = F.col("cut.n") if counter.adds_up else counter.count(F.col("text"))
    each = each.select("document_id", "source_id", "language", order.alias("number"), "header", body.alias("text"), "cut", "provision_id")
    return each.select(
        chunk_id(F.col("document_id"), F.lit("structural"), F.col("number")).alias("chunk_id"), "document_id", "source_id", "language", F.lit("structural").alias("strategy"), F.col("number").alias("ord"), "header",
        "text", tokens.alias("token_count"), F.array("provision_id").alias("provision_ids"),
    )


def _bodies(provisions: DataFrame, size: int, least: int, counter: TokenCounter) -> DataFrame:
    """Provisions with their cuts: bodies by numbers, one without parts for a provision that fits as a whole."""
    header = F.array_join("breadcrumb", BREADCRUMB)
    line = F.transform("paragraphs", lambda p: F.when(F.coalesce(p["label"], F.lit("")) == "", p["text"]).otherwise(F.concat(p["label"], F.lit(" "), p["text"])))
    own = provisions.select("document_id", "source_id", "language", "provision_id", "ord", header.alias("header"), provision_text(F.col("paragraphs")).alias("whole"), F.filter(line, lambda x: strip(x) != "").alias("lines")).where("whole <> ''")
    own = own.withColumns({"budget": F.greatest(F.lit(1), F.lit(size) - counter.count(F.col("header"))), "sizes": counter.count_of_each(F.col("lines"))})
    total = F.aggregate("sizes", F.lit(0), lambda a, n: a + n) if counter.adds_up else counter.count(F.col("whole"))
    own = own.withColumn("n", total)
    # The Arrow function stands between the counts and what uses them, so each text is counted once.
    own = own.withColumn("found", packing.bodies(F.when(F.col("n") > F.col("budget"), F.col("sizes")), F.col("budget"), least))
    long = F.transform("lines", lambda x, i: F.when(F.col("sizes")[i] > F.col("budget"), x))
    one = F.array(F.struct(F.col("n").cast("int").alias("n"), F.array().cast("array<struct<first:int,last:int,start:int,count:int>>").alias("parts")))
    own = own.withColumn("places", counter.offsets_of_each(F.when(F.col("n") > F.col("budget"), long).otherwise(F.array().cast("array<string>"))))
    return own.withColumn("cuts", F.when(F.col("n") > F.col("budget"), F.col("found")).otherwise(one)).drop("found", "sizes")


def chunk(provisions: DataFrame, strategy: str = "structural", size: int = 512, overlap: int = 64, least: int = 48, counter: TokenCounter = WORDS) -> DataFrame:
    if strategy == "fixed":
        return fixed_chunks(provisions, size, overlap, counter)
    if strategy == "structural":
        return structural_chunks(provisions, size, least, counter)
    raise ValueError(f"unknown strategy {strategy!r}: fixed or structural")
