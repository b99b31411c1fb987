"""Numbered sections of guidance texts, from lines, with windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HEADING, LEADER, PAGE_NUMBER, normalise_space


def lines(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, line): cleaned lines, without page numbers and table-of-contents lines."""
    each = texts.select(*keys, F.posexplode(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]")).alias("line_no", "line"))
    clean = each.withColumn("line", normalise_space(F.col("line")))
    return clean.where((F.col("line") != "") & ~F.col("line").rlike(PAGE_NUMBER) & ~F.col("line").rlike(LEADER))


def heading_number(line: Column) -> Column:
    """The number of a heading line; null for other lines. A long numbered sentence isn't a heading."""
    title = F.regexp_extract(line, HEADING, 3)
    number = F.concat(F.regexp_extract(line, HEADING, 1), F.regexp_extract(line, HEADING, 2))
    body = title.rlike("[.;,]$") & (F.size(F.split(title, " +")) > 12)
    return F.when((number != "") & ~body, number)


def islands(clean: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with their section: (keys, line_no, line, raw_number, section): 0 for lines before any heading."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    marked = clean.withColumn("raw_number", heading_number(F.col("line")))
    return marked.withColumn("section", F.count("raw_number").over(order))


def sections(clean: DataFrame, keys: list[str], fallback: Column) -> DataFrame:
    """(keys, ord, number, heading, lines). A number met again has its count behind it; text before any heading is a
    section 1 with the fallback as heading, and uses that number up."""
    found = islands(clean, keys)
    head = F.min(F.when(F.col("raw_number").isNotNull(), F.struct("line_no", "line", "raw_number")))
    body = F.array_sort(F.collect_list(F.when(F.col("raw_number").isNull(), F.struct("line_no", "line"))))
    grouped = found.groupBy(*keys, "section").agg(head.alias("h"), body.alias("b"))
    raw = F.coalesce("h.raw_number", F.lit("1"))
    named = grouped.withColumn("raw", raw).withColumn("k", F.row_number().over(Window.partitionBy(*keys, "raw").orderBy("section")))
    number = F.when(F.col("k") == 1, F.col("raw")).otherwise(F.concat(F.col("raw"), F.lit("-"), F.col("k").cast("string")))
    ordinal = F.row_number().over(Window.partitionBy(*keys).orderBy("section")) - 1
    heading = F.coalesce(F.regexp_extract("h.line", HEADING, 3), fallback)
    return named.select(*keys, ordinal.alias("ord"), number.alias("number"), heading.alias("heading"), F.transform("b", lambda x: x["line"]).alias("lines"))


def joined_lines(lines_col: Column) -> Column:
    """Wrapped lines as paragraphs: one ends after a line that ends ``.``, ``:`` or ``;`` when over 200 characters are there."""
    kind = "struct<done:array<string>,now:string>"

    def merge(s: Column, line: Column) -> Column:
        now = F.when(s["now"].isNull(), line).otherwise(F.concat(s["now"], F.lit(" "), line))
        ends = line.rlike("[.:;]$") & (F.length(now) > 200)
        closed = F.struct(F.concat(s["done"], F.array(now)).alias("done"), F.lit(None).cast("string").alias("now"))
        return F.when(ends, closed).otherwise(F.struct(s["done"].alias("done"), now.alias("now"))).cast(kind)

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now")).cast(kind)
    return F.aggregate(lines_col, zero, merge, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def section_provisions(found: DataFrame, least_words: int = 5) -> DataFrame:
    """Provisions of sections (source_id, language, short_title, ord, number, heading, lines); those of fewer words go, after numbering."""
    parts = F.transform(joined_lines(F.col("lines")), lambda t: F.struct(F.lit(None).cast("string").alias("label"), t.alias("text")))
    rows = found.select(
        F.concat_ws(":", "source_id", F.lit("sec"), "number").alias("provision_id"), F.concat_ws(":", "source_id", "language").alias("document_id"), "source_id", "language", F.lit("sec").alias("kind"), "number",
        F.col("heading").alias("title"), F.array("short_title", F.concat(F.lit("Section "), F.col("number"), F.lit(" — "), F.col("heading"))).alias("breadcrumb"), parts.alias("paragraphs"), F.col("ord").cast("int").alias("ord"),
    )
    words = F.aggregate("paragraphs", F.lit(0), lambda n, p: n + F.size(F.split(F.trim(p["text"]), r"\s+")))
    return rows.where(words >= least_words)
