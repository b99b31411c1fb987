"""Keyed tables on files: replace, upsert, filtered scans, embedding cache, data checks."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import digest, embedding_text


def where_given(df: DataFrame, **values: object) -> DataFrame:
    """Rows that equal every value that isn't None."""
    wanted = [F.col(k) == v for k, v in values.items() if v is not None]
    return df.where(reduce(Column.__and__, wanted)) if wanted else df


def scan_chunks(chunks: DataFrame, strategy: str | None = None, language: str | None = None) -> DataFrame:
    return where_given(chunks, strategy=strategy, language=language).orderBy("document_id", "ord")


def provision(provisions: DataFrame, provision_id: str, language: str | None = None) -> DataFrame:
    return where_given(provisions, provision_id=provision_id, language=language).limit(1)


def replaced(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` without any row of the keys that ``new`` has, and ``new``."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


upserted = replaced


def summaries(documents: DataFrame, provisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: provisions, chunks, mean tokens (0 without chunks), in order of document."""
    p = provisions.groupBy("document_id").agg(F.count("*").alias("provisions"))
    c = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.avg("token_count").alias("average"))
    out = documents.join(p, "document_id", "left").join(c, "document_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("document_id", zero("provisions").alias("provisions"), zero("chunks").alias("chunks"), F.coalesce("average", F.lit(0.0)).alias("average_tokens")).orderBy("document_id")


def ingest_report(documents: DataFrame, provisions: DataFrame, chunks: DataFrame) -> DataFrame:
    p = provisions.groupBy("document_id").agg(F.count("*").alias("provisions"))
    c = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
    out = documents.select("document_id").join(p, "document_id", "left").join(c, "document_id", "left").na.fill(0)
    return out.withColumn("average_tokens", F.coalesce(F.try_divide("tokens", "chunks"), F.lit(0.0)))


def hashed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("text_sha256", digest(embedding_text(F.col("header"), F.col("text"))))


def pending(hashes: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct hashed texts without a vector of the model."""
    return hashes.dropDuplicates(["text_sha256"]).join(cache.where(F.col("model") == model).select("text_sha256"), "text_sha256", "left_anti")


def embedded(texts: DataFrame, embed, model: str, dimensions: int) -> DataFrame:
    """New cache rows of texts (text_sha256, text); ``embed`` maps a text column to a vector column."""
    return texts.select("text_sha256", F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"), embed(F.col("text")).cast(T.ArrayType(T.FloatType())).alias("vector"))


def index_report(hashes: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """chunks, embedded (distinct new texts), reused, hit_rate: a new text's further copies count as reused."""
    known = cache.where(F.col("model") == model).select("text_sha256", F.lit(True).alias("known"))
    each = hashes.join(known, "text_sha256", "left")
    out = each.agg(F.count("*").alias("chunks"), F.countDistinct(F.when(F.col("known").isNull(), F.col("text_sha256"))).alias("embedded"))
    out = out.withColumn("reused", F.col("chunks") - F.col("embedded"))
    return out.withColumn("hit_rate", F.coalesce(F.try_divide("reused", "chunks"), F.lit(0.0)))


def vector_matrix(links: DataFrame, cache: DataFrame, chunks: DataFrame, model: str, strategy: str | None = None, language: str | None = None) -> DataFrame:
    """(chunk_id, vector) of current chunks with a vector of the model. Stale links meet no chunk and drop out."""
    own = where_given(chunks, strategy=strategy, language=language).select("chunk_id")
    held = links.where(F.col("model") == model).join(own, "chunk_id").join(cache, ["text_sha256", "model"])
    return held.select("chunk_id", "vector").orderBy("chunk_id")


def without_stale_links(links: DataFrame, chunks: DataFrame) -> DataFrame:
    return links.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has: a table with a primary key has none."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


BUCKETS = 64
#: Entry of the catalog with the last batch of each stream's query.
BATCHES = "#batches"
#: Times that an addition is tried again after another writer's commit came first.
TRIES = 5


class Conflict(RuntimeError):
    """Another writer committed since this one read the catalog."""


class Tables:
    """Parquet tables below a folder, with numbered catalog files of which the last says which folders are current.

    Keyed tables are kept in BUCKETS buckets by a hash of their first key column. Replacing keys writes the buckets they fall into
    anew, without the keys' old rows, into fresh folders; then a catalog with the next number is created, for all tables of a call at
    once. A number can be created only once: the second of two writers gets a Conflict and nothing of it is seen, so no update is lost.
    A reader sees all of a replacement or nothing of it, a failed one leaves only folders that nobody names, and other buckets are
    neither read nor written. ``vacuum`` removes folders and catalogs that are no longer current.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path(self.folder)))
        return sorted(int(n[8:-5]) for n in names if re.fullmatch(r"catalog-\d+\.json", n))

    def _latest(self) -> tuple[int, dict[str, dict[str, list[str]]]]:
        versions = self._versions()
        if not versions:
            return 0, {}
        row = self.spark.read.text(self.path(f"catalog-{versions[-1]}.json"), wholetext=True).first()
        return versions[-1], json.loads(row["value"])

    def catalog(self) -> dict[str, dict[str, list[str]]]:
        """Folders of each table by bucket; those of tables without a key are all in bucket ""."""
        return self._latest()[1]

    def _commit(self, version: int, catalog: dict[str, dict[str, list[str]]]) -> None:
        """Makes the catalog that follows ``version``: written under another name, then given its number if nobody has it."""
        fs, path = self._fs()
        new, name = path(self.path(f".{uuid.uuid4().hex}")), path(self.path(f"catalog-{version + 1}.json"))
        out = fs.create(new, False)
        out.write(json.dumps(catalog, sort_keys=True).encode())
        out.close()
        renames = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(name), renames)
        except Exception as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"catalog {version + 1} of {self.folder} was made by another writer") from None
            raise

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """The table, or no rows if it doesn't exist yet."""
        return self._read(self.catalog().get(name, {}), schema)

    def _read(self, buckets: dict[str, list[str]], schema: T.StructType) -> DataFrame:
        paths = [self.path(p) for own in buckets.values() for p in own]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def done(self, query: str) -> int:
        """The last batch of a stream's query that is in the tables; -1 before the first."""
        return int(self.catalog().get(BATCHES, {}).get(query, ["-1"])[0])

    def replace(
        self, keys: DataFrame, column: str, new: dict[str, tuple[DataFrame, T.StructType, dict[str, str]]], others: dict[str, tuple[DataFrame, T.StructType, dict[str, str], DataFrame, list[str]]] | None = None,
        batch: tuple[str, int] | None = None,
    ) -> None:
        """In each table of ``new`` (rows, schema, scope), rows of the ``keys`` (one column) go, and those of ``new`` come: keys
        without new rows are deleted. With a scope (column: value), only old rows that have it go. ``others`` change in the same
        commit and have keys of their own: (rows, schema, scope, keys, their columns). ``batch`` (query, number) is noted in that commit."""
        version, catalog = self._latest()
        if batch:
            catalog[BATCHES] = catalog.get(BATCHES, {}) | {batch[0]: [str(batch[1])]}
        for name, (rows, schema, scope, own, columns) in ({n: (*x, keys, [column]) for n, x in new.items()} | (others or {})).items():
            catalog[name] = self._replaced(catalog.get(name, {}), name, rows, schema, scope, own.select(*columns).distinct(), columns)
        self._commit(version, catalog)

    def _replaced(self, had: dict[str, list[str]], name: str, rows: DataFrame, schema: T.StructType, scope: dict[str, str], keys: DataFrame, columns: list[str]) -> dict[str, list[str]]:
        bucket = F.pmod(F.xxhash64(F.col(columns[0])), F.lit(BUCKETS)).cast("string")
        touched = sorted(r[0] for r in keys.select(bucket).distinct().collect())  # at most BUCKETS
        old = self._read({b: had[b] for b in touched if b in had}, schema)
        goes = old.join(keys.withColumn("__goes", F.lit(True)), columns, "left").withColumn("__goes", F.coalesce("__goes", F.lit(False)) & reduce(Column.__and__, [F.col(k).eqNullSafe(v) for k, v in scope.items()], F.lit(True)))
        kept = goes.where(~F.col("__goes")).select(*schema.fieldNames())
        out = f"{name}/{uuid.uuid4().hex}"
        sort = [c for c in ("term", columns[0]) if c in schema.fieldNames()]
        both = kept.unionByName(rows.select(*schema.fieldNames())).withColumn("bucket", bucket)
        both.repartition("bucket").sortWithinPartitions("bucket", *sort).write.partitionBy("bucket").parquet(self.path(out))
        fs, path = self._fs()
        made = {b for b in touched if fs.exists(path(self.path(f"{out}/bucket={b}")))}
        return {b: p for b, p in had.items() if b not in touched} | {b: [f"{out}/bucket={b}"] for b in made}

    def append(self, name: str, df: DataFrame) -> None:
        own = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(self.path(own))
        self._put(lambda catalog: catalog.setdefault(name, {}).setdefault("", []).append(own))

    def overwrite(self, name: str, df: DataFrame, part: str = "") -> None:
        """The table's ``part`` becomes ``df``."""
        own = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(self.path(own))
        self._put(lambda catalog: catalog.setdefault(name, {}).update({part: [own]}))

    def _put(self, change: Callable[[dict], object]) -> None:
        """Commits a change that doesn't depend on what the tables hold, after other writers' commits if need be."""
        for k in range(TRIES):
            version, catalog = self._latest()
            change(catalog)
            try:
                return self._commit(version, catalog)
            except Conflict:
                if k == TRIES - 1:
                    raise

    def count(self, name: str, schema: T.StructType, **values: object) -> int:
        """Rows of a table that equal every value that isn't None."""
        return where_given(self.read(name, schema), **values).count()

    def vacuum(self) -> int:
        """Deletes folders that the catalog doesn't name, and earlier catalogs; the number of folders. Not while others read or write."""
        fs, path = self._fs()
        version, catalog = self._latest()
        catalog.pop(BATCHES, None)
        named = {p.split("/")[1] for buckets in catalog.values() for own in buckets.values() for p in own}
        gone = 0
        for name in catalog:
            for status in fs.listStatus(path(self.path(name))):
                if status.getPath().getName() not in named:
                    gone += bool(fs.delete(status.getPath(), True))
        for v in self._versions():
            if v < version:
                fs.delete(path(self.path(f"catalog-{v}.json")), False)
        return gone
