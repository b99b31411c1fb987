"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A rule is a host and a path prefix. Its canonical key is ``host + path``. A page's URL fits a rule if its host is the
rule's or a subdomain of it and its path starts with the rule's path, so a URL is probed with each of its host's
suffixes (at label ends) crossed with the prefixes of its path that have the length of some listed path. The filter has
blocks of eight 32-bit lanes; a key picks a block and sets one bit in each lane. Keys that pass go to a hash join with the
rules on the key itself, which removes false positives.

Defined cases: a null URL or one without ``://`` has empty host and path and fits no rule; an empty rule list leaves all
to the default; repeated rules count once (block wins over allow for the same key); an empty table gives an empty result;
further columns of the page table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8
#: Keys for each block of 256 bits (16 bits a key). Filters of at most MAX_SENT_BLOCKS blocks (8 MB) are sent to all tasks; larger ones are joined by block.
KEYS_PER_BLOCK = 16
MAX_SENT_BLOCKS = 1 << 18


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column) -> list[Column]:
    """For each lane, the value with the key's bit set."""
    h = F.xxhash64(key, F.lit(7))
    return [F.call_function("shiftleft", F.lit(1), F.pmod(F.shiftrightunsigned(h, 5 * i), F.lit(32)).cast("int")) for i in range(LANES)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def blocked_bloom(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, lane0..lane7) for the keys; blocks without a key are absent."""
    lanes = [b.alias(f"lane{i}") for i, b in enumerate(_bits(F.col(key)))]
    return keys.select(_block(F.col(key), n_blocks).alias("block"), *lanes).groupBy("block").agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none), verdict. ``rules``: host, path, verdict."""
    listed = (
        rules.select(F.concat("host", "path").alias("key"), F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict")
        .groupBy("key", "r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))
    )
    facts = listed.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths")).first()
    n_blocks = max(1, -(-facts["n"] // KEYS_PER_BLOCK))
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("n_labels", F.size(F.split("host", r"\.")))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.col("n_labels")), lambda i: F.array_join(F.slice(labels, i, F.col("n_labels")), "."))
    prefixes = F.transform(F.filter(F.lit(list(facts["lengths"])).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    candidates = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("c_host"), p.alias("c_path")))))
    probes = urls.where("host <> ''").select("page_id", "host", "path", F.explode(candidates).alias("c")).select("page_id", "host", "path", "c.*").withColumn("c_key", F.concat("c_host", "c_path"))
    bloom = blocked_bloom(listed.select(F.col("key").alias("b_key")), "b_key", n_blocks)
    bloom = F.broadcast(bloom) if n_blocks <= MAX_SENT_BLOCKS else bloom
    passed = probes.withColumn("block", _block(F.col("c_key"), n_blocks)).join(bloom, "block")
    for i, bit in enumerate(_bits(F.col("c_key"))):
        passed = passed.where(F.col(f"lane{i}").bitwiseAND(bit) == bit)
    exact = passed.join(listed, (F.col("c_key") == F.col("key")) & (F.col("c_host") == F.col("r_host")) & (F.col("c_path") == F.col("r_path")))
    best = exact.groupBy("page_id", "host", "path").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), "r_verdict")).alias("best"))
    best = best.select(F.col("page_id").alias("b_id"), F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best")
    found = urls.join(best, F.col("page_id").eqNullSafe(F.col("b_id")) & (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
