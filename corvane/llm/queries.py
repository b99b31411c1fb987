"""Queries of the corpus operators over whole tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (host, path, verdict) of the listed URL rules.
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def remainder(doc_id: str, parts: int):
    """crc32 of doc_id as text, modulo ``parts``: deals rows to folds."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(parts))


def op1_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_main import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored, train

    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import scored, train

    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 7) == 2
    found = scored(docs, train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import proof_digest, tamper_check

    found = tamper_check(table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0)
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(found["proof"]).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_main": op1_html_main,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_lm_score": op6_lm_score,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_pack": op9_pack,
    "op10_simhash": op10_simhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_warc": op12_warc,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha AS text_sha256
        FROM d WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id)""",
    "op8_url_filter": r"""
        WITH u AS (
          SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        m AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
              FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1""",
    "op11_filter_audit": r"""
        WITH w AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        l AS (SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic FROM labels GROUP BY doc_id),
        m AS (
          SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
            'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t),
            'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS x
          FROM w LEFT JOIN l USING (doc_id)),
        f AS (
          SELECT part, x.A::INT + 2 * x.B::INT + 4 * x.C::INT + 8 * x.D::INT + 16 * x.E::INT AS fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS tox
          FROM m GROUP BY ALL),
        b(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
              FROM b a JOIN b ON b.bit <> a.bit JOIN b c ON c.bit NOT IN (a.bit, b.bit) JOIN b d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN b e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
        s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
        r AS (
          SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (fails & before > 0 AND fails & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
                 coalesce(sum(g) FILTER (fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(tox) FILTER (fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS toxic_lost
          FROM f, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r""",
    "op12_warc": r"""
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
        SELECT page_id, strlen(html) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p""",
    "op13_merkle": r"""
        WITH RECURSIVE v AS (
          SELECT row_number() OVER () AS id, doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
            list_reduce(list_transform(range(1, length(coalesce(doc_id::VARCHAR, '')) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT),
              lambda c, x: list_reduce(range(8), lambda r, j: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END, xor(c, x)), 4294967295::UBIGINT) AS crc FROM documents),
        d AS (
          SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                 sha256(head || CASE WHEN text IS NULL THEN '-' WHEN xor(crc, 4294967295::UBIGINT) % 5 > 0 THEN strlen(text) || ':' || text
                   ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) AS seen FROM v),
        leaves AS (
          SELECT *, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
        up AS (
          SELECT tree, 0 AS level, pos, leaf AS digest, n FROM leaves
          UNION ALL
          SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16) FROM up WHERE n > 1 GROUP BY tree, level, pos // 16),
        tops AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
        above AS (
          SELECT 0 AS level, pos, digest, n FROM tops
          UNION ALL
          SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16) FROM above WHERE n > 1 GROUP BY level, pos // 16),
        low AS (
          SELECT id, tree, 0 AS level, pos, n, seen AS h, '' AS proof FROM leaves
          UNION ALL
          SELECT id, l.tree, l.level + 1, l.pos // 16, any_value((l.n + 15) // 16), sha256(string_agg(CASE WHEN u.pos = l.pos THEN l.h ELSE u.digest END, '' ORDER BY u.pos)),
                 any_value(l.proof) || coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos <> l.pos), '')
          FROM low l JOIN up u ON u.tree = l.tree AND u.level = l.level AND u.pos // 16 = l.pos // 16 WHERE l.n > 1 GROUP BY id, l.tree, l.level, l.pos),
        high AS (
          SELECT id, 0 AS level, t.pos, t.n, h, proof FROM low JOIN tops t USING (tree) WHERE low.n = 1
          UNION ALL
          SELECT id, l.level + 1, l.pos // 16, any_value((l.n + 15) // 16), sha256(string_agg(CASE WHEN u.pos = l.pos THEN l.h ELSE u.digest END, '' ORDER BY u.pos)),
                 any_value(l.proof) || coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos <> l.pos), '')
          FROM high l JOIN above u ON u.level = l.level AND u.pos // 16 = l.pos // 16 WHERE l.n > 1 GROUP BY id, l.level, l.pos)
        SELECT doc_id, leaf, t.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = r.digest AS verified
        FROM leaves JOIN tops t USING (tree) JOIN high ON high.id = leaves.id AND high.n = 1 JOIN above r ON r.n = 1""",
}
