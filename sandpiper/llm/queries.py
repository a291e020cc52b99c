"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sandpiper.llm.bpe import encode_decode
from sandpiper.llm.factorisation import quality
from sandpiper.llm.lines import drop_lines
from sandpiper.llm.negatives import hard_negatives
from sandpiper.llm.packing import pack
from sandpiper.llm.quality import judged
from sandpiper.llm.shards import shard_documents
from sandpiper.llm.simhash import near_duplicates
from sandpiper.llm.substrings import removal_digest
from sandpiper.llm.topk import quantised, topk
from sandpiper.llm.toxicity import toxicity
from sandpiper.llm.urls import filter_urls
from sandpiper.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


URL_RULES = [("block", "com", "en/"), ("allow", "example.com", "en/7"), ("allow", "net", "de/"), ("block", "example.net", "de/8"), ("block", "org", "es/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return topk(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), 4).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END")
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives(vectors, vectors.filter("vec_id % 100 = 0"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_url_filter, op3_exact_topk, op4_simhash_neardup, op5_bpe, op6_packing, op7_line_dedup, op8_sharding, op9_toxicity, op10_substring_dedup, op11_embedding_whitening, op12_quality_classifier, op13_hard_negatives)}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, v.e)]) AS BIGINT) AS score
            FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM pairs
        )
        SELECT * FROM ranked WHERE "rank" <= 5""",
    "op7_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents
        ), w AS (
            SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws, row_number() OVER (ORDER BY doc_id, n) AS pos FROM l
        ), d AS (
            SELECT ws, min(pos) AS pos FROM w WHERE len(ws) > 0 GROUP BY ws
        ), v AS (
            SELECT pos, array_to_string(ws, ' ') AS rest, 0 AS i FROM d
            UNION ALL SELECT pos, array_to_string(list_concat(ws[: i - 1], ws[i + 1 :]), ' '), i FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) >= 5)
        ), same AS (
            SELECT rest, i, min(pos) AS p FROM v GROUP BY rest, i
        ), firsts AS (
            SELECT rest, min(p) FILTER (i = 0) AS whole, min(p) FILTER (i > 0) AS cut FROM same GROUP BY rest
        ), near AS (
            SELECT v.pos FROM v JOIN same s ON s.rest = v.rest AND s.i = v.i WHERE v.i > 0 AND s.p < v.pos
            UNION SELECT v.pos FROM v JOIN firsts f ON f.rest = v.rest WHERE CASE WHEN v.i = 0 THEN f.cut ELSE f.whole END < v.pos
        ), kept AS (
            SELECT w.doc_id, string_agg(w.line, chr(10) ORDER BY w.n) FILTER (k.keep) AS text, count(*) AS n_lines, count(*) FILTER (NOT k.keep) AS n_dropped
            FROM w LEFT JOIN d ON d.pos = w.pos LEFT JOIN near ON near.pos = w.pos, LATERAL (SELECT len(w.ws) = 0 OR (d.pos IS NOT NULL AND near.pos IS NULL) AS keep) k GROUP BY w.doc_id
        )
        SELECT doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(n_lines, 1) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
        FROM documents t LEFT JOIN kept USING (doc_id)""",
    "op8_sharding": """
        WITH RECURSIVE poly AS (
            SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))
        ), bytes AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
                list_concat([4294967295], [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]) AS b FROM documents
        ), sums AS (
            SELECT doc_id, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) AS crc FROM bytes, poly
        ), jump AS (
            SELECT doc_id, n, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, (CAST(doc_id AS HUGEINT) + 18446744073709551616) % 18446744073709551616 AS k FROM documents, (SELECT unnest([40, 41]) AS n)
            UNION ALL
            SELECT doc_id, n, j, CAST(least(floor((j + 1) * (2147483648.0::DOUBLE / CAST((k1 // 8589934592) + 1 AS DOUBLE))), n) AS BIGINT), k1
            FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k1 FROM jump WHERE j < n)
        ), shards AS (
            SELECT doc_id, CAST(max(b) FILTER (n = 40) AS INTEGER) AS shard, CAST(max(b) FILTER (n = 41) AS INTEGER) AS grown_shard FROM jump GROUP BY doc_id
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
        FROM sums JOIN shards USING (doc_id)""",
    "op10_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), starts AS (
            SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w WHERE len(words) >= 20
        ), keyed AS (
            SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(words[s : s + 19], ' ') ORDER BY doc_id, s) AS nth FROM starts
        ), gone AS (
            SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS pos FROM keyed WHERE nth > 1
        ), each AS (
            SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w
        ), kept AS (
            SELECT e.doc_id, count(g.pos) AS n_removed, string_agg(e.word, ' ' ORDER BY e.pos) FILTER (WHERE g.pos IS NULL) AS left_text
            FROM each e LEFT JOIN gone g USING (doc_id, pos) GROUP BY e.doc_id
        )
        SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.left_text, '')) AS kept_sha256
        FROM w LEFT JOIN kept k USING (doc_id)""",
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), pairs AS (
            SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.e, v.e)]) AS BIGINT) AS score
            FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY "rank" <= 5""",
}
