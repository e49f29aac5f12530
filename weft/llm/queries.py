"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import balltree, decontam, htmlmain, kdtree, langid, license, linededup, packing, prefixtrie, sharding, simhash, tokenstore, warc
from weft.session import table

END_ID = 2
CAPACITY = 1024
SHARDS = 24


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, "doc_id", "text", "lang", langid.training_fold())
    out = langid.predict(docs, model)
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score", "rejected")


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), (F.size("item_ids") > 0).alias("contaminated"), "item_ids", F.round("overlap", 6).alias("overlap")
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "license", "containment")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kdtree.whole_numbers(table(spark, sf_dir, "embeddings"))
    return kdtree.top_k(rows.where("id % 50 = 0"), rows, 5)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    read = tokenstore.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), text.alias("fingerprint"), "component_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID, CAPACITY, with_ids=False)
    packed = packing.pack(parts, CAPACITY)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefixtrie.graft_heads(*prefixtrie.number_turns(table(spark, sf_dir, "conversations")))
    return prefixtrie.trie(turns, convs)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def queries():
    return {
        "op1_language_id": op1_language_id,
        "op2_html_main_text": op2_html_main_text,
        "op3_decontaminate": op3_decontaminate,
        "op4_license_scan": op4_license_scan,
        "op5_line_dedup": op5_line_dedup,
        "op6_exact_top_k": op6_exact_top_k,
        "op7_token_ids": op7_token_ids,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_shards": op10_shards,
        "op11_warc_archive": op11_warc_archive,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_ranked_search": op13_ranked_search,
    }


_TOP_K = """
WITH usable AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_WARC = """
WITH payloads AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
kept AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS kept FROM payloads)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n < 100 OR page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < 100 OR page_id = kept THEN NULL ELSE kept END AS refers_to FROM kept
"""

_TRIE = """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL
), crc(c, s, i, v) AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM turns
  UNION ALL
  SELECT c, s, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END
  FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE v END AS x FROM crc WHERE i < 8 * length(s))
), plan AS (
  SELECT c, c - c % 100 AS base, xor(v, CAST(4294967295 AS BIGINT)) % 6 AS h FROM crc WHERE i = 8 * length(s)
), rebuilt AS (
  SELECT c, 0 AS part, pos, role, text FROM plan JOIN turns ON conv_id = base WHERE pos < h
  UNION ALL SELECT c, 1, pos, role, text FROM plan JOIN turns ON conv_id = c WHERE pos >= h
), whole AS (
  SELECT c, coalesce(list({'role': role, 'text': text} ORDER BY part, pos) FILTER (pos IS NOT NULL), []) AS s FROM plan LEFT JOIN rebuilt USING (c) GROUP BY c
), member AS (
  SELECT c, d, len(s) AS l, length(s[d].text) AS chars, min(c) OVER (PARTITION BY d, s[1:d]) AS node FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM whole)
), nodes AS (
  SELECT node, d, count(*) AS n, coalesce(any_value(chars), 0) AS chars, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = l), '') AS ends FROM member GROUP BY node, d
), linked AS (
  SELECT nodes.*, up.node AS parent FROM nodes LEFT JOIN member up ON up.c = nodes.node AND up.d = nodes.d - 1
), kids AS (
  SELECT a.*, (SELECT count(*) FROM linked b WHERE b.parent = a.node AND b.d = a.d + 1) AS children FROM linked a
), below AS (
  SELECT m.node, m.d, count(*) FILTER (k.children = 0) AS leaves, sum((k.n - 1) * k.chars) AS saved FROM kids k JOIN member m ON m.c = k.node AND m.d <= k.d GROUP BY ALL
)
SELECT node AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, children AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM kids JOIN below USING (node, d)
"""

_RANKED = r"""
WITH split AS (
  SELECT *, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
), counts AS (
  SELECT side, id, t, count(*) AS c FROM (SELECT side, id, unnest(ts) AS t FROM split) GROUP BY ALL
), docs AS (
  SELECT id, len(ts) AS n, count(*) OVER () AS n_docs, CAST(sum(len(ts)) OVER () AS BIGINT) AS n_terms FROM split WHERE side = 0 AND len(ts) > 0
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts JOIN docs USING (id) WHERE side = 0 GROUP BY t
), scored AS (
  SELECT q.id AS item_id, d.id AS doc_id,
    CAST(sum(q.c * w * ((1000000000 * d.c) // (1000 * d.c + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM counts q JOIN counts d ON q.t = d.t JOIN weights ON weights.t = q.t JOIN docs ON docs.id = d.id WHERE q.side = 1 AND d.side = 0 GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


def oracle_sql():
    return {"op4_license_scan": license.oracle_sql(), "op6_exact_top_k": _TOP_K, "op11_warc_archive": _WARC, "op12_prefix_trie": _TRIE, "op13_ranked_search": _RANKED}
