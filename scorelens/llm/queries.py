"""One registered query per operator, over its whole table, and its SQL form where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scorelens.llm import (
    conversation_repair,
    merge_replay,
    near_dedup,
    norm_buckets,
    offset_pieces,
    packing,
    paragraph_sketch,
    prefix_counts,
    quality_cnn,
    quality_rules,
    repeats,
    token_store,
    toxicity,
)
from scorelens.llm.common import table
from scorelens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, i, w FROM (
        SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d))),
t AS (SELECT doc_id, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS t
      FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM t WHERE t IS NOT NULL) WHERE n > 1),
c AS (SELECT doc_id, sum(g) AS n FROM (
        SELECT doc_id, least(3, i - lag(i, 1, -9) OVER (PARTITION BY doc_id ORDER BY i)) AS g FROM r) GROUP BY doc_id),
wc AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS chars,
              count(*) FILTER (lower(w) IN ({_STOP})) AS stops FROM w GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS u FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT d.doc_id, CAST(coalesce(wc.n, 0) AS BIGINT) AS n_words,
             CAST(coalesce(wc.chars, 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(l.n - l.u, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(l.n, 0) AS n_lines, coalesce(wc.stops, 0) AS stops
      FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars * 100 < 200 * n_words OR word_chars * 100 > 1500 * n_words
            OR n_symbols * 100 > 10 * n_words OR stops * 100 < 2 * n_words OR n_dup_lines * 100 > 30 * n_lines) AS kept
FROM g"""


@query("op7_quality_rules", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op5_prefix_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return prefix_counts.token_counts(table(spark, sf_dir, "documents"), path)


@query("op10_offset_pieces")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return offset_pieces.offset_digests(table(spark, sf_dir, "documents"), path)


@query("op6_token_store")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch_path(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents"), store, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_store(spark, store, with_ids=False)


@query("op3_pattern_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op1_toxicity_instances")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op4_byte_network")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


@query("op8_paragraph_sketch")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.edited_and_next(table(spark, sf_dir, "documents"))


@query("op2_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_repeated_bytes")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


@query("op12_merge_replay")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return merge_replay.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digest_only=True)


OP13_SQL = rf"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{norm_buckets.TERM}') AS ws
      FROM documents),
d AS (SELECT row, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM words WHERE len(ws) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{norm_buckets.TERM}')) AS term
      FROM benchmark),
t AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(ws) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, docs),
s AS (SELECT item_id, d.row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT)
             AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN d USING (row), c GROUP BY ALL),
r AS (SELECT item_id, doc_id, score,
             CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {norm_buckets.TOP}"""


@query("op13_norm_buckets", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
