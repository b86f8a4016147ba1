"""Registered queries of the operators on the driver tables, and their SQL where SQL can say it."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe_tree,
    katz,
    multi_index,
    periodic_runs,
    poisson_mix,
    prefix_trie,
    quality_fm,
    rules,
    sketch_dedup,
    style_tree,
    token_files,
    tool_links,
    warc,
)
from tidemark.llm.common import held_out, shared_dir, table

RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER, END_ID = "byte_bpe_50k.json", 2

QUERIES = {}
ORACLES = {}


def register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return keep


@register("op1_quality_fm")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality_fm.fit(documents, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4))
    return documents.select(
        "doc_id",
        held_out(F.col("doc_id"), 4).alias("held_out"),
        quality_fm.score(documents, model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= quality_fm.THRESHOLD).cast("int"))


@register("op2_katz_backoff")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(F.col("doc_id"), 7)
    scored = katz.score(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register("op3_sketch_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.classes(table(spark, sf_dir, "documents")).drop("fp")


@register("op4_style_tree")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages"))


_SCHEMAS = {
    "lookup": {
        "type": "object",
        "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}},
        "required": ["query", "limit"],
        "additionalProperties": False,
    }
}


@register(
    "op5_tool_links",
    """
    WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
               WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    u AS (SELECT conv_id, turn, conv_id || '-' || turn AS call_id,
                 CASE WHEN length(text) % 7 = 0 THEN 'unlisted' ELSE 'lookup' END AS name,
                 length(text) % 50 AS n, to_json(text)::VARCHAR AS query
          FROM m WHERE role = 'user'),
    c AS (SELECT *, count(*) OVER k AS copies, row_number() OVER (k ORDER BY turn, name, query, n) AS nth
          FROM u WINDOW k AS (PARTITION BY conv_id, call_id)),
    r AS (SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS call_id, text FROM m WHERE role = 'assistant'),
    a AS (SELECT *, count(*) OVER k AS copies, row_number() OVER (k ORDER BY turn, text) AS nth
          FROM r WINDOW k AS (PARTITION BY conv_id, call_id)),
    f AS (SELECT conv_id, min(turn) AS first_turn FROM u GROUP BY conv_id)
    SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id,
           coalesce(c.turn, a.turn) AS turn,
           CASE WHEN c.conv_id IS NOT NULL THEN (c.turn <> first_turn)::INT END AS level,
           coalesce(c.copies, a.copies) AS copies,
           CASE WHEN c.conv_id IS NULL THEN 'no_call' WHEN c.name = 'unlisted' THEN 'no_schema'
                WHEN n = 0 THEN 'invalid' WHEN a.conv_id IS NULL THEN 'no_result' ELSE 'ok' END AS status,
           '{"arguments":' || CASE WHEN c.conv_id IS NULL THEN '{}' ELSE '{"limit":' || n || ',"query":' || query || '}' END
             || ',"id":"' || coalesce(c.call_id, a.call_id) || '","name":' || coalesce('"' || name || '"', 'null')
             || ',"result":' || coalesce(to_json(a.text)::VARCHAR, 'null') || '}' AS line
    FROM (SELECT * FROM c WHERE nth = 1) c
    FULL JOIN (SELECT * FROM a WHERE nth = 1) a ON c.conv_id = a.conv_id AND c.call_id = a.call_id
    LEFT JOIN f ON c.conv_id = f.conv_id
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as calls of a lookup tool that build on the conversation's first, answers as results."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    text, size = F.coalesce(F.col("text"), F.lit("")), F.length(F.coalesce("text", F.lit("")))
    name = lambda turn: F.concat_ws("-", F.col("conv_id"), turn)
    asked = turns.where("role = 'user'")
    first = asked.groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    calls = asked.join(first, "conv_id").select(
        "conv_id",
        name(F.col("turn")).alias("call_id"),
        "turn",
        F.when(size % 7 == 0, "unlisted").otherwise("lookup").alias("name"),
        F.to_json(F.struct(text.alias("query"), (size % 50).alias("limit"))).alias("arguments"),
        F.array(name(F.col("first_turn"))).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", text.alias("content")
    )
    return tool_links.link(calls, results, _SCHEMAS)


@register("op6_bpe_tree")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    )


@register(
    "op7_warc",
    """
    WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS g FROM pages),
    f AS (SELECT g, min(page_id) AS m FROM d WHERE n >= 100 GROUP BY g),
    x AS (SELECT *, n >= 100 AND m IS NOT NULL AND (page_id IS NULL OR page_id > m) AS again FROM d LEFT JOIN f USING (g))
    SELECT page_id, n AS payload_bytes, g AS payload_digest,
           CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN m END AS refers_to
    FROM x
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).drop("url")


@register("op8_multi_index")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


_STOP_SQL = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)


@register(
    "op9_quality_rules",
    rf"""
    WITH t AS (
      SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
    ), w AS (
      SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM t
    ), win AS (
      SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
    ), rep AS (
      SELECT r, count(DISTINCT p) AS n FROM (
        SELECT r, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1)
      GROUP BY r
    ), m AS (
      SELECT doc_id, len(ws) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
             coalesce(rep.n, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop_words
      FROM w LEFT JOIN rep USING (r)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
             AND word_chars / n_words BETWEEN 2.0 AND 20.0
             AND n_symbols / n_words <= 0.3
             AND n_dup_lines / n_lines <= 0.6
             AND n_stop_words / n_words >= 0.02 AS kept
    FROM m
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@register(
    "op10_poisson_mix",
    """
    WITH c AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
    r AS (SELECT source, (SELECT sum(n) FROM c)::DOUBLE * w / (SELECT sum(w) FROM c) / n AS rate FROM c),
    q AS (SELECT source, ceil(rate / 16.0)::INT AS pieces, rate / ceil(rate / 16.0) AS mean FROM r),
    cdf AS (
      SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
      FROM q, generate_series(0, 89) AS g(k)
    ), d AS (SELECT *, row_number() OVER () AS row_no FROM documents),
    u AS (
      SELECT row_no, q.source,
             ('0x' || substr(md5(concat_ws(':', '11', piece, coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT
               / 4503599627370496.0 AS u
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source, generate_series(1, 1000) AS g(piece)
      WHERE piece <= pieces
    ), n AS (
      SELECT row_no, count(*) AS n FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND u.u >= cdf.p
      GROUP BY row_no
    )
    SELECT doc_id, text, lang, d.source, n_chars, unnest(range(1, n + 1))::INT AS copy_no FROM d JOIN n USING (row_no)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return poisson_mix.mix(documents, poisson_mix.tempered_weights(documents), marks=True).drop("place")


@register("op11_prefix_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefixes(table(spark, sf_dir, "conversations"))


@register("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"), repeat=True)


@register("op13_token_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read(spark, folder)


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
