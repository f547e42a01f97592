"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, decontaminate, exact_dedup, html_extract, mixing, near_dedup, repeat_dedup, tokens, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_repeat_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    one = spark.range(1).select(F.lit(-7).alias("conv_id"), F.lit(fixed).alias("text"))
    extra = [one.select("conv_id", F.lit(k).alias("turn"), F.lit(role).alias("role"), "text") for k, role in enumerate(("user", "assistant"))]
    turns = chat.canonical_turns(rows.unionByName(extra[0]).unionByName(extra[1]), "conv_id")
    made = turns.select(F.col("id").alias("conv_id"), chat.format_turns(F.col("turns")).alias("formatted"), chat.loss_spans(F.col("turns")).alias("mask"))
    # everything below is read back from the output and its mask
    back = made.withColumn("t", chat.parse_formatted(F.col("formatted")))
    whole = F.concat_ws("", F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    loss = F.concat_ws("", chat.masked_texts(F.col("formatted"), F.col("mask")))
    return back.select(
        "conv_id",
        F.size("t").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.Automaton(*tokens.load_pieces()))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_exact_dedup, op3_repeat_dedup, op4_html_extract, op5_chat_format, op6_warc, op7_near_dedup, op8_mixing, op9_toxicity, op10_token_counts)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES = {
    "op2_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               first_value(doc_id) OVER w = doc_id AS kept,
               text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)""",
    "op5_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        r AS (SELECT *, replace(replace(text, '\', '\b'), '<', '\l') AS escaped FROM rows)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(role) + length(escaped) + 5 + 8) AS BIGINT) AS formatted_chars
        FROM r GROUP BY conv_id""",
    "op6_warc": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
        g AS (SELECT html, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY html)
        SELECT page_id, payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN g.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.first <> page_id THEN g.first END AS refers_to
        FROM p LEFT JOIN g ON p.html = g.html AND payload_bytes >= 1000""",
}
