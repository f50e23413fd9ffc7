"""The registered queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import chat, decontaminate, lines, mixing, nbsvm, simhash, styletree, tokens, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """The file of the public word-level BPE tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7, n=3, held_out=1)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))
    added = spark.range(1).select(F.explode(turns).alias("t")).select(F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(said).alias("text"))
    return chat.read_back(chat.expand(rows.unionByName(added)))


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(table(spark, sf_dir, "documents"), word_tokenizer()))


def op5_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3, n=5, held_out=0)


#: Target weights of the mixture, in tickets of a round; sources that are not listed share the rest.
TICKETS = {"src0": 20} | {f"src{k}": 4 for k in range(1, 20)}


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, TICKETS, rest=4)


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styletree.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), similarity=0.8)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity_grammar, op2_benchmark_decontamination, op3_prefix_targets, op4_token_planes, op5_quality_nbsvm, op6_pfair_mixing, op7_site_style_tree, op8_simhash_near_dedup, op9_fuzzy_lines, op10_exact_top_k)
}

#: DuckDB's SQL for the queries that it can express.
ORACLE_SQL: dict[str, str] = {
    "op3_prefix_targets": r"""
        WITH given AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS said FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), escaped AS (
            SELECT *, regexp_replace(said, '(\\|###|</turn>)', '\\\1', 'g') AS body, regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') AS head FROM given
        ), placed AS (
            SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
                sum(length(head) + length(body) + 14) OVER (w ROWS UNBOUNDED PRECEDING) AS stop
            FROM escaped WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body)
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY place)) AS turns_sha256,
            coalesce(sum(length(said)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(said, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
            coalesce(sum(stop) FILTER (role = 'assistant' OR place = n), 0)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant' OR place = n) AS n_examples
        FROM placed GROUP BY conv_id
    """,
    "op10_exact_top_k": """
        WITH good AS (
            SELECT vec_id::BIGINT AS vec_id, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (
            SELECT vec_id, unnest(range(len(embedding))) AS place, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM good
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
            FROM parts q JOIN parts c ON q.place = c.place AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5
    """,
}
