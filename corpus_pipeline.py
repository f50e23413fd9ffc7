"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.

Rows with nulls in any column pass where no rule speaks against them; texts of any length are read whole; of rows that repeat an id one stays, null ids
stay all; an empty table passes as an empty table; other columns stay as they are, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sluice.cluster import materialize, release
from sluice.llm import decontaminate, mixing, queries, shingles, tokens, toxicity, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7; a null text counts as an empty one. The model is fitted on the corpus's labelled documents."""
    corpus, labels = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels")
    into = unused(docs.columns, "toxicity")
    scored = toxicity.score(docs, toxicity.train(corpus, labels, n=3, held_out=1), "text", into)
    return scored.filter(F.col(into) < 0.7).drop(into)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash fingerprints or a similarity of 0.8 of five-word shingles link."""
    return shingles.keep_one(docs, width=5, similarity=0.8, radius=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def interleave_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: the table's files and rows stand in that order."""
    position, place = unused(docs.columns, "position"), unused(docs.columns, "place")
    return mixing.mix(docs, queries.TICKETS, rest=4, into=position, in_block=place).orderBy(position, place).drop(position, place)


def write_token_planes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in plane files, in the order in which the documents' table stands, read back: doc_id, start, n_tokens, ids_crc32."""
    try:
        placed = docs.select("doc_id", "text", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("part"), F.col("_metadata.row_index").alias("row"))
        order = ["part", "row"]
    except AnalysisException:  # not a table in files: it has no order of its own
        placed, order = docs, ["doc_id"]
    return tokens.read_tokens(tokens.write_tokens(placed, queries.word_tokenizer(), order=order))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", keep_one_of_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", interleave_sources),
    ("token planes", write_token_planes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark)
    return docs


#: SQL has no tokenizer, no SimHash and no classifier: the tests check the stages against brute force instead.
ORACLE_SQL = None
