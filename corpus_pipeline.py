"""The training-corpus pipeline over ``documents``: quality, near copies, test items, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the session's shared folder and reads it again as the next stage's
documents. All stages but the last return the columns of ``documents``.

Rows with a null id or a null or empty text are judged like any other and kept
where a stage has nothing against them; of rows that repeat whole, near_dedup
keeps one (null ids stay apart); further columns are kept up to the last stage;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpdesk_lake.llm import decontaminate, minhash_forest, quality_rules, secret_scan, word_bpe
from helpdesk_lake.llm.common import stored, table, tokenizer_path
from helpdesk_lake.session import apply_missing

#: Documents that share this part of their five-word shingles are near copies here; op1's contract has its own.
NEAR_PERCENT = 80

#: Whole texts are wide rows: so many of them go to a Python worker at once, unless the launch settings say otherwise.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    apply_missing(spark, BATCHES)
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    apply_missing(spark, BATCHES)
    return minhash_forest.keep_one(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; the documents stay."""
    return secret_scan.masked(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the exact BPE ids of every text."""
    found = word_bpe.encode_texts(docs, tokenizer_path("word_bpe_49k.json"))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets),
          ("token_ids", token_ids)]

#: Fitted models and exact token ids are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
