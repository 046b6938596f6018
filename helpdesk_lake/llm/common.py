"""Helpers shared by the corpus operators.

Words, everywhere in this subpackage, are the runs ``[^\\x20\\x09-\\x0D]+`` of a
text whose A-Z are lower-cased; every other character is kept as it is. Python
side: ``text.encode().lower().split()`` (bytes methods know ASCII only, and
split at exactly these six white-space characters).
"""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder of the session and read
    again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns as x0, x1, ..., and each column's name there: helper columns then clash with none."""
    names = {c: f"x{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True for the fold kept from training; a null id is never held out."""
    return F.coalesce(fold(doc_id, parts) == F.lit(part), F.lit(False))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (all bits depend on all bits); works on any shape."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """Seedless 64-bit hashes, the same in every process."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, tokens), dtype=np.uint64, count=len(tokens))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes, in order."""
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = mixed(out ^ h[k:k + count])
    return out


def labelled_rows(labels: DataFrame, id_col: str, label_col: str, parts: int, part: int) -> DataFrame:
    """(``_id``, ``_label``) of all labelled ids outside the held-out fold. Null
    ids and null labels teach nothing; of repeated ids the larger label holds."""
    return (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
            .where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~held_out(F.col("_id"), parts, part))
            .groupBy("_id").agg(F.max("_label").alias("_label")))


def training_rows(labels: DataFrame, id_col: str, label_col: str, parts: int, part: int, bound: int) -> DataFrame:
    """At most ``bound`` of the ``labelled_rows``: those whose hashed id is
    smallest, so the choice depends on nothing but the ids."""
    return labelled_rows(labels, id_col, label_col, parts, part).orderBy(F.xxhash64("_id"), "_id").limit(bound)


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
