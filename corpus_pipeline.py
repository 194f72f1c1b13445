"""Training-corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet under the shared folder and reads again for the next stage.
All but the last keep the columns of ``documents``; ``n_chars`` follows the
text where a stage changes it.

Defined cases are those of the operators: null texts are empty, repeated rows
of one document leave one after the near-duplicate stage, an empty table
gives an empty result, further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowrank.llm.chunks import remove_repeats
from lowrank.llm.common import read_table, save_table
from lowrank.llm.ensemble import keep_good
from lowrank.llm.nearup import keep_one
from lowrank.llm.packing import pack_documents
from lowrank.llm.secrets import mask_secrets


def _recount(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that score below the cutoff go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of near duplicates the smallest id stays."""
    return keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: passages that an earlier document holds are cut out."""
    return _recount(remove_repeats(docs, spans_as=None))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: secrets are masked."""
    return _recount(mask_secrets(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token pieces with their places in sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", good_documents), ("near_dedup", one_of_each), ("substring_dedup", without_repeats),
          ("secret_scan", without_secrets), ("packing", packed)]

# Random forests, sampling sketches and rolling hashes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
