"""Running totals over a stream of documents, with the batch's own expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CONTEXT_LIMIT, MARGIN
from ..functions import columns as C
from ..operators import budget
from ..sources import tables

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, folder: str, schema: str = DOCUMENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def running_totals(documents: DataFrame, limit: int = CONTEXT_LIMIT, margin: float = MARGIN) -> DataFrame:
    """One row, updated: documents, tokens and whether the corpus is still within the limit (output mode complete)."""
    files = budget.with_estimate(budget.with_status(tables.as_text_files(documents)), margin)
    totals = budget.corpus_totals(files, margin)
    return totals.withColumn("is_blocked", C.over_limit(F.col("tokens_with_margin"), limit))
