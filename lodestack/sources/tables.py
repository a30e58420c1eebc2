"""Parquet tables of documents as files of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions that the virtual files of a table take in turn.
VIRTUAL = ("txt", "md", "html", "csv", "json", "pdf", "exe", "jpg")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def virtual_extension(id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, VIRTUAL)), (F.pmod(id, F.lit(len(VIRTUAL))) + 1).cast("int"))


def as_text_files(docs: DataFrame) -> DataFrame:
    """Each document as an extracted ``.txt`` file; pages, images and errors there are none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"),
        F.lit("txt").alias("extension"), F.lit("txt").alias("file_type"), F.octet_length(text).cast("long").alias("size_bytes"), text.alias("text"),
        F.lit(0).alias("page_count"), F.lit(0).alias("image_count"), F.lit("utf-8").alias("encoding"), F.array().cast("array<int>").alias("chars_per_page"),
        F.lit(False).alias("ignored"), F.lit(False).alias("failed"),
    )


def as_mixed_files(docs: DataFrame) -> DataFrame:
    """Each document as a file of one of ``VIRTUAL``'s extensions, some with images."""
    text, ext = F.coalesce(F.col("text"), F.lit("")), virtual_extension(F.col("doc_id"))
    return docs.select(
        F.col("doc_id").alias("ord"),
        F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("relative_path"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("name"),
        ext.alias("extension"), ext.alias("file_type"), F.octet_length(text).cast("long").alias("size_bytes"), text.alias("text"),
        F.when(ext == "pdf", 1).otherwise(0).alias("page_count"),
        F.when(F.col("doc_id") % 5 == 0, (F.col("doc_id") % 3).cast("int")).otherwise(0).alias("image_count"),
        F.when(ext.isin("txt", "md", "html", "csv", "json"), "utf-8").alias("encoding"),
        F.when(ext == "pdf", F.array(F.length(text))).otherwise(F.array().cast("array<int>")).alias("chars_per_page"),
        ext.isin("exe", "jpg").alias("ignored"), F.lit(False).alias("failed"), F.col("lang"), F.col("source"),
    )


def conversation_pages(conversations: DataFrame) -> DataFrame:
    """Each conversation as a paged file: a page for each turn."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Lengths and texts are gathered apart: where only one of them is wanted, the other is not gathered.
    sizes = F.array_sort(F.collect_list(F.struct("turn", F.length(text).alias("n"))))
    pages = F.array_sort(F.collect_list(F.struct("turn", text.alias("text"))))
    grouped = conversations.groupBy("conv_id").agg(sizes.alias("s"), pages.alias("p"))
    return grouped.select("conv_id", F.transform("s", lambda x: x["n"]).alias("chars_per_page"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
