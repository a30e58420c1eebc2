"""The queries of the training-data operators: each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, langid, licenses, linededup, media, mixing, negatives, ngram_join, quantize, toxicity, urls, warc
from .tables import table

#: The rules of the URL filter's contract: verdict, host, path.  They are the query's own; ``urls.RULES``, which blocks net/de/, is only what the operator takes by default.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and of every page."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, table(spark, sf_dir, "pages"), langid.train(docs))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines that an earlier, near-equal line makes redundant."""
    return linededup.report(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio features of every document's bytes."""
    return media.audio_table(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, archived and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replicated so that every source weighs the same, in shuffled order."""
    out = mixing.replicate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "n_copies", "copy", "shuffle_key", "text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and its component of near-equal documents."""
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL; the label of a page is that of the document with its id."""
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest, and the licence that its whole text is."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and the digests of its ids and of what they decode to."""
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), bpe.read(public_tokenizers.path("word_bpe_49k.json")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every anchor and each of its positives, the rows of other labels that score nearly as high."""
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code and error, by codebooks of all vectors."""
    return quantize.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": linededup.sql(), "op5_warc": warc.sql(), "op6_mixing": mixing.sql(), "op8_ngram_jaccard": ngram_join.sql(), "op10_license_scan": licenses.sql(), "op12_hard_negatives": negatives.sql(), "op13_vector_codes": quantize.sql()}
