"""Statuses, estimates, totals and the decision against the context limit: all expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import CONTEXT_LIMIT, MARGIN, TOO_LARGE
from ..functions import columns as C
from ..functions import tokenizers
from ..i18n import format_number, t

NUMBERS = ("bytes_utf8", "tokens_estimated", "tokens_with_margin")


def with_status(files: DataFrame, **thresholds) -> DataFrame:
    """base_status from text, pages, images and the flags ``ignored`` and ``failed``."""
    return files.withColumn("base_status", C.file_status(F.col("text"), F.col("chars_per_page"), F.col("image_count"), F.col("ignored"), F.col("failed"), **thresholds))


def with_estimate(files: DataFrame, margin: float = MARGIN, engine: tokenizers.Engine | None = None) -> DataFrame:
    """Bytes and tokens of header and text; zeros for files that give no text."""
    live = C.is_extracted(F.col("base_status"))
    if engine is None or engine.id == "approx":
        rows = files.withColumn("_e", F.when(live, C.source_estimate(margin)))
    else:
        mark = "\u0000"  # stands for the numbers, and cuts the header in three
        cut = F.split(C.source_header(F.lit(mark), F.lit(mark)), mark)
        count = F.pandas_udf(lambda rows: tokenizers.precise_estimate(rows, engine, margin), "bytes_utf8 long, tokens_estimated long, tokens_with_margin long")
        rows = files.withColumn("_e", F.when(live, count(F.struct(F.when(live, F.col("text")).alias("text"), cut[0].alias("before"), cut[1].alias("between"), cut[2].alias("after")))))
    return rows.select(*(c for c in rows.columns if c not in (*NUMBERS, "_e")), *(F.coalesce(F.col(f"_e.{n}"), F.lit(0)).cast("long").alias(n) for n in NUMBERS))


def corpus_totals(estimated: DataFrame, margin: float = MARGIN, precise: bool = False) -> DataFrame:
    """One row: the approximation divides the sum of bytes once and takes the margin once, not per file."""
    sums = estimated.agg(F.coalesce(F.sum("bytes_utf8"), F.lit(0)).alias("bytes_utf8"), F.coalesce(F.sum("tokens_estimated"), F.lit(0)).alias("_t"), F.count(F.lit(1)).alias("n_files"))
    tokens = F.col("_t") if precise else C.approx_tokens(F.col("bytes_utf8"))
    out = sums.withColumn("tokens_estimated", tokens.cast("long"))
    return out.select("n_files", "bytes_utf8", "tokens_estimated", C.with_margin(F.col("tokens_estimated"), margin).alias("tokens_with_margin"))


def blocked(estimated: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """status: too_large where an extracted file alone is over the limit, else base_status."""
    over = C.is_extracted(F.col("base_status")) & C.over_limit(F.col("tokens_with_margin"), limit)
    return estimated.withColumn("status", F.when(over, TOO_LARGE).otherwise(F.col("base_status")))


def decision(estimated: DataFrame, limit: int = CONTEXT_LIMIT, margin: float = MARGIN, precise: bool = False) -> DataFrame:
    """One row: totals, n_blocking, the first blocking file and whether anything is over the limit."""
    marked = blocked(estimated, limit)
    first = F.min(F.when(F.col("status") == TOO_LARGE, F.struct("ord", "relative_path", "tokens_with_margin")))
    sums = marked.agg(F.coalesce(F.sum("bytes_utf8"), F.lit(0)).alias("bytes_utf8"), F.coalesce(F.sum("tokens_estimated"), F.lit(0)).alias("_t"), F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("status") == TOO_LARGE).alias("n_blocking"), first.alias("_first"))
    sums = sums.withColumn("tokens_estimated", (F.col("_t") if precise else C.approx_tokens(F.col("bytes_utf8"))).cast("long"))
    sums = sums.withColumn("tokens_with_margin", C.with_margin(F.col("tokens_estimated"), margin))
    total_over = C.over_limit(F.col("tokens_with_margin"), limit)
    return sums.select(
        "n_files", "bytes_utf8", "tokens_estimated", "tokens_with_margin", "n_blocking", F.col("_first.relative_path").alias("first_blocking"), F.col("_first.tokens_with_margin").alias("first_tokens"),
        total_over.alias("total_over"), ((F.col("n_blocking") > 0) | total_over).alias("is_blocked"),
    )


def profile(estimated: DataFrame) -> DataFrame:
    """base_status, tokens_with_margin, n, sums and the first file of each: all that statuses, totals and decisions ask for, in one pass.

    A row for each number of tokens that occurs: a histogram with exact edges.
    """
    first = F.min(F.struct("ord", "relative_path", "tokens_with_margin")).alias("first")
    sums = [F.sum(c).alias(c) for c in ("bytes_utf8", "tokens_estimated")]
    return estimated.groupBy("base_status", F.col("tokens_with_margin").alias("tokens")).agg(F.count(F.lit(1)).alias("n"), *sums, first)


def decisions(profile: DataFrame, limits: list[int], margin: float = MARGIN, precise: bool = False) -> DataFrame:
    """A row as of ``decision`` for each limit, with ``context_limit``, from a ``profile``: no file is looked at again.

    Rows of the profile fall between two limits; what stands above a limit is then a running
    sum over the limits, of which there are as many as were asked for.
    """
    marks = sorted(set(limits))
    live = C.is_extracted(F.col("base_status"))
    above = F.size(F.filter(F.array(*(F.lit(m).cast("long") for m in marks)), lambda m: m < F.col("tokens")))
    # Groups for the limits and for the totals at once, and no condition on ``above``, which Spark would ask of every file.
    sums = (F.sum(c).alias(a) for c, a in (("n", "n_files"), ("bytes_utf8", "bytes_utf8"), ("tokens_estimated", "_t")))
    per = profile.groupBy(above.alias("_i")).agg(F.sum(F.when(live, F.col("n"))).alias("_n"), F.min(F.when(live, F.col("first"))).alias("_first"), *sums)
    asked = profile.sparkSession.createDataFrame(list(enumerate([None, *marks])), "_i int, context_limit long").join(F.broadcast(per), "_i", "left")
    every = Window.partitionBy()
    down = Window.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = asked.select(
        "_i", "context_limit", F.coalesce(F.sum("_n").over(down), F.lit(0)).alias("n_blocking"), F.min("_first").over(down).alias("_first"),
        *(F.coalesce(F.sum(c).over(every), F.lit(0)).alias(c) for c in ("n_files", "bytes_utf8", "_t")),
    )
    totals = totals.withColumn("tokens_estimated", (F.col("_t") if precise else C.approx_tokens(F.col("bytes_utf8"))).cast("long"))
    totals = totals.withColumn("tokens_with_margin", C.with_margin(F.col("tokens_estimated"), margin))
    total_over = F.col("tokens_with_margin") > F.col("context_limit")
    return totals.where("_i > 0").select(
        "context_limit", "n_files", "bytes_utf8", "tokens_estimated", "tokens_with_margin", "n_blocking", F.col("_first.relative_path").alias("first_blocking"), F.col("_first.tokens_with_margin").alias("first_tokens"),
        total_over.alias("total_over"), ((F.col("n_blocking") > 0) | total_over).alias("is_blocked"),
    )


@dataclass(frozen=True)
class Decision:
    n_files: int
    bytes_utf8: int
    tokens_estimated: int
    tokens_with_margin: int
    n_blocking: int
    first_blocking: str | None
    first_tokens: int | None
    total_over: bool
    is_blocked: bool


#: Names of blocking files that a message lists; ``blocking_files`` is the table of all.
NAMES_TOLD = 100


def block_reason(decided: Decision, limit: int, names: list[str]) -> str | None:
    """In words: the first blocking file (and the names of the first ones, if several), else the total."""
    if decided.n_blocking:
        text = t("summary.blocked_file", file=decided.first_blocking, tokens=format_number(decided.first_tokens), limit=format_number(limit))
        more = f", … (+{decided.n_blocking - len(names)})" if decided.n_blocking > len(names) else ""
        return text + (f" ({', '.join(names)}{more})" if len(names) > 1 else "")
    if decided.total_over:
        return t("summary.blocked_total", total=format_number(decided.tokens_with_margin), limit=format_number(limit))
    return None


def blocking_files(estimated: DataFrame, limit: int) -> DataFrame:
    """ord, relative_path, tokens_with_margin of all files over the limit."""
    rows = blocked(estimated.select("ord", "relative_path", "base_status", "tokens_with_margin"), limit)
    return rows.where(F.col("status") == TOO_LARGE).select("ord", "relative_path", "tokens_with_margin")


def blocking_names(estimated: DataFrame, limit: int, most: int = NAMES_TOLD) -> list[str]:
    """Labels of the first files over the limit, in order."""
    return [r["relative_path"] for r in blocking_files(estimated, limit).orderBy("ord").limit(most).collect()]


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("base_status").agg(F.count(F.lit(1)).alias("n"))
