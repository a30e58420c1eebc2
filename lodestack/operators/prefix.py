"""Running sums over an order of all rows, and what follows from them: packing rows into tasks by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..held import keep


def running_sums(df: DataFrame, order: list[Column], value: Column, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows that come earlier; meant for narrow rows.

    A range-partitioned sort gives the order; each partition's rows are summed on their own,
    and the partitions' totals, one number each, on the driver.
    """
    placed = keep(df.withColumn("_v", value.cast("long")).orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    totals = {r["p"]: r["v"] for r in placed.groupBy(part.alias("p")).agg(F.sum("_v").alias("v")).collect()}
    base, total = [], 0
    for p in range(max(totals, default=-1) + 1):
        base.append(total)
        total += totals.get(p) or 0
    own = F.sum("_v").over(Window.partitionBy(part).orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_v")
    start = F.element_at(F.array(*(F.lit(b).cast("long") for b in base or [0])), (part + 1).cast("int"))
    return placed.withColumn(name, (start + own).cast("long")).drop("_m", "_v")


#: Bytes that a task should read, and the most tasks of a job: beyond these, tasks grow with the input.
TASK_BYTES, MOST_TASKS = 32 << 20, 100_000


def task_bytes(total: int, cores: int, least: int = TASK_BYTES, most: int = MOST_TASKS) -> int:
    """The bytes of one task: ``least`` or more, so that there are no more than ``most`` tasks; less where cores would idle."""
    return max(1, min(max(least, -(-total // most)), -(-total // max(1, cores))))


def packed(df: DataFrame, size: str, order: list[Column], target: int | None = None) -> DataFrame:
    """``df`` dealt out so that each partition holds about ``target`` bytes of ``size``, by running sums.

    Rows come in order; a partition ends with the row that fills it, so it holds less than
    ``target`` and its largest row.
    """
    total = df.agg(F.sum(F.greatest(F.col(size), F.lit(1)))).first()[0] or 0
    target = target or task_bytes(total, df.sparkSession.sparkContext.defaultParallelism)
    sums = running_sums(df, order, F.greatest(F.col(size), F.lit(1)), "_before")
    bins = max(1, -(-total // target))
    return sums.withColumn("_bin", F.least(F.floor(F.col("_before") / target), F.lit(bins - 1)).cast("int")).repartitionById(bins, F.col("_bin")).drop("_bin", "_before")


def ranges(df: DataFrame, size: str, target: int) -> DataFrame:
    """``df`` with a row for each range of ``target`` bytes of a file: part, offset, length; an empty file is one range."""
    count = F.greatest(F.ceil(F.col(size) / target), F.lit(1)).cast("int")
    parts = df.withColumn("part", F.explode(F.sequence(F.lit(0), count - 1)))
    offset = F.col("part").cast("long") * target
    return parts.withColumn("offset", offset).withColumn("length", F.least(F.lit(target).cast("long"), F.col(size) - offset))
