"""Inventory and decision over a stream of files: any cut into micro-batches ends with what the batch would give.

Events say that a source has a file, or that the user took one out again.  What is kept for
each file (its key) is the smallest of what sources said of it and whether it has been taken
out.  Both only ever move one way, so events may come in any order, in any batches, and twice.
That state is Spark's, keyed by file and checkpointed; each micro-batch writes the keys that it
changed, and the last row of a key is how it stands.  Totals, statuses and the first blocking
file are then the batch's own expressions over these rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..constants import CONTEXT_LIMIT, MARGIN
from ..functions import columns as C
from ..operators import budget

#: What a source says of a file; ``removed`` events need the key alone.
EVENTS = "key string, removed boolean, source_idx int, path string, name string, relative_path string, ord long, base_status string, bytes_utf8 long, tokens_estimated long, tokens_with_margin long"
_SAID = [c.split()[0] for c in EVENTS.split(", ")][2:]
FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, url: str, source_idx: int = 0, a_batch: int | None = None) -> DataFrame:
    """key, removed, source_idx, path, name, size_bytes, mtime of files as they come to a folder of any store that Spark reads.

    Spark's file source remembers which files it has given; nothing is opened.
    """
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    files = (reader if a_batch is None else reader.option("maxFilesPerTrigger", a_batch)).load(url)
    return files.select(F.col("path").alias("key"), F.lit(False).alias("removed"), F.lit(source_idx).alias("source_idx"), "path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def standing(events: DataFrame) -> DataFrame:
    """key, removed, said: one row for each file, from a stream or a table of events."""
    said = [c for c in events.columns if c not in ("key", "removed")]
    removed = F.coalesce(F.col("removed"), F.lit(False))
    return events.groupBy("key").agg(F.bool_or(removed).alias("removed"), F.min(F.when(~removed, F.struct(*said))).alias("said"))


def follow(events: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Keeps ``folder``/changes up to date with a stream of events; ``trigger`` as of ``DataStreamWriter.trigger``."""

    def put(changed: DataFrame, batch: int) -> None:
        # A batch that is run again writes the same folder again.
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    writer = standing(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(**trigger) if trigger else writer).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """key, removed and what the first source said, of every file as it stands now."""
    last = spark.read.parquet(f"{folder}/changes").groupBy("key").agg(F.max_by(F.struct("removed", "said"), "batch").alias("s"))
    return last.select("key", "s.removed", "s.said.*")


def compact(spark: SparkSession, folder: str) -> None:
    """Puts the changes of all batches but the last into one; call it while no query runs."""
    changes = spark.read.parquet(f"{folder}/changes")
    newest = changes.agg(F.max("batch")).first()[0]
    rows = changes.where(F.col("batch") < newest).groupBy("key").agg(F.max_by(F.struct("removed", "said"), "batch").alias("s")).select("key", "s.removed", "s.said")
    rows.write.mode("overwrite").parquet(f"{folder}/compacted")
    # Batch numbers go on from the newest, so the compacted rows are older than all that follow.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path(f"{folder}/changes")):
        if status.getPath().getName() != f"batch={newest}" and status.isDirectory():
            fs.delete(status.getPath(), True)
    fs.rename(path(f"{folder}/compacted"), path(f"{folder}/changes/batch=-1"))


def decision(spark: SparkSession, folder: str, limits: tuple[int, ...] = (CONTEXT_LIMIT,), margin: float = MARGIN) -> DataFrame:
    """What the files as they stand now decide under each limit; for events with the columns of ``EVENTS``."""
    files = current(spark, folder).where("NOT removed AND path IS NOT NULL")
    return budget.decisions(budget.profile(files), list(limits), margin)


def left_out(files: DataFrame, exclude=()) -> DataFrame:
    """``files`` with the reason for which each is left out, null for those that are read."""
    return files.withColumn("reason_code", F.when(F.col("removed"), "removed").otherwise(C.ignore_reason(F.col("name"), exclude=tuple(exclude))))
