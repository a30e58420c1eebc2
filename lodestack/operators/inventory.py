"""From a selection to the ordered list of files to read and the list of those left out."""

from __future__ import annotations

import os
from functools import reduce
from pathlib import Path, PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import EXTENSIONS, MAX_DEPTH
from ..functions import columns as C
from ..held import keep
from ..scratch import Scratch, checkpointed
from ..selection import InputSelection, path_key
from ..sources import folders

ENTRY = "path string, name string, ext string, size_bytes long, mtime double, relative_path string, ord long"


def candidates(spark: SparkSession, selection: InputSelection, recursive: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """All files of all sources, by name alone: source_idx, path, name, preferred (label), key."""
    many = len(selection.paths) > 1
    parts = []
    for i, source in enumerate(selection.paths):
        if source.is_dir():
            rows = folders.list_names(spark, str(source), recursive, max_depth)
            preferred = F.concat(F.lit(f"{source.name}/"), F.col("relative")) if many else F.col("relative")
        elif source.is_file():
            rows, preferred = spark.createDataFrame([(str(source), source.name)], "path string, name string"), F.col("name")
        else:
            continue
        parts.append(rows.select(F.lit(i).alias("source_idx"), "path", "name", preferred.alias("preferred")))
    if not parts:
        return spark.createDataFrame([], "source_idx int, path string, name string, preferred string, key string")
    here = os.getcwd()
    absolute = F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat(F.lit(f"{here}/"), F.col("path")))
    return reduce(DataFrame.unionByName, parts).withColumn("key", absolute)


def first_wins(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def split(found: DataFrame, extensions=EXTENSIONS, exclude=()) -> tuple[DataFrame, DataFrame]:
    """(kept, left out with reason_code), by name alone: nothing is opened."""
    judged = found.withColumn("ext", C.suffix(F.col("name"))).withColumn("reason_code", C.ignore_reason(F.col("name"), extensions, exclude))
    return judged.where("reason_code IS NULL").drop("reason_code"), judged.where("reason_code IS NOT NULL")


def sort_order(sort: str, label: str = "relative_path") -> list[Column]:
    """Columns to order by; the path decides between equal keys."""
    if sort == "mtime":
        return [F.col("mtime").desc(), F.col("path")]
    natural = C.natural_key(F.col(label))
    return [F.col("ext"), natural, F.col("path")] if sort == "type" else [natural, F.col("path")]


def ordinals(df: DataFrame, order: list[Column]) -> DataFrame:
    """``ord`` from 0 in the given order, without a task that sees all rows.

    A range-partitioned sort numbers rows within partitions; the partitions' sizes, one
    number each, are summed up on the driver.
    """
    placed = keep(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    base = F.element_at(F.array(*map(F.lit, offsets or [0])), (F.shiftright("_m", 33) + 1).cast("int"))
    return placed.withColumn("ord", (base + F.col("_m").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_m")


def unique_labels(rows: list[tuple[str, str]], taken: set[str]) -> dict[str, str]:
    """path to label, in order: the preferred one, else longer ends of the path, else a number."""
    out = {}
    for path, preferred in rows:
        parts = PurePath(path).parts
        ends = [preferred, *(str(PurePath(*parts[-w:])) for w in range(2, len(parts) + 1))]
        label = next((e for e in ends if e.casefold() not in taken), None)
        if label is None:
            n = 2
            while f"{ends[-1]} ({n})".casefold() in taken:
                n += 1
            label = f"{ends[-1]} ({n})"
        taken.add(label.casefold())
        out[path] = label
    return out


def _numbers(claims: DataFrame, settled: DataFrame) -> DataFrame:
    """``claims`` of files that have run out of path ends, with ``number``: of a base's files in order, the first takes
    the first number from 2 on that no settled label has, the next the next, and so on.

    Numbers that settled labels have are gaps: the i-th free number is i + 1 plus the gaps b_j, in order, with b_j - j
    up to i.  Files and gaps are put in one order per base and the gaps counted as they go by: a sort, nothing gathered.
    """
    per = Window.partitionBy("base")
    files = claims.withColumn("key", F.row_number().over(per.orderBy("ord")).cast("long")).withColumn("gap", F.lit(0))
    form = r"(?s)\A(.*) \(([2-9]|[1-9][0-9]{1,15})\)\z"
    taken = settled.where(F.col("_f").rlike(form)).select(F.regexp_extract("_f", form, 1).alias("base"), F.regexp_extract("_f", form, 2).cast("long").alias("n"))
    taken = taken.join(claims.select("base").distinct(), "base", "left_semi").distinct()
    gaps = taken.select("base", (F.col("n") - F.row_number().over(per.orderBy("n"))).alias("key"), F.lit(1).alias("gap"))
    passed = F.sum("gap").over(per.orderBy("key", F.desc("gap")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = files.unionByName(gaps, allowMissingColumns=True).withColumn("passed", passed).where("gap = 0")
    return rows.withColumn("number", F.col("key") + 1 + F.col("passed")).drop("key", "gap", "passed")


def labelled(kept: DataFrame) -> DataFrame:
    """relative_path for each file, as ``unique_labels`` gives it to the colliding ones, by joins alone.

    All files without a label claim their next choice at once and the first in order
    gets it; one that comes earlier takes it from one that comes later, which goes on to
    its next.  This ends with the labels that the files would take one after the other.
    Files that have run out of path ends claim the number that is theirs by rank (a lower one
    would be refused them), so that rounds follow the depth of paths, not the number of files.
    """
    folded = kept.select("path", "preferred", "source_idx", C.casefold(F.col("preferred")).alias("_f"))
    clash = folded.groupBy("_f").count().where("count > 1").select("_f")
    if not clash.limit(1).count():
        return kept.withColumnRenamed("preferred", "relative_path")
    order = [F.col("source_idx"), C.natural_key(F.col("preferred")), F.col("path")]
    # Repeated rows of one path take one label, the last one's.
    placed = ordinals(folded.join(clash, "_f").select("path", "preferred", "source_idx"), order)
    parts = F.filter(F.split("path", "/"), lambda x: (x != "") & (x != "."))
    depth = F.size("parts")
    rooted = F.startswith("path", F.lit("/"))
    joined = lambda n: F.array_join(F.slice("parts", depth - n + 1, n), "/")
    whole = F.when(rooted, F.concat(F.lit("/"), joined(depth))).otherwise(joined(depth))
    # Choices: 0 is the preferred label, then ends of two parts and more, then numbers from 2 on.
    last = F.when(rooted, depth).otherwise(F.greatest(depth - 1, F.lit(0)))
    end = F.when(F.col("choice") == 0, F.col("preferred")).when(F.col("choice") == last, whole).otherwise(joined(F.col("choice") + 1))
    with Scratch(kept.sparkSession) as scratch:
        # Each round is written: plans that hold the rounds before them would double with every round.
        settled = scratch.save(folded.join(clash, "_f", "left_anti").select("_f"), "settled")
        now = placed.select("path", "preferred", "ord", parts.alias("parts"), F.lit(0).cast("long").alias("choice"))
        step, lost = 0, 1
        while lost:
            now = scratch.save(now, f"now-{step}")
            claims = now.where(F.col("choice") <= last).withColumn("label", end)
            spent = now.where(F.col("choice") > last).withColumn("name", F.when(last == 0, F.col("preferred")).otherwise(whole))
            if spent.limit(1).count():
                numbered = _numbers(spent.withColumn("base", C.casefold(F.col("name"))), settled)
                numbered = numbered.withColumn("choice", F.greatest("choice", last + F.col("number") - 1))
                numbered = numbered.withColumn("label", F.concat("name", F.lit(" ("), (F.col("choice") - last + 1).cast("string"), F.lit(")")))
                claims = claims.unionByName(numbered.select(*claims.columns))
            claims = scratch.save(claims.withColumn("_f", C.casefold(F.col("label"))), f"claims-{step}")
            best = claims.groupBy("_f").agg(F.min("ord").alias("_first"))
            judged = claims.join(best, "_f").join(settled.withColumn("_fixed", F.lit(True)), "_f", "left").withColumn("lost", F.col("_fixed").isNotNull() | (F.col("ord") > F.col("_first")))
            judged = scratch.save(judged.select("path", "preferred", "ord", "parts", "choice", "label", "lost"), f"judged-{step}")
            lost = judged.where("lost").limit(1).count()
            now = judged.withColumn("choice", F.col("choice") + F.col("lost").cast("int")).drop("label", "lost")
            step += 1
        table = checkpointed(judged.groupBy("path").agg(F.max_by("label", "ord").alias("_label")))
    return kept.join(table, "path", "left").withColumn("relative_path", F.coalesce("_label", "preferred")).drop("_label", "preferred")


def collect_store(spark: SparkSession, url: str, recursive=True, exclude=(), extensions=EXTENSIONS, sort="name", max_depth=MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """``collect_inputs`` for one folder of a store that only Spark reads."""
    found = folders.list_store(spark, url, recursive, max_depth).withColumnRenamed("relative", "relative_path").drop("depth")
    kept, out = split(found, tuple(e.lower() for e in extensions), tuple(exclude))
    inventory = ordinals(kept, sort_order(sort))
    return inventory.select("path", "name", "ext", "size_bytes", "mtime", "relative_path", "ord"), out.select("path", "name", "reason_code", C.reason_text(F.col("reason_code"), F.col("ext")).alias("reason"))


def collect_inputs(spark: SparkSession, selection, recursive=True, exclude=(), extensions=EXTENSIONS, sort="name", max_depth=MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(inventory in order, left out: path, name, reason_code, reason)."""
    selection = InputSelection.of(selection)
    kept, out = split(candidates(spark, selection, recursive, max_depth), tuple(e.lower() for e in extensions), tuple(exclude))
    kept = first_wins(kept, "key", [F.col("source_idx"), F.col("path")])
    out = out.select("source_idx", "path", "name", "ext", "reason_code", "key")
    if selection.excluded_files:
        gone = spark.createDataFrame([(path_key(p),) for p in selection.excluded_files], "key string")
        removed = kept.join(F.broadcast(gone), "key", "left_semi").withColumn("reason_code", F.lit("removed"))
        out = out.unionByName(removed.select("source_idx", "path", "name", "ext", "reason_code", "key"))
        kept = kept.join(F.broadcast(gone), "key", "left_anti")
    out = first_wins(out, "key", [F.col("reason_code") == "removed", F.col("source_idx"), F.col("path")])
    # Only files that are read are asked for size and time.
    inventory = ordinals(labelled(folders.with_stat(kept)), sort_order(sort))
    return inventory.select("path", "name", "ext", "size_bytes", "mtime", "relative_path", "ord"), out.select("path", "name", "reason_code", C.reason_text(F.col("reason_code"), F.col("ext")).alias("reason"))
