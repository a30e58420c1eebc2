"""Folders and files as tables.

A folder on a mounted file system is listed breadth first: a round lists all folders of one
depth, each in some task, and what it finds are the files and the folders of the next round.
Sizes and times are asked for afterwards, of the files that are wanted, dealt out by count; so
a folder with nearly all files of a tree is one listing of names and many tasks of questions.
Symbolic links to folders are not followed.  (Spark's own binary source passes over names that
begin with ``_`` or ``.``, which are files like others here; it lists the stores that only
Spark can read, see ``list_store``.)

``spark.read.format("lodestack_folder")`` gives the same rows from a data source, whose
filters on depth, name and ending reach the listing where Spark pushes them down.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThanOrEqual, StringEndsWith

from ..constants import MAX_DEPTH, SKIPPED_FOLDERS
from ..held import keep
from ..shipping import ship

SCHEMA = "path string, name string, relative string, depth int, size_bytes long, mtime double"
NAMES = "path string, name string, relative string, depth int"
#: Files that one task asks for size and time; folders that one task lists; rows sent on at a time.
STATS, LISTS, ROWS = 4_000, 64, 8_192


def scan(folder: str, relative: str, depth: int, deeper: bool) -> Iterator[tuple[str, str, str, int, bool]]:
    """(path, name, relative path, depth, whether a folder to go on with) of a folder's entries; none of one that can't be read."""
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                own = f"{relative}/{entry.name}" if relative else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if deeper and entry.name not in SKIPPED_FOLDERS:
                        yield entry.path, entry.name, own, depth + 1, True
                elif not entry.is_dir():
                    yield entry.path, entry.name, own, depth, False
    except OSError:
        return


def _batches(rows: Iterable[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)

    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def list_names(spark: SparkSession, path: str, recursive: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """path, name, relative, depth of the files below a folder; ``max_depth`` folders down at most.  Nothing is opened or asked for its size."""
    root = str(path)
    if not os.path.isdir(root):
        raise NotADirectoryError(f"not a folder: {root}")
    ship(spark)
    names = [c.split()[0] for c in NAMES.split(", ")] + ["folder"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder, relative, depth in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                yield from _batches(scan(folder, relative, depth, recursive and depth < max_depth), names, types)

    frontier, rounds, n = spark.createDataFrame([(root, "", 0)], "path string, relative string, depth int"), [], 1
    while n:
        tasks = max(1, min(n, n // LISTS + spark.sparkContext.defaultParallelism))
        found = keep(frontier.repartition(tasks).mapInArrow(work, f"{NAMES}, folder boolean"))
        rounds.append(found.where("NOT folder").drop("folder"))
        frontier = found.where("folder").select("path", "relative", "depth")
        n = frontier.count()
    out = rounds[0]
    for part in rounds[1:]:
        out = out.unionByName(part)
    return out


def with_stat(files: DataFrame) -> DataFrame:
    """``files`` with size_bytes and mtime of their ``path``; those that are gone are left out."""
    ship(files.sparkSession)
    at = files.columns.index("path")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sizes, times = [], [], []
            for i, path in enumerate(b.column(at).to_pylist()):
                try:
                    stat = os.stat(path)
                except OSError:
                    continue
                kept.append(i)
                sizes.append(stat.st_size)
                times.append(stat.st_mtime)
            rows = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sizes, pa.int64()), pa.array(times, pa.float64())], names=[*rows.schema.names, "size_bytes", "mtime"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    files = keep(files)
    n = files.count()
    return files.repartition(max(1, min(n, n // STATS + files.sparkSession.sparkContext.defaultParallelism))).mapInArrow(work, f"{fields}, size_bytes long, mtime double")


def list_folder(spark: SparkSession, path: str, recursive: bool = True, max_depth: int = MAX_DEPTH, where=None) -> DataFrame:
    """The files below a folder; ``where`` is a condition on path, name, relative or depth, which saves the questions for the others."""
    found = list_names(spark, path, recursive, max_depth)
    return with_stat(found if where is None else found.where(where))


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Just these files; the folders they are in are not looked at."""
    rows = [(str(p), os.path.basename(p), os.path.basename(p), 0) for p in paths]
    return with_stat(spark.createDataFrame(rows, NAMES))


def list_store(spark: SparkSession, url: str, recursive: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The files below a folder of any store that Spark reads, listed by Spark's own index (which leaves out empty files and names that begin with ``_`` or ``.``)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(url)
    # As Hadoop spells it: viewfs:///a for viewfs:/a, no slash at the end.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(url)
    base = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/") + "/"
    relative = F.when(F.startswith("path", F.lit(base)), F.substring("path", len(base) + 1, 2**31 - 1)).otherwise(F.regexp_extract("path", "[^/]*$", 0))
    parts = F.split(relative, "/")
    rows = found.select("path", F.element_at(parts, -1).alias("name"), relative.alias("relative"), (F.size(parts) - 1).alias("depth"), F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").alias("mtime"), parts.alias("parts"))
    inside = ~F.exists(F.slice("parts", F.lit(1), F.col("depth")), lambda p: p.isin(*SKIPPED_FOLDERS))
    return rows.where(inside & (F.col("depth") <= (max_depth if recursive else 0))).drop("parts").withColumn("mtime", F.col("mtime") / 1e6)


def store_bytes(spark: SparkSession, url: str) -> DataFrame:
    """path, raw: the bytes of the files of a store that Spark reads; Spark deals files out by their sizes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(url).select("path", F.col("content").alias("raw"))


def write_tree(files: DataFrame) -> str:
    """Writes files (relative, raw) below a new folder that driver and executors share; it goes when the driver's program ends."""
    spark = ship(files.sparkSession)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    shared = shared.removeprefix("file://") if shared else None
    if shared is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a mounted folder that all executors share")
    root = tempfile.mkdtemp(prefix="lodestack-tree-", dir=shared and os.path.isdir(shared) and shared or None)
    atexit.register(shutil.rmtree, root, ignore_errors=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, made = 0, set()
        for b in batches:
            for relative, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = os.path.join(root, relative)
                if (folder := os.path.dirname(path)) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                # A repeated task writes the same file again.
                with open(path, "wb") as f:
                    f.write(raw or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    files.select("relative", "raw").mapInArrow(work, "n long").agg(F.sum("n")).collect()
    return root


# --- the data source ---

#: Folders found on the driver before the tasks take over.
BRANCHES = 64


class Branch(InputPartition):
    def __init__(self, top: str, relative: str, depth: int, alone: bool):
        self.top, self.relative, self.depth, self.alone = top, relative, depth, alone


class FolderReader(DataSourceReader):
    """Folders are split breadth first until there are ``BRANCHES`` of them; a task walks each."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.max_depth = int(options.get("maxdepth", options.get("maxDepth", MAX_DEPTH)))
        self.names: set[str] | None = None
        self.endings: list[str] = []

    def partitions(self):
        if not os.path.isdir(self.root):
            raise NotADirectoryError(f"not a folder: {self.root}")
        if self.max_depth < 0:
            return []
        out, open_folders = [], [(self.root, "", 0)]
        while open_folders and len(out) + len(open_folders) < BRANCHES:
            folder, relative, depth = open_folders.pop(0)
            out.append(Branch(folder, relative, depth, True))
            open_folders += [(p, r, d) for p, _, r, d, down in scan(folder, relative, depth, self.recursive and depth < self.max_depth) if down]
        return out + [Branch(*x, False) for x in open_folders]

    def read(self, partition: Branch):
        folders = [(partition.top, partition.relative, partition.depth)]
        while folders:
            folder, above, depth = folders.pop()
            for path, name, relative, level, down in scan(folder, above, depth, not partition.alone and self.recursive and depth < self.max_depth):
                if down:
                    folders.append((path, relative, level))
                elif (self.names is None or name in self.names) and all(name.endswith(e) for e in self.endings):
                    try:
                        stat = os.stat(path)
                    except OSError:
                        continue
                    yield path, name, relative, level, stat.st_size, stat.st_mtime


class FilteredFolderReader(FolderReader):
    """The same where Spark pushes filters down; it refuses readers that take filters where it does not."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes depth <= n, name = x, name in (...) and name ends with; gives the others back."""
        for f in filters:
            if isinstance(f, LessThanOrEqual) and f.attribute == ("depth",):
                self.max_depth = min(self.max_depth, int(f.value))
            elif isinstance(f, EqualTo | In) and f.attribute == ("name",):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.names = wanted if self.names is None else self.names & wanted
            elif isinstance(f, StringEndsWith) and f.attribute == ("name",):
                self.endings.append(f.value)
            else:
                yield f


class FolderSource(DataSource):
    """``spark.read.format("lodestack_folder").option("recursive", ...).load(path)``; the option pushdown is for sessions with filter pushdown."""

    @classmethod
    def name(cls):
        return "lodestack_folder"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        options = dict(self.options)
        return (FilteredFolderReader if options.get("pushdown") == "true" else FolderReader)(options)


def folder_source(spark: SparkSession, path: str, recursive: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The data source's rows; filters reach it where ``spark.sql.python.filterPushdown.enabled`` is set."""
    ship(spark).dataSource.register(FolderSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("lodestack_folder").option("pushdown", pushed).option("recursive", str(recursive).lower()).option("maxDepth", max_depth).load(str(path))
