"""The whole analysis: inventory, extraction, status, estimate, decision, and its recomputations."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..constants import CONTEXT_LIMIT, EXTENSIONS, IGNORED, IMAGES, LOW_TEXT, MARGIN, MAX_DEPTH, READY, STATUSES
from ..functions import tokenizers
from ..held import keep, released
from ..i18n import t
from ..operators import assembly, budget, extraction, inventory
from ..schema import IGNORED_FILES
from ..selection import path_key
from ..sources import folders
from ..streaming.progress import Address, ProgressEmitter, ProgressEvent, listening


#: A watched analysis: files of a part, parts at most, parts at a time.
FILES_A_PART, MAX_PARTS, WORKERS = 50, 64, 4


@dataclass
class AnalysisResult:
    """Lazy tables and the decision; limit, engine and files can change without a new extraction."""

    extracted: DataFrame
    ignored: DataFrame
    context_limit: int = CONTEXT_LIMIT
    margin: float = MARGIN
    engine: tokenizers.Engine = field(default_factory=lambda: tokenizers.resolve("approx"))
    estimated: DataFrame | None = None
    decided: budget.Decision | None = None
    profile: DataFrame | None = None

    def __post_init__(self):
        self._estimate()

    @property
    def engine_id(self) -> str:
        return self.engine.id

    @property
    def precise(self) -> bool:
        return self.engine.id != "approx"

    @property
    def files(self) -> DataFrame:
        return budget.blocked(self.estimated, self.context_limit)

    @property
    def n_ignored(self) -> int:
        return self.ignored.count()

    @property
    def is_blocked(self) -> bool:
        return self.decided.is_blocked

    @property
    def block_reason(self) -> str | None:
        names = budget.blocking_names(self.estimated, self.context_limit) if self.decided.n_blocking > 1 else []
        return budget.block_reason(self.decided, self.context_limit, names)

    @property
    def blocking(self) -> DataFrame:
        """All files over the limit."""
        return budget.blocking_files(self.estimated, self.context_limit)

    def _estimate(self) -> None:
        """One pass over the texts; limits, totals and counts are read from its profile."""
        self.estimated = budget.with_estimate(self.extracted, self.margin, self.engine)
        before, self.profile = self.profile, budget.profile(self.estimated).persist()
        self._decide()
        if before is not None:
            before.unpersist()

    def _decide(self) -> None:
        self.decided = self.decisions([self.context_limit])[self.context_limit]

    def decisions(self, limits: list[int]) -> dict[int, budget.Decision]:
        """What would be decided under each of these limits."""
        rows = budget.decisions(self.profile, limits, self.margin, self.precise).collect()
        return {r["context_limit"]: budget.Decision(**{k: v for k, v in r.asDict().items() if k != "context_limit"}) for r in rows}

    def release(self) -> None:
        """Gives the caches back; the result can't be used any more."""
        for df in (self.extracted, self.ignored, self.profile):
            df.unpersist()

    def recompute_limit(self, context_limit: int) -> AnalysisResult:
        """Statuses come from base_status again, so raising a limit gives them back."""
        self.context_limit = context_limit
        self._decide()
        return self

    def recompute_engine(self, engine_id: str) -> AnalysisResult:
        self.engine = tokenizers.resolve(engine_id)
        self._estimate()
        return self

    def count_base_status(self, status: str) -> int:
        return self.profile.where(F.col("base_status") == status).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def summary(self) -> dict[str, int]:
        counts = {r["base_status"]: r["n"] for r in self.profile.groupBy("base_status").agg(F.sum("n").alias("n")).collect()}
        return {s: counts.get(s, 0) for s in STATUSES}

    def remove_file(self, path: Path | str, reason: str | None = None) -> bool:
        """False if no file has that path."""
        key = path_key(path)
        mine = F.col("path").isin(str(path), key)
        gone = self.extracted.where(mine).select("path").limit(1).collect()
        if not gone:
            return False
        self.extracted = self.extracted.where(~mine)
        if reason is not None and not self.ignored.where(F.col("path").isin(str(path), key)).limit(1).count():
            row = self.extracted.sparkSession.createDataFrame([(gone[0]["path"], Path(gone[0]["path"]).name, "removed", reason)], IGNORED_FILES)
            self.ignored = self.ignored.unionByName(row)
        self._estimate()
        return True


def run_analysis(
    spark: SparkSession, input_path, context_limit: int = CONTEXT_LIMIT, margin: float = MARGIN, recursive: bool = True, exclude_globs=(), extensions=EXTENSIONS,
    scan: ScanConfig | None = None, sort: str = "name", max_depth: int = MAX_DEPTH, tokenizer_engine: str = "approx", emitter: ProgressEmitter | None = None,
) -> AnalysisResult:
    """Analyses folders and files; the texts are extracted once and kept for recomputations.

    A text with ``://`` names a folder of a store that only Spark reads.
    """
    scan = scan or ScanConfig()
    store = input_path if isinstance(input_path, str) and "://" in input_path else None
    limits = {"min_file": scan.min_chars_file, "min_page": scan.min_chars_per_page, "sparse": scan.sparse_page_chars, "ratio": scan.sparse_page_ratio}

    def read(files: DataFrame, done: Address | None = None) -> DataFrame:
        if store is None:
            rows = extraction.extract(files, done, lambda row: told_status(row, **limits))
        else:
            rows = extraction.extract_bytes(files.join(folders.store_bytes(spark, store), "path"))
        rows = rows.withColumn("failed", extraction.is_failed()).withColumn("ignored", F.coalesce(F.col("extract_status") == IGNORED, F.lit(False)))
        return budget.with_status(rows, **limits).drop("extract_status", "failed", "ignored").persist()

    with released():
        extensions, exclude_globs = extensions or EXTENSIONS, exclude_globs or ()
        if store is None:
            files, ignored = inventory.collect_inputs(spark, input_path, recursive, exclude_globs, extensions, sort, max_depth)
        else:
            files, ignored = inventory.collect_store(spark, store, recursive, exclude_globs, extensions, sort, max_depth)
        ignored = ignored.persist()
        ignored.count()
        rows = read(files) if emitter is None else _watched(spark, keep(files), read, emitter)
        return AnalysisResult(rows, ignored, context_limit, margin, tokenizers.resolve(tokenizer_engine))


def told_status(row: tuple, min_file: int, min_page: int, sparse: int, ratio: float) -> str:
    """The status of a row of ``extracted`` as a task can tell it at once; ``with_status`` gives the same."""
    found = dict(zip(extraction.COLUMNS, row, strict=True))
    if found["extract_status"]:
        return found["extract_status"]
    chars, images = found["chars_per_page"] or [], found["image_count"]
    low = bool(chars) and (sum(chars) / len(chars) < min_page or (images > 0 and sum(c < sparse for c in chars) / len(chars) >= ratio))
    if low or len((found["text"] or "").strip()) < min_file:
        return LOW_TEXT
    return IMAGES if images > 0 else READY


def _watched(spark: SparkSession, files: DataFrame, read: Callable[..., DataFrame], emitter: ProgressEmitter) -> DataFrame:
    """``read(files)``, part by part, with an event for each file as soon as its task has read it; cancelled, the parts that had ended by then.

    Tasks report to the driver as they go; what was not heard by the end of a part comes then.
    Parts are read side by side, each in jobs under one tag of this analysis, so that
    cancelling stops no other job of the session.  The rows stay cached on the executors;
    only paths and statuses come to the driver, a partition at a time.
    """
    sc = spark.sparkContext
    total, tag = files.count(), f"analysis-{uuid.uuid4().hex}"
    for row in files.select("path").toLocalIterator():
        emitter.emit(ProgressEvent(row["path"], 0, total, "pending", t("status.pending")))
    parts = max(1, min(MAX_PARTS, total // FILES_A_PART + 1))
    heard, lock = set(), threading.Lock()

    def tell(path: str, status: str) -> None:
        with lock:
            if path not in heard:
                heard.add(path)
                emitter.emit(ProgressEvent(path, len(heard), total, status, ""))

    def one(part: int, done: Address) -> DataFrame | None:
        if emitter.is_cancelled():
            return None
        sc.addJobTag(tag)
        try:
            rows = read(files.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == part), done)
            for row in rows.select("path", "base_status").toLocalIterator():
                if emitter.is_cancelled():
                    return None
                tell(row["path"], row["base_status"])
            return rows
        except Exception:
            if emitter.is_cancelled():
                return None
            raise
        finally:
            sc.removeJobTag(tag)

    with listening(spark, tell) as done, ThreadPoolExecutor(max_workers=WORKERS) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(one), part, done) for part in range(parts)]
        while not all(j.done() for j in jobs):
            if emitter.is_cancelled():
                sc.cancelJobsWithTag(tag)
            wait(jobs, timeout=0.1)
    out = None
    for rows in (j.result() for j in jobs):
        if rows is not None:
            out = rows if out is None else out.unionByName(rows)
    return read(files.limit(0)) if out is None else out


def report_paths(output: Path, report: Path | None = None) -> tuple[Path, Path]:
    """(Markdown, JSON): beside the output, or the one named and its sibling."""
    if report is None:
        base = output.with_name(f"{output.stem}_rapport")
        return base.with_name(base.name + ".md"), base.with_name(base.name + ".json")
    report = Path(report)
    return (report.with_suffix(".md"), report) if report.suffix.lower() == ".json" else (report if report.suffix else report.with_suffix(".md"), report.with_suffix(".json"))


def write_reports(result: AnalysisResult, output: Path, report: Path | None = None, now: datetime | None = None) -> tuple[Path, Path]:
    md, js = report_paths(Path(output), report)
    md.parent.mkdir(parents=True, exist_ok=True)
    assembly.write_markdown_report(result, md, now)
    assembly.write_json_report(result, js, now)
    return md, js


def generate_corpus(result: AnalysisResult, output: Path, line_ending: str = "lf", now: datetime | None = None) -> bool:
    """Writes the corpus and its reports; a blocked result only gives reports, and False."""
    output = Path(output)
    kind = output.suffix.lower()
    if kind not in (".md", ".pdf"):
        raise ValueError(f"not a corpus format: {output.suffix or '(none)'}")
    output.parent.mkdir(parents=True, exist_ok=True)
    if not result.is_blocked:
        if kind == ".md":
            assembly.write_markdown(result, output, line_ending, now)
        else:
            assembly.write_pdf(result, output, now)
    write_reports(result, output, now=now)
    return not result.is_blocked
