"""Command line.  Exit codes: 0 done, 1 wrong input, 2 over the limit, 3 no files, 4 not writable."""

from __future__ import annotations

import argparse
import logging
import sys
import tempfile
from logging.handlers import RotatingFileHandler
from pathlib import Path

from pyspark.sql import SparkSession

from . import __version__
from .config import load_config, writable
from .constants import ENGINES, EXTENSIONS, UNUSUAL_LIMIT
from .functions.tokenizers import configure, list_engines
from .i18n import format_number, set_language, t
from .selection import InputSelection
from .sources.readers import supported_extensions

OK, WRONG, BLOCKED, NO_FILES, NOT_WRITABLE = range(5)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestack")
    p.add_argument("--input", "-i", action="append", help=t("cli.input"))
    p.add_argument("--output", "-o")
    p.add_argument("--format", "-f", choices=("md", "pdf"))
    p.add_argument("--context", "-c", type=int)
    p.add_argument("--margin", type=float)
    p.add_argument("--tokenizer-engine", choices=ENGINES)
    p.add_argument("--vocabulary", action="append", default=[], metavar="ENGINE=FILE", help="vocabulary file of a precise engine")
    p.add_argument("--list-tokenizers", action="store_true")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("--include-ext", nargs="+")
    p.add_argument("--exclude-glob", nargs="+")
    p.add_argument("--report")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--yes", "-y", action="store_true")
    p.add_argument("--force-images", action="store_true", help="accepted; images never block")
    p.add_argument("--lang")
    p.add_argument("--config", type=Path)
    p.add_argument("--list-formats", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--verbose", action="store_true")
    return p


def set_up_logging(verbose: bool) -> None:
    """To stderr and to a file of two megabytes that is rotated; texts of documents are never logged."""
    folder = Path(tempfile.gettempdir()) / "lodestack"
    folder.mkdir(parents=True, exist_ok=True)
    handlers = [logging.StreamHandler(sys.stderr), RotatingFileHandler(folder / "lodestack.log", maxBytes=2_000_000, backupCount=1, encoding="utf-8")]
    logging.basicConfig(level=logging.DEBUG if verbose else logging.WARNING, handlers=handlers, format="%(asctime)s %(name)s %(levelname)s %(message)s")


def output_path(given: str | None, form: str, primary: Path) -> Path:
    """A suffix decides the format; without one the output is a folder."""
    if given is None:
        return primary / "lodestack_output" / f"corpus.{form}" if primary.is_dir() else Path(f"corpus.{form}")
    path = Path(given)
    return path if path.suffix.lower() in (".md", ".pdf") else path / f"corpus.{form}"


def session() -> SparkSession:
    return SparkSession.builder.appName("lodestack").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    set_language(load_config().lang)
    args = build_parser().parse_args(argv)
    set_up_logging(args.verbose)
    config = load_config(args.config)
    set_language(args.lang or config.lang)
    if args.list_formats:
        print(f"{t('cli.formats')}:", *(f"  {e}" for e in supported_extensions()), sep="\n")
        return OK
    if args.list_tokenizers:
        print(f"{t('cli.tokenizers')}:", *(f"  {e.id} — {t(e.label_key)}" for e in list_engines()), sep="\n")
        return OK
    for pair in args.vocabulary:
        engine, _, path = pair.partition("=")
        configure(engine, path)
    if not args.input:
        print(t("cli.input"), file=sys.stderr)
        return WRONG
    for p in args.input:
        if not Path(p).exists():
            print(f"{t('error.unknown')}: {p}", file=sys.stderr)
            return WRONG
    limit = config.context_limit if args.context is None else args.context
    if limit > UNUSUAL_LIMIT:
        print(t("cli.unusual", tokens=format_number(limit)), file=sys.stderr)
    selection = InputSelection.of(args.input)
    output = output_path(args.output, args.format or config.format, selection.primary_path)
    if not writable(output.parent):
        print(f"{t('exit.not_writable')}: {output.parent}", file=sys.stderr)
        return NOT_WRITABLE

    from .plans.analysis import generate_corpus, run_analysis, write_reports

    extensions = tuple((e if e.startswith(".") else f".{e}").lower() for e in args.include_ext) if args.include_ext else EXTENSIONS
    result = run_analysis(
        spark or session(), selection, limit, config.margin if args.margin is None else args.margin, args.recursive or (config.recursive and not args.no_recursive),
        config.exclude_globs if args.exclude_glob is None else args.exclude_glob, extensions, config.scan, config.sort, config.max_depth, args.tokenizer_engine or config.tokenizer_engine,
    )
    d = result.decided
    if not d.n_files:
        print(t("exit.no_files"), file=sys.stderr)
        return NO_FILES
    if d.is_blocked:
        print(f"{t('exit.blocked')}: {result.block_reason}", file=sys.stderr)
    if args.dry_run or (d.is_blocked and args.yes):
        if args.dry_run:
            print(f"{t('cli.analyze')}: {d.n_files}", f"{t('counter.estimated')}: {format_number(d.tokens_estimated)}", f"{t('counter.with_margin')}: {format_number(d.tokens_with_margin)}", f"{t('counter.limit')}: {format_number(limit)}", sep="\n")
        write_reports(result, output, Path(args.report) if args.report else None)
        return BLOCKED if d.is_blocked else OK
    if not generate_corpus(result, output):
        return BLOCKED
    if args.report:
        write_reports(result, output, Path(args.report))
    print(t("corpus.done", path=str(output)), f"{t('counter.estimated')}: {format_number(d.tokens_estimated)}", f"{t('counter.with_margin')}: {format_number(d.tokens_with_margin)}", sep="\n")
    return OK
