"""Settings: found in files, checked, saved."""

from __future__ import annotations

import json
import logging
import os
import sys
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from .constants import CONTEXT_LIMIT, ENGINES, MARGIN, MAX_DEPTH, MIN_CHARS_FILE, MIN_CHARS_PAGE, SPARSE_CHARS, SPARSE_RATIO, UNUSUAL_LIMIT

log = logging.getLogger(__name__)
FILE_NAME = "lodestack.json"


@dataclass
class ScanConfig:
    min_chars_file: int = MIN_CHARS_FILE
    min_chars_per_page: int = MIN_CHARS_PAGE
    sparse_page_chars: int = SPARSE_CHARS
    sparse_page_ratio: float = SPARSE_RATIO


@dataclass
class Config:
    context_limit: int = CONTEXT_LIMIT
    margin: float = MARGIN
    format: str = "md"
    recursive: bool = True
    exclude_globs: list[str] = field(default_factory=list)
    sort: str = "name"
    max_depth: int = MAX_DEPTH
    lang: str = "fr"
    open_output_folder: bool = True
    tokenizer_engine: str = "approx"
    scan: ScanConfig = field(default_factory=ScanConfig)

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, ensure_ascii=False)

    def validate(self) -> list[str]:
        """What is out of range, in words; a context limit over a million is only unusual."""
        s, most = self.scan, 10_000
        rules = (
            (self.context_limit >= 1, f"context_limit must be 1 at least, not {self.context_limit}"),
            (self.context_limit <= UNUSUAL_LIMIT, f"context_limit is unusual: {self.context_limit}"),
            (-1 <= self.margin <= 10, f"margin must be between -1 and 10, not {self.margin}"),
            (self.format in ("md", "pdf"), f"format must be md or pdf, not {self.format}"),
            (self.sort in ("name", "mtime", "type"), f"sort must be name, mtime or type, not {self.sort}"),
            (1 <= self.max_depth <= 100, f"max_depth must be between 1 and 100, not {self.max_depth}"),
            (self.tokenizer_engine in ENGINES, f"tokenizer_engine must be one of {', '.join(ENGINES)}"),
            (0 <= s.min_chars_file <= most, f"scan.min_chars_file must be between 0 and {most}, not {s.min_chars_file}"),
            (0 <= s.min_chars_per_page <= most, f"scan.min_chars_per_page must be between 0 and {most}, not {s.min_chars_per_page}"),
            (s.sparse_page_chars >= 0, "scan.sparse_page_chars must not be negative"),
            (0 <= s.sparse_page_ratio <= 1, f"scan.sparse_page_ratio must be between 0 and 1, not {s.sparse_page_ratio}"),
        )
        return [message for right, message in rules if not right]


def program_dir() -> Path:
    return Path(sys.executable if getattr(sys, "frozen", False) else sys.argv[0] or ".").resolve().parent


def user_dir() -> Path:
    base = os.environ.get("APPDATA") or os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return Path(base) / "lodestack"


def config_paths() -> list[Path]:
    return [program_dir() / FILE_NAME, user_dir() / FILE_NAME]


def _coerced(value, like):
    """``value`` as the type of ``like``: "5000" is 5000 where a number is due; ValueError or TypeError if it can't be."""
    return [str(x) for x in value] if isinstance(like, list) else type(like)(value)


def merged(base: Config, data: dict) -> Config:
    """``base`` with the known keys of ``data``, each as its own type."""
    scan = data.get("scan")
    take = lambda name, like, given: _coerced(given[name], like) if name in given else like
    out = Config(**{f.name: take(f.name, getattr(base, f.name), data) for f in fields(Config) if f.name != "scan"})
    out.scan = ScanConfig(**{f.name: take(f.name, getattr(base.scan, f.name), scan if isinstance(scan, dict) else {}) for f in fields(ScanConfig)})
    return out


def load_config(explicit: Path | None = None) -> Config:
    """The first usable file of: the one named, beside the program, in the user's folder; else defaults."""
    for path in [*([Path(explicit)] if explicit else []), *config_paths()]:
        try:
            if not path.is_file():
                continue
            data = json.loads(path.read_text(encoding="utf-8"))
            if not isinstance(data, dict):
                raise ValueError("not an object")
            config = merged(Config(), data)
        except (OSError, ValueError, TypeError, OverflowError) as exc:
            log.warning("configuration %s is not usable: %s", path, exc)
            continue
        for message in config.validate():
            log.warning("configuration %s: %s", path, message)
        return config
    return Config()


def writable(folder: Path) -> bool:
    """Tried out by writing a file there."""
    probe = folder / f".lodestack_probe_{os.getpid()}"
    try:
        folder.mkdir(parents=True, exist_ok=True)
        probe.touch()
        probe.unlink()
    except OSError:
        return False
    return True


def save_config(config: Config, explicit: Path | None = None) -> Path:
    path = Path(explicit) if explicit else next((p for p in config_paths() if writable(p.parent)), config_paths()[-1])
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(config.to_json(), encoding="utf-8")
    return path
