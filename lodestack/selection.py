"""What the user chose: folders and files, and files taken out again."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path


def path_key(path: Path | str) -> str:
    """By this two paths are the same."""
    return os.path.normcase(os.path.abspath(path))


def _distinct(paths: Iterable[Path | str]) -> tuple[Path, ...]:
    return tuple({path_key(p): Path(p) for p in reversed(list(paths))}[k] for k in dict.fromkeys(path_key(p) for p in paths))


@dataclass(frozen=True)
class InputSelection:
    """Immutable; paths and exclusions are distinct, the first one stays."""

    paths: tuple[Path, ...]
    excluded_files: tuple[Path, ...] = ()

    def __post_init__(self):
        paths, excluded = list(self.paths), list(self.excluded_files)
        if not paths:
            raise ValueError("an input path is needed")
        object.__setattr__(self, "paths", _distinct(paths))
        object.__setattr__(self, "excluded_files", _distinct(excluded))

    @classmethod
    def of(cls, value: Path | str | Sequence[Path | str] | InputSelection) -> InputSelection:
        if isinstance(value, InputSelection):
            return value
        return cls((Path(value),) if isinstance(value, str | Path) else tuple(Path(v) for v in value))

    @property
    def primary_path(self) -> Path:
        return self.paths[0]

    @property
    def output_directory(self) -> Path:
        return self.primary_path if self.primary_path.is_dir() else self.primary_path.parent

    def exclude(self, path: Path | str) -> InputSelection:
        return InputSelection(self.paths, (*self.excluded_files, Path(path)))

    def add(self, paths: Iterable[Path | str]) -> InputSelection:
        """Adding a path that was excluded takes the exclusion back."""
        new = [Path(p) for p in paths]
        keys = {path_key(p) for p in new}
        return InputSelection((*self.paths, *new), tuple(p for p in self.excluded_files if path_key(p) not in keys))

    def is_excluded(self, path: Path | str) -> bool:
        return path_key(path) in {path_key(p) for p in self.excluded_files}
