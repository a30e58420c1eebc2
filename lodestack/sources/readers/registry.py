"""Which reader takes which extension, and error isolation per file."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from ...constants import ERROR, IGNORED, READY
from ...i18n import t


@dataclass
class Extraction:
    """What a reader returns."""

    text: str = ""
    status: str = READY
    error_message: str | None = None
    image_count: int = 0
    page_count: int = 0
    encoding: str | None = None
    chars_per_page: list[int] = field(default_factory=list)
    file_type: str | None = None


Reader = Callable[[bytes, str], Extraction]
_readers: dict[str, list[tuple[float, int, Reader]]] = {}
_MODULES = ("plain", "tabular", "structured", "html", "rtf", "ooxml", "odf", "mail", "pdf")
_loaded = False


def register(*extensions: str, priority: float = 0.0) -> Callable[[Reader], Reader]:
    """The lowest priority wins; of equal ones, the first registered."""

    def add(reader: Reader) -> Reader:
        for e in extensions:
            known = _readers.setdefault(e.lower(), [])
            known.append((priority, len(known), reader))
            known.sort(key=lambda x: x[:2])
        return reader

    return add


def _load() -> None:
    global _loaded
    if not _loaded:
        _loaded = True
        for name in _MODULES:
            importlib.import_module(f"{__package__}.{name}")


def reader_for(extension: str) -> Reader | None:
    _load()
    known = _readers.get(extension.lower())
    return known[0][2] if known else None


def supported_extensions() -> list[str]:
    _load()
    return sorted(_readers)


def snapshot() -> dict[str, list[tuple[float, int, Reader]]]:
    """All readers with their priorities, to go with the tasks: those of this package by name, others as they are."""
    _load()
    return {extension: list(known) for extension, known in _readers.items()}


def install(readers: dict[str, list[tuple[float, int, Reader]]]) -> None:
    """Makes the readers of a ``snapshot`` the ones of this process, in place of what an earlier task left."""
    global _loaded
    _loaded = True
    _readers.clear()
    _readers.update(readers)


def clear_registry() -> None:
    """Forgets all readers; the next look-up does not load them again."""
    global _loaded
    _readers.clear()
    _loaded = True


def failed(exc: BaseException) -> Extraction:
    message = str(exc)
    return Extraction(status=ERROR, error_message=f"{type(exc).__name__}: {message}" if message else t("error.unknown"))


def safe_read(raw: bytes, extension: str) -> Extraction:
    """Never raises: a file that can't be read becomes a row with its error."""
    reader = reader_for(extension)
    if reader is None:
        return Extraction(status=IGNORED, error_message=t("error.no_extractor", ext=extension))
    try:
        return reader(raw, extension)
    except Exception as exc:
        return failed(exc)
