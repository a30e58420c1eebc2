"""What a front end does with what its user types or drops."""

from __future__ import annotations

import re

from ..i18n import format_number, t


def dropped_paths(data: str) -> list[str]:
    """Paths of a drop event: those in braces first, then the others, between spaces."""
    grouped = re.findall(r"\{([^}]+)\}", data)
    return grouped + re.sub(r"\{[^}]+\}", "", data).split()


def limit_of(entry: str, default: int) -> int:
    """A positive whole number, else the default."""
    try:
        value = int(entry)
    except ValueError:
        return default
    return value if value > 0 else default


def engine_of_label(label: str, ids: dict[str, str]) -> str:
    return ids.get(label, "approx")


def summary_lines(counts: dict[str, int], decided, limit: int) -> list[str]:
    """What the user is told: ready files, images, low text, and why nothing can be written."""
    out = []
    if counts.get("ready", 0) and not decided.is_blocked:
        out.append(t("summary.ok", count=counts["ready"], limit=format_number(limit)))
    out += [t(f"summary.{s}", count=counts[s]) for s in ("images", "low_text") if counts.get(s, 0)]
    if decided.n_blocking:
        out.append(t("summary.blocked_file", file=decided.first_blocking, tokens=format_number(decided.first_tokens), limit=format_number(limit)))
    elif decided.total_over:
        out.append(t("summary.blocked_total", total=format_number(decided.tokens_with_margin), limit=format_number(limit)))
    return out
