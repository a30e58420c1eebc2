"""E-mails and web archives in MIME."""

from __future__ import annotations

from email import policy
from email.headerregistry import HeaderRegistry
from email.message import EmailMessage
from email.parser import BytesParser
from functools import lru_cache

from .html import plain_text
from .registry import Extraction, register

# Header and its label.
LABELS = (("Subject", "Sujet"), ("From", "De"), ("To", "À"), ("Date", "Date"))


#: Header values up to this length are kept, that many of them; longer ones are parsed each time.
SHORT, KEPT = 1_000, 1_024
_parsed = HeaderRegistry()
_kept = lru_cache(KEPT)(_parsed)


def _header(name: str, value: str):
    """A header's value, parsed once for equal ones: the library parses it again whenever it is asked for."""
    return (_kept if len(value) <= SHORT else _parsed)(name, value)


_POLICY = policy.default.clone(header_factory=_header)


def _message(raw: bytes) -> EmailMessage:
    return BytesParser(policy=_POLICY).parsebytes(raw)


def _first(message: EmailMessage, kind: str) -> str:
    for part in message.walk():
        if part.get_content_type() == kind and (body := part.get_content()):
            return str(body)
    return ""


@register(".eml")
def read_eml(raw: bytes, extension: str) -> Extraction:
    message = _message(raw)
    lines = [f"**{label}** : {value}" for name, label in LABELS if (value := message.get(name, ""))]
    lines.append("")
    if message.is_multipart():
        plain, html = _first(message, "text/plain"), _first(message, "text/html")
    else:
        content = str(message.get_content() or "")
        plain, html = ("", content) if message.get_content_type() == "text/html" else (content, "")
    body = plain or plain_text(html, frozenset({"script", "style"}))
    return Extraction(text="\n".join([*lines, body] if body else lines), file_type="eml")


@register(".mhtml", ".mht")
def read_mhtml(raw: bytes, extension: str) -> Extraction:
    message = _message(raw)
    parts = list(message.walk()) if message.is_multipart() else [message]
    texts = [plain_text(str(p.get_content())) for p in parts if p.get_content_type() == "text/html"]
    images = sum(p.get_content_type().startswith("image/") for p in parts)
    return Extraction(text="\n\n".join(x for x in texts if x), image_count=images)
