"""OpenDocument texts, sheets and slides."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

from ...constants import ERROR
from .registry import Extraction, register

# Fixed values of the format: namespaces.
OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def _words(node: ET.Element) -> str:
    return "".join(s.strip() for s in node.itertext())


def _local(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _body(root: ET.Element) -> ET.Element | None:
    """office:text, else the first element of that local name in any namespace."""
    found = next(root.iter(f"{OFFICE}text"), None)
    return found if found is not None else next((x for x in root.iter() if _local(x) == "text"), None)


def _blocks(body: ET.Element) -> list[str]:
    out = []
    for child in body:
        name = _local(child)
        if "table" in name:
            for row in (x for x in child.iter() if "table-row" in _local(x)):
                cells = [_words(c) for c in row if "table-cell" in _local(c)]
                if any(cells):
                    out.append(" | ".join(cells))
        elif child.tag in (f"{TEXT}p", f"{TEXT}h"):
            out.append(_words(child))
        elif "list" in name:
            out += [f"- {w}" for x in child.iter() if "list-item" in _local(x) and (w := _words(x))]
    return [x for x in out if x]


@register(".odt", ".ods", ".odp")
def read_odf(raw: bytes, extension: str) -> Extraction:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        if "content.xml" not in names:
            return Extraction(status=ERROR, error_message="content.xml introuvable dans l'archive ODF")
        root = ET.fromstring(z.read("content.xml"))
    body = _body(root)
    parts = _blocks(body) if body is not None else [w for x in root.iter() if x.tag in (f"{TEXT}p", f"{TEXT}h") and (w := _words(x))]
    return Extraction(text="\n".join(parts), image_count=sum(n.startswith(("Pictures/", "media/")) for n in names))
