"""JSON and XML, indented by two."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

from .plain import decoded
from .registry import Extraction, register


@register(".json")
def read_json(raw: bytes, extension: str) -> Extraction:
    text, encoding = decoded(raw)
    return Extraction(text=json.dumps(json.loads(text), indent=2, ensure_ascii=False), encoding=encoding)


@register(".xml")
def read_xml(raw: bytes, extension: str) -> Extraction:
    text, encoding = decoded(raw)
    root = ET.fromstring(text)
    ET.indent(root, space="  ")
    return Extraction(text=ET.tostring(root, encoding="unicode"), encoding=encoding)
