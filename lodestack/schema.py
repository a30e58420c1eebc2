"""Schemas of the engine's tables."""

from __future__ import annotations

INVENTORY = "source_idx int, pos long, path string, name string, ext string, preferred string, size_bytes long, mtime double"
EXTRACTED = (
    "path string, relative_path string, extension string, file_type string, size_bytes long, text string, extract_status string, "
    "error_message string, image_count int, page_count int, encoding string, chars_per_page array<int>, extra_metadata map<string,string>, ord long"
)
IGNORED_FILES = "path string, name string, reason_code string, reason string"
