"""Readers: from a file's bytes to its text.  Each is a function of bytes and extension."""

from .registry import Extraction, reader_for, register, safe_read, supported_extensions

__all__ = ["Extraction", "reader_for", "register", "safe_read", "supported_extensions"]
