"""Fixed values of the data model: formats, names to skip, defaults, thresholds."""

from __future__ import annotations

# Extension and the kind of reader for it.
FORMATS = {
    ".pdf": "pdf", ".docx": "docx", ".pptx": "pptx", ".rtf": "rtf", ".txt": "text", ".text": "text", ".log": "text", ".html": "html", ".htm": "html",
    ".md": "markdown", ".markdown": "markdown", ".csv": "csv", ".tsv": "csv", ".xlsx": "xlsx", ".ods": "odf", ".odt": "odf", ".odp": "odf",
    ".xml": "xml", ".json": "json", ".yaml": "plain", ".yml": "plain", ".ini": "plain", ".cfg": "plain", ".eml": "eml", ".mhtml": "mhtml", ".mht": "mhtml",
}
EXTENSIONS = tuple(sorted(FORMATS))
# Pictures, which are named as such when they are left out.
IMAGE_EXTENSIONS = (".bmp", ".gif", ".heic", ".ico", ".jpeg", ".jpg", ".png", ".svg", ".tif", ".tiff", ".webp")
# File names (globs) and folders that are never read.
SPECIAL_FILES = ("~$*", "Thumbs.db", "desktop.ini", ".DS_Store", "corpus.md", "corpus.pdf", "*_rapport.md", "*_rapport.json")
SKIPPED_FOLDERS = ("$RECYCLE.BIN", "System Volume Information", ".git", "__pycache__", "_internal")
# Texts of these types go into the corpus without a fence.
VERBATIM_TYPES = ("markdown", "text", "csv_tsv", "xml_json", "eml", "mhtml")

CONTEXT_LIMIT, MARGIN, MAX_DEPTH = 128_000, 0.15, 12
BYTES_PER_TOKEN = 4
UNUSUAL_LIMIT, LARGE_FILE = 1_000_000, 50 * 1024 * 1024
MIN_CHARS_FILE, MIN_CHARS_PAGE, SPARSE_CHARS, SPARSE_RATIO = 80, 50, 20, 0.30

READY, IMAGES, LOW_TEXT, TOO_LARGE, IGNORED, ERROR = "ready", "images", "low_text", "too_large", "ignored", "error"
STATUSES = (READY, IMAGES, LOW_TEXT, TOO_LARGE, IGNORED, ERROR)
EXTRACTED = (READY, IMAGES, LOW_TEXT)
# Severity and colour of a status.
SEVERITY = {READY: 0, IMAGES: 1, LOW_TEXT: 2, IGNORED: 3, ERROR: 4, TOO_LARGE: 5}
COLOURS = {READY: "#22c55e", IMAGES: "#eab308", LOW_TEXT: "#f97316", TOO_LARGE: "#ef4444", IGNORED: "#9ca3af", ERROR: "#dc2626"}
ENGINES = ("approx", "mistral", "openai")
