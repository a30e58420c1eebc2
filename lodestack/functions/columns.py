"""The engine's scalar functions as Column expressions: no Python runs per row."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    BYTES_PER_TOKEN,
    COLOURS,
    ERROR,
    EXTENSIONS,
    EXTRACTED,
    IGNORED,
    IMAGE_EXTENSIONS,
    IMAGES,
    LOW_TEXT,
    MARGIN,
    MIN_CHARS_FILE,
    MIN_CHARS_PAGE,
    READY,
    SEVERITY,
    SPARSE_CHARS,
    SPARSE_RATIO,
    SPECIAL_FILES,
    STATUSES,
    TOO_LARGE,
    VERBATIM_TYPES,
)
from ..i18n import language, t

#: White space as Python's ``str.strip`` knows it.
STRIP = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{STRIP}|{STRIP}\z", "")


def shorter(text: Column, least: int) -> Column:
    """Whether the stripped text has fewer than ``least`` characters: a search that ends at the first place that decides it."""
    if least < 1:
        return F.lit(False)
    black = f"[^{STRIP[1:-2]}]"
    return ~F.rlike(text, F.lit(black if least == 1 else rf"{black}[\s\S]{{{least - 2},}}?{black}"))


def suffix(name: Column) -> Column:
    """Last dot and what follows, in lower case; none for dot files and names that end in a dot."""
    return F.lower(F.regexp_extract(name, r"(?s)(?<=.)(\.[^.]+)\z", 1))


#: Between the texts and the numbers of a key: under every character of a name.
_MARK = "\u0000"


def natural_key(path: Column) -> Column:
    """A text that sorts, byte by byte, file2 before file10: texts in lower case and numbers in turn.

    A number is how many digits its number of digits has, that number, and the digits without
    leading zeros, so numbers of any length come in the order of their values.
    """
    parts = F.split(F.regexp_replace(F.lower(path), r"([0-9]+)", "\u0001$1\u0001"), "\u0001")

    def number(digits: Column) -> Column:
        bare = F.ltrim(digits, F.lit("0"))
        size = F.length(bare).cast("string")
        return F.concat(F.length(size).cast("string"), size, bare)

    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, number(x)).otherwise(x)), _MARK)


def casefold(name: Column) -> Column:
    """Equal for names that differ in case alone, as Python's ``str.casefold`` tells it: straße.txt and STRASSE.TXT."""
    # Upper case unites what has two lower forms; a dotless i is a letter of its own.  The translation
    # between keeps Spark from taking the lower case of an upper case for a mere lower case.
    up = F.translate(F.upper(F.translate(name, "\u1e9e\u0131", "\u00df\uf131")), "\uf131", "\u0131")
    return F.translate(F.lower(up), "\u03c2", "\u03c3")


def approx_tokens(bytes_utf8: Column) -> Column:
    return F.ceil(bytes_utf8.cast("double") / F.lit(float(BYTES_PER_TOKEN))).cast("long")


def with_margin(tokens: Column, margin: float = MARGIN) -> Column:
    """In IEEE doubles: a decimal margin would round some values elsewhere."""
    return F.ceil(tokens.cast("double") * (F.lit(1.0) + F.lit(float(margin)))).cast("long")


def over_limit(tokens_with_margin: Column, limit: int) -> Column:
    """Equality still fits."""
    return tokens_with_margin > F.lit(limit)


def format_number(value: Column, lang: str | None = None) -> Column:
    text = F.format_number(value, 0)
    return F.translate(text, ",", "\u00a0") if (lang or language()) == "fr" else text


def glob_regex(pattern: str) -> str:
    """A file-name glob as a Java pattern for a whole name."""
    body = fnmatch.translate(pattern)
    body = re.sub(r"^\(\?s:(.*)\)(\\Z|\\z)$", r"\1", body, flags=re.S)
    return rf"(?s)\A(?:{body})\z"


def matches_any(name: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(glob_regex(p))
    return out


def ignore_reason(name: Column, extensions=EXTENSIONS, exclude=()) -> Column:
    """special, excluded, image, unsupported, or null for a file that is read."""
    ext = suffix(name)
    return (
        F.when(matches_any(name, SPECIAL_FILES), "special")
        .when(matches_any(name, exclude), "excluded")
        .when(~ext.isin(*extensions) & ext.isin(*IMAGE_EXTENSIONS), "image")
        .when(~ext.isin(*extensions), "unsupported")
    )


def reason_text(code: Column, ext: Column) -> Column:
    """The reason in words, in the current language."""
    out = F.lit(None).cast("string")
    for known in ("special", "excluded", "image", "removed"):
        out = F.when(code == known, t(f"inventory.{known}")).otherwise(out)
    before, after = t("inventory.unsupported").split("{ext}")
    return F.when(code == "unsupported", F.concat(F.lit(before), F.when(ext == "", "(none)").otherwise(ext), F.lit(after))).otherwise(out)


def page_average(chars: Column) -> Column:
    return F.aggregate(chars, F.lit(0.0), lambda a, x: a + x) / F.size(chars)


def sparse_share(chars: Column, sparse: int = SPARSE_CHARS) -> Column:
    return F.size(F.filter(chars, lambda x: x < sparse)) / F.size(chars)


def low_text(text: Column, chars: Column, images: Column, min_file=MIN_CHARS_FILE, min_page=MIN_CHARS_PAGE, sparse=SPARSE_CHARS, ratio=SPARSE_RATIO) -> Column:
    paged = F.coalesce(F.size(chars) > 0, F.lit(False))
    pages = F.when(paged, (page_average(chars) < min_page) | ((images > 0) & (sparse_share(chars, sparse) >= ratio))).otherwise(False)
    return shorter(F.coalesce(text, F.lit("")), min_file) | pages


def file_status(text: Column, chars: Column, images: Column, ignored: Column, failed: Column, **thresholds) -> Column:
    """error before ignored before low_text before images before ready."""
    return F.when(failed, ERROR).when(ignored, IGNORED).when(low_text(text, chars, images, **thresholds), LOW_TEXT).when(images > 0, IMAGES).otherwise(READY)


def is_extracted(status: Column) -> Column:
    return status.isin(*EXTRACTED)


def is_blocking(status: Column) -> Column:
    return status == TOO_LARGE


def is_warning(status: Column) -> Column:
    return status == IMAGES


def is_alert(status: Column) -> Column:
    return status == LOW_TEXT


def _lookup(status: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(status == k, F.lit(v)).otherwise(out)
    return out


def severity(status: Column) -> Column:
    return _lookup(status, SEVERITY).cast("int")


def colour(status: Column) -> Column:
    return _lookup(status, COLOURS)


def status_label(status: Column) -> Column:
    return _lookup(status, {s: t(f"status.{s}") for s in STATUSES})


def gauge(total: Column, limit: int) -> Column:
    share = total / F.lit(float(limit))
    return F.when(share >= 1, "red").when(share >= 0.8, "orange").otherwise("green")


def source_header(tokens: Column, margined: Column, c=F.col) -> Column:
    """The block that introduces a file in the corpus; ``c`` finds the file's columns."""
    alert = F.when(c("base_status") == IMAGES, "images").when(c("base_status") == LOW_TEXT, "peu_de_texte")
    line = lambda name, value: F.concat(F.lit(f"- {name}: "), value.cast("string"))
    return F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("## SOURCE: "), c("relative_path")),
        line("type", c("file_type")),
        line("taille_octets", c("size_bytes")),
        F.when(c("page_count") > 0, line("pages_ou_diapos", c("page_count"))),
        line("tokens_estimes", tokens),
        line("tokens_avec_marge", margined),
        F.when(c("image_count") > 0, line("images", c("image_count"))),
        line("alerte", alert),
        F.when(c("encoding") != "", line("encodage", c("encoding"))),
        F.lit("---"),
    )


#: Rounds after which the estimate of a text of up to 10^15 bytes has settled.
ROUNDS = 6


def source_estimate(margin: float = MARGIN, c=F.col) -> Column:
    """struct(bytes_utf8, tokens_estimated, tokens_with_margin) of header and text.

    The header names both estimates, so they are a fixed point: only the numbers of
    their digits change the size, and the estimate rises to its least fixed point.
    """
    text = F.octet_length(F.coalesce(c("text"), F.lit(""))).cast("long")
    fixed = F.octet_length(source_header(F.lit(""), F.lit(""), c)).cast("long") + 2 + text

    def entry(size: Column) -> Column:
        tokens = approx_tokens(size)
        return F.struct(size.alias("bytes_utf8"), tokens.alias("tokens_estimated"), with_margin(tokens, margin).alias("tokens_with_margin"))

    digits = lambda n: F.length(n.cast("string")).cast("long")
    start = F.struct(entry(text).alias("now"), fixed.alias("fixed"))
    grow = lambda s, _: F.struct(entry(s["fixed"] + digits(s["now"]["tokens_estimated"]) + digits(s["now"]["tokens_with_margin"])).alias("now"), s["fixed"].alias("fixed"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, grow, lambda s: s["now"])


def fence(text: Column) -> Column:
    """Backticks that do not occur in the text: three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)")), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def body(text: Column, file_type: Column, verbatim=VERBATIM_TYPES, end: str = "\n") -> Column:
    """The text as it stands in the corpus: fenced if it holds a fence and its type is not verbatim."""
    ticks = fence(text)
    return F.when(~file_type.isin(*verbatim) & F.contains(text, F.lit("```")), F.concat_ws(end, ticks, text, ticks)).otherwise(text)


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
