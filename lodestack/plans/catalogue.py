"""The queries over the driver's tables, by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import EXTENSIONS, IMAGE_EXTENSIONS, SPECIAL_FILES, TOO_LARGE
from ..functions import columns as C
from ..functions import decoding
from ..operators import assembly, budget, extraction, inventory, prefix
from ..sources import folders
from ..sources.tables import as_mixed_files, as_text_files, conversation_pages, read
from . import formats

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return _QUERIES | formats.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | formats.oracle_sql()


def _n(x: str) -> str:
    return f"ceil(({x})::DOUBLE / 4.0::DOUBLE)::BIGINT"


def _m(x: str, margin: float = 0.15) -> str:
    return f"ceil(({x})::DOUBLE * (1.0::DOUBLE + {margin}::DOUBLE))::BIGINT"


_TXT = "(SELECT doc_id AS ord, 'doc_' || doc_id || '.txt' AS relative_path, 'txt' AS file_type, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS size_bytes, 0 AS page_count, 0 AS image_count, 'utf-8' AS encoding, [0][:0] AS chars, false AS ignored FROM documents)"
_EXT = "(['txt','md','html','csv','json','pdf','exe','jpg'])[doc_id % 8 + 1]"
_MIXED = f"(SELECT doc_id AS ord, source || '/doc_' || doc_id || '.' || {_EXT} AS relative_path, 'doc_' || doc_id || '.' || {_EXT} AS name, {_EXT} AS file_type, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS size_bytes, CASE WHEN {_EXT} = 'pdf' THEN 1 ELSE 0 END AS page_count, CASE WHEN doc_id % 5 = 0 THEN (doc_id % 3)::INTEGER ELSE 0 END AS image_count, CASE WHEN {_EXT} IN ('txt','md','html','csv','json') THEN 'utf-8' END AS encoding, CASE WHEN {_EXT} = 'pdf' THEN [length(coalesce(text, ''))] ELSE [0][:0] END AS chars, {_EXT} IN ('exe','jpg') AS ignored, lang, source FROM documents)"
_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_BARE = rf"regexp_replace(text, '\A{_WHITE}|{_WHITE}\z', '', 'g')"
_LOW = f"(length({_BARE}) < 80 OR (len(chars) > 0 AND (list_sum(chars)::DOUBLE / len(chars) < 50 OR (image_count > 0 AND len(list_filter(chars, lambda x: x < 20))::DOUBLE / len(chars) >= 0.3))))"
_STATUS = f"CASE WHEN ignored THEN 'ignored' WHEN {_LOW} THEN 'low_text' WHEN image_count > 0 THEN 'images' ELSE 'ready' END"


def _header(tokens: str, margined: str) -> str:
    return f"""concat_ws(chr(10), '---', '## SOURCE: ' || relative_path, '- type: ' || file_type, '- taille_octets: ' || size_bytes, CASE WHEN page_count > 0 THEN '- pages_ou_diapos: ' || page_count END,
 '- tokens_estimes: ' || {tokens}, '- tokens_avec_marge: ' || {margined}, CASE WHEN image_count > 0 THEN '- images: ' || image_count END,
 CASE base_status WHEN 'images' THEN '- alerte: images' WHEN 'low_text' THEN '- alerte: peu_de_texte' END, CASE WHEN encoding <> '' THEN '- encodage: ' || encoding END, '---')"""


def _estimated(files: str, margin: float = 0.15) -> str:
    """CTEs up to ``est``: the fixed point in seven rounds."""
    rounds = "".join(
        f", r{i} AS (SELECT *, {_n(f'b{i - 1}')} AS t{i}, {_m(_n(f'b{i - 1}'), margin)} AS m{i}, fixed + length({_n(f'b{i - 1}')}::VARCHAR) + length({_m(_n(f'b{i - 1}'), margin)}::VARCHAR) AS b{i} FROM r{i - 1})"
        for i in range(1, 8)
    )
    return f"""WITH f AS (SELECT *, {_STATUS} AS base_status FROM {files}),
r0 AS (SELECT *, strlen({_header("''", "''")}) + 2 + strlen(text) AS fixed, strlen(text) AS b0 FROM f){rounds},
est AS (SELECT * EXCLUDE (ignored), CASE WHEN ignored THEN 0 ELSE b7 END::BIGINT AS bytes_utf8, CASE WHEN ignored THEN 0 ELSE {_n('b7')} END::BIGINT AS tokens_estimated, CASE WHEN ignored THEN 0 ELSE {_m(_n('b7'), margin)} END::BIGINT AS tokens_with_margin FROM r7)"""


def _txt(spark, sf, margin=0.15):
    return budget.with_estimate(budget.with_status(as_text_files(read(spark, sf, "documents"))), margin)


def _mixed(spark, sf, margin=0.15):
    return budget.with_estimate(budget.with_status(as_mixed_files(read(spark, sf, "documents"))), margin)


# --- estimates ---


@query(f"SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes_utf8, {_n('strlen(coalesce(text, chr(0)[:0]))')} AS tokens_estimated, {_m(_n('strlen(coalesce(text, chr(0)[:0]))'))} AS tokens_with_margin FROM documents".replace("chr(0)[:0]", "''"))
def token_estimate(spark, sf):
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    tokens = C.approx_tokens(size)
    return read(spark, sf, "documents").select("doc_id", size.alias("bytes_utf8"), tokens.alias("tokens_estimated"), C.with_margin(tokens).alias("tokens_with_margin"))


@query("SELECT doc_id, " + ", ".join(f"{_m('n_chars', m)} AS m{round(m * 100)}" for m in (0.0, 0.1, 0.2, 0.5)) + " FROM documents")
def token_margin_sweep(spark, sf):
    return read(spark, sf, "documents").select("doc_id", *(C.with_margin(F.col("n_chars"), m).alias(f"m{round(m * 100)}") for m in (0.0, 0.1, 0.2, 0.5)))


@query(_estimated(_TXT) + " SELECT ord AS doc_id, bytes_utf8, tokens_estimated, tokens_with_margin, tokens_with_margin > 8000 AS over_limit FROM est")
def source_context_estimate(spark, sf):
    return _txt(spark, sf).select(F.col("ord").alias("doc_id"), "bytes_utf8", "tokens_estimated", "tokens_with_margin", C.over_limit(F.col("tokens_with_margin"), 8000).alias("over_limit"))


@query(_estimated(_MIXED) + f" SELECT ord AS doc_id, {_header('tokens_estimated', 'tokens_with_margin')} AS header FROM est")
def source_header_text(spark, sf):
    return _mixed(spark, sf).select(F.col("ord").alias("doc_id"), C.source_header(F.col("tokens_estimated"), F.col("tokens_with_margin")).alias("header"))


@query(f"SELECT ord AS doc_id, {_LOW} AS low_text, length(text)::BIGINT AS text_length, strlen(text)::BIGINT AS text_bytes, image_count > 0 AS has_images FROM {_MIXED}")
def low_text_flag(spark, sf):
    f = as_mixed_files(read(spark, sf, "documents"))
    return f.select(F.col("ord").alias("doc_id"), C.low_text(F.col("text"), F.col("chars_per_page"), F.col("image_count")).alias("low_text"), F.length("text").cast("long").alias("text_length"), F.col("size_bytes").alias("text_bytes"), (F.col("image_count") > 0).alias("has_images"))


@query(f"SELECT ord AS doc_id, {_STATUS} AS base_status, {_STATUS} = 'images' AS is_warning, {_STATUS} = 'low_text' AS is_alert, {_STATUS} IN ('ready','images','low_text') AS is_extracted FROM {_MIXED}")
def file_status(spark, sf):
    s = F.col("base_status")
    return budget.with_status(as_mixed_files(read(spark, sf, "documents"))).select(F.col("ord").alias("doc_id"), s, C.is_warning(s).alias("is_warning"), C.is_alert(s).alias("is_alert"), C.is_extracted(s).alias("is_extracted"))


@query("""WITH p AS (SELECT conv_id, list(length(coalesce(text, '')) ORDER BY turn) AS c FROM conversations GROUP BY 1)
SELECT conv_id, len(c)::INTEGER AS pages, round(list_sum(c)::DOUBLE / len(c), 6) AS average, round(len(list_filter(c, lambda x: x < 20))::DOUBLE / len(c), 6) AS sparse_share FROM p""")
def sparse_page_stats(spark, sf):
    c = F.col("chars_per_page")
    return conversation_pages(read(spark, sf, "conversations")).select("conv_id", F.size(c).alias("pages"), F.round(C.page_average(c), 6).alias("average"), F.round(C.sparse_share(c), 6).alias("sparse_share"))


# --- budget ---


@query(_estimated(_TXT) + " SELECT ord AS doc_id, relative_path, tokens_with_margin FROM est WHERE tokens_with_margin > 8000")
def over_limit_files(spark, sf):
    return budget.blocked(_txt(spark, sf), 8000).where(F.col("status") == TOO_LARGE).select(F.col("ord").alias("doc_id"), "relative_path", "tokens_with_margin")


@query(_estimated(_MIXED) + f", s AS (SELECT count(*) AS n_files, sum(bytes_utf8)::BIGINT AS bytes_utf8 FROM est) SELECT n_files, bytes_utf8, {_n('bytes_utf8')} AS tokens_estimated, {_m(_n('bytes_utf8'))} AS tokens_with_margin FROM s")
def corpus_totals(spark, sf):
    return budget.corpus_totals(_mixed(spark, sf))


_DECIDE = f""", s AS (SELECT count(*) AS n_files, sum(bytes_utf8)::BIGINT AS bytes_utf8, count(*) FILTER (tokens_with_margin > {{0}} AND base_status IN ('ready','images','low_text')) AS n_blocking, arg_min(relative_path, ord) FILTER (tokens_with_margin > {{0}}) AS first_blocking, arg_min(tokens_with_margin, ord) FILTER (tokens_with_margin > {{0}}) AS first_tokens FROM est)
SELECT {{0}} AS context_limit, n_files, bytes_utf8, {_n('bytes_utf8')} AS tokens_estimated, {_m(_n('bytes_utf8'))} AS tokens_with_margin, n_blocking, first_blocking, first_tokens, {_m(_n('bytes_utf8'))} > {{0}} AS total_over, n_blocking > 0 OR {_m(_n('bytes_utf8'))} > {{0}} AS is_blocked FROM s"""


@query(_estimated(_TXT) + _DECIDE.format(8000))
def block_decision(spark, sf):
    return budget.decision(_txt(spark, sf), 8000).select(F.lit(8000).alias("context_limit"), "*")


@query(_estimated(_TXT) + " SELECT coalesce(string_agg(relative_path, ', ' ORDER BY ord), '') AS names FROM est WHERE tokens_with_margin > 4000")
def block_reason(spark, sf):
    over = budget.blocked(_txt(spark, sf), 4000).where(F.col("status") == TOO_LARGE)
    names = F.array_sort(F.collect_list(F.struct("ord", "relative_path")))
    return over.agg(F.array_join(F.transform(names, lambda x: x["relative_path"]), ", ").alias("names"))


@query(f"SELECT {_STATUS} AS base_status, count(*) AS n FROM {_MIXED} GROUP BY 1")
def status_counts(spark, sf):
    return budget.status_counts(budget.with_status(as_mixed_files(read(spark, sf, "documents"))))


_BLOCKED = "CASE WHEN tokens_with_margin > 1500 AND base_status IN ('ready','images','low_text') THEN 'too_large' ELSE base_status END"


@query(_estimated(_MIXED) + f", b AS (SELECT ord, {_BLOCKED} AS status FROM est) SELECT ord AS doc_id, status, CASE status WHEN 'ready' THEN 0 WHEN 'images' THEN 1 WHEN 'low_text' THEN 2 WHEN 'ignored' THEN 3 WHEN 'error' THEN 4 ELSE 5 END::INTEGER AS severity, CASE status WHEN 'ready' THEN '#22c55e' WHEN 'images' THEN '#eab308' WHEN 'low_text' THEN '#f97316' WHEN 'ignored' THEN '#9ca3af' ELSE '#ef4444' END AS colour FROM b")
def status_severity(spark, sf):
    b = budget.blocked(_mixed(spark, sf), 1500)
    return b.select(F.col("ord").alias("doc_id"), "status", C.severity(F.col("status")).alias("severity"), C.colour(F.col("status")).alias("colour"))


@query(_estimated(_TXT) + f", s AS (SELECT l AS context_limit, count(*) FILTER (tokens_with_margin > l) AS n_blocking, sum(bytes_utf8)::BIGINT AS b FROM est, (VALUES (8000), (128000), (1000000)) v(l) GROUP BY 1) SELECT context_limit, n_blocking, n_blocking > 0 OR {_m(_n('b'))} > context_limit AS is_blocked, CASE WHEN {_m(_n('b'))} >= context_limit THEN 'red' WHEN {_m(_n('b'))}::DOUBLE / context_limit >= 0.8 THEN 'orange' ELSE 'green' END AS gauge FROM s")
def recompute_limit(spark, sf):
    """One scan, whatever the number of limits."""
    rows = budget.decisions(budget.profile(_txt(spark, sf)), [8000, 128_000, 1_000_000])
    share = F.col("tokens_with_margin") / F.col("context_limit").cast("double")
    return rows.select(F.col("context_limit").cast("int").alias("context_limit"), "n_blocking", "is_blocked", F.when(share >= 1, "red").when(share >= 0.8, "orange").otherwise("green").alias("gauge"))


@query(_estimated(_TXT) + f", s AS (SELECT l AS context_limit, count(*) FILTER (tokens_with_margin > l) AS n_blocking, arg_min(relative_path, ord) FILTER (tokens_with_margin > l) AS first_blocking, sum(bytes_utf8)::BIGINT AS b FROM est, (SELECT unnest(range(500, 20500, 100)) AS l) GROUP BY 1) SELECT context_limit, n_blocking, first_blocking, n_blocking > 0 OR {_m(_n('b'))} > context_limit AS is_blocked FROM s")
def limit_sweep(spark, sf):
    """What two hundred limits would each decide, from one pass over the files."""
    return budget.decisions(budget.profile(_txt(spark, sf)), list(range(500, 20_500, 100))).select("context_limit", "n_blocking", "first_blocking", "is_blocked")


@query(_estimated(_TXT) + f", s AS (SELECT count(*) AS n_files, sum(bytes_utf8)::BIGINT AS bytes_utf8 FROM est WHERE ord NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT n_files, bytes_utf8, {_n('bytes_utf8')} AS tokens_estimated, {_m(_n('bytes_utf8'))} AS tokens_with_margin FROM s")
def recompute_removed(spark, sf):
    gone = read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("ord"))
    return budget.corpus_totals(_txt(spark, sf).join(gone, "ord", "left_anti"))


# --- inventory ---

_SPECIAL = " OR ".join(f"name GLOB '{p}'" for p in SPECIAL_FILES)
_NAMES = f"(SELECT doc_id, CASE doc_id % 16 WHEN 8 THEN '~$doc_' || doc_id || '.docx' WHEN 9 THEN 'Thumbs.db' WHEN 10 THEN 'x_rapport.md' WHEN 11 THEN 'NOTES.MD' WHEN 12 THEN 'tmp_' || doc_id || '.txt' WHEN 13 THEN '.bashrc' ELSE 'doc_' || doc_id || '.' || {_EXT} END AS name FROM documents)"


def _names(spark, sf):
    d = read(spark, sf, "documents")
    id = F.col("doc_id").cast("string")
    from ..sources.tables import virtual_extension

    odd = {8: F.concat(F.lit("~$doc_"), id, F.lit(".docx")), 9: F.lit("Thumbs.db"), 10: F.lit("x_rapport.md"), 11: F.lit("NOTES.MD"), 12: F.concat(F.lit("tmp_"), id, F.lit(".txt")), 13: F.lit(".bashrc")}
    name = F.concat(F.lit("doc_"), id, F.lit("."), virtual_extension(F.col("doc_id")))
    for k, v in odd.items():
        name = F.when(F.col("doc_id") % 16 == k, v).otherwise(name)
    return d.select("doc_id", name.alias("name"))


_SUFFIX = r"lower(regexp_extract(name, '.(\.[^.]+)$', 1))"
_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_REASON = f"CASE WHEN {_SPECIAL} THEN 'special' WHEN name GLOB 'tmp_*' THEN 'excluded' WHEN {_SUFFIX} NOT IN {_IN(EXTENSIONS)} AND {_SUFFIX} IN {_IN(IMAGE_EXTENSIONS)} THEN 'image' WHEN {_SUFFIX} NOT IN {_IN(EXTENSIONS)} THEN 'unsupported' END"


@query(f"SELECT doc_id, name, {_SUFFIX} AS ext FROM {_NAMES} WHERE {_SUFFIX} IN {_IN(EXTENSIONS)}")
def ext_whitelist(spark, sf):
    ext = C.suffix(F.col("name"))
    return _names(spark, sf).select("doc_id", "name", ext.alias("ext")).where(F.col("ext").isin(*EXTENSIONS))


@query(f"SELECT doc_id, name, {_REASON} AS reason FROM {_NAMES}")
def ignore_reason(spark, sf):
    return _names(spark, sf).select("doc_id", "name", C.ignore_reason(F.col("name"), exclude=("tmp_*",)).alias("reason"))


@query(f"SELECT doc_id, name FROM {_NAMES} WHERE NOT (name GLOB 'doc_*1?.*' OR name GLOB '*[02].txt')")
def exclude_glob(spark, sf):
    return _names(spark, sf).where(~C.matches_any(F.col("name"), ("doc_*1?.*", "*[02].txt")))


@query(f"SELECT doc_id, name FROM {_NAMES} WHERE {_SPECIAL}")
def special_ignore(spark, sf):
    return _names(spark, sf).where(C.matches_any(F.col("name"), SPECIAL_FILES))


@query(f"SELECT {_REASON} AS reason, count(*) AS n FROM {_NAMES} GROUP BY 1 HAVING {_REASON} IS NOT NULL".replace("GROUP BY 1 HAVING " + _REASON + " IS NOT NULL", f"WHERE {_REASON} IS NOT NULL GROUP BY 1"))
def ignored_rows(spark, sf):
    return inventory.split(_names(spark, sf), exclude=("tmp_*",))[1].groupBy(F.col("reason_code").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_NATURAL = "list_transform(regexp_extract_all(lower({0}), '([0-9]+|[^0-9]+)'), lambda x: {{'k': CASE WHEN x[1] BETWEEN '0' AND '9' THEN 1 ELSE 0 END, 's': CASE WHEN x[1] BETWEEN '0' AND '9' THEN '' ELSE x END, 'n': CASE WHEN x[1] BETWEEN '0' AND '9' THEN x::HUGEINT ELSE 0 END}})"


@query(f"SELECT ord AS doc_id, (row_number() OVER (ORDER BY {_NATURAL.format('relative_path')}, relative_path) - 1)::BIGINT AS ord FROM {_MIXED}")
def natural_sort_rank(spark, sf):
    f = as_mixed_files(read(spark, sf, "documents")).select(F.col("ord").alias("doc_id"), F.col("relative_path").alias("path"), "relative_path", "size_bytes")
    return inventory.ordinals(f, inventory.sort_order("name")).select("doc_id", "ord")


@query(f"SELECT ord AS doc_id, (row_number() OVER (ORDER BY file_type, {_NATURAL.format('relative_path')}, relative_path) - 1)::BIGINT AS ord FROM {_MIXED}")
def sort_type_rank(spark, sf):
    f = as_mixed_files(read(spark, sf, "documents")).select(F.col("ord").alias("doc_id"), F.col("relative_path").alias("path"), "relative_path", F.col("extension").alias("ext"))
    return inventory.ordinals(f, inventory.sort_order("type")).select("doc_id", "ord")


_DIGITS = "repeat('9', (30 + doc_id % 3 * 200)::INTEGER) || doc_id"


@query(f"SELECT doc_id, (row_number() OVER (ORDER BY doc_id % 7, length(n), n) - 1)::BIGINT AS ord FROM (SELECT doc_id, {_DIGITS} AS n FROM documents)")
def natural_sort_long_numbers(spark, sf):
    """Names with numbers of up to hundreds of digits."""
    digits = F.concat(F.repeat(F.lit("9"), (30 + F.col("doc_id") % 3 * 200).cast("int")), F.col("doc_id").cast("string"))
    path = F.concat(F.lit("F"), (F.col("doc_id") % 7).cast("string"), F.lit("x00"), digits)
    return inventory.ordinals(read(spark, sf, "documents").select("doc_id", path.alias("path"), path.alias("relative_path")), inventory.sort_order("name")).select("doc_id", "ord")


@query("SELECT event_id, (row_number() OVER (ORDER BY ts DESC, event_id::VARCHAR) - 1)::BIGINT AS ord FROM events")
def sort_mtime_rank(spark, sf):
    f = read(spark, sf, "events").select("event_id", F.col("ts").alias("mtime"), F.col("event_id").cast("string").alias("path"))
    return inventory.ordinals(f, inventory.sort_order("mtime")).select("event_id", "ord")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(coalesce(text, ''))")
def dedup_first_wins(spark, sf):
    """The first of equal texts; a grouped minimum, so a text with very many copies stays spread."""
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return read(spark, sf, "documents").groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'removed' ELSE 'kept' END AS side FROM documents")
def exclude_anti_join(spark, sf):
    d, gone = read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return d.join(gone, "doc_id", "left_anti").withColumn("side", F.lit("kept")).unionByName(d.join(gone, "doc_id", "left_semi").withColumn("side", F.lit("removed")))


@query("""SELECT key, min(source_idx)::INTEGER AS source_idx FROM (SELECT doc_id AS key, 0 AS source_idx FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT page_id, 2 FROM pages) GROUP BY 1""")
def multi_source_union(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("key"))
    parts = [d.where("key % 2 = 0"), d.where("key % 3 = 0"), read(spark, sf, "pages").select(F.col("page_id").alias("key"))]
    rows = [p.withColumn("source_idx", F.lit(i)).withColumn("path", F.col("key").cast("string")) for i, p in enumerate(parts)]
    return inventory.first_wins(rows[0].unionByName(rows[1]).unionByName(rows[2]), "key", [F.col("source_idx"), F.col("path")]).select("key", "source_idx")


@query("SELECT doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END::INTEGER AS source_idx, CASE WHEN doc_id % 2 = 0 THEN 'even' WHEN doc_id % 3 = 0 THEN 'third' ELSE 'all' END || '/' || doc_id AS path FROM documents")
def sources_first_wins(spark, sf):
    """Three sources that overlap, the last of which has every document: the first that has it gives the path."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("key"))
    rows = None
    for i, (name, part) in enumerate((("even", d.where("key % 2 = 0")), ("third", d.where("key % 3 = 0")), ("all", d))):
        part = part.withColumn("source_idx", F.lit(i)).withColumn("path", F.concat_ws("/", F.lit(name), F.col("key").cast("string")))
        rows = part if rows is None else rows.unionByName(part)
    return inventory.first_wins(rows, "key", [F.col("source_idx"), F.col("path")])


@query("""SELECT path, CASE WHEN path = min(path) OVER () THEN 'page.html' ELSE page_id || '/page.html' END AS relative_path
FROM (SELECT page_id, '/' || regexp_extract(url, '://([^/?#]*)', 1) || '/' || page_id || '/page.html' AS path FROM pages)""")
def unique_labels(spark, sf):
    """Labels of all pages, which have the same file name, made different by their folders."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    p = read(spark, sf, "pages").select(F.lit(0).alias("source_idx"), F.concat(F.lit("/"), host, F.lit("/"), F.col("page_id").cast("string"), F.lit("/page.html")).alias("path"), F.lit("page.html").alias("preferred"))
    return inventory.labelled(p).select("path", "relative_path")


@query("""SELECT '/a/' || page_id || '/Straße ' || page_id || '.txt' AS path, 'Straße ' || page_id || '.txt' AS relative_path FROM pages
UNION ALL SELECT '/b/' || page_id || '/STRASSE ' || page_id || '.TXT', page_id || '/STRASSE ' || page_id || '.TXT' FROM pages""")
def casefold_labels(spark, sf):
    """Two files for each page whose names differ in case alone, as case folding tells it."""
    id, rows = F.col("page_id").cast("string"), None
    for i, (folder, stem, end) in enumerate((("/a/", "Straße ", ".txt"), ("/b/", "STRASSE ", ".TXT"))):
        name = F.concat(F.lit(stem), id, F.lit(end))
        part = read(spark, sf, "pages").select(F.lit(i).alias("source_idx"), F.concat(F.lit(folder), id, F.lit("/"), name).alias("path"), name.alias("preferred"))
        rows = part if rows is None else rows.unionByName(part)
    return inventory.labelled(rows).select("path", "relative_path")


@query("""SELECT path, path || CASE WHEN r > 1 THEN ' (' || r || ')' ELSE '' END AS relative_path FROM (SELECT path, row_number() OVER (ORDER BY path) AS r FROM
(SELECT array_to_string(list_transform(range(24), lambda i: chr(((CASE WHEN (page_id >> i) & 1 = 1 THEN 65 ELSE 97 END) + i)::INTEGER)), '') AS path FROM pages))""")
def numbered_labels(spark, sf):
    """Files of one name, each in another case: all but the first need a number."""
    letter = lambda i: F.char(F.when(F.getbit("page_id", i) == 1, 65).otherwise(97) + i)
    name = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(23)), letter), "")
    return inventory.labelled(read(spark, sf, "pages").select(F.lit(0).alias("source_idx"), name.alias("path"), name.alias("preferred"))).select("path", "relative_path")


@query("""SELECT (before // 65536)::INTEGER AS task, count(*) AS files, sum(size)::BIGINT AS bytes FROM
(SELECT size, sum(size) OVER (ORDER BY doc_id) - size AS before FROM (SELECT doc_id, greatest(strlen(coalesce(text, '')), 1) AS size FROM documents)) GROUP BY 1""")
def task_packing(spark, sf):
    """Which task reads which file: cuts of the running sum of sizes."""
    f = as_text_files(read(spark, sf, "documents")).select("ord", F.greatest("size_bytes", F.lit(1).cast("long")).alias("size"))
    rows = prefix.running_sums(f, [F.col("ord")], F.col("size"))
    return rows.groupBy(F.floor(F.col("before") / 65536).cast("int").alias("task")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(f"SELECT source || '/' || doc_id % 5 || '/' || name AS relative, 2 AS depth, size_bytes::BIGINT AS size_bytes FROM {_MIXED.replace('SELECT doc_id AS ord,', 'SELECT doc_id, doc_id AS ord,', 1)}")
def folder_listing(spark, sf):
    """A folder tree made of all documents, listed: a folder for each source, five in each."""
    f = as_mixed_files(read(spark, sf, "documents"))
    relative = F.concat_ws("/", "source", (F.col("ord") % 5).cast("string"), "name")
    root = folders.write_tree(f.select(relative.alias("relative"), F.col("text").cast("binary").alias("raw")))
    return folders.list_folder(spark, root).select("relative", "depth", "size_bytes")


# --- folders made of all documents ---

_PLACE = "CASE WHEN doc_id % 10 = 9 THEN source || '/__pycache__/' WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN source || '/' WHEN doc_id % 4 = 2 THEN source || '/sub/' ELSE source || '/sub/deep/' END"
_TREE = f"(SELECT *, {_PLACE} || name AS relative, len(string_split({_PLACE}, '/')) - 1 AS depth, doc_id % 10 = 9 AS pruned FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS size, 'doc_' || doc_id || '.' || {_EXT} AS name FROM documents))"


def _placed(spark, sf):
    """relative, raw: every document as a file, in folders up to three deep, some of which are never read."""
    f = as_mixed_files(read(spark, sf, "documents"))
    id, source = F.col("ord"), F.coalesce("source", F.lit(""))
    place = F.when(id % 4 == 0, F.lit("")).when(id % 4 == 1, F.concat(source, F.lit("/"))).when(id % 4 == 2, F.concat(source, F.lit("/sub/"))).otherwise(F.concat(source, F.lit("/sub/deep/")))
    place = F.when(id % 10 == 9, F.concat(source, F.lit("/__pycache__/"))).otherwise(place)
    return f.select(F.concat(place, "name").alias("relative"), F.col("text").cast("binary").alias("raw"))


@query(f"SELECT relative, depth::INTEGER AS depth, size::BIGINT AS size_bytes FROM {_TREE} WHERE NOT pruned AND depth <= 1")
def folder_depth_limit(spark, sf):
    return folders.list_folder(spark, folders.write_tree(_placed(spark, sf)), max_depth=1).select("relative", "depth", "size_bytes")


@query(f"SELECT name, size::BIGINT AS size_bytes FROM {_TREE} WHERE depth = 0")
def folder_flat(spark, sf):
    return folders.list_folder(spark, folders.write_tree(_placed(spark, sf)), recursive=False).select("name", "size_bytes")


@query(f"SELECT relative, depth::INTEGER AS depth FROM {_TREE} WHERE NOT pruned AND (name LIKE '%.md' OR depth = 3)")
def folder_pruned(spark, sf):
    """Folders that are never read are passed over, and a condition on names and depth comes before any file is asked for."""
    return folders.list_folder(spark, folders.write_tree(_placed(spark, sf)), where="name LIKE '%.md' OR depth = 3").select("relative", "depth")


@query(f"SELECT relative AS relative_path, CASE WHEN {_SUFFIX} IN {_IN(EXTENSIONS)} THEN 'read' WHEN {_SUFFIX} IN {_IN(IMAGE_EXTENSIONS)} THEN 'image' ELSE 'unsupported' END AS fate FROM {_TREE} WHERE NOT pruned")
def folder_inventory(spark, sf):
    """What of a folder is read, and why the rest is not."""
    root = folders.write_tree(_placed(spark, sf))
    files, out = inventory.collect_inputs(spark, root)
    return files.select("relative_path", F.lit("read").alias("fate")).unionByName(out.select(F.substring("path", len(root) + 2, 10**6).alias("relative_path"), F.col("reason_code").alias("fate")))


@query(f"SELECT relative, greatest(ceil(size / 4096.0), 1)::BIGINT AS parts, size::BIGINT AS bytes, md5(text) AS digest FROM {_TREE} WHERE NOT pruned")
def range_read(spark, sf):
    """Files read in ranges of four kilobytes by many tasks, and put together again."""
    root = folders.write_tree(_placed(spark, sf))
    parts = extraction.read_ranges(folders.list_folder(spark, root), 4096, shared=True)
    whole = parts.groupBy("path").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.octet_length("raw")).alias("bytes"), F.array_sort(F.collect_list(F.struct("part", F.hex("raw").alias("h")))).alias("p"))
    raw = F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), ""))
    return whole.select(F.substring("path", len(root) + 2, 10**6).alias("relative"), "parts", F.col("bytes").cast("long").alias("bytes"), F.md5(raw).alias("digest"))


_ON_DISK = _TXT.replace("'doc_' || doc_id || '.txt' AS relative_path", "coalesce(source, '') || '/doc_' || doc_id || '.txt' AS relative_path")


@query(_estimated(_ON_DISK) + f" SELECT relative_path, {_BLOCKED} AS status, bytes_utf8, tokens_estimated, tokens_with_margin FROM est")
def analyse_folder(spark, sf):
    """The whole analysis of a folder that holds every document as a text file."""
    from .analysis import run_analysis

    d = read(spark, sf, "documents")
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    root = folders.write_tree(d.select(name.alias("relative"), F.coalesce("text", F.lit("")).cast("binary").alias("raw")))
    return run_analysis(spark, root, context_limit=1500).files.select("relative_path", "status", "bytes_utf8", "tokens_estimated", "tokens_with_margin")


# --- corpus and reports ---

_TICKED = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a ' || repeat('`', (doc_id % 7)::INTEGER) || ' b' || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM documents)"


@query(f"""SELECT doc_id, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0))::BIGINT) AS fence, contains(text, '```') AS fenced FROM {_TICKED}""")
def adaptive_fence(spark, sf):
    d = read(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    ticked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a "), F.repeat(F.lit("`"), (F.col("doc_id") % 7).cast("int")), F.lit(" b"), text)).otherwise(text)
    return d.select("doc_id", ticked.alias("text")).select("doc_id", C.fence(F.col("text")).alias("fence"), F.contains("text", F.lit("```")).alias("fenced"))


_BLOCK = f"{_header('tokens_estimated', 'tokens_with_margin')} || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10)"


@query(_estimated(_MIXED) + f" SELECT ord, {_BLOCK} AS block FROM est WHERE base_status <> 'ignored' AND tokens_with_margin <= 128000")
def corpus_blocks(spark, sf):
    return assembly.corpus_blocks(budget.blocked(_mixed(spark, sf)))


@query(_estimated(_MIXED) + f", b AS (SELECT ord, strlen({_BLOCK}) AS size FROM est WHERE base_status <> 'ignored' AND tokens_with_margin <= 128000) SELECT ord, size::BIGINT AS size, (sum(size) OVER (ORDER BY ord) - size)::BIGINT AS place FROM b")
def corpus_places(spark, sf):
    """Where each block stands in the one file of the corpus."""
    sizes = corpus_blocks(spark, sf).select("ord", F.octet_length("block").cast("long").alias("size"))
    return prefix.running_sums(sizes, [F.col("ord")], F.col("size"), "place").select("ord", "size", "place")


@query(_estimated(_MIXED) + " SELECT lang, count(*) AS n_files, sum(tokens_with_margin)::BIGINT AS tokens, sum(strlen(text))::BIGINT AS bytes FROM est WHERE base_status <> 'ignored' GROUP BY 1")
def corpus_by_lang(spark, sf):
    return _mixed(spark, sf).where(C.is_extracted(F.col("base_status"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"), F.sum("tokens_with_margin").alias("tokens"), F.sum("size_bytes").alias("bytes"))


@query(_estimated(_MIXED) + ", l AS (SELECT * FROM est) SELECT ord, '| ' || relative_path || ' | ' || file_type || ' | ' || replace(format('{:,}', tokens_estimated), ',', chr(160)) || ' | ' || replace(format('{:,}', tokens_with_margin), ',', chr(160)) || ' | ' || CASE base_status WHEN 'ready' THEN 'Prêt' WHEN 'images' THEN 'Images' WHEN 'low_text' THEN 'Peu de texte' ELSE 'Ignoré' END || ' |' AS row, length(text)::INTEGER AS text_length FROM l")
def report_rows(spark, sf):
    return assembly.report_rows(budget.blocked(_mixed(spark, sf), 10**12)).select("ord", "row", "text_length")


@query(_estimated(_MIXED) + """ SELECT ord, '{"relative_path":"' || relative_path || '","extension":"' || file_type || '","file_type":"' || file_type || '","size_bytes":' || size_bytes || ',"text_length":' || length(text) || ',"status":"' || base_status
|| '","image_count":' || image_count || ',"page_count":' || page_count || ',"encoding":' || CASE WHEN encoding IS NULL THEN 'null' ELSE '"' || encoding || '"' END || ',"chars_per_page":[' || array_to_string(chars, ',') || '],"tokens_estimated":' || tokens_estimated || ',"tokens_with_margin":' || tokens_with_margin || '}' AS json FROM est""")
def report_json(spark, sf):
    """Each file of the JSON report: all that is known of it but its text."""
    return assembly.file_json(assembly.report_rows(budget.blocked(_mixed(spark, sf), 10**12)))


@query("SELECT doc_id, replace(format('{:,}', n_chars * 1000), ',', chr(160)) AS fr, format('{:,}', n_chars * 1000) AS en FROM documents")
def number_format(spark, sf):
    n = F.col("n_chars") * 1000
    return read(spark, sf, "documents").select("doc_id", C.format_number(n, "fr").alias("fr"), C.format_number(n, "en").alias("en"))


@query("SELECT doc_id, replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def xml_escape(spark, sf):
    return read(spark, sf, "documents").select("doc_id", C.xml_escape(F.coalesce("text", F.lit(""))).alias("escaped"))


# --- readers over table columns ---


def _read_column(df: DataFrame, id: str, content, extension: str) -> DataFrame:
    """The reader for ``extension`` over a column of bytes."""
    return formats.read_back(df.select(id, content.cast("binary").alias("raw")), id, extension, None, ("raw",))


@query()
def html_extract(spark, sf):
    p = read(spark, sf, "pages")
    return _read_column(p, "page_id", F.coalesce("html", F.lit("")), ".html").select(F.col("id").alias("page_id"), "text", "image_count")


@query("SELECT page_id, len(regexp_extract_all(html, '<img[ >/]'))::INTEGER AS image_count FROM pages")
def html_image_count(spark, sf):
    """The images that the reader finds."""
    return html_extract(spark, sf).select("page_id", "image_count")


@query("""SELECT event_id AS id, '{' || chr(10) || '  "k": ' || regexp_extract(props, '([0-9]+)', 1) || chr(10) || '}' AS text FROM events""")
def json_pretty(spark, sf):
    return _read_column(read(spark, sf, "events"), "event_id", F.col("props"), ".json").select("id", "text")


@query("SELECT n_nationkey::BIGINT AS id, 'key | name | region' || chr(10) || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey AS text FROM nation")
def csv_join_text(spark, sf):
    raw = F.concat(F.lit("key;name;region\n"), F.concat_ws(";", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")))
    return _read_column(read(spark, sf, "nation"), "n_nationkey", raw, ".csv").select("id", "text")


@query("SELECT conv_id * 100 + turn AS id, '**Sujet** : ' || role || chr(10) || '**De** : a@example.org' || chr(10) || chr(10) || replace(coalesce(text, ''), chr(13), '') || chr(10) AS text FROM conversations")
def eml_extract(spark, sf):
    c = read(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    raw = F.concat(F.lit("Subject: "), F.col("role"), F.lit("\nFrom: a@example.org\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "\r", ""), F.lit("\n"))
    return _read_column(c, "id", raw, ".eml").select("id", "text")


@query("SELECT r_regionkey::BIGINT AS id, '<region>' || chr(10) || '  <key>' || r_regionkey || '</key>' || chr(10) || '  <name>' || r_name || '</name>' || chr(10) || '</region>' AS text FROM region")
def xml_pretty(spark, sf):
    raw = F.concat(F.lit("<?xml version='1.0'?><!-- c --><region><key>"), F.col("r_regionkey").cast("string"), F.lit("</key><name>"), F.col("r_name"), F.lit("</name></region>"))
    return _read_column(read(spark, sf, "region"), "r_regionkey", raw, ".xml").select("id", "text")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 1 THEN 'utf-16' WHEN doc_id % 3 = 2 THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding, coalesce(text, '') AS text FROM documents")
def encoding_detect(spark, sf):
    """Texts in three encodings, told and decoded by expressions."""
    text = F.coalesce("text", F.lit(""))
    kind = F.col("doc_id") % 3
    raw = F.when(kind == 1, F.encode(text, "UTF-16")).when(kind == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).otherwise(F.encode(text, "UTF-8"))
    raw = F.when((kind == 1) & (text == ""), F.unhex(F.lit("FEFF"))).otherwise(raw)
    return decoding.decoded(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), raw.alias("raw")))


@query(r"""SELECT doc_id AS id, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'cp1252' ELSE 'utf-8' END AS encoding, text FROM
(SELECT doc_id, '€' || regexp_replace(coalesce(text, ''), '[^\x00-\x7F\xA0-\xBF]', 'é', 'g') || '”' AS text FROM documents)""")
def encoding_cp1252(spark, sf):
    """Texts in Windows-1252, with signs that Latin-1 does not have."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F\xA0-\xBF]", "é")
    raw = F.concat(F.unhex(F.lit("80")), F.encode(text, "ISO-8859-1"), F.unhex(F.lit("94")))
    return decoding.decoded(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), raw.alias("raw")))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'error' ELSE 'ready' END AS status FROM documents")
def error_rows(spark, sf):
    """Every second file is malformed; none stops the others."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.lit("{broken")).otherwise(F.lit('{"k": 1}'))
    return _read_column(read(spark, sf, "documents"), "doc_id", raw, ".json").select("id", "status")
