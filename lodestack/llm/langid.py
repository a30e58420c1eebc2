"""Operator 1, language ID: Bayesian evidence fusion.

Four kinds of evidence are added up as log probabilities for each language:

* the text: a naive-Bayes likelihood of hashed byte trigrams, tempered to an
  effective number of independent trigrams;
* the language declared in the markup, right with probability ``DECLARED``;
* the country suffix of the address, in the language of the country with
  probability ``SUFFIX``;
* a prior of the host: grouped sums of the text's posteriors by host, smoothed
  toward those of the host's domain, which are smoothed toward those of all rows; a
  row's own posterior is taken out of its host's sum.

The trigram model is trained on about ``TRAINING`` labelled documents at most (the
documented bound), picked by the hash of their id; host priors and decisions cover
all rows and whole texts.

Defined results: a text without letters (null and empty ones too) gives no
evidence; its language is "und" and it is not accepted; ties go to the first
language in the alphabet; a text of any length counts whole; rows without a host
share the host ""; without labelled documents all rows are "und"; repeated rows get
equal results in a row each; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .bytescan import text_blocks
from .sampling import sampled
from .scratch import Scratch, checkpointed
from .skew import few

BUCKETS = 1 << 16
TRAINING = 20_000
#: Bytes of a long text that are looked at together.
PIECE = 1 << 19
#: Trigrams overlap and words repeat: at most so many count as independent, a third of those seen below that.
EFFECTIVE = 120.0
DECLARED, SUFFIX, SMOOTH, ACCEPT = 0.9, 0.7, 10.0, 0.5

# Country suffixes of addresses and the language most pages there are in.
COUNTRY = {"ar": "es", "at": "de", "be": "fr", "ch": "de", "cl": "es", "co": "es", "de": "de", "es": "es", "fr": "fr", "ie": "en", "mx": "es", "nz": "en", "pe": "es", "uk": "en", "us": "en"}

_LETTERS = np.full(256, 0x20, dtype=np.uint32)
for _b in range(256):
    if _b >= 128 or chr(_b).isalpha():
        _LETTERS[_b] = ord(chr(_b).lower()) if _b < 128 else _b


@dataclass(frozen=True)
class Model:
    """Log probabilities of the buckets, a column per language (in alphabetical order)."""

    languages: tuple[str, ...]
    table: np.ndarray


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte, and where it counts (inside one text, with a letter in its middle)."""
    codes = _LETTERS[raw]
    n = len(codes)
    bucket = np.zeros(n, dtype=np.uint32)
    counts = np.zeros(n, dtype=bool)
    if n > 2:
        h = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
        bucket[:-2] = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
        counts[:-2] = codes[1:-1] != 0x20
    ends = offsets[1:]
    for back in (1, 2):
        at = ends - back
        counts[at[at >= 0]] = False
    return bucket, counts


def pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes and offsets as they are, or, of one long text, parts that share two bytes: each trigram is in one of them."""
    if len(offsets) != 2 or len(raw) <= PIECE + 2:
        yield raw, offsets
        return
    for at in range(0, len(raw) - 2, PIECE):
        part = raw[at : at + PIECE + 2]
        yield part, np.array([0, len(part)])


def train(docs: DataFrame, most: int = TRAINING) -> Model:
    """``docs``: text, lang and an id to pick by."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    picked = sampled(known, F.xxhash64("doc_id", F.lit(5)), most).select("lang", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for start, end, raw, offsets in text_blocks(batch.column(1)):
                langs = batch.column(0)[start:end].to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs])
                for piece, cuts in pieces(raw, offsets):
                    bucket, counts = trigrams(piece, cuts)
                    owner = np.repeat(np.arange(end - start), np.diff(cuts))
                    for i, name in enumerate(names):
                        mine = bucket[counts & (number[owner] == i)]
                        sums[name] = sums.get(name, 0) + np.bincount(mine, minlength=BUCKETS)
        for name, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["lang", "bucket", "n"])

    ship(docs.sparkSession)
    rows = picked.mapInArrow(work, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = tuple(sorted(rows["lang"].unique()))
    table = np.full((BUCKETS, len(languages)), 0.1)
    for i, name in enumerate(languages):
        mine = rows[rows["lang"] == name]
        table[mine["bucket"].to_numpy(), i] += mine["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def likelihoods(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` without its text, with _letters (trigrams seen), _ll (tempered log likelihoods by language) and _own (their softmax; zeros if no trigram was seen)."""
    others = [c for c in df.columns if c != text]
    table, width = model.table, max(1, len(model.languages))
    columns = [np.ascontiguousarray(table[:, i]) for i in range(table.shape[1])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, raw, offsets in text_blocks(batch.column(len(others))):
                seen, ll = np.zeros(end - start), np.zeros((end - start, width))
                for piece, cuts in pieces(raw, offsets):
                    bucket, counts = trigrams(piece, cuts)
                    total = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)])[cuts])  # noqa: B023, E731
                    seen += total(counts)
                    for i, column in enumerate(columns):
                        ll[:, i] += total(np.where(counts, column[bucket], 0))
                ll *= (np.minimum(seen / 3, EFFECTIVE) / np.maximum(seen, 1))[:, None]
                ll = np.round(ll - ll.max(axis=1, keepdims=True), 9)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (end - start + 1) * width, width), pa.int32()), pa.array(ll.ravel()))
                own = np.exp(ll)
                own *= ((seen > 0) / own.sum(axis=1))[:, None]
                owns = pa.ListArray.from_arrays(lists.offsets, pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[start:end] for i in range(len(others))), pa.array(seen.astype(np.int64)), lists, owns], names=[*others, "_letters", "_ll", "_own"])

    ship(df.sparkSession)
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*others).dtypes)
    return df.select(*others, text).mapInArrow(work, f"{kinds}, _letters long, _ll array<double>, _own array<double>")


def fuse(rows: DataFrame, model: Model, scratch: Scratch, accept: float = ACCEPT) -> DataFrame:
    """Adds lang, posterior and accepted to rows of ``likelihoods`` that have _host and _declared."""
    names = model.languages
    given = [c for c in rows.columns if c not in ("_ll", "_own", "_letters")]
    if not names:
        return rows.withColumn("lang", F.lit("und")).withColumn("posterior", F.lit(0.0)).withColumn("accepted", F.lit(False)).select(*given, "lang", "posterior", "accepted")
    suffix = F.regexp_extract("_host", r"\.([^.]+)$", 1)
    rows = rows.withColumn("_domain", F.regexp_extract("_host", r"([^.]*(\.[^.]*)?)$", 1)).withColumn("_seen", (F.col("_letters") > 0).cast("double"))
    hosts = rows.groupBy("_host", "_domain").agg(F.sum("_seen").alias("_hn"), *(F.sum(F.col("_own")[i]).alias(f"_h{i}") for i in range(len(names))))
    hosts = scratch.save(hosts, "hosts")
    domains = scratch.save(hosts.groupBy("_domain").agg(F.sum("_hn").alias("_dn"), *(F.sum(f"_h{i}").alias(f"_d{i}") for i in range(len(names)))), "domains")
    every = domains.agg(F.sum("_dn").alias("n"), *(F.sum(f"_d{i}").alias(f"g{i}") for i in range(len(names)))).first()
    world = [((every[f"g{i}"] or 0.0) + 1.0) / ((every["n"] or 0.0) + len(names)) for i in range(len(names))]
    hosts = scratch.save(hosts.join(few(domains), "_domain"), "priors").drop("_domain")
    # Saved, so that both sides of the join are plain exchanges: Spark splits a host that holds many rows.
    rows = rows.drop("_domain").join(few(hosts), "_host")
    parts = []
    for i, name in enumerate(names):
        domain = (F.col(f"_d{i}") - F.col("_own")[i] + SMOOTH * world[i]) / (F.col("_dn") - F.col("_seen") + SMOOTH)
        host = (F.col(f"_h{i}") - F.col("_own")[i] + SMOOTH * domain) / (F.col("_hn") - F.col("_seen") + SMOOTH)
        part = F.col("_ll")[i] + F.log(F.greatest(host, F.lit(1e-9)))
        for said, trust in ((F.when(F.col("_declared").isin(*names), F.col("_declared")), DECLARED), (_country(suffix, names), SUFFIX)):
            wrong = (1 - trust) / max(1, len(names) - 1)
            part = part + F.when(said.isNull(), 0.0).when(said == name, float(np.log(trust))).otherwise(float(np.log(max(wrong, 1e-9))))
        parts.append(part)
    for i, p in enumerate(parts):
        rows = rows.withColumn(f"_part{i}", p)
    best = F.lit(names[-1])
    top = F.greatest(*(F.col(f"_part{i}") for i in range(len(names)))) if len(names) > 1 else F.col("_part0")
    for i in reversed(range(len(names) - 1)):
        best = F.when(F.col(f"_part{i}") == top, names[i]).otherwise(best)
    sure = F.lit(1.0) / sum((F.exp(F.col(f"_part{i}") - top) for i in range(1, len(names))), F.exp(F.col("_part0") - top))
    rows = rows.withColumn("lang", F.when(F.col("_seen") > 0, best).otherwise("und")).withColumn("posterior", F.round(F.when(F.col("_seen") > 0, sure).otherwise(0.0), 6))
    return rows.withColumn("accepted", (F.col("_seen") > 0) & (F.col("posterior") >= accept)).select(*given, "lang", "posterior", "accepted")


def _country(suffix: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("string")
    for country, language in COUNTRY.items():
        if language in names:
            out = F.when(suffix == country, language).otherwise(out)
    return out


def markup_text(html: Column) -> Column:
    """What stands between the tags, scripts and styles left out."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>|&[a-z#0-9]+;", " ")


def declared_in(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))


def identify(docs: DataFrame | None, pages: DataFrame | None, model: Model, accept: float = ACCEPT) -> DataFrame:
    """doc_id, page_id, host, declared, lang, posterior, accepted for every document and page (one id is null)."""
    from .urls import host_of

    parts = []
    if docs is not None:
        parts.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host"), F.lit("").alias("_declared"), F.col("text").cast("string").alias("text")))
    if pages is not None:
        html = F.coalesce(F.col("html").cast("string"), F.lit(""))
        parts.append(pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url").cast("string")).alias("_host"), declared_in(html).alias("_declared"), markup_text(html).alias("text")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    with Scratch(rows.sparkSession) as scratch:
        evidence = scratch.save(likelihoods(rows, model), "evidence")
        out = fuse(evidence, model, scratch, accept)
        return checkpointed(out.select("doc_id", "page_id", F.col("_host").alias("host"), F.when(F.col("_declared") != "", F.col("_declared")).alias("declared"), "lang", "posterior", "accepted"))


def accepted_documents(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """``docs`` (its own columns) without the rows whose language stays in doubt.

    A row is known by its id and text, so rows with equal ids are judged apart.
    """
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), key.alias("_key"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host"), F.lit("").alias("_declared"), F.col("text").cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        evidence = scratch.save(likelihoods(rows, model), "evidence")
        bad = checkpointed(fuse(evidence, model, scratch, accept).where(~F.col("accepted")).select("_id", "_key").distinct())
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), key.alias("_mine"))
    out = keyed.join(few(bad), keyed["_doc"].eqNullSafe(bad["_id"]) & (keyed["_mine"] == bad["_key"]), "left_anti")
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
