"""Operator 13, vector code compression: product quantisation by Yinyang Lloyd.

Vectors of integers are cut into ``PARTS`` equal parts, each with a codebook of ``ENTRIES``
entries; a vector's code is the nearest entry of each part.  Lloyd's rounds assign and
average.  Each part's entries are clustered into ``GROUPS`` groups.  A row keeps, for each
part, an upper bound of the distance to its entry and one lower bound for each group: the
distance to the group's nearest other entry.  When entries move, the upper bound grows by
the own entry's drift and a group's lower bound shrinks by its largest drift.  Where the
upper bound stays under all lower bounds nothing is computed; else it is made exact, and
only the groups whose lower bound is not above it are scanned.  Bounds are rounded outward;
what decides, ties included, are squared distances of integers.

A round is one pass over the rows, which carry their bounds in a table of the shared folder,
so a lost executor costs a task.  Tasks send on what the rows that changed their entry take
from its sum and bring to another, added up over the task; Spark adds these up to a few
numbers for each entry, whatever the number of rows.

Defined results: rows whose vector is null or holds a null, a NaN or an infinite component
go; shorter vectors count as if they ended in zeros, as long as the longest and a multiple
of ``PARTS``; components beyond ``_limit`` are taken as that limit, so that all distances
are exact; rows without an id are coded, and start a codebook only where there are not
enough ids; equal ids start it in the order of their vectors, each row for itself; with
fewer rows than entries there are as many entries as rows; repeated rows count as often as
they stand there and get a row each; an empty table, or one without a usable vector, gives an
empty one; only id, vector and label are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .scratch import Scratch, checkpointed
from .skew import FEW_ROWS, salted_join

SCALE, PARTS, ENTRIES, ROUNDS, GROUPS = 4096, 8, 16, 6, 4
ROWS = "vec_id long, label long, vec array<int>, state binary, slot int, value long"


def _limit(width: int) -> int:
    """The largest component for which squared distances of parts stay exact as doubles."""
    return min((1 << 30) - 1, math.isqrt((1 << 51) // max(1, width)) // 2)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def whole_numbers(vector: Column, scale: int, size: int, limit: int) -> Column:
    """floor(scale * x) for each component, within the limit, with zeros up to ``size``."""
    low, high = F.lit(float(-limit)), F.lit(float(limit))
    numbers = F.transform(vector, lambda x: F.floor(F.greatest(low, F.least(high, x.cast("double") * scale))).cast("int"))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), size)), 1, size) if size else numbers


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to the entries, both whole numbers as doubles."""
    return (x * x).sum(1)[:, None] + (entries * entries).sum(1)[None] - 2 * (x @ entries.T)


def grouped(entries: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of each entry of one part: a few rounds of averaging, from evenly spaced entries."""
    groups = min(groups, len(entries))
    centres = entries[np.arange(groups) * len(entries) // groups].astype(float)
    for _ in range(5):
        group = squares(entries.astype(float), centres).argmin(1)
        for g in range(groups):
            if (group == g).any():
                centres[g] = entries[group == g].mean(0)
    return group


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf))


class Bounds:
    """Entry, upper bound and the groups' lower bounds of one part, for the rows of a batch."""

    def __init__(self, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.entry, self.upper, self.lower = entry, upper, lower


def first_bounds(x: np.ndarray, entries: np.ndarray, group: np.ndarray) -> Bounds:
    far = squares(x, entries)
    entry = far.argmin(1)
    row = np.arange(len(x))
    best = far[row, entry]
    far[row, entry] = np.inf
    lower = np.stack([far[:, group == g].min(1, initial=np.inf) for g in range(group.max() + 1)], 1)
    return Bounds(entry, _up(np.sqrt(best)), _down(np.sqrt(lower)))


def moved_bounds(x: np.ndarray, entries: np.ndarray, group: np.ndarray, drift: np.ndarray, b: Bounds) -> int:
    """Brings the bounds of a part up to date after its entries have drifted; the number of squared distances computed."""
    groups = range(group.max() + 1)
    upper = _up(b.upper.astype(float) + drift[b.entry])
    lower = _down(b.lower.astype(float) - np.array([drift[group == g].max(initial=0) for g in groups]))
    b.upper, b.lower = upper, lower
    open_rows = np.flatnonzero(upper >= lower.min(1))
    if not len(open_rows):
        return 0
    own = ((x[open_rows] - entries[b.entry[open_rows]]) ** 2).sum(1)
    b.upper[open_rows] = _up(np.sqrt(own))
    still = b.upper[open_rows] >= lower[open_rows].min(1)
    open_rows, own, done = open_rows[still], own[still], len(open_rows)
    best, entry = own.copy(), b.entry[open_rows].copy()
    scans = []
    for g in groups:
        hit = np.flatnonzero(lower[open_rows, g] <= b.upper[open_rows])
        members = np.flatnonzero(group == g)
        if not len(hit) or not len(members):
            continue
        far = squares(x[open_rows[hit]], entries[members])
        done += far.size
        at = far.argmin(1)
        least, name = far[np.arange(len(hit)), at], members[at]
        nearer = (least < best[hit]) | ((least == best[hit]) & (name < entry[hit]))
        best[hit] = np.where(nearer, least, best[hit])
        entry[hit] = np.where(nearer, name, entry[hit])
        scans.append((g, hit, members, far))
    for g, hit, members, far in scans:
        b.lower[open_rows[hit], g] = _down(np.sqrt(np.where(members[None] == entry[hit][:, None], np.inf, far).min(1)))
    # The entry that a row has left belongs to a group's others now.
    left = np.flatnonzero(entry != b.entry[open_rows])
    rows, old = open_rows[left], group[b.entry[open_rows[left]]]
    b.lower[rows, old] = np.minimum(b.lower[rows, old], _down(np.sqrt(own[left])))
    b.entry[open_rows], b.upper[open_rows] = entry, _up(np.sqrt(best))
    return done


def _packed(parts: list[Bounds]) -> pa.Array:
    """One binary value for each row: entries, upper and lower bounds of all parts."""
    entry = np.stack([b.entry for b in parts], 1).astype(np.uint8)
    bounds = np.concatenate([np.stack([b.upper for b in parts], 1), *(b.lower for b in parts)], 1).astype("<f4")
    raw = np.concatenate([entry, np.ascontiguousarray(bounds).view(np.uint8)], 1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1]), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def _unpacked(column: pa.Array, groups: list[int]) -> list[Bounds]:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    entry = raw[:, :PARTS].astype(np.int64)
    bounds = np.ascontiguousarray(raw[:, PARTS:]).view("<f4")
    out, at = [], PARTS
    for p, n in enumerate(groups):
        out.append(Bounds(entry[:, p].copy(), bounds[:, p].copy(), bounds[:, at : at + n].copy()))
        at += n
    return out


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def assigned(rows: DataFrame, books: np.ndarray, before: np.ndarray | None, groups: list[np.ndarray]) -> DataFrame:
    """The rows with their bounds for ``books``, and rows (slot, value) of what each task's changes add to the sums.

    ``books``: part, entry, component; ``before``: the books for which the rows' bounds hold, None for none.
    A slot is a component of an entry, or its number of rows.
    """
    parts, entries, width = books.shape
    now = books.astype(np.float64)
    # A little more than the drift: it is a bound.
    drift = None if before is None else np.sqrt(((books - before).astype(float) ** 2).sum(2)) * (1 + 1e-12)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = _matrix(batch.column(2), parts * width)
            known = None if before is None else _unpacked(batch.column(3), [g.max() + 1 for g in groups])
            found = []
            for p in range(parts):
                own = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                if known is None:
                    b, changed, old = first_bounds(own, now[p], groups[p]), np.arange(n), None
                else:
                    b, old = known[p], known[p].entry.copy()
                    moved_bounds(own, now[p], groups[p], drift[p], b)
                    changed = np.flatnonzero(old != b.entry)
                counted = np.column_stack([own[changed], np.ones(len(changed))]).astype(np.int64)
                np.add.at(sums[p], b.entry[changed], counted)
                if old is not None:
                    np.subtract.at(sums[p], old[changed], counted)
                found.append(b)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _packed(found), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=["vec_id", "label", "vec", "state", "slot", "value"])
        slots = np.flatnonzero(sums)
        m = len(slots)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32())), pa.nulls(m, pa.binary()), pa.array(slots, pa.int32()), pa.array(sums.ravel()[slots])], names=["vec_id", "label", "vec", "state", "slot", "value"])

    return rows.mapInArrow(work, ROWS)


def averaged(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The entries' floored means; entries without rows stay."""
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error from rows whose entries are those of ``books``."""
    parts, _, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(2), parts * width).astype(np.int64).reshape(len(batch), parts, width)
            states = batch.column(3).to_pylist()
            entry = np.frombuffer(b"".join(s[:parts] for s in states), np.uint8).reshape(len(batch), parts)
            error = ((x - books[np.arange(parts)[None], entry]) ** 2).sum((1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s[:parts].hex() for s in states]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(work, "vec_id long, label long, code string, error long")


def codebooks(rows: DataFrame, scratch: Scratch, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """The books after ``rounds`` rounds from ``first``, and the rows assigned to them."""
    books, before, sums = first, None, np.zeros((*first.shape[:2], first.shape[2] + 1), np.int64)
    groups = [grouped(first[p]) for p in range(len(first))]
    for step in range(rounds + 1):
        saved = scratch.save(assigned(rows, books, before, groups), f"round-{step}")
        if step:
            scratch.drop(f"round-{step - 1}")
        rows = saved.where("slot IS NULL")
        if step == rounds:
            return books, rows
        # As many rows as the books have numbers.
        for r in saved.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("value").alias("value")).collect():
            sums.ravel()[r["slot"]] += r["value"]
        before, books = books, averaged(books, sums)


def compress(df: DataFrame, rounds: int = ROUNDS, vector: str = "embedding", id: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    spark = ship(df.sparkSession)
    rows = df.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("vec")).where(finite(F.col("vec")))
    longest = rows.agg(F.max(F.size("vec")).alias("n")).first()["n"]
    width = max(1, -(-(longest or 0) // PARTS))
    numbers = rows.select("vec_id", "label", whole_numbers(F.col("vec"), SCALE, PARTS * width, _limit(width)).alias("vec"))
    with Scratch(spark) as scratch:
        start = [r["vec"] for r in numbers.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(ENTRIES).collect()]
        if not start:
            return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
        first = np.array(start, np.int64).reshape(len(start), PARTS, width).transpose(1, 0, 2)
        books, last = codebooks(numbers.withColumn("state", F.lit(None).cast("binary")), scratch, first, rounds)
        codes = scratch.save(coded(last, books).withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(0))}), "codes")
        per = scratch.save(codes.groupBy("_none", "_label").agg(F.sum("error").alias("label_error")), "labels")
        keys = ["_none", "_label"]
        joined = codes.join(F.broadcast(per), keys) if per.limit(FEW_ROWS + 1).count() <= FEW_ROWS else salted_join(codes, per, keys, F.struct("vec_id", "code"), "inner")
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
        return checkpointed(joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def sql(rounds: int = ROUNDS) -> str:
    """``compress`` over ``embeddings``, for DuckDB: every distance of every round."""
    out = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding AS v, len(embedding) // {PARTS} AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, (i // w)::INTEGER AS p, (i % w)::INTEGER AS i, floor({SCALE} * c::DOUBLE)::BIGINT AS c
  FROM (SELECT r, w, unnest(v) AS c, unnest(range(len(v))) AS i FROM k)),
b0 AS MATERIALIZED (SELECT p, (r - 1)::INTEGER AS e, i, c FROM x WHERE r <= {ENTRIES})"""
    for n in range(rounds + 1):
        out += f""",
d{n} AS MATERIALIZED (SELECT r, p, min(row(d, e)) AS m FROM
  (SELECT x.r, x.p, b.e, sum((x.c - b.c) * (x.c - b.c))::BIGINT AS d FROM x JOIN b{n} b ON b.p = x.p AND b.i = x.i GROUP BY 1, 2, 3) GROUP BY 1, 2),
a{n} AS MATERIALIZED (SELECT r, p, m[1] AS d, m[2] AS e FROM d{n})"""
        if n < rounds:
            out += f""",
b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, b.i, coalesce((s - ((s % n) + n) % n) // n, b.c)::BIGINT AS c FROM b{n} b LEFT JOIN
  (SELECT x.p, a.e, x.i, sum(x.c)::BIGINT AS s, count(*) AS n FROM x JOIN a{n} a ON a.r = x.r AND a.p = x.p GROUP BY 1, 2, 3) t ON t.p = b.p AND t.e = b.e AND t.i = b.i)"""
    return out + f""",
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256
FROM o JOIN k USING (r)"""
