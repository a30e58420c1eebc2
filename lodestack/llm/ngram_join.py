"""Operator 8, n-gram Jaccard join: universe-partition pigeonhole.

A document's set holds the hashes of its word shingles.  Sizes fall into bands
whose ends lie a factor 1 / threshold apart, so that a set only meets sets of its
own band and the two next to it.  Two linked sets differ in at most H elements,
H depending on the band.  The universe of hashes is cut into H + 1 segments by
value: one segment at least must hold the same subset in both sets, and, going
round the ring of segments, one of these is followed by a segment that differs by
one element at most.  So the index holds each segment's subset, and where a subset
is so small that many unrelated sets share it, the subset together with the next
segment's and its one-deletion neighbourhood.  Which of the two a segment gets is
decided by cost: the partners to be expected by chance among all documents against
the keys that the neighbourhood takes.  Subsets are hashed as sums, so a deletion is
a subtraction.

Equal sets are one class, and only its smallest document is indexed.  Documents that
share a key are first held against the key's first document; what these links
leave apart is then compared pairwise, in keys with few open pairs directly, in
others behind a prefix and positional filter over the rarest shingles, by the counts of their buckets.  Every pair
that shares a key is either verified exactly, excluded by an exact bound (the elements in
which the sets differ within a quarter of the universe are too many already), or
already known to be in one component; nothing is capped.

Defined results: null and empty texts and texts without words have no shingles and
their own id as component; a text of any length is taken whole; rows with equal
ids are one document and get a row each; rows without an id get a null component;
an empty table gives an empty table; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .bytescan import LOWER, NOT_SPACE, mix, shingle_hashes, text_blocks, word_bounds, word_hashes
from .components import connected_components
from .scratch import Scratch, checkpointed
from .skew import few, without

#: Each further word of a shingle makes it so much less likely that an unrelated document holds it too.
#: This estimate only decides between subsets and neighbourhoods; both are exact.
CHANCE = 1 / 8
#: Open pairs in a key from which the prefix filter takes over; buckets in which it counts elements.
OPEN, ORDERS = 64, 1 << 16


def set_of(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, k))


def bands(size: int, percent: int) -> tuple[int, int, int, int]:
    """The band of ``size`` (number, first and last size) and the last size of the next."""
    number, low, high = 0, 1, 100 // percent
    while size > high:
        number, low = number + 1, high + 1
        high = max(low, low * 100 // percent)
    return number, low, high, max(high + 1, (high + 1) * 100 // percent)


def difference(size: int, percent: int) -> int:
    """The most elements in which two linked sets of up to ``size`` differ."""
    return (100 - percent) * 2 * size // (100 + percent)


def keys_of(elements: np.ndarray, percent: int, total: int, chance: float, known: dict) -> np.ndarray:
    """The index keys of a set (sorted, distinct) among ``total`` sets of which each holds a given element by ``chance``; ``known`` keeps the bands by size."""
    size = len(elements)
    if size not in known:
        known[size] = bands(size, percent)
    number, _, high, next_high = known[size]
    mixed = mix(elements)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    out = []
    for scheme, top in ((number, high), (number + 1, next_high)):
        most = difference(top, percent)
        if not most or (scheme != number and size * 100 < percent * (high + 1)):
            continue
        m = most + 1
        edges = np.array([(i << 64) // m for i in range(1, m)], dtype=np.uint64) if m not in known.setdefault("edges", {}) else known["edges"][m]
        known["edges"][m] = edges
        cuts = np.concatenate([[0], np.searchsorted(elements, edges), [size]])
        part = sums[cuts[1:]] - sums[cuts[:-1]]
        base = mix(part ^ mix(np.arange(m, dtype=np.uint64) + np.uint64(scheme << 32)))
        count = np.diff(cuts)
        small = total * chance**count > 1 + top / m
        out.append(base[~small])
        here = np.flatnonzero(small)
        after = (here + 1) % m
        salt, many = mix(base[here] + np.uint64(1)), count[after]
        # The next segment whole, and without each of its elements.
        out.append(mix(part[after] + salt))
        if len(here):
            element = np.repeat(cuts[after] - np.cumsum(many) + many, many) + np.arange(many.sum())
            out.append(mix(np.repeat(part[after] + salt, many) - mixed[element]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for start, end, raw, offsets in text_blocks(batch.column(1)):
            starts, ends, first = word_bounds(raw, offsets, NOT_SPACE)
            words = word_hashes(raw, starts, ends)
            yield batch.column(0)[start:end], [set_of(words[a:b], k) for a, b in zip(first[:-1], first[1:], strict=True)]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.view(np.int64)))


def signatures(docs: DataFrame, k: int, percent: int, total: int) -> DataFrame:
    """doc_id, n_shingles, two hashes that identify the set, and its index keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        chance = CHANCE ** (k - 1)
        for ids, sets in _sets(batches, k):
            h1 = np.array([mix(x.copy()).sum(dtype=np.uint64) for x in sets], np.uint64)
            h2 = np.array([mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for x in sets], np.uint64)
            keys = [keys_of(x, percent, total, chance, known) if len(x) else x for x in sets]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in sets], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), _lists(keys)], names=["doc_id", "n_shingles", "h1", "h2", "keys"])

    ship(docs.sparkSession)
    return docs.mapInArrow(work, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def shingle_sets(docs: DataFrame, k: int, bits: int = 0) -> DataFrame:
    """doc_id, n (size of the set), shingles (sorted hashes; of 2 ** ``bits`` equal parts of the universe, those in the first)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, k):
            kept = [x[: np.searchsorted(x, np.uint64(1 << (64 - bits)))] for x in sets] if bits else sets
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in sets], pa.int64()), _lists(kept)], names=["doc_id", "n", "shingles"])

    ship(docs.sparkSession)
    return docs.mapInArrow(work, "doc_id long, n long, shingles array<long>")


def within(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets, or the parts of them that are given, differ in no more elements than the threshold allows the whole sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    apart = F.size("sa") + F.size("sb") - 2 * F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(apart * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch, tag: str) -> DataFrame:
    """The pairs (a, b) that reach the threshold: looked at in a quarter of the universe first, then whole."""
    for name, bits in (("part", 2), ("whole", 0)):
        ids = scratch.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{tag}-{name}-ids")
        sets = scratch.save(shingle_sets(docs.join(few(ids), "doc_id", "left_semi"), k, bits).dropDuplicates(["doc_id", "n", "shingles"]), f"{tag}-{name}-sets")
        pairs = scratch.save(within(pairs, sets, percent), f"{tag}-{name}-pairs")
        scratch.drop(f"{tag}-{name}-sets")
    return pairs


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, pos, token: of each set the rarest elements, of which two linked sets share one at least.

    How common an element is, is told by the count of its bucket, one of ``ORDERS``; equal ones go by
    their hash.  Any one order keeps the join exact, and this one asks for no exchange of the elements.
    """
    counted = sets.select(F.explode("shingles").alias("t")).groupBy(F.col("t").bitwiseAND(ORDERS - 1).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()
    common = np.zeros(ORDERS, np.int64)
    for r in counted:
        common[r["b"]] = r["c"]
    shared = ship(sets.sparkSession).sparkContext.broadcast(common)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
            ids, sizes, places, tokens = [], [], [], []
            for id, start, end in zip(batch.column(0).to_numpy(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                mine, size = values[start:end], end - start
                order = np.lexsort((mine, shared.value[mine & (ORDERS - 1)]))[: size + percent * size // -100 + 1]
                ids.append(np.full(len(order), id))
                sizes.append(np.full(len(order), size, np.int32))
                places.append(np.arange(len(order), dtype=np.int32))
                tokens.append(mine[order])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, sizes, places, tokens)], names=["doc_id", "n", "pos", "token"])

    return sets.select("doc_id", "shingles").mapInArrow(work, "doc_id long, n int, pos int, token long")


def prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that pass the prefix, positional and length filters."""
    index = prefixes(sets, percent).join(labels, "doc_id", "left").select("doc_id", "n", "pos", "token", F.coalesce("component", "doc_id").alias("component"))
    a = index.select("token", *(F.col(c).alias(f"{c}_a") for c in ("doc_id", "n", "pos", "component")))
    b = index.select("token", *(F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "pos", "component")))
    bound = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    fits = (F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("component_a") != F.col("component_b")) & (bound * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))
    return a.join(b, "token").where(fits).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def similar_documents(df: DataFrame, k: int = 3, percent: int = 90, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, a row per row of ``df``; a link is a Jaccard of ``percent`` / 100 or more."""
    docs = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with Scratch(df.sparkSession) as scratch:
        signed = scratch.save(signatures(docs, k, percent, docs.count()), "signed")
        plain = scratch.save(signed.drop("keys"), "plain")
        whole = plain.where("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = whole.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        # Saved first, so that the join's both sides are plain exchanges, of which Spark splits the large ones.
        classes = scratch.save(classes, "classes")
        members = whole.join(few(classes), ["h1", "h2", "n_shingles"], "left").select("doc_id", "n_shingles", "h1", "h2", F.coalesce("least", "doc_id").alias("first"))
        members = scratch.save(members, "members")

        # An id may have another text besides a copy.
        copies = members.where("doc_id <> first").select("doc_id", "h1", "h2").distinct()
        index = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "h1", "h2", "keys")
        index = index.join(few(copies), ["doc_id", "h1", "h2"], "left_anti").select("doc_id", F.explode("keys").alias("key"))
        # Only rows whose key has company; all that follows is over these.  One exchange serves both sides, whatever
        # the input's size: a count of its own would be an exchange more, and a broadcast only while keys are few.
        index = index.repartition("key")
        shared = index.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("key")
        met = scratch.save(index.join(shared.hint("shuffle_hash"), "key").select("key", "doc_id").distinct(), "met")
        scratch.drop("signed")
        first = met.groupBy("key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
        first = scratch.save(first, "first")
        pairs = scratch.save(met.join(first, "key").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "pairs")
        links = confirmed(pairs, docs, k, percent, scratch, "first")
        # Rows with one id but different texts stand in several classes, which belong together.
        torn = members.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("z")).where("a <> z").select("doc_id", "a")
        torn = scratch.save(members.join(torn, "doc_id").select("a", F.col("first").alias("b")), "torn")
        graph = links.unionByName(torn)
        labels = connected_components(graph, scratch, "c0")

        open_rows = met.join(first.where("size > 2").select("key"), "key").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        open_rows = open_rows.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        per = open_rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        apart = per.groupBy("key").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("open")).where("open > 0")
        rest = scratch.save(open_rows.join(apart, "key"), "rest")
        if rest.limit(1).count():
            lone = rest.where(F.col("open") <= 2 * OPEN)
            x, y = lone.select("key", F.col("doc_id").alias("a"), F.col("component").alias("ca")), lone.select("key", F.col("doc_id").alias("b"), F.col("component").alias("cb"))
            more = x.join(y, "key").where("a < b AND ca <> cb").select("a", "b")
            crowd = scratch.save(rest.where(F.col("open") > 2 * OPEN).select("doc_id").distinct(), "crowd")
            sets = scratch.save(shingle_sets(docs.join(few(crowd), "doc_id", "left_semi"), k).dropDuplicates(["doc_id", "shingles"]), "sets")
            dense = prefix_pairs(sets, labels.withColumnRenamed("id", "doc_id"), percent)
            more = scratch.save(more.unionByName(dense).distinct().join(pairs, ["a", "b"], "left_anti"), "more")
            labels = connected_components(graph.unionByName(confirmed(more, docs, k, percent, scratch, "more")), scratch, "c1")
        moved = scratch.save(labels.where("id <> component").select(F.col("id").alias("first"), "component"), "moved")
        done = members.join(few(moved), "first", "left").select("doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id"))
        bare = plain.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id"))
        return checkpointed(done.unionByName(bare))


def one_of_each(df: DataFrame, k: int = 3, percent: int = 90, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``df`` without the documents that are linked, over any number of links, with one of a smaller id."""
    found = similar_documents(df, k, percent, text, id)
    return without(df, checkpointed(found.where("doc_id <> component_id").select("doc_id").distinct()), id)


def sql(k: int = 3, percent: int = 90) -> str:
    """The same over ``documents``, for DuckDB: all pairs that share a shingle, counted."""
    grams = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {k} THEN array_to_string(w, ' ') ELSE {grams} END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k} + 1, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
sets AS (SELECT doc_id, n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s JOIN n USING (doc_id) GROUP BY 1, 2),
reps AS (SELECT h, n, min(doc_id) AS r FROM sets GROUP BY 1, 2),
x AS (SELECT r, n, g FROM s JOIN reps ON r = doc_id),
e AS (SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.g = b.g AND a.r < b.r AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
      GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT a AS v, a AS l FROM u UNION SELECT u.b, c.l FROM c JOIN u ON u.a = c.v),
m AS (SELECT v, min(l) AS component FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(sets.n, 0)::BIGINT AS n_shingles, coalesce(m.component, reps.r, d.doc_id) AS component_id
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN reps ON reps.h = sets.h AND reps.n = sets.n LEFT JOIN m ON m.v = reps.r"""
