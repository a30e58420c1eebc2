"""Operator 12, hard-negative mining: a vantage-point tree over norm-augmented vectors.

A component more, the root of M less the squared norm (M: the largest squared norm), gives
every vector the same length; a query gets a zero there.  Then a squared distance is
|q|^2 + M - 2 * (inner product), so that the highest scores are the nearest rows and a window
of scores is an annulus around the query.  All of it is integers but the new component, which
only serves to bound distances, with some slack; scores themselves are exact.

The index.  Rows that have vector and label in common are one class, of which only the
smallest ids can ever be asked for; so a vector with very many copies is one entry.  The tree
is fitted on about ``SAMPLE`` classes: at each node the vantage point whose distances vary
most of a few candidates, and the median as the radius.  All classes are sent down the tree;
for each leaf and each vantage point above it the least and the largest distance are kept
(as many numbers as the tree has nodes and levels, ``LEAVES`` leaves at most).  A leaf's rows
are sorted by their distance to its last vantage point and cut into blocks of ``BLOCK``, so a
large leaf is many shells and no task holds a leaf.

The search.  For each query the leaves' bounds give the nearest and the farthest that a row
in them can be; leaves outside the annulus are passed over, the others are taken nearest
first from the annulus's inner edge.  The first leaf gives the ``k``-th best score, which
narrows the annulus for the rest; shells outside it are passed over too.  Blocks and the
queries that visit them meet by one exchange on the block, of which there are copies where
many queries come; a task holds one block at a time and scores visiting queries in tiles.  Anchors with equal vector and label are one
query.  Nothing is approximate: what is passed over can't be among the first ``k``.

Defined results: rows with a null id, label or vector, or a null or non-finite component
take no part; of rows with equal ids the one with the least label, then vector, takes part;
shorter vectors count as if they ended in zeros; components beyond ``_limit`` are taken as
that limit, so that scores stay exact; a negative positive score leaves no window, and gives
no row; ties go to the smaller id; anchors without positives or negatives give no row; an
empty table gives an empty one; only id, vector and label are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .quantize import finite, whole_numbers
from .sampling import sampled
from .scratch import Scratch, checkpointed
from .skew import few, salted_join

SCALE, EVERY, TURNED, LABELS = 256, 100, 7, 10
POSITIVES = NEGATIVES = 5
#: A negative's score is this share (of 100) of the positive's at least.
LOW = 80
#: Classes that fit the tree; leaves at most; rows of a block; queries scored at a time.
SAMPLE, LEAVES, BLOCK, TILE = 1 << 14, 1 << 10, 1024, 256
#: Visits of a block that one task takes; where there are more, the block is repeated.
SHARE = 1024
NOTHING = np.iinfo(np.int64).min


def _limit(size: int) -> int:
    """The largest component for which all scores are exact as doubles, with room for a place in a block."""
    return min((1 << 30) - 1, math.isqrt((1 << 50) // max(1, size)))


class Tree:
    """Vantage points and radii of a complete binary tree, in the order of a heap."""

    def __init__(self, sample: np.ndarray, depth: int, top: float):
        """``sample``: vectors, one at least; ``top``: the largest squared norm of all rows."""
        self.depth, self.top = depth, top
        nodes = (1 << depth) - 1
        self.points, self.tails = np.zeros((nodes, sample.shape[1])), np.zeros(nodes)
        self.radii = np.full(nodes, np.inf)
        tail = self.tail(sample)
        parts = {0: np.arange(len(sample))}
        for node in range(nodes):
            rows = parts.pop(node, np.zeros(0, int))
            if len(rows):
                tries = rows[np.linspace(0, len(rows) - 1, 5).astype(int)]
                far = np.sqrt(np.maximum(0, 2 * top - 2 * (sample[rows] @ sample[tries].T + tail[rows][:, None] * tail[tries][None])))
                best = int(far.var(0).argmax())
                self.points[node], self.tails[node], self.radii[node] = sample[tries[best]], tail[tries[best]], np.median(far[:, best])
                outside = far[:, best] > self.radii[node]
                parts[2 * node + 1], parts[2 * node + 2] = rows[~outside], rows[outside]

    def tail(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.top - (x * x).sum(1)))

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distance to each vantage point on the way."""
        tail, node = self.tail(x), np.zeros(len(x), int)
        far = np.zeros((len(x), self.depth))
        for level in range(self.depth):
            near = np.einsum("ij,ij->i", x, self.points[node]) + tail * self.tails[node]
            far[:, level] = np.sqrt(np.maximum(0, 2 * self.top - 2 * near))
            node = 2 * node + 1 + (far[:, level] > self.radii[node])
        return node - ((1 << self.depth) - 1), far

    def to_points(self, q: np.ndarray) -> np.ndarray:
        """The distance of each query to each vantage point."""
        return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + self.top - 2 * (q @ self.points.T)))


class Ranges:
    """For each leaf and level, the least and the largest distance of its rows to the vantage point; leaves without rows are left out."""

    def __init__(self, tree: Tree, leaves: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.tree, self.leaves, self.low, self.high = tree, leaves, low, high
        self.above = np.zeros((len(leaves), tree.depth), int)
        node = leaves + (1 << tree.depth) - 1
        for level in reversed(range(tree.depth)):
            node = (node - 1) // 2
            self.above[:, level] = node

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query to each leaf the nearest and the farthest that a row can be, and the distance to the leaf's last vantage point."""
        far = self.tree.to_points(q)
        near, most = np.zeros((len(q), len(self.leaves))), np.full((len(q), len(self.leaves)), np.inf)
        last = np.zeros_like(near)
        for level in range(self.tree.depth):
            last = far[:, self.above[:, level]]
            near = np.maximum(near, np.maximum(self.low[:, level] - last, last - self.high[:, level]))
            most = np.minimum(most, self.high[:, level] + last)
        return near, most, last


def annulus(q: np.ndarray, top: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances between which rows lie whose scores are from ``low`` to ``high``, with slack for rounding."""
    base = (q * q).sum(1) + top
    slack = 1 + 1e-6 * np.sqrt(base)
    inner = np.sqrt(np.maximum(0, base - 2 * np.minimum(high, base))) - slack
    return inner, np.sqrt(np.maximum(0, base - 2 * np.maximum(low, -base))) + slack


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(df: DataFrame, vector: str = "embedding", id: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, label (long), vec (whole numbers, all of one length), a row for each id."""
    rows = df.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vec")))
    # An empty vector counts as a zero.
    size = max(1, rows.agg(F.max(F.size("vec")).alias("n")).first()["n"] or 0)
    rows = rows.select("vec_id", "label", whole_numbers(F.col("vec"), SCALE, size, _limit(size)).alias("vec"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """vec, label, ids (the ``keep`` smallest), norm: a row for each vector and label."""
    place = F.row_number().over(Window.partitionBy("vec", "label").orderBy("vec_id"))
    least = rows.withColumn("_n", place).where(F.col("_n") <= keep).groupBy("vec", "label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    norm = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    return least.withColumn("norm", norm)


class Index:
    """The tables ``rows`` (vec, label, ids, block) and ``blocks`` (block, leaf, near, far), and the tree with its ranges."""

    def __init__(self, entries: DataFrame, scratch: Scratch):
        """``entries``: a saved table of ``classes``, one row at least."""
        spark = ship(entries.sparkSession)
        self.scratch = scratch
        told = entries.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).first()
        depth = min(LEAVES.bit_length() - 1, max(0, math.ceil(math.log2(told["n"] / BLOCK))))
        picked = sampled(entries, F.xxhash64("vec", "label"), SAMPLE) if depth else entries.limit(1)
        table = picked.select("vec").toArrow()
        if not table.num_rows:  # a sample may miss a handful of rows
            table = entries.limit(1).select("vec").toArrow()
        self.tree = tree = Tree(_matrix(table.column("vec").combine_chunks()), depth, float(told["top"]))
        shared = spark.sparkContext.broadcast(tree)  # LEAVES vectors at most

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    leaf, far = shared.value.route(_matrix(batch.column(0)))
                    last = far[:, -1] if far.shape[1] else np.zeros(len(leaf))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32()), pa.array(last), lists], names=["vec", "label", "ids", "leaf", "far", "way"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, number, leaf, held = TaskContext.get().partitionId() << 33, -1, None, 0
            for batch in batches:
                blocks = np.zeros(len(batch), np.int64)
                for i, x in enumerate(batch.column(3).to_pylist()):
                    if x != leaf or held == BLOCK:
                        number, leaf, held = number + 1, x, 0
                    held += 1
                    blocks[i] = base + number
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks)], names=["vec", "label", "ids", "leaf", "far", "block"])

        fields = "vec array<int>, label long, ids array<long>, leaf int, far double"
        sent = scratch.save(entries.select("vec", "label", "ids").mapInArrow(send, f"{fields}, way array<double>"), "sent")
        ends = [f(F.col("way")[i]).alias(f"{f.__name__}_{i}") for i in range(depth) for f in (F.min, F.max)]
        found = sent.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *ends).orderBy("leaf").collect()  # LEAVES rows at most
        low, high = (np.array([[r[f"{f}_{i}"] for i in range(depth)] for r in found]).reshape(len(found), depth) for f in ("min", "max"))
        self.ranges = Ranges(tree, np.array([r["leaf"] for r in found]), low, high)
        self.rows = scratch.save(sent.select("vec", "label", "ids", "leaf", "far").orderBy("leaf", "far").mapInArrow(cut, f"{fields}, block long"), "rows")
        scratch.drop("sent")
        self.blocks = scratch.save(self.rows.groupBy("block").agg(F.min("leaf").alias("leaf"), F.min("far").alias("near"), F.max("far").alias("far")), "blocks")

    def _visits(self, queries: DataFrame, first: bool) -> DataFrame:
        """q, vec, label, low, high, block: the blocks of each query's nearest leaf, or those of all its others.

        ``start`` is the lower end of scores by which leaves were ordered, ``low`` what it is by now.
        """
        shared = queries.sparkSession.sparkContext.broadcast(self.ranges)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranges = shared.value
            for batch in batches:
                for at in range(0, len(batch), TILE):
                    part = batch.slice(at, TILE)
                    q = _matrix(part.column(1))
                    start, low, high = (part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (3, 4, 5))
                    near, most, last = ranges.bounds(q)
                    inner, outer = annulus(q, ranges.tree.top, start, high)
                    shut = (near > outer[:, None]) | (most < inner[:, None])
                    order = np.where(shut, np.inf, np.maximum(near, inner[:, None]))
                    nearest = order.argmin(1)
                    outer = annulus(q, ranges.tree.top, low, high)[1]
                    open_leaves = ~shut & (near <= outer[:, None])
                    is_first = np.arange(order.shape[1])[None] == nearest[:, None]
                    row, leaf = np.nonzero(open_leaves & (is_first if first else ~is_first))
                    for some in range(0, len(row), 8 * TILE):
                        r, c = row[some : some + 8 * TILE], leaf[some : some + 8 * TILE]
                        taken = part.take(pa.array(r))
                        found = [pa.array(ranges.leaves[c], pa.int32()), *(pa.array(x) for x in (last[r, c], inner[r], outer[r]))]
                        yield pa.RecordBatch.from_arrays([*(taken.column(i) for i in (0, 1, 2, 4, 5)), *found], names=["q", "vec", "label", "low", "high", "leaf", "d", "inner", "outer"])

        fields = "q string, vec array<int>, label long, low long, high long, leaf int, d double, inner double, outer double"
        leaves = queries.select("q", "vec", "label", "start", "low", "high").mapInArrow(work, fields)
        blocks = self.blocks.select("leaf", "block", F.col("near").alias("_near"), F.col("far").alias("_far"))
        met = (F.col("d") - F.col("_far") <= F.col("outer")) & (F.col("_near") - F.col("d") <= F.col("outer")) & (F.col("d") + F.col("_far") >= F.col("inner"))
        # Without a vantage point there is one leaf, whose distances say nothing.
        met = met if self.tree.depth else F.lit(True)
        return leaves.join(few(blocks), "leaf").where(met).select("q", "vec", "label", "low", "high", "block")

    def _scan(self, visits: DataFrame, k: int, same: bool, tag: str) -> DataFrame:
        """q, score, id: of each visited block the first ``k`` classes in the query's window, with all their ids."""
        visits = self.scratch.save(visits, f"{tag}-visits")
        own = self.rows.select("block", F.lit(0).alias("kind"), "vec", "label", "ids", F.lit(None).cast("string").alias("q"), *(F.lit(None).cast("long").alias(c) for c in ("low", "high")))
        asks = visits.select("block", F.lit(1).alias("kind"), "vec", "label", F.lit(None).cast("array<long>").alias("ids"), "q", "low", "high")
        crowd = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("_shares")).where("_shares > 1")
        crowd = few(self.scratch.save(crowd, f"{tag}-crowd"))
        own = own.join(crowd, "block", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
        asks = asks.join(crowd, "block", "left").withColumn("share", F.pmod(F.xxhash64("q"), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares")
        together = own.unionByName(asks).repartition("block", "share").sortWithinPartitions("block", "share", "kind")
        together = together.select("block", "kind", "vec", "label", "ids", "q", "low", "high", "share")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, parts, ready = None, [], None
            for batch in batches:
                if not len(batch):
                    continue
                blocks, kinds, shares = (batch.column(i).to_numpy() for i in (0, 1, 8))
                edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(shares) != 0) | (np.diff(kinds) != 0)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
                    run = batch.slice(a, b - a)
                    if (blocks[a], shares[a]) != block:
                        block, parts, ready = (blocks[a], shares[a]), [], None
                    if kinds[a] == 0:
                        parts.append(run)
                        continue
                    ready = ready or _loaded(parts)
                    for at in range(0, len(run), TILE):
                        yield from _best(run.slice(at, TILE), *ready, k, same)

        return together.mapInArrow(work, "q string, score long, id long")

    def nearest(self, queries: DataFrame, k: int, same: bool, tag: str) -> DataFrame:
        """q, score, id, place: for each query (q, vec, label, low, high) the first ``k`` rows of its own (``same``) or another label.

        Scores lie from low to high, both included; the highest come first, of equal ones the smaller id.
        """
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))

        def best(found: DataFrame) -> DataFrame:
            return found.withColumn("place", place).where(F.col("place") <= k)

        asked = queries.withColumn("start", F.col("low"))
        one = self.scratch.save(best(self._scan(self._visits(asked, True), k, same, f"{tag}-one")), f"{tag}-first")
        kth = one.where(F.col("place") == k).select("q", F.col("score").alias("_kth"))
        rest = self.scratch.save(asked.join(kth, "q", "left").withColumn("low", F.greatest("low", F.coalesce("_kth", "low"))).drop("_kth"), f"{tag}-rest")
        more = self._scan(self._visits(rest, False), k, same, f"{tag}-more")
        return self.scratch.save(best(more.unionByName(one.drop("place"))), f"{tag}-best")


def _loaded(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block in the order of the classes' first ids: vectors, labels, where each class's ids begin, and the ids."""
    table = pa.Table.from_batches(parts).combine_chunks()
    ids = table.column("ids").combine_chunks()
    sizes = np.diff(ids.offsets.to_numpy())
    flat, starts = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(flat[starts[:-1]], kind="stable")
    x, labels = _matrix(table.column("vec").combine_chunks()), table.column("label").to_numpy()
    new = np.concatenate([[0], np.cumsum(sizes[order])])
    moved = flat[np.repeat(starts[order] - new[:-1], sizes[order]) + np.arange(new[-1])]
    return x[order], labels[order], new, moved


def _best(asks: pa.RecordBatch, x: np.ndarray, labels: np.ndarray, starts: np.ndarray, ids: np.ndarray, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    score = (_matrix(asks.column(2)) @ x.T).astype(np.int64)
    own, low, high = (asks.column(i).to_numpy() for i in (3, 6, 7))
    fits = (labels[None] == own[:, None]) == same
    fits &= (score >= low[:, None]) & (score <= high[:, None])
    # Of equal scores the class with the smaller first id: scores stay under 2^51, places under 2^11.
    rank = np.where(fits, (score << 11) - np.arange(len(x))[None], NOTHING)
    if len(x) > k:
        at = np.argpartition(rank, len(x) - k, axis=1)[:, len(x) - k :]
    else:
        at = np.broadcast_to(np.arange(len(x)), rank.shape)
    row, col = np.nonzero(np.take_along_axis(rank, at, 1) != NOTHING)
    if not len(row):
        return
    entry = at[row, col]
    sizes = np.diff(starts)[entry]
    each = np.repeat(np.arange(len(row)), sizes)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    yield pa.RecordBatch.from_arrays([asks.column(5).take(pa.array(row[each])), pa.array(score[row, entry][each]), pa.array(ids[starts[entry[each]] + inside])], names=["q", "score", "id"])


def mine(df: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, vector: str = "embedding", id: str = "vec_id", label: str = "label", turned: int | None = TURNED) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; labels of ids divisible by ``turned`` are moved on by one.
    """
    spark = df.sparkSession
    fields = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with Scratch(spark) as scratch:
        rows = usable(df, vector, id, label)
        if turned is not None:
            rows = rows.withColumn("label", F.when(F.col("vec_id") % turned == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
        rows = scratch.save(rows, "usable")
        # One more than the positives: an anchor is no positive of its own.
        entries = scratch.save(classes(rows, max(positives + 1, negatives)), "classes")
        if not entries.limit(1).count():
            return spark.createDataFrame([], fields)
        index = Index(entries, scratch)
        name = F.md5(F.concat_ws("/", F.array_join("vec", ","), F.col("label").cast("string")).cast("binary"))
        anchors = scratch.save(rows.where(F.col("vec_id") % every == 0).withColumn("q", name), "anchors")
        queries = anchors.select("q", "vec", "label").dropDuplicates(["q"])
        floor, ceiling = F.lit(-(1 << 51)).cast("long"), F.lit(1 << 51).cast("long")
        near = index.nearest(scratch.save(queries.withColumns({"low": floor, "high": ceiling}), "queries"), positives + 1, True, "positives")
        per = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("near"))
        mates = salted_join(anchors.select("q", F.col("vec_id").alias("anchor_id")), scratch.save(per, "per"), ["q"], F.col("anchor_id"), "inner")
        mates = mates.withColumn("near", F.slice(F.filter("near", lambda x: x["id"] != F.col("anchor_id")), 1, positives))
        mates = mates.select("q", "anchor_id", F.explode("near").alias("p")).select("q", "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
        mates = scratch.save(mates.where("positive_score >= 0"), "mates")
        windows = mates.select("q", F.col("positive_score").alias("high")).distinct().join(queries, "q")
        windows = windows.withColumn("low", F.expr(f"({low} * high + 99) div 100")).withColumn("anchor", F.col("q")).withColumn("q", F.concat_ws("/", "q", F.col("high").cast("string")))
        windows = scratch.save(windows, "windows")
        hard = index.nearest(windows.drop("anchor"), negatives, False, "negatives")
        hard = hard.groupBy("q").agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("hard"))
        joined = salted_join(mates.withColumn("q", F.concat_ws("/", "q", F.col("positive_score").cast("string"))), scratch.save(hard, "hard"), ["q"], F.struct("anchor_id", "positive_id"), "inner")
        out = joined.select("anchor_id", "positive_id", "positive_score", F.explode("hard").alias("n"))
        return checkpointed(out.select("anchor_id", "positive_id", F.col("n.rank").cast("int").alias("rank"), F.col("n.negative_id").alias("negative_id"), "positive_score", F.col("n.negative_score").alias("negative_score")))


def sql() -> str:
    """``mine`` over ``embeddings``, for DuckDB: every anchor against every row."""
    return f"""
WITH k AS MATERIALIZED (SELECT DISTINCT vec_id, CASE WHEN vec_id % {TURNED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS MATERIALIZED (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= {POSITIVES})
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND {LOW} * p.s <= 100 * s.s AND s.s <= p.s
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) QUALIFY row_number() OVER w <= {NEGATIVES}"""
