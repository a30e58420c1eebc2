"""Operator 3, benchmark decontamination: CGK embedding and bit-sampling LSH.

Texts are sequences of words (runs of ASCII letters and digits and of non-ASCII
bytes, A-Z lower-cased).  A document holds an item if some run of its words is within
an edit distance of ``DISTANCE`` of the item's number of words.

The embedding walks over a sequence: step j writes the word under the pointer and
moves on by a random bit that depends on j and on that word.  Two sequences of small
edit distance fall into step again, so their embeddings differ in few places.  A hash
table samples ``SAMPLED`` places of the embedding; windows that agree in all of them
meet.  Windows are about half as long as the items at most (``WINDOWS``), so that every
item has several, and begin at every word of every document and of every item.  Where a walk goes from a word on
depends on the step alone, so the walks of all windows are moved together, one array
operation a step.  ``tables_for`` adds tables for each window size until the target recall
is reached at every length of item, for the largest distance allowed.  Where ``MOST`` tables
do not reach it, the items of that window size are looked up exactly instead: cut into one run
more than the edits allowed, one of their runs at least stands unchanged in a copy, and the
hash of a run is a key.  Items under ``LEAST`` words allow no edit: the whole is their run.

A pair that meets is verified: first by the number of words it shares at least, then
by the exact edit distance to the best run of words around (a bit-parallel scan).

Defined results: null and empty texts and items without words match nothing; items
under ``LEAST`` words are looked for as exact runs; texts of any
length are scanned whole, ``CHUNK`` words at a time; an item that occurs repeatedly in a document is
one pair, with its least distance; repeated rows give repeated pairs; empty tables
give empty results; only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .bytescan import ALPHANUMERIC, mix, shingle_hashes, text_blocks, word_bounds, word_hashes
from .scratch import checkpointed
from .skew import without

DISTANCE, RECALL, SAMPLED, WALKS = 0.2, 0.98, 4, 2
#: Words of an item from which edits are allowed; (words of an item, from there on the words of a window).
LEAST, WINDOWS = 8, ((8, 4), (12, 8), (32, 16), (64, 32))
#: Edited copies for each length of item when tables are chosen, and tables of a window size beyond which runs of words take their place.
TRIALS, MOST = 400, 256
#: Items of one pass over the documents: what goes with the tasks is bounded by it.
ITEMS = 5_000
FILTER_BITS = 18
#: Words whose walks are moved together.
CHUNK = 1 << 16
#: The number of the walk that is none: the key is the hash of a run of words.
RUN = -1


@dataclass(frozen=True)
class Index:
    """Items of one pass: their words, and for each table the keys of their windows."""

    ids: np.ndarray
    words: list[np.ndarray]
    tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    """(walk, sampled steps, sorted keys, item and start of each key)."""


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(raw, offsets, ALPHANUMERIC)
    return word_hashes(raw, starts, ends), first


def walk(words: np.ndarray, number: int, steps: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(step, pointers) of the walks from every word, at the given steps (ascending)."""
    n = len(words)
    at, wanted, bits = np.arange(n, dtype=np.int32), set(steps), None
    for step in range(max(steps) + 1 if steps else 0):
        if step % 64 == 0:
            bits = mix(words ^ np.uint64((number * 1000 + step // 64 + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
        if step in wanted:
            yield step, at
        move = ((bits >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int8)
        at = at + move[at]
        np.minimum(at, n - 1, out=at)


def table_keys(words: np.ndarray, plan: list[tuple[int, int, tuple[int, ...]]]) -> Iterator[tuple[int, np.ndarray]]:
    """(table number, key of the window at every word); ``plan``: walk, table and its steps (of a run, its words)."""
    for t, (size,) in ((t, steps) for w, t, steps in plan if w == RUN):
        keys = np.zeros(len(words), dtype=np.uint64)
        keys[: max(0, len(words) - size + 1)] = shingle_hashes(words, size) if len(words) >= size else 0
        yield t, keys
    for number in sorted({w for w, _, _ in plan} - {RUN}):
        mine = [(t, steps) for w, t, steps in plan if w == number]
        keys: dict[int, np.ndarray] = {}
        uses: dict[int, list[int]] = {}
        for t, steps in mine:
            for s in steps:
                uses.setdefault(s, []).append(t)
        last = {t: max(steps) for t, steps in mine}
        for step, at in walk(words, number, sorted(uses)):
            seen = words[at]
            for t in uses[step]:
                if t in keys:
                    keys[t] *= np.uint64(0x9E3779B97F4A7C15)
                    keys[t] += seen
                else:
                    keys[t] = seen.copy()
                if last[t] == step:
                    yield t, keys.pop(t) * np.uint64(0xD6E8FEB86659FD93)


def window_size(n: int) -> int:
    return max((size for least, size in WINDOWS if least <= n), default=n)


def sampled_steps(size: int, table: int, sampled: int = SAMPLED) -> tuple[int, ...]:
    """Places of the embedding that a table looks at, the same wherever it is computed."""
    span = max(1, size * 3 // 2)
    rng = np.random.default_rng(size * 1009 + table)
    return tuple(sorted(rng.choice(span, size=min(sampled, span), replace=False).tolist()))


def runs_of(n: int, distance: float) -> tuple[int, list[int]]:
    """The length of runs of words, and where they begin in an item of ``n`` words, of which a copy edited as far as allowed keeps one."""
    count = (int(distance * n) if n >= LEAST else 0) + 1
    return n // count, [i * n // count for i in range(count)]


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with that many random replacements, insertions and deletions."""
    out = words.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(out))))
        if kind == 0 and out:
            out[at] = int(rng.integers(1 << 62))
        elif kind == 1:
            out.insert(at, int(rng.integers(1 << 62)))
        elif len(out) > 1:
            del out[at]
    return np.array(out, dtype=np.uint64)


def tables_for(items: list[np.ndarray], size: int, recall: float = RECALL, distance: float = DISTANCE, most: int | None = None) -> int | None:
    """Tables (None: more than ``most``) with which copies of the items that have windows of ``size`` are met often enough, at each length.

    Copies are edited as far as allowed and stand between other words.  All items take
    part, each as often as their length needs for ``TRIALS`` copies; lengths from twice
    the shortest that has such windows on, which are easier, count as one.
    """
    mine = [w for w in items if len(w) >= LEAST and window_size(len(w)) == size]
    if not mine:
        return 4
    rng = np.random.default_rng(7)
    group = np.array([min(len(w), 2 * min(n for n, s in WINDOWS if s == size)) for w in mine])
    originals, copies = [], []
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        for i in np.tile(at, -(-TRIALS // len(at))).tolist():
            originals.append(i)
            copies.append(edited(mine[i], int(distance * len(mine[i])), rng))

    def joined(texts: list[np.ndarray], numbers: np.ndarray, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Words, places of the windows and the number of each window's text.
        between = [rng.integers(1 << 62, size=2 * size).astype(np.uint64) for _ in texts]
        begins = np.cumsum([0, *(len(t) + 2 * size for t in texts[:-1])])
        counts = np.array([max(0, len(t) - short) for t in texts])
        places = np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.concatenate([x for pair in zip(texts, between, strict=True) for x in pair]), places, np.repeat(numbers, counts).astype(np.uint64)

    words, places, of = joined(mine, np.arange(len(mine)), size - 1)
    others, spots, copy = joined(copies, np.arange(len(copies)), 0)
    source = np.array(originals, np.uint64)[copy.astype(np.int64)]
    kind, met = group[np.array(originals)], np.zeros(len(copies), dtype=bool)
    of, source = mix(of), mix(source)
    for t in range(MOST if most is None else most):
        plan = [(t % WALKS, t, sampled_steps(size, t))]
        (_, known), (_, keys) = *table_keys(words, plan), *table_keys(others, plan)
        met[copy[np.isin(mix(keys[spots] ^ source), mix(known[places] ^ of))].astype(np.int64)] = True
        least = min(met[kind == g].mean() for g in np.unique(kind))
        if t >= 3 and least >= recall:
            return t + 1
    return None


def build(ids: list[int], texts: list[str | None], recall: float = RECALL, distance: float = DISTANCE) -> Index:
    words = []
    for _, _, raw, offsets in text_blocks(pa.array(texts, pa.string())):
        w, first = words_of(raw, offsets)
        words += [w[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    tables = []

    def add(walk: int, steps: tuple[int, ...], size: int, places: dict[int, list[int] | np.ndarray]) -> None:
        """A table of the keys of windows of ``size`` at the given places of each item."""
        keys, items, starts = [], [], []
        for i, at in places.items():
            (_, k), = table_keys(words[i], [(walk, 0, steps)])
            keys.append(k[at])
            items.append(np.full(len(at), i))
            starts.append(np.asarray(at))
        k, i, s = np.concatenate(keys), np.concatenate(items), np.concatenate(starts)
        order = np.argsort(k, kind="stable")
        tables.append((walk, np.array(steps), k[order], i[order].astype(np.int32), s[order].astype(np.int32)))

    exact = [i for i, w in enumerate(words) if 0 < len(w) < LEAST]
    for size in sorted({window_size(len(w)) for w in words if len(w) >= LEAST}):
        mine = [i for i, w in enumerate(words) if len(w) >= LEAST and window_size(len(w)) == size]
        count = tables_for(words, size, recall, distance)
        if count is None:
            exact += mine
        for t in range(count or 0):
            add(t % WALKS, sampled_steps(size, t), size, {i: np.arange(len(words[i]) - size + 1) for i in mine})
    runs: dict[int, dict[int, list[int]]] = {}
    for i in exact:
        size, places = runs_of(len(words[i]), distance)
        runs.setdefault(size, {})[i] = places
    for size, places in sorted(runs.items()):
        add(RUN, (size,), size, places)
    return Index(np.array(ids, dtype=np.int64), words, tables)


def best_distance(item: np.ndarray, region: np.ndarray) -> int:
    """Edit distance in words from ``item`` to the nearest run of words in ``region`` (Myers' bit-parallel scan)."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for w in region.tolist():
        eq = masks.get(w, 0)
        x = eq | down
        across = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(across | up), up & across
        score += bool(rise & high) - bool(fall & high)
        best = min(best, score)
        rise = rise << 1
        fall = fall << 1
        up, down = (fall | ~(x | rise)) & full, rise & x & full
    return best


def search(words: np.ndarray, first: np.ndarray, index: Index, filters: list[np.ndarray], distance: float) -> list[tuple[int, int, int]]:
    """(text, item, distance) of each pair that is verified, for texts whose words lie side by side."""
    if not len(words):
        return []
    found = []
    plan = [(number, t, tuple(steps.tolist())) for t, (number, steps, *_) in enumerate(index.tables)]
    # A walk sees no more words than it takes steps.
    margin = max((max(steps) + 1 for _, _, steps in plan), default=0)
    for left in range(0, len(words), CHUNK):
        for t, keys in table_keys(words[left : left + CHUNK + margin], plan):
            _, _, known, items, starts = index.tables[t]
            keys = keys[:CHUNK]
            hits = np.flatnonzero(filters[t][keys >> np.uint64(64 - FILTER_BITS)])
            if len(hits):
                low = np.searchsorted(known, keys[hits], side="left")
                count = np.searchsorted(known, keys[hits], side="right") - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                place = np.repeat(hits, count) + left
                found.append(np.stack([place - starts[at], items[at], place]))
    if not found:
        return []
    begin, item, hit = np.concatenate(found, axis=1)
    text = np.searchsorted(first, hit, side="right") - 1
    rows = np.unique(np.stack([text, item, begin // 4]), axis=1, return_index=True)[1]
    out: dict[tuple[int, int], int] = {}
    sets = {}
    for r in rows.tolist():
        d, i, b = int(text[r]), int(item[r]), int(begin[r])
        w = index.words[i]
        allowed = int(distance * len(w)) if len(w) >= LEAST else 0
        if out.get((d, i), allowed + 1) == 0:
            continue
        slack = allowed + 5
        region = words[max(first[d], b - slack) : min(first[d + 1], max(b, 0) + len(w) + slack)]
        if i not in sets:
            sets[i] = np.unique(w)
        place = np.minimum(np.searchsorted(sets[i], region), len(sets[i]) - 1)
        if np.count_nonzero(sets[i][place] == region) < len(w) - allowed:
            continue
        best = best_distance(w, region)
        if best <= allowed and best < out.get((d, i), allowed + 1):
            out[d, i] = best
    return [(d, i, n) for (d, i), n in sorted(out.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, distance: float = DISTANCE, recall: float = RECALL, items: int = ITEMS) -> DataFrame:
    """doc_id, item_id, distance (in words), item_words: a row per document and item in it.

    Items are a stated query set: ``items`` at a time go with the tasks, each block
    against all documents.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).where("item_id IS NOT NULL")
    blocks = max(1, -(-known.count() // items))
    schema = "doc_id long, item_id long, distance int, item_words int"
    out = None
    ship(docs.sparkSession)
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect() if blocks > 1 else known.collect()
        rows.sort(key=lambda r: (r["item_id"], r["item"] or ""))
        index = build([r["item_id"] for r in rows], [r["item"] for r in rows], recall, distance)

        def work(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            filters = []
            for _, _, keys, _, _ in index.tables:
                table = np.zeros(1 << FILTER_BITS, dtype=bool)
                table[keys >> np.uint64(64 - FILTER_BITS)] = True
                filters.append(table)
            for batch in batches:
                for start, end, raw, offsets in text_blocks(batch.column(1)):
                    found = search(*words_of(raw, offsets), index, filters, distance)
                    if found:
                        d, i, n = (np.array(x) for x in zip(*found, strict=True))
                        ids = batch.column(0)[start:end].take(pa.array(d))
                        sizes = np.array([len(index.words[x]) for x in i.tolist()], np.int32)
                        yield pa.RecordBatch.from_arrays([ids, pa.array(index.ids[i]), pa.array(n.astype(np.int32)), pa.array(sizes)], names=["doc_id", "item_id", "distance", "item_words"])

        mine = narrow.mapInArrow(work, schema)
        out = mine if out is None else out.unionByName(mine)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, distance: float = DISTANCE, recall: float = RECALL) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = checkpointed(contaminated(docs, benchmark, distance, recall).where("doc_id IS NOT NULL").select("doc_id").distinct())
    return without(docs, bad, "doc_id")
