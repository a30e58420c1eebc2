"""Line dedup and the n-gram join against all pairs."""

import re
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import linededup, ngram_join
from lodestack.llm.bytescan import NOT_SPACE, shingle_hashes, word_bounds, word_hashes
from lodestack.llm.scratch import Scratch
from lodestack.llm.tables import table

from .helpers import EDGE, docs


def shingles(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, percent=90):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t))
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = find(a), find(b)
                        root[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def near_copies(seed, n=60, words=80):
    """Copies of a few texts with one to fifteen words changed, so links form chains and stars."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = [[rng.choice(vocabulary) for _ in range(words)] for _ in range(3)]
    out = []
    for i in range(n):
        w = list(rng.choice(texts))
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        out.append((i * 3, " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_all_pairs(spark, seed):
    rows = near_copies(seed) + [(1000 + i, " ".join(f"s{j}" for j in range(i))) for i in range(25)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs(spark, rows)).collect()}
    want = components(rows)
    assert got == {d: (len(shingles(t)), want[d]) for d, t in rows}


def test_ngram_join_crowded_keys_use_the_prefix_filter(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "OPEN", 1)
    rows = near_copies(3)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs(spark, rows)).collect()}
    assert got == components(rows)


def test_ngram_join_edges(spark):
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs(spark, EDGE)).collect()}
    assert rows == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 3, None), (4, 1, 4), (5, 59_998, 5), (6, 2, 6), (7, 1, 7)}
    assert ngram_join.similar_documents(docs(spark, EDGE)).count() == len(EDGE)
    assert ngram_join.similar_documents(docs(spark, [])).count() == 0
    assert ngram_join.one_of_each(docs(spark, EDGE)).columns == docs(spark, []).columns


def test_ids_with_two_texts_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (7, a), (7, b), (9, b)]
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.similar_documents(docs(spark, rows)).collect())
    assert got == [(5, 5), (7, 5), (7, 5), (9, 5)]


def test_a_copy_leaves_the_other_text_of_its_id_in_the_index(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (7, a), (7, b), (9, f"{b} more")]
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.similar_documents(docs(spark, rows)).collect())
    assert got == [(5, 5), (7, 5), (7, 5), (9, 5)]


@pytest.mark.parametrize("turn", [1, -1])
def test_texts_of_one_id_that_are_equal_in_the_looked_at_part_are_told_apart(spark, turn):
    """The quarter of the universe is the same for both texts of id 2; only one of them reaches the threshold."""
    words = [f"w{i}" for i in range(37)]
    words.append(next(w for w in (f"z{i}" for i in range(1000)) if hash_of([*words[-2:], w]) >> 62))
    longer = list(words)
    for step in range(4):
        longer.append(next(w for w in (f"y{step}x{i}" for i in range(1000)) if not hash_of([*longer[-2:], w]) >> 62))
    a, b, c = " ".join(words[:-1]), " ".join(words), " ".join(longer)
    assert len(shingles(b)) == 36 and len(shingles(c)) == 40
    two = [(2, a), (2, b)][::turn]
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.similar_documents(docs(spark, [(1, c), *two]).coalesce(1)).collect())
    assert got == [(1, 1), (2, 1), (2, 1)]


def hash_of(words):
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]), NOT_SPACE)
    return int(shingle_hashes(word_hashes(raw, starts, ends), len(words))[0])


def test_pipeline_stage_links_five_words_at_four_fifths(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = near_copies(7, 40, 50)
    sets, group = {d: shingles(t, 5) for d, t in rows}, {d: d for d, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    got = {r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, docs(spark, rows), "").collect()}
    assert got == set(group.values())
    assert got < {d for d, c in components(rows).items() if d == c}


@pytest.fixture(autouse=True)
def small_counts(monkeypatch):
    """Fewer buckets of words: as exact, and quicker on small tables."""
    monkeypatch.setattr(linededup, "COUNTS", 1 << 10)


def removed(rows, percent=80):
    lines = [(d, i, set(w for w in re.split("[ \t\n\x0b\x0c\r]", line.lower()) if w)) for d, t in rows if d is not None for i, line in enumerate((t or "").split("\n"))]
    return {(d, i) for d, i, s in lines if s and any((e, j) < (d, i) and u and 100 * len(s & u) >= percent * len(s | u) for e, j, u in lines)}


@pytest.mark.parametrize("seed", [4, 5])
def test_line_dedup_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    lines = [t for _, t in near_copies(seed, 40, 20)] + ["A b c d", "a B c d e", "d c b a", "x", "X", "", "one two", "one two three"] * 3
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(len(lines) // 4)]
    got = {(r.d, r.l) for r in linededup.removed_lines(docs(spark, rows)).collect()}
    assert got == removed(rows)
    kept = {r.doc_id: r.text for r in linededup.deduplicated(docs(spark, rows)).collect()}
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in got) for d, t in rows}
    assert kept == {d: t for d, t in want.items() if t.strip() or not any(d == e for e, _ in got)}


@pytest.mark.parametrize(("star", "crowd"), [(1, 1), (2, 4), (1000, 3)])
def test_line_dedup_equals_all_pairs_where_words_are_crowded(spark, monkeypatch, star, crowd):
    """Near pairs that share rare and crowded prefix words, at distances up to the threshold."""
    monkeypatch.setattr(linededup, "STAR", min(star, crowd))
    monkeypatch.setattr(linededup, "CROWD", crowd)
    monkeypatch.setattr(linededup, "SAMPLE", 1)
    monkeypatch.setattr(linededup, "WIDE", 12)
    rng = random.Random(6)
    common, lines = [f"c{i}" for i in range(30)], []
    for i in range(60):
        line = [f"r{i}_{j}" for j in range(2)] + rng.sample(common, rng.randrange(7, 17))
        for _ in range(3):
            copy = list(line)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice([*common, f"u{rng.randrange(10**6)}"])
            lines.append(" ".join(copy))
    lines += [" ".join(rng.sample(common, rng.randrange(14, 24))) for _ in range(60)]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(len(lines) // 4)]
    assert {(r.d, r.l) for r in linededup.removed_lines(docs(spark, rows)).collect()} == removed(rows)


def test_line_dedup_keeps_documents_of_one_id_apart(spark):
    a, b = "one two three four\nfive six seven eight", "nine ten eleven twelve\nthirteen fourteen"
    rows = [(3, "one two three four"), (7, a), (7, b), (7, b)]
    kept = sorted((r.doc_id, r.text) for r in linededup.deduplicated(docs(spark, rows)).collect())
    assert kept == sorted([(3, "one two three four"), (7, "five six seven eight"), (7, b), (7, b)])


def test_a_document_of_very_many_lines(spark):
    """Removal takes time of the number of lines: a second or two for these, and hours if each were sought among the removed."""
    many = 300_000
    text = "\n".join(["alpha beta gamma delta"] * many + ["the last line is another"] + [""] * many + ["alpha beta gamma delta"])
    rows = [(1, text), (2, "ALPHA beta gamma delta\nnew words stand here")]
    kept = {r.doc_id: r.text for r in linededup.deduplicated(docs(spark, rows)).collect()}
    assert kept == {1: "\n".join(["alpha beta gamma delta", "the last line is another"] + [""] * many), 2: "new words stand here"}


def test_line_dedup_carries_columns_with_dots(spark):
    frame = spark.createDataFrame([(1, "a b c d\ne f", 5, "x"), (2, "A b c d", 6, "y")], "doc_id long, text string, `a.b` int, d string")
    out = linededup.deduplicated(frame)
    assert out.columns == frame.columns
    assert [tuple(r) for r in out.collect()] == [(1, "a b c d\ne f", 5, "x")]


def test_line_dedup_edges(spark):
    out = linededup.report(docs(spark, EDGE)).collect()
    assert len(out) == len(EDGE) and all(r.n_removed == 0 for r in out)
    assert linededup.report(docs(spark, [])).count() == 0
    assert linededup.deduplicated(docs(spark, EDGE)).columns == docs(spark, []).columns
    assert linededup.deduplicated(docs(spark, EDGE)).count() == len(EDGE)


def test_line_dedup_runs_no_python(spark, sf_dir, monkeypatch):
    plans = []
    save = Scratch.save

    def seen(self, df, name):
        plans.append(df._jdf.queryExecution().toString())
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", seen)
    plans.append(linededup.report(table(spark, sf_dir, "documents"))._jdf.queryExecution().toString())
    assert len(plans) > 8
    for plan in plans:
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_the_constant_of_the_rarity_is_short_in_plans(spark):
    """The driver keeps plans as text: the array of all buckets takes a few characters for each."""
    docs = spark.createDataFrame([(0, "a b c d e")], "doc_id long, text string")
    steps = linededup.rarity(docs.select(linededup.hashes(F.col("text")).alias("hashes")))
    text = spark.range(1).select(F.get(steps, F.col("id").cast("int")))._jdf.queryExecution().executedPlan().toString()
    assert len(text) < 5 * linededup.COUNTS


def test_long_unrelated_lines_are_told_apart_in_the_join(spark):
    """Two lines of 150 and more words, one in ten shared, seldom pass both parities; related ones always do."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    common, rows = [word() for _ in range(15)], []
    for i in range(60):
        own = common + [word() for _ in range(150)]
        rows.append((2 * i, " ".join(own)))
        rows.append((2 * i + 1, " ".join(own[:-12] + [word() for _ in range(12)])))
    h = linededup.hashes(F.col("text"))
    lines = spark.createDataFrame(rows, "d long, text string").select("d", F.size(h).alias("n"), F.lit(0).alias("p"), linededup.parity(h).alias("s"), linededup.half_parity(h).alias("v")).cache()
    a, b = (lines.select(*(F.col(c).alias(f"{c}{x}") for c in lines.columns)) for x in "ab")
    got = {(r.da, r.db) for r in a.join(b, F.col("da") < F.col("db")).where(linededup._fits(80, 1)).select("da", "db").collect()}
    related = {(2 * i, 2 * i + 1) for i in range(60)}
    assert related <= got and len(got - related) < 10


def below_exchanges(plan):
    """What stands below each exchange that a repartition asks for, without the numbers of columns."""
    lines = plan.split("\n")
    return [re.sub(r"#\d+L?", "", lines[i + 1]).lstrip(" :+-") for i, line in enumerate(lines) if "REPARTITION_BY_COL" in line]


@pytest.fixture
def plans(monkeypatch):
    """The plans of the tables that are saved, by name."""
    out = {}
    save = Scratch.save

    def seen(self, df, name):
        out[name] = df._jdf.queryExecution().executedPlan().toString()
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", seen)
    return out


def test_line_dedup_deals_its_words_out_once(spark, monkeypatch, plans):
    """Both sides of the join share one exchange, and no table of all words is kept."""
    monkeypatch.setattr(linededup, "STAR", 2)
    monkeypatch.setattr(linededup, "SAMPLE", 1)
    rows = near_copies(3, 10, 12)
    assert {(r.d, r.l) for r in linededup.removed_lines(docs(spark, rows)).collect()} == removed(rows)
    assert "star-1-closed" in plans and "hashes" not in plans
    a, b = below_exchanges(plans["near-1"])
    assert a == b


def test_ngram_join_deals_its_keys_out_once(spark, plans):
    ngram_join.similar_documents(docs(spark, near_copies(3, 10, 12))).collect()
    a, b = below_exchanges(plans["met"])
    assert a == b and plans["met"].count("Exchange hashpartitioning(key") == 2
