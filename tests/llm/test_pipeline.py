"""The pipeline and the toxicity model against plain versions of the same, loop by loop."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestack.llm import bytescan, decontaminate, langid, linededup, mixing, toxicity
from lodestack.llm.scratch import Scratch
from lodestack.llm.tables import table

from .helpers import docs
from .test_content import plain_language
from .test_similarity import removed, shingles

corpus_pipeline = pytest.importorskip("corpus_pipeline")


# --- toxicity ---


def hashed(word):
    raw = np.frombuffer(word, np.uint8)
    return bytescan.word_hashes(raw, np.array([0]), np.array([len(raw)]))


def buckets(text, known={}):  # noqa: B006
    out = set()
    for w in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower()):
        if w not in known:
            known[w] = {int(hashed(w)[0]) % toxicity.BUCKETS} | ({int(bytescan.mix(hashed(w[:5]))[0]) % toxicity.BUCKETS} if len(w) > 5 else set())
        out |= known[w]
    return out


def plain_scores(rows, labels):
    """Scores of rows (id, text) by a model of the labels (id, toxic) that are not held out, a number at a time."""
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    known = {}
    for i, x in labels:
        if not held(i):
            known[i] = max(x, known.get(i, 0))
    prior = sum(known.values()) / len(known)
    texts = dict(rows)
    sample = [(1, buckets(texts[i])) for i in sorted(known) if known[i] and i in texts] + [(0, buckets(t)) for i, t in rows if not held(i)]
    n_p, n_u = sum(r for r, _ in sample), sum(1 - r for r, _ in sample)
    in_p, in_u = Counter(b for r, s in sample if r for b in s), Counter(b for r, s in sample if not r for b in s)
    ratio = {}
    for b, n in in_p.items():
        expected = n_p * (in_u[b] + 1) / (n_u + 2)
        if n >= 3 and n - expected >= toxicity.EVIDENCE * math.sqrt(expected):
            ratio[b] = math.log((n + 0.5) / (n_p + 1)) - math.log((in_u[b] + 0.5) / (n_u + 1))
    w, bias = dict.fromkeys(ratio, 0.0), math.log(prior / (1 - prior))
    m, v = Counter(), Counter()
    rows_used = [(r, [b for b in s if b in ratio]) for r, s in sample]
    for step in range(1, 401):
        z = [bias + sum(ratio[b] * w[b] for b in s) for _, s in rows_used]
        p = [1 / (1 + math.exp(-x)) for x in z]
        soft = [max(0.0, x) + math.log1p(math.exp(-abs(x))) for x in z]
        rest = sum(soft[i] * ((1 - r) / n_u - prior * r / n_p) for i, (r, _) in enumerate(rows_used))
        slope = []
        for i, (r, _) in enumerate(rows_used):
            minus = p[i] * ((1 - r) / n_u - prior * r / n_p)
            slope.append(prior * r / n_p * (p[i] - 1) + minus if rest >= 0 else -minus)
        g = Counter({b: 1e-4 * w[b] for b in w})
        for (_, s), d in zip(rows_used, slope, strict=True):
            for b in s:
                g[b] += ratio[b] * d
        g["bias"] = sum(slope)
        for b in [*w, "bias"]:
            m[b], v[b] = 0.9 * m[b] + 0.1 * g[b], 0.999 * v[b] + 0.001 * g[b] ** 2
            change = 0.05 * (m[b] / (1 - 0.9**step)) / (math.sqrt(v[b] / (1 - 0.999**step)) + 1e-8)
            if b == "bias":
                bias -= change
            else:
                w[b] -= change
    return {i: (held(i), 1 / (1 + math.exp(-(bias + sum(w[b] * ratio[b] for b in buckets(t) if b in ratio))))) for i, t in rows}


def test_training_and_scoring_equal_plain_loops(spark, monkeypatch):
    """Also with texts over one block of the scanner."""
    rng = random.Random(8)
    calm, rude = [f"calm{i}" for i in range(60)], [f"rude{i}" for i in range(8)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        words = rng.choices(calm, k=rng.randrange(3, 30)) + (rng.sample(rude, 4) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    labels += [(1, 0), (3, 0)]  # said twice; the worse counts
    rows += [(900, None), (901, ""), (902, "calm1 " * 120_000 + "rude1 rude2 rude3 ÉTÉ")]
    want = plain_scores(rows, labels)
    frame, said = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(frame, toxicity.train(frame, said)).collect()}
    assert {i: r.held_out for i, r in got.items()} == {i: h for i, (h, _) in want.items()}
    assert max(abs(got[i].score - s) for i, (_, s) in want.items()) < 1e-4
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values()) and 0 < sum(r.predicted for r in got.values()) < len(rows) / 2


# --- pipeline ---


def plain_near(rows, k=5, percent=80):
    """The ids that stay: the smallest of each component."""
    sets = {i: shingles(t, k) for i, t in rows}
    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for ids in by.values() for a in ids for b in ids if a < b}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def plain_clean(rows, items):
    """The ids whose texts hold no item: the edit distance to the best run of words, cell by cell, where enough words are shared."""
    split = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
    bad = set()
    for item in map(split, items):
        allowed = int(0.2 * len(item)) if len(item) >= decontaminate.LEAST else 0
        for i, text in rows:
            words = split(text)
            if i in bad or not item or len(set(item) & set(words)) < len(set(item)) - allowed:
                continue
            row = list(range(len(item) + 1))
            for w in words:
                new = [0]
                for j, x in enumerate(item, 1):
                    new.append(min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (x != w)))
                row = new
                if row[-1] <= allowed:
                    bad.add(i)
                    break
    return {i for i, _ in rows} - bad


def test_every_stage_equals_its_plain_version_on_its_own_input(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(linededup, "COUNTS", 1 << 10)
    first = table(spark, sf_dir, "documents")
    model = langid.train(first)
    items = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    rows_of = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    with Scratch(spark) as scratch:
        out = [first]
        for name, stage in corpus_pipeline.STAGES:
            out.append(scratch.save(stage(spark, out[-1], sf_dir), name))
        before = first.select("source", "text", "doc_id").collect()
        told = plain_language([(r.source or "", "", r.text) for r in before], model)
        sure = {r.doc_id for r, (lang, posterior) in zip(before, told, strict=True) if lang != "und" and posterior >= langid.ACCEPT}
        border = {r.doc_id for r, (_, posterior) in zip(before, told, strict=True) if abs(posterior - langid.ACCEPT) < 1e-5}
        assert {i for i, _ in rows_of(out[1])} - border == sure - border

        rows = rows_of(out[1])
        gone = removed(rows)
        want = []
        for i, text in rows:
            lines = [x for j, x in enumerate((text or "").split("\n")) if (i, j) not in gone]
            if "\n".join(lines).strip(" \t\n\x0b\x0c\r") or not any(d == i for d, _ in gone):
                want.append((i, "\n".join(lines)))
        assert rows_of(out[2]) == want
        assert {i for i, _ in rows_of(out[3])} == plain_near(want)
        rows = rows_of(out[3])
        assert {i for i, _ in rows_of(out[4])} == plain_clean(rows, items)

        mixed = out[4].toArrow()
        duckdb.register("kept", pa.table({c: mixed[c] for c in ("doc_id", "source", "text")}))
        copies = duckdb.sql(mixing.sql("kept")).project("doc_id, n_copies, copy, shuffle_key, text").fetchall()
        own = "doc_id", "n_copies", "copy", "shuffle_key", "text"
        assert sorted(map(tuple, out[5].select(*own).collect())) == sorted(copies)
        assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(*own).collect())) == sorted(copies)
