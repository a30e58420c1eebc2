"""Media, WARC, mixing, URL filters, and the pipeline."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import media, mixing, queries, urls, warc
from lodestack.llm.scratch import Scratch
from lodestack.llm.tables import table

from .helpers import EDGE, docs


# --- media ---


def test_payloads_come_back(spark):
    rows = media.audio_table(docs(spark, EDGE), leave=()).collect()
    assert len(rows) == len(EDGE)
    for r, (id, text) in zip(sorted(rows, key=lambda r: (r.doc_id or 0, r.n_bytes)), sorted(EDGE, key=lambda e: (e[0] or 0, len((e[1] or "").encode()))), strict=True):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, math.ceil(len(raw) / 576)) * 576 - len(raw))
        assert r.doc_id == id and r.n_bytes == len(raw) and r.payload_bytes == len(payload)
        assert media.from_wav(bytes(r.wav)) == (media.STORED_RATE, payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes == len(r.wav) and r.media_sha256 == hashlib.sha256(r.wav).hexdigest()
        assert len(r.segments) == r.n_segments and all(x.start_s < x.end_s for x in r.segments)
        mel, batch = media.from_tensors(bytes(r.tensors))
        tensors = batch.column("mel")
        assert tensors.type.shape == [media.PATCH, media.BANDS] and len(tensors) == -(-r.n_frames // media.PATCH) and len(mel) == r.n_frames
        assert (mel == media.log_mel(np.frombuffer(payload, np.uint8))).all()
        starts, ends = batch.column("start_s").to_pylist(), batch.column("end_s").to_pylist()
        assert starts[0] == 0 and all(a < e for a, e in zip(starts, ends, strict=True))
        assert starts[1:] == [media.PATCH * i * media.HOP / media.RATE for i in range(1, len(starts))]
    assert len({r.feature for r in rows if r.doc_id == 4}) == 1
    assert media.audio_table(docs(spark, [])).count() == 0


def test_a_text_over_many_blocks_is_whole(spark):
    text = "é" * 1_500_000 + "x" * 2_000_000
    out = media.audio_table(docs(spark, [(1, text), (2, "x"), (3, text)])).collect()
    payload = text.encode() + b"\xff" * (-len(text.encode()) % 576)
    got = {r.doc_id: r for r in out}
    assert got[1].payload_sha256 == got[3].payload_sha256 == hashlib.sha256(payload).hexdigest()
    assert got[1].feature == got[3].feature and got[1].n_frames > 3 * media.FRAMES


def test_resampling_and_bands_equal_the_plain_formulas():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, 30_000).astype(np.uint8)
    half = 8 * max(media.UP, media.DOWN)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(media.UP, media.DOWN)) * np.hamming(2 * half + 1)
    taps *= media.UP / taps.sum()
    stuffed = np.zeros(len(x) * media.UP)
    stuffed[:: media.UP] = (x.astype(float) - 128) / 128
    want = np.convolve(stuffed, taps)[half : half + len(stuffed)][:: media.DOWN]
    assert np.abs(media.resample(x, 0, len(want)) - want).max() < 1e-9
    assert np.abs(media.resample(x, 777, 9000) - want[777:9000]).max() < 1e-9
    window, bank = media._mel()
    whole = media.log_mel(x)
    for i in (0, 1, 57):
        frame = want[i * media.HOP : i * media.HOP + media.WIDTH] * window
        assert np.allclose(whole[i], np.log(np.abs(np.fft.rfft(frame, media.FFT)) ** 2 @ bank + 1e-6), atol=1e-5)


def test_blocks_of_frames_do_not_show(monkeypatch):
    x = np.random.default_rng(3).integers(0, 256, 40_000).astype(np.uint8)
    whole = media.log_mel(x)
    monkeypatch.setattr(media, "FRAMES", 7)
    assert np.allclose(media.log_mel(x), whole, atol=1e-5)


def test_segments_need_two_thresholds():
    level = np.array([0, 0.2, 0.05, 0.05, 0.0, 0.05, 0.3, 0.01])
    assert media.segments(level) == [(1, 4), (6, 7)]
    assert media.segments(np.full(4, 0.05)) == []


# --- WARC ---

PAGES = [(1, "http://a/x y\n", "same"), (2, None, "same"), (3, "http://a/3", None), (4, "http://a/4", ""), (5, "http://a/5", "é" * 100_000), (6, "http://a/6", "same"), (None, "http://a/7", "same")]
PAGE = "page_id long, url string, html string"


def expected(rows, least=0):
    out = Counter()
    keep = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            keep[html or ""] = max(keep.get(html or "", i), i)
    for i, _, html in rows:
        raw = (html or "").encode()
        top = keep.get(html or "", i) if i is not None and len(raw) >= least else i
        out[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if top == i else "revisit", None if top == i else top] += 1
    return out


@pytest.mark.parametrize("least", [0, 1, 10])
def test_warc_round_trip(spark, least):
    rows = warc.round_trip(spark.createDataFrame(PAGES, PAGE), least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, rows)) == expected(PAGES, least)


def test_warc_repeats_and_empty(spark):
    twice = [(1, "u", "x"), (1, "u", "x"), (2, "v", "y")]
    rows = warc.round_trip(spark.createDataFrame(twice, PAGE)).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == [(1, "response"), (1, "response"), (2, "response")]
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_warc_files_are_members_that_the_index_points_at(spark, tmp_path):
    with Scratch(spark) as scratch:
        index = warc.write_archives(spark.createDataFrame(PAGES, PAGE), str(tmp_path), scratch, file_bytes=200)
        rows = index.collect()
        assert len({r.file for r in rows}) > 1
        ids, targets = set(), {}
        for r in rows:
            raw = (tmp_path / r.file).read_bytes()
            member = gzip.decompress(raw[r.offset : r.offset + r.length])
            head, _, payload = warc.parse(member)
            assert head["warc-payload-digest"] == f"sha1:{r.digest}" and head["warc-type"] == r.record_type
            assert "\n" not in head.get("warc-target-uri", "")
            ids.add(head["warc-record-id"])
            targets[r.page_id] = head.get("warc-refers-to-target-uri")
            assert gzip.decompress(raw).count(b"WARC/1.1\r\n") >= 2
        assert len(ids) == len(rows)
        assert targets[2] == "http://a/6" and targets[3] == "http://a/4" and targets[6] is None
        some = warc.read_records(index.where("page_id in (2, 5)"), str(tmp_path), payloads=True).collect()
        assert {(r.page_id, None if r.payload is None else len(r.payload)) for r in some} == {(2, None), (5, 200_000)}


def test_reading_is_cut_by_archived_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 1000)
    rows = [(i, f"http://a/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 20) for i in range(60)]
    with Scratch(spark) as scratch:
        index = warc.write_archives(spark.createDataFrame(rows, PAGE), str(tmp_path), scratch, file_bytes=2000)
        read = warc.read_records(index, str(tmp_path))
        assert read.rdd.getNumPartitions() == -(-index.agg(F.sum("length")).first()[0] // 1000) > 10
        assert read.count() == 60


def test_folders_of_object_stores():
    assert warc.opened("file:///tmp/x")[1] == "/tmp/x" and warc.opened("/tmp/x")[1] == "/tmp/x"


def test_ranges_are_joined():
    got = list(warc.runs([("a", 0, 10), ("a", 10, 10), ("a", 200_000, 5), ("b", 0, 1)], gap=100))
    assert [(f, s, e, len(m)) for f, s, e, m in got] == [("a", 0, 20, 2), ("a", 200_000, 200_005, 1), ("b", 0, 1, 1)]
    assert len(list(warc.runs([("a", i * 10, 10) for i in range(10)], most=30))) == 4


# --- mixing ---


def test_counts_are_the_inverted_distribution(spark):
    rows = [(i, "t", "en", "abc"[i % 3] if i % 5 else "a") for i in range(300)] + [(None, None, "en", None), (7, "", "en", "a")]
    out = mixing.replicate(docs(spark, rows), {"a": 2, "b": 1, None: 1}).collect()
    n = Counter("" if r[3] is None else r[3] for r in rows)
    total = {"a": 2, "b": 1, "": 1}
    want = Counter()
    for i, _, _, s in rows:
        s = s or ""
        if s not in total:
            continue
        rate = total[s] / 4 * len(rows) / n[s]
        parts = max(1, math.ceil(rate / mixing.PART))
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}:{part}".encode()).hexdigest()[:13], 16) / 2**52
            mean = rate / parts
            p = c = math.exp(-mean)
            k = 0
            while c <= u:
                k += 1
                p *= mean / k
                c += p
            want[i, s] += k
    got = Counter((r.doc_id, r.source or "") for r in out)
    assert got == want
    keys = [r.shuffle_key for r in out]
    assert keys == sorted(keys)
    assert {r._gone for r in out} == {"x"}


def test_sources_reach_their_weights(spark):
    big = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "rare").when(F.col("id") < 10_000, "some").otherwise("hot").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.replicate(big).groupBy("source").count().collect()}
    assert all(abs(got[s] - 10_000) < 500 for s in ("rare", "some", "hot"))
    assert mixing.replicate(big.limit(0)).count() == 0
    assert mixing.replicate(big, {"none": 1}).count() == 0


def test_columns_with_the_names_of_mixing_are_kept(spark):
    frame = spark.createDataFrame([(i, "s", i, "r", "k", i) for i in range(40)], "doc_id long, source string, Copy long, rate string, `shuffle.key` string, _copy long")
    out = mixing.replicate(frame)
    assert out.columns == [*frame.columns, "_rate", "n_copies", "__copy", "shuffle_key"]
    assert all(r.Copy == r.doc_id == r._copy and r.rate == "r" for r in out.collect())
    with Scratch(spark) as scratch:
        assert scratch.save(out, "mixed").count() == out.count()


def test_many_copies_are_made_in_blocks(spark, monkeypatch):
    big = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, "rare").otherwise("hot").alias("source"))
    whole = sorted(tuple(r) for r in mixing.replicate(big).collect())
    assert max(r[3] for r in whole) > 60
    monkeypatch.setattr(mixing, "BLOCK", 16)
    assert sorted(tuple(r) for r in mixing.replicate(big).collect()) == whole


def test_many_sources_are_joined_without_broadcast(spark, monkeypatch):
    big = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("source"))
    whole = {tuple(r) for r in mixing.replicate(big).collect()}
    monkeypatch.setattr(mixing, "FEW", 3)
    assert {tuple(r) for r in mixing.replicate(big).collect()} == whole


# --- URLs ---


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.COM/en/7?x#y", "a.example.com", "/en/7", "example.com/en/7", "allow"),
        ("https://x.com/en/", "x.com", "/en/", "com/en/", "block"),
        ("https://notcom/en/", "notcom", "/en/", None, "allow"),
        ("ftp://example.net/de/85", "example.net", "/de/85", "example.net/de/8", "block"),
        ("ftp://b.net/de/1://z", "b.net", "/de/1://z", "net/de/", "block"),
        ("http://c.org#/es/", "c.org", "", None, "allow"),
        ("http://d.org?/es/", "d.org", "", None, "allow"),
        ("http://com/en/x\ny", "com", "/en/x\ny", "com/en/", "block"),
        ("no-scheme.com/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://q.org/es/", "q.org", "/es/", "org/es/", "block"),
        ("http://É.ORG/es/1", "É.org", "/es/1", "org/es/", "block"),
    ]
    pages = spark.createDataFrame([(i, c[0], 1, "n") for i, c in enumerate(cases)], "page_id long, url string, purity int, template string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, labels).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_the_query_judges_by_the_rules_of_its_contract(spark, tmp_path):
    """net/de/ is allowed there, whatever the labels say, and example.net/de/8 blocked."""
    cases = [
        ("http://b.net/de/1", "net/de/", "allow"),
        ("http://example.net/de/71", "net/de/", "allow"),
        ("http://a.example.net/de/8", "example.net/de/8", "block"),
        ("http://b.com/en/7", "com/en/", "block"),
        ("http://example.com/en/7", "example.com/en/7", "allow"),
        ("http://b.org/es/", "org/es/", "block"),
    ]
    bad = [(100 + i, f"http://b.net/de/{i}") for i in range(50)]
    spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + bad, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op9_url_filters(spark, str(tmp_path)).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)} | {i: ("net/de/", "allow") for i, _ in bad}


def test_templates_with_bad_labels_are_rejected(spark):
    pages, labels = [], []
    for i in range(400):
        kind = "spam" if i % 4 == 0 else "news"
        pages.append((i, f"http://h.example/{kind}/item-{i}/{i * 7}.html"))
        labels.append((i, int(kind == "news"), 0))
    pages += [(1000, "http://h.example/spam/new/3.html"), (1001, "http://h.example/spam/item-5000/9.html"), (1002, "http://h.example/news/item-5000/9.html")]
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(pages)
    assert got[1001].verdict == "block" and got[1002].verdict == "allow"
    assert got[1001].template == "/spam/item-{n}/{n}.html" or "*" in got[1001].template
    assert all(got[i].verdict == ("block" if i % 4 == 0 else "allow") for i in range(400))


def test_variable_segments_become_wildcards(spark):
    pages = spark.createDataFrame([(i, f"http://h.example/u/{chr(97 + i % 26)}{chr(97 + i // 26)}/x") for i in range(300)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.template for r in urls.judge(pages, labels).collect()} == {"/u/*/x"}


def judged(spark, pages, labels):
    return {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}


@pytest.mark.parametrize("path", ["/{user}/{kind}/p.html", "/a/b/c/d/{kind}", "/a/b/c/d/e/f/{user}/{kind}"])
def test_statistics_are_pooled_below_variable_segments(spark, path):
    rows = [(2 * i + j, "http://h.example" + path.format(user=f"user-{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwx'[i // 100]}", kind=kind)) for i in range(400) for j, kind in enumerate(("spam", "news"))]
    got = judged(spark, rows, [(i, i % 2) for i, _ in rows])
    assert all(got[i].verdict == ("allow" if i % 2 else "block") for i, _ in rows)
    assert len({r.template for r in got.values()}) == 2


def plain_templates(leaves):
    """template by (host, shape), of (host, shape) -> (labelled, good): the tree walked node by node."""
    out = {}

    def walk(host, template, below):
        branches = {}
        for shape, rest in below:
            if rest:
                branches.setdefault(rest[0], []).append((shape, rest[1:]))
            else:
                out[host, shape] = template
        count = lambda rows: (sum(leaves[host, s][0] for s, _ in rows), sum(leaves[host, s][1] for s, _ in rows))
        all_n, all_g = count([x for rows in branches.values() for x in rows])
        children = {}
        for segment, rows in branches.items():
            n, g = count(rows)
            rest_n, rest_g = all_n - n, all_g - g
            differs = False
            if n >= urls.LEAST and rest_n >= urls.LEAST:
                share = all_g / all_n
                differs = abs(g / n - rest_g / rest_n) > urls.Z * math.sqrt(share * (1 - share) * (1 / n + 1 / rest_n))
            name = "*" if segment and len(branches) > 1 and not differs else segment
            children.setdefault(name, []).extend(rows)
        for name, rows in children.items():
            walk(host, f"{template}/{name}", rows)

    for host in {h for h, _ in leaves}:
        walk(host, "", [(s, s.split("/")[1:]) for h, s in leaves if h == host])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_the_tree_equals_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    pages, labels = [], []
    for i in range(1500):
        parts = [rng.choice("abc") * rng.randrange(1, 3), rng.choice(["x", "spam", "y", f"p{rng.randrange(9)}*"]), rng.choice(["", "q", "r.html"])][: rng.randrange(1, 4)]
        pages.append((i, rng.choice([f"http://{rng.choice('mno')}.example/" + "/".join(parts), "http://m.example", None]) if i % 40 == 0 else f"http://{rng.choice('mno')}.example/" + "/".join(parts)))
        if rng.random() < 0.7:
            labels.append((i, int(rng.random() < (0.1 if "spam" in parts else 0.6 if "a" in parts else 0.9))))
            if rng.random() < 0.1:
                labels.append((i, 0))
    pages += pages[:5]
    good = {}
    for i, g in labels:
        good[i] = min(g, good.get(i, 1))
    leaves, keys = {}, []
    for i, url in pages:
        host, _, path = (url or "").partition("://")[2].partition("/")
        key = (host, re.sub("[0-9]+", "{n}", ("/" + path if _ else "").replace("*", "%2A")))
        n, g = leaves.get(key, (0, 0))
        leaves[key] = (n + (i in good), g + good.get(i, 0))
        keys.append((i, key))
    named = plain_templates(leaves)
    total = lambda rows: (sum(leaves[k][0] for k in rows), sum(leaves[k][1] for k in rows))
    n, g = total(leaves)
    p0 = (g + urls.SMOOTH / 2) / (n + urls.SMOOTH)
    want = Counter()
    for i, key in keys:
        n, g = total([k for k in leaves if k[0] == key[0]])
        p1 = (g + urls.SMOOTH * p0) / (n + urls.SMOOTH)
        n, g = total([k for k in leaves if k[0] == key[0] and named[k] == named[key]])
        want[i, named[key], round((g + urls.SMOOTH * p1) / (n + urls.SMOOTH), 6)] += 1
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert Counter((r.page_id, r.template, r.purity) for r in out) == want
    assert all(r.verdict == ("block" if r.purity < urls.PURITY else "allow") for r in out)


def test_jobs_do_not_follow_the_longest_path(spark, monkeypatch):
    """Traps of very many segments are settled with the rest; the result is that of the plain walk."""
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: saved.append(name) or save(self, df, name))

    def run(depth):
        deep = ["/".join(f"s{i}" for i in range(depth)), "/".join(f"t{i}" if i % 7 else "" for i in range(depth)), "/".join(f"s{i}" for i in range(depth - 1)), "a//b/", "a/b/", ""]
        urls_ = [f"http://h.example/{x}" for x in deep] + [f"http://k.example/{'x/' * depth}{i}" for i in "abc"]
        pages = [(i, u) for i, u in enumerate(urls_ + [f"http://h.example/{'news' if i % 2 else 'spam'}/w{chr(97 + i % 9)}/p" for i in range(60)])]
        labels = [(i, i % 2) for i in range(len(pages)) if i != 2]
        saved.clear()
        got = Counter((r.page_id, r.template) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect())
        said, leaves, keys = dict(labels), {}, {}
        for i, u in pages:
            host, path = re.match(r"[^:]*://([^/?#]*)([^?#]*)", u).groups()
            key = keys[i] = (host, re.sub("[0-9]+", "{n}", path.replace("*", "%2A")))
            n, g = leaves.get(key, (0, 0))
            leaves[key] = (n + (i in said), g + said.get(i, 0))
        named = plain_templates(leaves)
        assert got == Counter((i, named[k]) for i, k in keys.items())
        return len(saved)

    assert run(12) == run(300)


def test_url_filters_run_no_python(spark, sf_dir, monkeypatch):
    plans = []
    save = Scratch.save

    def seen(self, df, name):
        plans.append(df._jdf.queryExecution().toString())
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", seen)
    plans.append(urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))._jdf.queryExecution().toString())
    assert len(plans) > 5
    for plan in plans:
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_columns_of_other_tables_with_the_operators_own_names_change_nothing(spark):
    rows = [(i, f"http://h{i % 3}.example/a{i % 2}/{i}", f"<p>{i % 4}</p>") for i in range(30)] + [(30, None, None), (3, "http://h.example/x", "<p>3</p>")]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    names = ("host", "shape", "template", "path", "rule", "file", "offset", "payload", "record_type", "digest", "segment", "rest", "tail")
    more = plain.withColumns({n: F.lit("x") for n in names})
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    same = lambda f, *a: sorted(map(str, f(plain, *a).collect())) == sorted(map(str, f(more, *(x.withColumn("page_id", F.lit(1)).withColumn("good", F.lit(9)) for x in a)).collect()))
    assert same(urls.judge, labels)
    assert same(warc.round_trip)


# --- pipeline ---


def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    documents = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        now, seen = documents, []
        for name, stage in corpus_pipeline.STAGES:
            now = scratch.save(stage(spark, now, sf_dir), name)
            seen.append({r.doc_id for r in now.select("doc_id").collect()})
            if name != "mixing":
                assert now.columns == documents.columns
        assert all(b <= a for a, b in zip(seen, seen[1:], strict=False))
        assert len(seen[3]) > 0.6 * documents.count()
        assert {c for c in now.columns} == {*documents.columns, "rate", "n_copies", "copy", "shuffle_key"}
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


@pytest.mark.parametrize("rows", [EDGE, []])
def test_pipeline_takes_edge_rows_and_an_empty_table(spark, sf_dir, rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    now = docs(spark, rows)
    columns = now.columns
    with Scratch(spark) as scratch:
        for name, stage in corpus_pipeline.STAGES:
            now = scratch.save(stage(spark, now, sf_dir), name)
            assert name == "mixing" or now.columns == columns
        assert now.columns == [*columns, "rate", "n_copies", "_copy", "shuffle_key"]
        assert {r.doc_id for r in now.collect()} <= {4, 5, 6, None}
