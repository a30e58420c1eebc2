"""Scalar functions against literals and plain Python models."""

import math
import os
import re
from pathlib import PurePath

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import columns as C
from lodestack.i18n import MESSAGES, format_number, set_language, t
from lodestack.operators import budget


@pytest.mark.parametrize(("text", "margin", "want"), [("", 0.15, (0, 0, 0)), ("abcd", 0.15, (4, 1, 2)), ("éé", 0.15, (4, 1, 2)), ("A" * 4000, 0.15, (4000, 1000, 1150))])
def test_token_estimates(spark, text, margin, want):
    size = F.octet_length(F.lit(text)).cast("long")
    tokens = C.approx_tokens(size)
    assert tuple(spark.range(1).select(size, tokens, C.with_margin(tokens, margin)).first()) == want


def test_margin_is_ieee(spark):
    rows = spark.range(2000).select("id", *(C.with_margin(F.col("id"), m).alias(f"m{i}") for i, m in enumerate((0.05, 0.1, 0.15, 0.2)))).collect()
    assert all(r[f"m{i}"] == math.ceil(r["id"] * (1.0 + m)) for r in rows for i, m in enumerate((0.05, 0.1, 0.15, 0.2)))


NAMES = ["a.txt", "A.TXT", ".bashrc", "a.", "a.tar.gz", "noext", "x.Y.Z", "dir.name", "é.Md", ".hid.txt"]


def test_suffixes(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    assert {r.n: r.s for r in df.select("n", C.suffix(F.col("n")).alias("s")).collect()} == {n: (PurePath(n).suffix.lower() if n != "a." else "") for n in NAMES}


def test_natural_order(spark):
    names = ["file10", "file2", "File1", "a/2/b", "a/10/b", "x", "file2a", "10", "9", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    want = sorted(names, key=lambda p: [int(s) if s.isdigit() else s.lower() for s in re.split(r"(\d+)", p)])
    assert [r.n for r in df.orderBy(C.natural_key(F.col("n")), "n").collect()] == want


SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def test_strip_is_pythons(spark):
    texts = ["".join(SPACES) + "x y" + "".join(SPACES), "", "\u200b a", " \n", "a"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r.s for r in df.select(C.strip(F.col("x")).alias("s")).collect()] == [x.strip() for x in texts]


LOW = [
    ("x" * 100, [10] * 10, 0, True), ("x" * 100, [200] * 10, 0, False), ("x" * 100, [5] * 4 + [200] * 6, 3, True), ("x" * 100, [5] * 4 + [200] * 6, 0, False),
    ("x" * 79, [], 0, True), (" " * 90, [], 0, True), ("x" * 80, None, 2, False), (None, [], 0, True),
]


def test_low_text_and_status(spark):
    df = spark.createDataFrame([(i, *row[:3], False, False) for i, row in enumerate(LOW)], "i int, text string, chars_per_page array<int>, image_count int, ignored boolean, failed boolean")
    got = {r.i: r.l for r in df.select("i", C.low_text(F.col("text"), F.col("chars_per_page"), F.col("image_count")).alias("l")).collect()}
    assert got == {i: row[3] for i, row in enumerate(LOW)}
    status = {r.i: r.base_status for r in budget.with_status(df).collect()}
    assert status[6] == "images" and status[4] == "low_text" and status[1] == "ready"
    for ignored, failed, want in ((True, False, "ignored"), (True, True, "error")):
        assert {r.base_status for r in budget.with_status(df.withColumn("ignored", F.lit(ignored)).withColumn("failed", F.lit(failed))).collect()} == {want}


def header(f, tokens, margined):
    out = ["---", f"## SOURCE: {f['relative_path']}", f"- type: {f['file_type']}", f"- taille_octets: {f['size_bytes']}"]
    out += [f"- pages_ou_diapos: {f['page_count']}"] * (f["page_count"] > 0) + [f"- tokens_estimes: {tokens}", f"- tokens_avec_marge: {margined}"]
    out += [f"- images: {f['image_count']}"] * (f["image_count"] > 0) + [f"- alerte: {a}" for s, a in (("images", "images"), ("low_text", "peu_de_texte")) if f["base_status"] == s]
    return "\n".join([*out, *([f"- encodage: {f['encoding']}"] if f["encoding"] else []), "---"])


def model(f, margin):
    tokens, margined = math.ceil(len(f["text"].encode()) / 4), 0
    margined = math.ceil(tokens * (1.0 + margin))
    for _ in range(20):
        size = len(f"{header(f, tokens, margined)}\n\n{f['text']}".encode())
        new = (math.ceil(size / 4), math.ceil(math.ceil(size / 4) * (1.0 + margin)))
        if new == (tokens, margined):
            break
        tokens, margined = new
    return size, tokens, margined


FILE = st.fixed_dictionaries({
    "relative_path": st.text(st.sampled_from("aé/9. "), min_size=1, max_size=30), "file_type": st.sampled_from(["txt", "pdf"]), "size_bytes": st.integers(0, 10**12),
    "text": st.builds(lambda s, n: s * n, st.text(st.sampled_from("aé\n"), max_size=5), st.sampled_from([0, 1, 7, 63, 999, 40_000])),
    "page_count": st.integers(0, 3), "image_count": st.integers(0, 3), "base_status": st.sampled_from(["ready", "images", "low_text"]), "encoding": st.sampled_from([None, "", "utf-8"]),
})


@settings(max_examples=5, deadline=None, phases=(Phase.explicit, Phase.generate))
@given(st.lists(FILE, min_size=1, max_size=40), st.sampled_from([0.0, 0.1, 0.15, 0.5]))
def test_estimate_equals_the_loop(spark, files, margin):
    names = ("relative_path", "file_type", "size_bytes", "text", "page_count", "image_count", "base_status", "encoding")
    df = spark.createDataFrame([(i, *(f[n] for n in names)) for i, f in enumerate(files)], "i int, relative_path string, file_type string, size_bytes long, text string, page_count int, image_count int, base_status string, encoding string")
    got = {r.i: (r.bytes_utf8, r.tokens_estimated, r.tokens_with_margin) for r in budget.with_estimate(df, margin).collect()}
    assert got == {i: model(f, margin) for i, f in enumerate(files)}


def test_totals_take_the_margin_once(spark):
    def total(sizes, margin):
        df = spark.createDataFrame([(s, -(-s // 4)) for s in sizes], "bytes_utf8 long, tokens_estimated long")
        r = budget.corpus_totals(df, margin).first()
        return r.tokens_estimated, r.tokens_with_margin

    assert total([4, 4], 0.15) == (2, 3)
    assert total([2, 2], 0.0) == (1, 1)
    assert total([], 0.15) == (0, 0)


def test_limit_equality_fits(spark):
    rows = spark.createDataFrame([(1000,), (128_000,), (128_001,)], "n long").select(C.over_limit(F.col("n"), 128_000).alias("o")).collect()
    assert [r.o for r in rows] == [False, False, True]


@pytest.mark.parametrize(("text", "want"), [("", "```"), ("a `b`", "```"), ("```x```", "````"), ("`````", "``````")])
def test_fences(spark, text, want):
    assert spark.range(1).select(C.fence(F.lit(text))).first()[0] == want


def test_body_is_fenced_only_when_needed(spark):
    get = lambda text, kind: spark.range(1).select(C.body(F.lit(text), F.lit(kind))).first()[0]
    assert get("```x", "md") == "````\n```x\n````"
    assert get("```x", "markdown") == "```x" and get("x", "md") == "x"


def test_gauge_and_numbers(spark):
    rows = spark.createDataFrame([(79,), (80,), (100,)], "n long").select(C.gauge(F.col("n"), 100).alias("g"), C.format_number(F.col("n") * 100_000, "fr").alias("f")).collect()
    assert [r.g for r in rows] == ["green", "orange", "red"] and rows[2].f == "10\u00a0000\u00a0000"
    assert format_number(1234567, "en") == "1,234,567"


def test_messages():
    assert MESSAGES["fr"].keys() == MESSAGES["en"].keys()
    try:
        set_language("en")
        assert t("status.ready") == "Ready" and t("no.key") == "no.key" and t("inventory.unsupported", ext=".x").endswith(".x")
        set_language("xx")
        assert t("status.ready") == "Prêt"
    finally:
        set_language("fr")


def test_globs(spark):
    names = ["~$a.docx", "Thumbs.db", "thumbs.db", "a_rapport.md", "corpus.md", "a[1].txt", "b2.txt", "x\ny.txt"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    hit = lambda *p: {r.n for r in df.where(C.matches_any(F.col("n"), p)).collect()}
    assert hit("~$*", "Thumbs.db", "*_rapport.md", "corpus.md") == {"~$a.docx", "Thumbs.db", "a_rapport.md", "corpus.md"}
    assert hit("b[0-9].txt") == {"b2.txt"} and hit("x*.txt") == {"x\ny.txt"} and hit("*[!2].txt") == {"a[1].txt", "x\ny.txt"}


def test_shorter_is_the_length_of_the_stripped_text(spark):
    texts = ["", " ", "a", " a ", "ab", "a b", "\u00a0a\n\n b\u3000", "x" * 80, "x" * 79, " " * 90 + "x", "x" + " " * 90, "x" + " " * 78 + "y", "x" + "\n" * 77 + "y", "😀" * 80, "😀" * 79, "é" * 40 + " " * 60 + "é" * 39]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for least in (0, 1, 2, 3, 80):
        assert [r.s for r in df.select(C.shorter(F.col("x"), least).alias("s")).collect()] == [len(x.strip()) < least for x in texts]


def test_engines_fall_back():
    from lodestack.functions import tokenizers

    assert tokenizers.resolve("mistral").id == "approx" and tokenizers.resolve("nope").id == "approx"
    assert [e.id for e in tokenizers.list_engines()] == ["approx", "mistral", "openai"]


def test_the_pattern_is_that_of_the_engine():
    import regex

    from lodestack.functions import tokenizers

    split = lambda name, text: regex.findall(tokenizers.PATTERNS.get(name, tokenizers.BYTE_LEVEL), text)
    assert split("openai", "year 20261 isn't//\n\nHelloWorld") == ["year", " ", "202", "61", " isn't", "//\n\n", "Hello", "World"]
    assert split("mistral", "year 20261 isn't") == ["year", " 20261", " isn", "'t"]
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if os.path.exists(path):
        old, new = tokenizers.encoding(path), tokenizers.encoding(path, tokenizers.O200K)
        assert new.encode_ordinary("123456789") == old.encode_ordinary("123") + old.encode_ordinary("456") + old.encode_ordinary("789")
        tokenizers.configure("openai", path)
        try:
            assert tokenizers.resolve("openai").counter()("123456789") == len(new.encode_ordinary("123456789"))
        finally:
            tokenizers.configure("openai", None)


def test_engines_can_be_added(spark):
    from lodestack.functions import tokenizers

    tokenizers.register("words", lambda text: len(text.split()))
    try:
        engine = tokenizers.resolve("words")
        assert [e.id for e in tokenizers.list_engines()] == ["approx", "mistral", "openai", "words"] and tokenizers.available("words")
        df = spark.createDataFrame([("a b  c",), (None,)], "text string")
        assert [r.n for r in df.select(tokenizers.token_count(F.col("text"), engine).alias("n")).collect()] == [3, 0]
    finally:
        tokenizers.unregister("words")
    assert tokenizers.resolve("words").id == "approx"


def test_precise_engine(spark):
    from lodestack.functions import tokenizers

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    tokenizers.configure("openai", path)
    try:
        engine = tokenizers.resolve("openai")
        texts = ["", "Hello world, hello", "accentué", "A" * 5000, "日本語", "def f(x):\n    return x", "😀"]
        df = spark.createDataFrame([(i, x, f"f{i}", "txt", len(x), 0, 0, "ready", "utf-8") for i, x in enumerate(texts)], "i int, text string, relative_path string, file_type string, size_bytes int, page_count int, image_count int, base_status string, encoding string")
        e = tokenizers.encoding(path, tokenizers.O200K)
        rows = {r.i: r for r in budget.with_estimate(df.withColumn("n", tokenizers.token_count(F.col("text"), engine)), 0.15, engine).collect()}
        for i, x in enumerate(texts):
            r = rows[i]
            assert r.n == len(e.encode_ordinary(x))
            h = header(r.asDict(), r.tokens_estimated, r.tokens_with_margin)
            assert r.tokens_estimated == len(e.encode_ordinary(h + "\n\n")) + r.n and r.bytes_utf8 == len(f"{h}\n\n{x}".encode())
    finally:
        tokenizers.configure("openai", None)
