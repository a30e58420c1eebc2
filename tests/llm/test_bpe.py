"""The streaming transducer against the tokenizers library and against merging whole pieces."""

import hashlib
import random

import numpy as np
import pytest

from lodestack.llm import bpe
from lodestack.llm.tables import table

from .helpers import EDGE, LONG, docs

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
ODD = [
    "", "Hello  World's it'S <|endoftext|>x<|endoftext|> <|STARTOFTEXT|>", "a" * 10_000, "日本語のテキスト" * 900, "😀🎉" * 700, "x\x1cy \x1d z\x85w", "ΑΣ ΣΑΣ İstanbul ẞ",
    "!?" * 3000, "́a é ñ Ᲊᲊ \U00010d50x", "the" * 4000 + " end", "1234 ١٢٣ Ⅷ", "'ll 'LL '' 'x",
]


@pytest.fixture(scope="module")
def rules():
    return bpe.read(PATH)


@pytest.fixture(scope="module")
def library():
    out = tokenizers.Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


def ids_of(encoder, text):
    return np.frombuffer(b"".join(encoder.encode(text)), "<u4")


def check(encoder, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    ids = ids_of(encoder, text)
    assert ids.tolist() == want, text[:80]
    machine = bpe.Decoder(encoder.rules)
    cut = len(ids) // 3
    assert machine.feed(ids[:cut]) + machine.feed(ids[cut:]) + machine.finish() == library.decode(want, skip_special_tokens=False)


def test_texts_as_the_library_encodes_and_decodes_them(rules, library):
    encoder, rng = bpe.Encoder(rules), random.Random(5)
    signs = "abcdefghijklmnopqrstuvwxyz  '0123ÉéßñŁΣ.,!-#́日本\U0001f600\n"
    words = [w.decode() for w in rules.plain if len(w) > 2 and w.isascii()]
    for text in [*ODD, LONG[:50_000]] + ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(400)] + ["".join(rng.choice(words).strip() for _ in range(60)) for _ in range(60)]:
        check(encoder, library, text)


@pytest.mark.parametrize("size", [1, 7, 300])
def test_slices_and_forgetting_change_nothing(rules, library, monkeypatch, size):
    monkeypatch.setattr(bpe, "SLICE", size)
    monkeypatch.setattr(bpe, "WORDS", 3)
    monkeypatch.setattr(bpe, "PIECES", 3)
    encoder = bpe.Encoder(rules)
    for text in [x[:3000] for x in ODD]:
        check(encoder, library, text)


def small_rules(seed, n=12, letters="ab"):
    """A list of merges as training makes them: each of two tokens that are known by then."""
    rng, known, made = random.Random(seed), list(letters), []
    while len(made) < n:
        a, b = rng.choice(known), rng.choice(known)
        if a + b not in known and len(a + b) < 9:
            known.append(a + b)
            made.append((a, b))
    return made


def merge_all(text, rules):
    tokens = list(text)
    for a, b in rules:
        i = 0
        while i < len(tokens) - 1:
            if tokens[i] == a and tokens[i + 1] == b:
                tokens[i : i + 2] = [a + b]
            i += 1
    return tokens


@pytest.mark.parametrize("seed", range(25))
def test_lookahead_suffices(seed):
    """Tokens that end that far before the end stay, whatever follows."""
    rules, rng = small_rules(seed), random.Random(seed)
    far = bpe.lookahead(rules)
    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(far + 30))
        stable, at = [], 0
        for token in merge_all(text, rules):
            at += len(token)
            if at > len(text) - far:
                break
            stable.append(token)
        for _ in range(4):
            more = merge_all(text + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))), rules)
            assert more[: len(stable)] == stable
    assert bpe.lookahead([]) == 0 and bpe.lookahead([("a", "b")]) == 1


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe.lookahead([("ab", "c"), ("a", "b")])


def test_transducer_emits_what_the_whole_piece_gives(rules):
    rng = random.Random(2)
    whole = rules.inner[np.frombuffer("".join(rng.choice("etaoinshrdlu") for _ in range(3 * rules.window)).encode(), np.uint8)]
    want = bpe.merged(whole, rules)
    machine, got, held = bpe.Transducer(rules), [], 0
    for at in range(0, len(whole), 1000):
        for tokens in machine.feed(whole[at : at + 1000], last=at + 1000 >= len(whole)):
            got += tokens
        held = max(held, len(machine.held))
    assert got == want and held <= rules.window


def test_plain_text_comes_back_across_ids(rules):
    encoder = bpe.Encoder(rules)
    ids, machine = ids_of(encoder, "déjà 日本 😀 ok"), bpe.Decoder(rules, plain=True)
    assert "".join([machine.feed(ids[i : i + 1]) for i in range(len(ids))]) + machine.finish() == "déjà 日本 😀 ok "
    half = [i for i, x in enumerate(rules.plain) if x == b"\xc3"][:1]
    machine = bpe.Decoder(rules, plain=True)
    assert machine.feed(np.array(half)) == "" and machine.finish() == "�"


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_digests_of_edge_rows(spark, rules, library):
    rows = [*EDGE, *((100 + i, x) for i, x in enumerate(ODD))]
    found = sorted(map(tuple, bpe.digests(docs(spark, rows), rules).collect()), key=str)
    assert found == sorted(((i, *expected(library, x)) for i, x in rows), key=str)
    empty = bpe.digests(docs(spark, []), rules)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_columns_of_ids_and_back(spark, rules, library):
    rows = [(1, "One two, three!"), (2, None), (None, "x")]
    ids = bpe.encoded(docs(spark, rows), rules)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: r.text for r in bpe.decoded(ids, rules).collect()} == {1: "one</w> two</w> ,</w> three</w> !</w>", 2: "", None: "x</w>"}
    assert {r.doc_id: r.text for r in bpe.decoded(ids, rules, plain=True).collect()}[1] == "one two , three ! "


def test_query_equals_the_library(spark, sf_dir, library):
    from lodestack.llm.queries import queries

    want = {r.doc_id: expected(library, r.text) for r in table(spark, sf_dir, "documents").collect()}
    assert {r.doc_id: tuple(r)[1:] for r in queries()["op11_bpe"](spark, sf_dir).collect()} == want
