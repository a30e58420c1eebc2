"""Operator 11, BPE encoding and decoding: a streaming transducer with bounded lookahead.

A merge of the list may be forestalled by an earlier rule that takes some of its symbols,
that one by a still earlier rule, and so on: ranks fall along such a chain, so it ends, and
it reaches only so many symbols to the right.  ``lookahead`` computes that number for every
rule, in the order of the list, from how the rules' strings overlap.  A token whose end lies
that far before the end of what has been read is stable: whatever follows, it stays.  The
transducer reads a window, merges in it, emits the stable tokens, and goes on behind the
last of them, because no merge crosses the border of a token that stays.  So a run of
letters of any length is encoded in constant memory.

Most pieces of a text (runs of letters, single digits, runs of signs) are shorter than a
window and end in it, which makes all their tokens stable at once.  Such pieces are merged
many at a time, each by its rule of lowest rank, leftmost first; a bounded memory of words
keeps the results of frequent ones.

Decoding is a state machine over bytes: ids give bytes, a byte sequence that is not
complete waits for the next id.  A vocabulary without a decoder spells its tokens, with
spaces between them, as the tokenizers library does; ``plain`` gives the bytes themselves
back, with a space at each end of a word.

The scheme is that of the vocabulary file: NFC, lower case, white space dropped, the split
pattern below, byte-level symbols, an end-of-word mark; ``Vocabulary`` refuses files that
say otherwise.  Letters are those of Python's Unicode tables; texts that hold characters
newer than these are normalised and split by the tokenizers library's own tables.

Defined results: null texts count as empty and have no tokens and the digests of nothing;
texts of any length are taken whole, in slices that end at white space, so that beside the
text only a slice, or the longest run without white space, is held; repeated rows and
equal texts give equal rows; a null id stays null; an empty table gives an empty one; only
id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# The split pattern of the vocabulary file, white space as it knows it, and its end of a word.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
END = "</w>"
#: Characters of a text that are normalised and split at a time.
SLICE = 1 << 18
#: Words and pieces remembered by a worker; the longest that is.
WORDS, PIECES, LONGEST = 1 << 19, 1 << 18, 64
#: Symbols up to which a piece is merged among many; longer ones go through the window.
SHORT = 48
NONE = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it shows, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _class(kind: str) -> str:
    """The code points of a general category, as ranges of a pattern."""
    ranges: list[list[int]] = []
    for point in range(0x110000):
        if unicodedata.category(chr(point)).startswith(kind):
            if ranges and ranges[-1][1] == point - 1:
                ranges[-1][1] = point
            else:
                ranges.append([point, point])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(maxsize=1)
def patterns() -> dict[str, re.Pattern]:
    letters, numbers = _class("L"), _class("N")
    ends = "'s|'t|'re|'ve|'m|'ll|'d"
    return {
        "ascii": re.compile(f"{ends}|[a-z]+|[0-9]|[^{SPACE}a-z0-9]+"),
        "any": re.compile(f"{ends}|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+"),
        "space": re.compile(f"[{SPACE}]+"),
    }


def lookahead(rules: list[tuple[str, str]]) -> int:
    """Symbols (characters of the rules' strings) after a token's end from which on nothing can change it.

    For each rule, in order, the farthest that its application may depend on, counted from its
    right end: that of an earlier rule whose string overlaps it, or lies in it, moved by where
    that string ends.  Rules must use only tokens that earlier rules made, each made once.
    """
    made: set[str] = set()
    reach: dict[str, int] = {}
    ending: dict[str, int] = {}
    going_on: dict[str, int] = {}
    within: dict[str, int] = {}
    longest = farthest = 0
    for left, right in rules:
        whole = left + right
        if whole in made or any(len(x) > 1 and x not in made for x in (left, right)):
            raise ValueError(f"not a list of merges in the order they were made: {left} {right}")
        size, far = len(whole), 0
        for j in range(1, size + 1):
            short = size - j
            far = max(far, ending.get(whole[:j], 0) - short, *(reach.get(whole[i:j], 0) - short for i in range(j)))
        for i in range(size):
            far = max(far, going_on.get(whole[i:], 0))
        far = max(far, within.get(whole, 0))
        made.add(whole)
        reach[whole] = far
        for i in range(size):
            ending[whole[i:]] = max(ending.get(whole[i:], 0), far)
        for j in range(1, size):
            out = size - j + far
            going_on[whole[:j]] = max(going_on.get(whole[:j], 0), out)
            for i in range(j):
                within[whole[i:j]] = max(within.get(whole[i:j], 0), out)
        longest, farthest = max(longest, size), max(farthest, far)
    return max(longest - 1, 0) + farthest


class Vocabulary:
    """What the tasks need of a vocabulary file; fixed in size, whatever the corpus."""

    def __init__(self, source: str, known: int | None = None):
        """``known``: the lookahead, where it has been computed already."""
        data = json.loads(source)
        model = data["model"]
        normal = [x["type"] for x in (data.get("normalizer") or {}).get("normalizers", [])]
        split = (data.get("pre_tokenizer") or {}).get("pretokenizers", [])
        right = normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": PATTERN}
        if not right or model["type"] != "BPE" or model["end_of_word_suffix"] != END or data.get("decoder") or any(x["normalized"] for x in data["added_tokens"]):
            raise ValueError("another scheme than lower-cased words with byte-level symbols")
        self.source = source
        vocabulary, symbols = model["vocab"], byte_symbols()
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.inner = np.array([vocabulary[s] for s in symbols], np.int64)
        self.final = np.array([vocabulary[s + END] for s in symbols], np.int64)
        if any(a.endswith(END) for a, _ in pairs):
            raise ValueError("a merge goes on after the end of a word")
        # One character for each symbol, so that lengths of strings are numbers of symbols.
        last = str.maketrans({s: chr(0x1000 + b) for b, s in enumerate(symbols)})
        one = lambda x: x[: -len(END) - 1] + x[-len(END) - 1].translate(last) if x.endswith(END) else x
        self.lookahead = lookahead([(one(a), one(b)) for a, b in pairs]) if known is None else known
        self.window = max(256, 2 * self.lookahead)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        spelled = [b""] * (max([*vocabulary.values(), *self.special.values()], default=-1) + 1)
        plain, of_symbol = list(spelled), {s: bytes([b]) for b, s in enumerate(symbols)}
        for token, id in vocabulary.items():
            spelled[id] = token.encode()
            body, ended = (token[: -len(END)], b" ") if token.endswith(END) else (token, b"")
            plain[id] = b"".join(of_symbol.get(c, c.encode()) for c in body) + ended
        for token, id in self.special.items():
            spelled[id] = token.encode()
            plain[id] = token.encode()
        self.spelled, self.plain = spelled, plain

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``NONE`` where there is no rule."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def read(path: str) -> Vocabulary:
    """The vocabulary in a file of the driver."""
    with open(path, encoding="utf-8") as f:
        return vocabulary(f.read())


@lru_cache(maxsize=2)
def vocabulary(source: str, known: int | None = None) -> Vocabulary:
    return Vocabulary(source, known)


def merged(symbols: np.ndarray, rules: Vocabulary) -> list[int]:
    """One sequence of symbols after all merges, lowest rank first, leftmost first of equal ones."""
    token, n = symbols.tolist(), len(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    ranks = rules.rank_of(symbols[:-1], symbols[1:]).tolist()
    queue = [(r, i, token[i], token[i + 1]) for i, r in enumerate(ranks) if r != NONE]
    heapq.heapify(queue)
    while queue:
        r, i, left, right = heapq.heappop(queue)
        j = after[i]
        if not alive[i] or j >= n or token[i] != left or token[j] != right:
            continue
        token[i], alive[j], after[i] = int(rules.results[r]), False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n:
                r = int(rules.rank_of(np.array([token[a]]), np.array([token[b]]))[0])
                if r != NONE:
                    heapq.heappush(queue, (r, a, token[a], token[b]))
    return [x for x, live in zip(token, alive, strict=True) if live]


class Transducer:
    """Symbols of one piece in, tokens out as soon as they are stable; holds a window of symbols at most."""

    def __init__(self, rules: Vocabulary):
        self.rules, self.sizes = rules, _sizes(rules)
        self.held = np.zeros(0, np.int64)

    def feed(self, symbols: np.ndarray, last: bool) -> Iterator[list[int]]:
        """``last``: the piece ends with these symbols."""
        at = 0
        while True:
            more = symbols[at : at + self.rules.window - len(self.held)]
            at += len(more)
            self.held = np.concatenate([self.held, more])
            ended = last and at >= len(symbols)
            if not ended and len(self.held) < self.rules.window:
                return
            tokens = merged(self.held, self.rules)
            if ended:
                self.held = self.held[:0]
                yield tokens
                return
            ends = np.cumsum(self.sizes[tokens])
            stable = int(np.searchsorted(ends, len(self.held) - self.rules.lookahead, side="right"))
            yield tokens[:stable]
            self.held = self.held[ends[stable - 1] :]


@lru_cache(maxsize=2)
def _sizes(rules: Vocabulary) -> np.ndarray:
    """Symbols of each token."""
    out = np.ones(len(rules.spelled), np.int64)
    for id, token in enumerate(rules.spelled):
        text = token.decode()
        out[id] = max(1, len(text) - len(END) if text.endswith(END) and text != END else len(text))
    return out


def merged_many(pieces: list[bytes], rules: Vocabulary) -> list[bytes]:
    """The ids (32 bits, little-endian) of each piece; every round merges one pair in each piece that still has one."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(x) for x in pieces], np.int64)
    end = np.cumsum(size)
    token, piece = rules.inner[raw], np.repeat(np.arange(len(pieces)), size)
    token[end - 1] = rules.final[raw[end - 1]]
    rank = np.full(len(token), NONE)
    same = np.flatnonzero(piece[:-1] == piece[1:])
    rank[same] = rules.rank_of(token[same], token[same + 1])
    done_token, done_piece = [], []
    while len(token):
        first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        least = np.minimum.reduceat(rank, first)
        counts = np.diff(np.append(first, len(token)))
        closed = np.repeat(least == NONE, counts)
        if closed.any():
            done_token.append(token[closed])
            done_piece.append(piece[closed])
            token, piece, rank = token[~closed], piece[~closed], rank[~closed]
            counts, least = counts[least != NONE], least[least != NONE]
            if not len(token):
                break
        hit = np.flatnonzero(rank == np.repeat(least, counts))
        hit = hit[np.concatenate([[True], piece[hit[1:]] != piece[hit[:-1]]])]
        token[hit] = rules.results[rank[hit]]
        keep = np.ones(len(token), bool)
        keep[hit + 1] = False
        at = hit - np.arange(len(hit))  # where these stand once one symbol of each earlier piece is gone
        token, piece, rank = token[keep], piece[keep], rank[keep]
        for left in (at - 1, at):
            inside = (left >= 0) & (left + 1 < len(token))
            left = left[inside]
            left_piece = piece[left]
            joined = left_piece == piece[left + 1]
            rank[left] = np.where(joined, rules.rank_of(token[left], token[left + 1]), NONE)
        # A symbol that is now its piece's last has no pair.
        final = at[at == len(token) - 1]
        rank[final] = NONE
    token, piece = np.concatenate(done_token), np.concatenate(done_piece)
    order = np.argsort(piece, kind="stable")
    cuts = 4 * np.concatenate([[0], np.cumsum(np.bincount(piece, minlength=len(pieces)))])
    flat = token[order].astype("<u4").tobytes()
    return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class Encoder:
    """Texts to ids, a slice at a time; what it remembers of words is bounded."""

    def __init__(self, rules: Vocabulary):
        self.rules, self.pattern = rules, patterns()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.long: list[tuple[dict, str]] = []
        self.assigned: set[str] = set()
        self.splitter = re.compile("(" + "|".join(re.escape(x) for x in sorted(rules.special, key=len, reverse=True)) + ")") if rules.special else None
        self._library = None

    @property
    def library(self):
        """The tokenizers library, for characters that Python's tables don't have yet."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.rules.source)
        return self._library

    def newer(self, text: str) -> bool:
        """Whether a character of the text is not in Python's tables."""
        unseen = set(text).difference(self.assigned)
        new = {c for c in unseen if unicodedata.category(c) == "Cn"}
        self.assigned |= unseen - new
        return bool(new)

    def parts(self, text: str) -> Iterator[list[str] | bytes]:
        """The words of each slice of a text in order, and the ids of special tokens between."""
        for part in self.splitter.split(text) if self.splitter and "<" in text else [text]:
            if part in self.rules.special:
                yield self.rules.special[part].to_bytes(4, "little")
                continue
            at = 0
            while at < len(part):
                end = len(part) if len(part) - at <= SLICE else self._cut(part, at)
                yield self._words(part[at:end])
                at = end

    def _cut(self, text: str, at: int) -> int:
        """After a white space near the end of the slice, or else the first one behind it."""
        end = max(text.rfind(" ", at, at + SLICE), text.rfind("\n", at, at + SLICE)) + 1
        if end > at:
            return end
        found = re.compile("[ \n]").search(text, at + SLICE)
        return found.end() if found else len(text)

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            if self.newer(text):
                text = self.library.normalizer.normalize_str(text)
            else:
                text = unicodedata.normalize("NFC", text)
                # The library lowers a letter alone; Python gives a word's last sigma another form.
                text = text.replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in self.pattern["space"].split(text) if x]
        return text.split()

    def _split(self, word: str) -> list[str]:
        if word.isascii():
            return self.pattern["ascii"].findall(word)
        if self.newer(word):
            byte = {s: b for b, s in enumerate(byte_symbols())}
            return [bytes(byte[c] for c in x).decode() for x, _ in self.library.pre_tokenizer.pre_tokenize_str(word)]
        return self.pattern["any"].findall(word)

    def _long(self, piece: str) -> bytes:
        raw = np.frombuffer(piece.encode(), np.uint8)
        symbols = self.rules.inner[raw]
        symbols[-1] = self.rules.final[raw[-1]]
        machine = Transducer(self.rules)
        return b"".join(np.array(x, "<u4").tobytes() for x in machine.feed(symbols, last=True))

    def learn(self, words: Iterable[str]) -> None:
        """Makes the ids of these words known."""
        if len(self.words) > WORDS:
            self.words.clear()
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        new = [x for x in set(words).difference(self.words)]
        split = [self._split(x) for x in new]
        unknown = list({p for ps in split for p in ps}.difference(self.pieces))
        raw = [p.encode() for p in unknown]
        short = [i for i, x in enumerate(raw) if len(x) <= SHORT]
        if short:
            self.pieces.update(zip([unknown[i] for i in short], merged_many([raw[i] for i in short], self.rules), strict=True))
        self.pieces.update((p, self._long(p)) for p, x in zip(unknown, raw, strict=True) if len(x) > SHORT)
        get = self.pieces.__getitem__
        self.words.update((x, b"".join(map(get, ps))) for x, ps in zip(new, split, strict=True))
        self.long += [(self.words, x) for x in new if len(x) > LONGEST] + [(self.pieces, x) for x in unknown if len(x) > LONGEST]

    def forget_long(self) -> None:
        """Long words and pieces don't stay."""
        for known, x in self.long:
            known.pop(x, None)
        self.long.clear()

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text, as bytes, slice by slice."""
        for part in self.parts(text):
            if isinstance(part, bytes):
                yield part
            else:
                self.learn(part)
                yield b"".join(map(self.words.__getitem__, part))

    def encode_many(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """For each text its ids, slice by slice; new words of short texts are learnt together."""
        small = sum(map(len, texts)) <= 4 * SLICE
        parts = [list(self.parts(x)) for x in texts] if small else None
        if parts is not None:
            self.learn(w for ps in parts for p in ps if not isinstance(p, bytes) for w in p)
            get = self.words.__getitem__
            for ps in parts:
                yield (p if isinstance(p, bytes) else b"".join(map(get, p)) for p in ps)
        else:
            for x in texts:
                yield self.encode(x)


class Decoder:
    """Ids to text, as they come: bytes of a character that is not complete wait for the next ids."""

    def __init__(self, rules: Vocabulary, plain: bool = False):
        self.table, self.between = (rules.plain, b"") if plain else (rules.spelled, b" ")
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.started = False

    def feed(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        raw = self.between.join(map(self.table.__getitem__, ids.tolist()))
        raw = self.between + raw if self.started else raw
        self.started = True
        return self.state.decode(raw)

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=1)
def _encoder(source: str, known: int) -> Encoder:
    """One for each worker: its words stay known from task to task."""
    return Encoder(vocabulary(source, known))


def groups(texts: list[str | None], most: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``most`` characters, with the number of the first."""
    run, first, total = [], 0, 0
    for i, text in enumerate(texts):
        run.append(text or "")
        total += len(run[-1])
        if total >= most:
            yield first, run
            run, first, total = [], i + 1, 0
    if run:
        yield first, run


def _input(df: DataFrame, text: str, id: str) -> DataFrame:
    return df.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def encoded(df: DataFrame, rules: Vocabulary, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, ids: the token ids of each text."""
    shared = ship(df.sparkSession).sparkContext.broadcast((rules.source, rules.lookahead))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*shared.value)
        for batch in batches:
            for first, texts in groups(batch.column(1).to_pylist()):
                found = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in encoder.encode_many(texts)]
                encoder.forget_long()
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
                lists = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), lists], names=["doc_id", "ids"])

    return _input(df, text, id).mapInArrow(work, "doc_id long, ids array<int>")


def decoded(df: DataFrame, rules: Vocabulary, plain: bool = False, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """doc_id, text from a column of token ids; a null list gives an empty text."""
    shared = ship(df.sparkSession).sparkContext.broadcast((rules.source, rules.lookahead))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(*shared.value)
        for batch in batches:
            texts = []
            for x in batch.column(1).to_pylist():
                machine = Decoder(known, plain)
                texts.append(machine.feed(np.array(x or [], np.int64)) + machine.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{ids}`")).mapInArrow(work, "doc_id long, text string")


def digests(df: DataFrame, rules: Vocabulary, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and, slice by slice, decoded again."""
    shared = ship(df.sparkSession).sparkContext.broadcast((rules.source, rules.lookahead))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*shared.value)
        for batch in batches:
            for first, texts in groups(batch.column(1).to_pylist()):
                count, of_ids, of_text = [], [], []
                for stream in encoder.encode_many(texts):
                    machine, ids, back, n = Decoder(encoder.rules), hashlib.sha256(), hashlib.sha256(), 0
                    for part in stream:
                        ids.update(part)
                        n += len(part) // 4
                        back.update(machine.feed(np.frombuffer(part, "<u4")).encode())
                    back.update(machine.finish().encode())
                    count.append(n)
                    of_ids.append(ids.hexdigest())
                    of_text.append(back.hexdigest())
                encoder.forget_long()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(count, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(df, text, id).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
