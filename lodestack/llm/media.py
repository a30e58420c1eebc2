"""Operator 4, media columns: audio stored losslessly, and its features.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576,
are stored as the 8-bit unsigned samples of a mono WAV file.  The features come
from the samples read back from that file: polyphase resampling from 24 kHz to
16 kHz, overlapped log-mel filterbanks, and segments found by two energy
thresholds (hysteresis).  The log-mel frames are cut into patches of a fixed
shape, each with its time span, and stored as an Arrow stream: a record batch of
start, end and a fixed-shape-tensor column (``to_tensors``, ``from_tensors``).
Frame counts, means and the digest in ``feature`` are those of what is read back from it.

All is computed in doubles and stored as floats; the digest is over sixteenths, so that
another processor's order of summing does not show but in a value that lies within some
1e-7 of an edge.

Defined results: a null or empty text is 576 bytes of 255; equal texts give
equal values, because each text is computed alone, in blocks of fixed size; of a
text of any length, samples and spectra are made for ``FRAMES`` frames at a time, and
only its bytes and its log-mel frames are held whole; repeated rows give
repeated rows; an empty table gives an empty table; only the id and the text
column are read, so other columns and their names do not matter; a null id
stays null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .bytescan import text_blocks

UNIT, FILL = 576, 255
STORED_RATE, RATE, UP, DOWN = 24_000, 16_000, 2, 3
WIDTH, HOP, FFT, BANDS = 400, 160, 512, 40
#: Frames of a patch, frames worked on at a time.
PATCH, FRAMES = 16, 4096
#: Hysteresis, in units of the natural log of a frame's mean power over the file's median.
RISE, FALL = 0.12, 0.02
SILENCE = 1e-6

#: The columns after doc_id, each with its type in Spark and in Arrow.
SPAN = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
COLUMNS = {
    "n_bytes": ("long", pa.int64()), "payload_bytes": ("long", pa.int64()), "payload_sha256": ("string", pa.string()),
    "tail_crc32": ("long", pa.int64()), "media_bytes": ("long", pa.int64()), "media_sha256": ("string", pa.string()),
    "feature": ("string", pa.string()), "n_frames": ("long", pa.int64()), "n_segments": ("long", pa.int64()),
    "segments": ("array<struct<start_s: double, end_s: double>>", pa.list_(SPAN)), "tensors": ("binary", pa.binary()), "wav": ("binary", pa.binary()),
}
TENSOR = pa.fixed_shape_tensor(pa.float32(), (PATCH, BANDS), dim_names=("frame", "band"))


def padded(text: bytes) -> bytes:
    size = max(1, -(-len(text) // UNIT)) * UNIT
    return text + bytes([FILL]) * (size - len(text))


def to_wav(payload: bytes) -> bytes:
    """A canonical RIFF/WAVE file: one channel of 8-bit unsigned samples."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, STORED_RATE, STORED_RATE, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def from_wav(stored: bytes) -> tuple[int, bytes]:
    """(rate, samples); chunks other than ``fmt`` and ``data`` are passed over."""
    riff, _, wave = struct.unpack_from("<4sI4s", stored)
    if riff != b"RIFF" or wave != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        kind, size = struct.unpack_from("<4sI", stored, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is stored here")
        elif kind == b"data":
            return rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=1)
def _phases() -> list[tuple[int, np.ndarray]]:
    """Per output phase: how far its first tap lies from the start, and its taps, last input first."""
    half = 8 * max(UP, DOWN)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(UP, DOWN)) * np.hamming(2 * half + 1)
    taps *= UP / taps.sum()
    pad = np.zeros(UP - 1 + len(taps) + UP)
    out = []
    for r in range(UP):
        base, phase = divmod(r * DOWN + half, UP)
        pad[:] = 0
        pad[: len(taps)] = taps
        mine = pad[phase::UP]
        mine = mine[: -(-(len(taps) - phase) // UP)]
        out.append((base, mine[::-1].copy()))
    return out


def resample(x: np.ndarray, low: int, high: int) -> np.ndarray:
    """Samples ``low`` to ``high`` of the 8-bit samples ``x`` at ``RATE``: only the filter phases that are needed are computed."""
    y = np.zeros(high - low)
    for r, (base, taps) in enumerate(_phases()):
        j, end = max(0, -(-(low - r) // UP)), -(-(high - r) // UP)
        if end <= j:
            continue
        first = base - (len(taps) - 1) + DOWN * j
        last = first + DOWN * (end - j - 1) + len(taps)
        part = np.zeros(last - first)
        a, b = max(first, 0), min(last, len(x))
        if b > a:
            part[a - first : b - first] = (x[a:b].astype(np.float64) - 128) / 128
        y[r + UP * j - low :: UP] = np.lib.stride_tricks.sliding_window_view(part, len(taps))[::DOWN] @ taps
    return y


@lru_cache(maxsize=1)
def _mel() -> tuple[np.ndarray, np.ndarray]:
    top = 2595 * np.log10(1 + RATE / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * RATE / FFT
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))
    return np.hanning(WIDTH), np.ascontiguousarray(bank.T)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames x bands of 8-bit samples; at least one frame, the last filled with silence."""
    window, bank = _mel()
    n = -(-len(x) * UP // DOWN)
    count = 1 + max(0, -(-(n - WIDTH) // HOP))
    out = np.empty((count, BANDS), dtype=np.float32)
    for at in range(0, count, FRAMES):
        end = min(at + FRAMES, count)
        y = np.zeros((end - 1 - at) * HOP + WIDTH)
        stop = min(n, at * HOP + len(y))
        y[: stop - at * HOP] = resample(x, at * HOP, stop)
        frames = np.lib.stride_tricks.sliding_window_view(y, WIDTH)[::HOP]
        spectrum = np.fft.rfft(frames * window, FFT)
        out[at:end] = np.log((spectrum.real**2 + spectrum.imag**2) @ bank + SILENCE)
    return out


def segments(level: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of runs that rise over ``RISE`` and last until the level falls under ``FALL``."""
    state = np.where(level >= RISE, 1, np.where(level < FALL, 0, -1))
    known = np.flatnonzero(state >= 0)
    if not len(known):
        return []
    last = np.searchsorted(known, np.arange(len(level)), side="right") - 1
    active = np.where(last >= 0, state[known[np.maximum(last, 0)]], 0)
    edges = np.diff(np.concatenate([[0], active, [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def audio_features(stored: bytes) -> dict:
    """Log-mel frames and segments of a WAV file's samples."""
    _, samples = from_wav(stored)
    mel = log_mel(np.frombuffer(samples, dtype=np.uint8))
    energy = mel.mean(axis=1, dtype=np.float64)
    return {"mel": mel, "segments": segments(energy - np.median(energy))}


def span(first: int, end: int) -> dict[str, float]:
    """The seconds that the frames from ``first`` up to ``end`` cover."""
    return {"start_s": first * HOP / RATE, "end_s": (end - 1) * HOP / RATE + WIDTH / RATE}


def to_tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of one batch: start_s, end_s and a PATCH x BANDS tensor a row; the last one is filled with the log of silence."""
    rows = -(-len(mel) // PATCH)
    cells = np.full((rows * PATCH, BANDS), np.log(SILENCE), dtype=np.float32)
    cells[: len(mel)] = mel
    spans = pa.array([span(i * PATCH, min((i + 1) * PATCH, len(mel))) for i in range(rows)], SPAN)
    tensors = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), PATCH * BANDS))
    batch = pa.RecordBatch.from_arrays([*spans.flatten(), tensors], names=["start_s", "end_s", "mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_tensors(stored: bytes) -> tuple[np.ndarray, pa.RecordBatch]:
    """The log-mel frames, without the filling, and the batch of spans and tensors."""
    with pa.ipc.open_stream(stored) as reader:
        batch = reader.read_next_batch()
    cells = batch.column("mel").to_numpy_ndarray().reshape(-1, BANDS)
    last = batch.column("end_s")[batch.num_rows - 1].as_py()
    return cells[: round((last * RATE - WIDTH) / HOP) + 1], batch


def _row(text: bytes) -> dict:
    stored = to_wav(padded(text))
    _, payload = from_wav(stored)
    found = audio_features(stored)
    tensors, spans = to_tensors(found["mel"]), found["segments"]
    mel, _ = from_tensors(tensors)
    grid = np.round(mel.astype(np.float64) * 16).astype("<i2")
    mean = ",".join(f"{v:.2f}" for v in mel.mean(axis=0, dtype=np.float64)[:: BANDS // 8])
    return {
        "n_bytes": len(text), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(),
        "feature": f"frames={len(mel)};segments={len(spans)};voiced={sum(b - a for a, b in spans)};mel={mean};sha1={hashlib.sha1(grid.tobytes()).hexdigest()}",
        "n_frames": len(mel), "n_segments": len(spans), "segments": [span(a, b) for a, b in spans], "tensors": tensors, "wav": stored,
    }


def audio_table(df: DataFrame, text: str = "text", id: str = "doc_id", leave: tuple[str, ...] = ("wav",)) -> DataFrame:
    """doc_id and ``COLUMNS`` but those to ``leave`` out, a row per row of ``df``."""
    types = {k: t for k, t in COLUMNS.items() if k not in leave}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, raw, offsets in text_blocks(batch.column(1)):
                rows = [_row(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                columns = [pa.array([r[k] for r in rows], type=t) for k, (_, t) in types.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:end], *columns], names=["doc_id", *types])

    narrow = df.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ship(narrow.sparkSession)
    return narrow.mapInArrow(work, ", ".join(["doc_id long", *(f"{k} {t}" for k, (t, _) in types.items())]))
