"""Media columns: lossless 8-bit audio and its features.

A payload is stored as a mono 8-bit PCM WAV file and read back from those
bytes. The samples are resampled by a polyphase filter, cut into overlapped
frames, and turned into log-mel filterbanks; segments of energy are found with
two thresholds (hysteresis). Filterbanks are stored as fixed-shape Arrow
tensors of FRAMES x MELS half-precision numbers, each with the time span that
it covers. `store` writes media and tensors as a table; `read_back` measures
what is in it.

Defined results: a null or empty text is a payload of 64 zero bytes; the last
tensor is padded with the floor value and its span ends with the last frame;
a payload shorter than a frame has one frame; equal payloads have equal bytes
and features; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import lean, materialise

UNIT = 64
RATE = 8000
#: Resampling by UP / DOWN: 8 kHz to 6 kHz.
UP, DOWN, TAPS = 3, 4, 8
RATE_OUT = RATE * UP // DOWN
#: 32 ms frames every 16 ms at 6 kHz.
SIZE, HOP = 192, 96
MELS = 24
#: Frames of a tensor.
FRAMES = 32
#: Frames that are worked on at once; bounds memory for long payloads.
BLOCK = 4096


def to_payload(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the bytes padded with 0 to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of one channel of unsigned 8-bit samples."""
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = b"WAVE" + head + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples, by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache
def _phases() -> np.ndarray:
    """Windowed-sinc low-pass in UP phases of 2 * TAPS coefficients, unit gain each."""
    n = np.arange(-TAPS * UP, TAPS * UP)
    cut = 1 / max(UP, DOWN)
    h = cut * np.sinc(cut * n) * (0.54 + 0.46 * np.cos(np.pi * n / (TAPS * UP)))
    p = np.stack([h[(r) :: UP][::-1] for r in range(UP)])
    return (p / p.sum(1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, first: int, count: int) -> np.ndarray:
    """Outputs first to first + count of x taken from RATE to RATE_OUT; x is 0 beyond its ends."""
    t = (first + np.arange(count)) * DOWN
    base, phase = t // UP, t % UP
    low = int(base[0]) - TAPS if count else 0
    high = int(base[-1]) + TAPS + 1 if count else 0
    part = np.zeros(high - low, np.float32)
    a, b = max(low, 0), min(high, len(x))
    if b > a:
        part[a - low : b - low] = x[a:b]
    views = np.lib.stride_tricks.sliding_window_view(part, 2 * TAPS)
    out = np.empty(count, np.float32)
    for r in range(UP):
        own = np.flatnonzero(phase == r)
        out[own] = views[base[own] - low - TAPS + 1] @ _phases()[r]
    return out


@lru_cache
def _mel() -> np.ndarray:
    """Triangular filters over the bins of a real FFT, evenly spaced in mel."""
    top = 2595 * np.log10(1 + RATE_OUT / 2 / 700)
    edge = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.linspace(0, RATE_OUT / 2, 128 + 1)
    up = (f[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2])
    down = (edge[2:] - f[:, None]) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@lru_cache
def _window() -> np.ndarray:
    return (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(SIZE) / SIZE)).astype(np.float32)


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows by frame (float32) and the log energy of each frame."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) / 128 - 1
    n_out = max(1, len(x) * UP // DOWN)
    frames = 1 + max(0, n_out - SIZE) // HOP
    mel, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for at in range(0, frames, BLOCK):
        count = min(BLOCK, frames - at)
        y = resample(x, at * HOP, (count - 1) * HOP + SIZE)
        cut = np.lib.stride_tricks.sliding_window_view(y, SIZE)[::HOP]
        spec = np.fft.rfft(cut * _window(), 256, axis=1)
        power = (spec.real**2 + spec.imag**2).astype(np.float32)
        mel[at : at + count] = np.log10(power @ _mel() + 1e-6)
        energy[at : at + count] = 10 * np.log10((cut * cut).mean(1) + 1e-9)
    return mel, energy


def energy_segments(energy: np.ndarray, up: float = 0.5, down: float = 0.5) -> list[tuple[int, int]]:
    """Runs of frames that begin above mean + up * deviation and last until below mean - down * deviation.

    Returned as (first, after last). With no spread at all there is no run.
    """
    mean, dev = float(energy.mean()), float(energy.std())
    if dev < 1e-6:
        return []
    mark = np.where(energy > mean + up * dev, 1, np.where(energy < mean - down * dev, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last] > 0, False)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def tensors(mel: np.ndarray) -> pa.RecordBatch:
    """start_s, end_s and a fixed-shape tensor of FRAMES x MELS per block of frames."""
    n = -(-len(mel) // FRAMES)
    full = np.full((n * FRAMES, MELS), -6, np.float16)
    full[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float16(), (FRAMES, MELS))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), FRAMES * MELS)
    first = np.arange(n) * FRAMES
    last = np.minimum(first + FRAMES, len(mel)) - 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array(first * HOP / RATE_OUT),
            pa.array((last * HOP + SIZE) / RATE_OUT),
            pa.ExtensionArray.from_storage(kind, flat),
        ],
        ["start_s", "end_s", "log_mel"],
    )


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def made(text: str | None) -> dict:
    """What is stored of one text: its unpadded length, media, tensors and energy segments."""
    n, payload = to_payload(text)
    media = write_wav(payload)
    mel, energy = log_mel(read_wav(media)[1])
    runs = energy_segments(energy)
    return {
        "n_bytes": n,
        "media": media,
        "tensors": to_ipc(tensors(mel)),
        "segments": [{"start_s": a * HOP / RATE_OUT, "end_s": ((b - 1) * HOP + SIZE) / RATE_OUT} for a, b in runs],
    }


def told(n: int, media: bytes, ipc: bytes, segments: list[dict]) -> dict:
    """The digests of what was stored, from its bytes."""
    _, back = read_wav(media)
    with pa.ipc.open_stream(ipc) as source:
        batch = source.read_next_batch()
    values = batch.column(2).storage.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    digest = hashlib.sha256(np.round(values * 100).astype("<i2").tobytes()).hexdigest()[:16]
    frames = 1 + round((batch.column(1)[-1].as_py() * RATE_OUT - SIZE) / HOP)
    voiced = sum(round(((s["end_s"] - s["start_s"]) * RATE_OUT - SIZE) / HOP) + 1 for s in segments)
    return {
        "n_bytes": n,
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-UNIT:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"frames={frames};tensors={batch.num_rows};segments={len(segments)};voiced={voiced};mel={digest}",
        "segments": segments,
    }


_KIND = {
    "n_bytes": (pa.int64(), "bigint"),
    "payload_bytes": (pa.int64(), "bigint"),
    "payload_sha256": (pa.string(), "string"),
    "tail_crc32": (pa.int64(), "bigint"),
    "media_bytes": (pa.int64(), "bigint"),
    "media_sha256": (pa.string(), "string"),
    "feature": (pa.string(), "string"),
    "segments": (
        pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])),
        "array<struct<start_s:double,end_s:double>>",
    ),
    "media": (pa.binary(), "binary"),
    "tensors": (pa.binary(), "binary"),
}


STORED = ("n_bytes", "media", "tensors", "segments")
TOLD = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "segments")


def _rows(source: DataFrame, names: tuple[str, ...], one: Callable[..., dict]) -> DataFrame:
    """doc_id and `names` of one(the other columns) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = [one(*x) for x in zip(*[part.column(k).to_pylist() for k in range(1, part.num_columns)])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([r[c] for r in rows], _KIND[c][0]) for c in names]], ["doc_id", *names]
                )

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(lean(run), ", ".join([f"doc_id {kind}", *[f"{c} {_KIND[c][1]}" for c in names]]))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, tensors (an Arrow stream) and segments of every text."""
    return _rows(docs.select("doc_id", "text"), STORED, made)


def read_back(stored: DataFrame) -> DataFrame:
    """doc_id and the columns of `told` from a stored table."""
    return _rows(stored.select("doc_id", *STORED), TOLD, told)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store media and tensors in the shared folder and measure what is there."""
    return read_back(materialise(features(docs), "media", "zstd"))
