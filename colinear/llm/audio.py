"""Audio features of media columns: log-mel tensors and energy segments with time spans.

Media are WAV files (8-bit unsigned PCM, one channel). Features of a file:

* the samples are resampled by up/down through a windowed-sinc filter in
  polyphase form: each output phase is one dot product with its own taps;
* overlapped Hann frames give power spectra, a triangular mel filterbank and the
  log give the log-mel frames;
* frames whose energy passes a high threshold open a segment, which ends where
  the energy falls below a low one (hysteresis);
* the frames are cut into tensors of one fixed shape (``PATCH`` x ``MELS``,
  float32), the last one padded with the floor, each with its time span. They are
  stored as an Arrow IPC stream with the canonical fixed-shape tensor type.

A file is worked off in runs of frames. Its bytes, its resampled signal and its tensors
are held at once: some 14 times the size of a long file. Its features depend on its own bytes only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.session import table

RATE, TO_RATE = 8000, 6000
#: Frame and hop in samples at the new rate, FFT length, mel bands, frames of a tensor.
FRAME, HOP, FFT, MELS, PATCH = 150, 60, 256, 32, 64
#: Sinc lobes on each side, frames worked off at a time, log floor.
LOBES, RUN, FLOOR = 6, 2048, 1e-10
#: Hysteresis thresholds above the mean energy of the file, in natural log units.
HIGH, LOW = 0.15, -0.15
#: Payload bytes come in multiples of this.
PAD = 192
RIFF = struct.Struct("<4sI4s4sIHHIIHH4sI")


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit unsigned samples, one channel."""
    pad = b"\0" * (len(samples) % 2)
    return RIFF.pack(b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + pad


def read_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a WAV file of 8-bit samples and one channel; other chunks are skipped."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("8-bit PCM with one channel is read only")
        elif kind == b"data":
            if rate is None or at + 8 + size > len(media):
                raise ValueError("a WAV file is cut short or has no format")
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file has no data")


@lru_cache(maxsize=8)
def phases(rate: int, to_rate: int) -> tuple[int, int, np.ndarray]:
    """(up, down, taps of each output phase): a Hann-windowed sinc at the lower of the two Nyquist rates."""
    g = gcd(rate, to_rate)
    up, down = to_rate // g, rate // g
    width = LOBES * max(up, down) / up  # in input samples
    half = int(np.ceil(width)) + 1
    taps = np.empty((up, 2 * half), np.float32)
    for p in range(up):
        x = np.arange(-half + 1, half + 1) - (p * down % up) / up
        cut = min(1.0, up / down)
        h = np.sinc(x * cut) * np.where(np.abs(x) < width, 0.5 + 0.5 * np.cos(np.pi * x / width), 0.0)
        taps[p] = h / h.sum()
    return up, down, taps


def resample(x: np.ndarray, rate: int, to_rate: int) -> np.ndarray:
    """Polyphase resampling; the ends are padded with silence."""
    up, down, taps = phases(rate, to_rate)
    half = taps.shape[1] // 2
    n = -(-len(x) * up // down)
    padded = np.zeros(len(x) + 2 * half + down, np.float32)
    padded[half - 1 : half - 1 + len(x)] = x
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)
    out = np.empty(-(-n // up) * up, np.float32)
    for p in range(up):
        first = p * down // up
        rows = windows[first : first + (len(out) // up - 1) * down + 1 : down]
        got = rows @ taps[p]
        out[p::up][: len(got)] = got
        out[p::up][len(got) :] = 0
    return out[:n]


@lru_cache(maxsize=8)
def filterbank(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(Hann window, triangular mel filters as bins x bands)."""
    mel = lambda f: 2595.0 * np.log10(1 + f / 700.0)
    edges = 700.0 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595.0) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.hanning(FRAME + 1)[:-1].astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """Log-mel frames (frames x bands); the signal is padded with silence, so that the last frame covers its end."""
    window, bank = filterbank(rate)
    x = np.pad(x, (0, FRAME + HOP * max(0, -(-(len(x) - FRAME) // HOP)) - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    for a in range(0, len(frames), RUN):
        spectrum = np.fft.rfft(frames[a : a + RUN] * window, FFT, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[a : a + RUN] = np.log(power @ bank + np.float32(FLOOR))
    return out


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """[first, last) frames of the active segments by hysteresis on the mean log energy."""
    energy = mel.mean(axis=1)
    energy = energy - energy.mean()
    state = np.where(energy > HIGH, 1, np.where(energy < LOW, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    active = np.where(known >= 0, state[known], 0)
    steps = np.diff(np.concatenate([[0], active, [0]]))
    return list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True))


def seconds(frame: int, rate: int) -> float:
    return frame * HOP / rate


def patches(mel: np.ndarray) -> np.ndarray:
    """The frames as tensors of one shape, the last padded with the log of the floor."""
    n = -(-len(mel) // PATCH)
    out = np.full((n * PATCH, MELS), np.float32(np.log(FLOOR)), np.float32)
    out[: len(mel)] = mel
    return out.reshape(n, PATCH, MELS)


def tensor_stream(mel: np.ndarray, rate: int) -> bytes:
    """An Arrow IPC stream: ``start_s, end_s, log_mel`` (fixed-shape tensor of float32)."""
    p = patches(mel)
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(p)
    starts = [seconds(i * PATCH, rate) for i in range(len(p))]
    ends = [seconds(min((i + 1) * PATCH, len(mel)), rate) for i in range(len(p))]
    batch = pa.RecordBatch.from_arrays([pa.array(starts, pa.float64()), pa.array(ends, pa.float64()), column], ["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(tensors, their spans in seconds) of an Arrow IPC stream, see ``tensor_stream``."""
    t = pa.ipc.open_stream(stream).read_all()
    return t.column("log_mel").combine_chunks().to_numpy_ndarray(), list(zip(t.column("start_s").to_pylist(), t.column("end_s").to_pylist(), strict=True))


def described(media: bytes) -> tuple[bytes, list[dict[str, float]], int]:
    """(tensor stream, active segments in seconds, number of frames) of a WAV file."""
    mel, active = features(media)
    return tensor_stream(mel, TO_RATE), [{"start_s": seconds(x, TO_RATE), "end_s": seconds(y, TO_RATE)} for x, y in active], len(mel)


def features(media: bytes, to_rate: int = TO_RATE) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(log-mel frames, active segments) of a WAV file."""
    rate, samples = read_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x, rate, to_rate), to_rate)
    return mel, segments(mel)


def audio_features(rows: DataFrame, id_col: str, media: str) -> DataFrame:
    """``id_col, tensors, segments, n_frames`` of a column of WAV files.

    ``tensors``: Arrow IPC stream (see ``tensor_stream``); ``segments``: array of
    (start_s, end_s). A null file gives nulls; a damaged one fails the job.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(media).alias("media"))
    kind = dict(rows.dtypes)["id"]
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[list] = [[], [], []]
            for m in b.column("media"):
                for c, v in zip(got, described(m.as_py()) if m.is_valid else (None, None, None), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got[0], pa.binary()), pa.array(got[1], spans), pa.array(got[2], pa.int64())], ["id", "tensors", "segments", "n_frames"])

    return rows.mapInArrow(run, f"id {kind}, tensors binary, segments array<struct<start_s: double, end_s: double>>, n_frames long").withColumnRenamed("id", id_col)


def payload_of(text: str) -> tuple[int, bytes]:
    """(bytes of the text, bytes with blanks up to a positive multiple of ``PAD``)."""
    raw = text.encode()
    return len(raw), raw + b" " * (max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def media_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every whole text as a WAV file, reads it back and describes it: one row per document.

    ``feature`` is read off the stored tensors (as ``audio_features`` gives them):
    frames, tensors, the time that their spans cover, active segments and seconds,
    mean of the tensors, and a digest of them and of all spans. Null texts count as
    empty; an empty text is 192 blanks.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    arrow = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[list] = [[] for _ in arrow]
            for t in b.column("text"):
                n, payload = payload_of(t.as_py())
                media = write_wav(payload)
                _, back = read_wav(media)
                stream, active, frames = described(media)
                tensors, spans = read_tensors(stream)
                spoken = [(x["start_s"], x["end_s"]) for x in active]
                digest = zlib.crc32(np.array([*spans, *spoken], np.float64).tobytes(), zlib.crc32(np.round(tensors, 2).tobytes()))
                feature = f"frames={frames};tensors={len(tensors)};covers_s={spans[-1][1] - spans[0][0]:.2f};segments={len(spoken)};active_s={sum(y - x for x, y in spoken):.2f};mean={float(tensors.mean(dtype=np.float64)):.4f};crc32={digest:08x}"
                for c, v in zip(got, (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, k) for c, k in zip(got, arrow, strict=True)]], [x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
