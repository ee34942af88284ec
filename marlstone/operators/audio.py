"""PCM audio from WAV files: probing, mixing down, resampling to 16 kHz, and cutting into chunks on one timeline.

The output is mono 32-bit float samples at 16 kHz, little-endian. Only PCM WAV can be decoded here; every other container is refused by name.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from pathlib import Path

import numpy as np

from marlstone.model import EngineError

#: The output's rate, and bounds of a request.
RATE, MOST_CHUNKS, MOST_PCM_BYTES, MOST_FILE_BYTES = 16_000, 1_024, 64 << 20, 1 << 30
PER_MILLI = RATE // 1000
#: Input frames that are resampled at once.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Chunk:
    start_millis: int
    end_millis: int
    samples: np.ndarray

    @property
    def payload(self) -> bytes:
        return self.samples.astype("<f4").tobytes()


@dataclass(frozen=True)
class Wave:
    """Where a WAV file's samples lie. ``kind`` 1: integers, 3: floats."""

    kind: int
    channels: int
    rate: int
    bits: int
    offset: int
    frames: int


def chunk_samples(start: int, end: int, chunk_millis: int, most: int) -> int:
    """Samples of a chunk, no more than the window's, for a request (milliseconds) that is within bounds before anything is opened."""
    if chunk_millis <= 0 or not 1 <= most <= MOST_CHUNKS or start < 0 or end < start or end > (2**63 - 1) // PER_MILLI:
        raise EngineError("audio_request", f"audio needs a chunk length, 1 to {MOST_CHUNKS} chunks and a window from 0 on")
    window = (end - start) * PER_MILLI
    chunk = min(chunk_millis * PER_MILLI, window)
    if min(window, chunk * most) * 4 > MOST_PCM_BYTES:
        raise EngineError("payload_budget", "decoded audio would exceed 64 MiB")
    return chunk


def probe(path: str) -> Wave:
    """The format and extent of a PCM WAV file."""
    size = Path(path).stat().st_size
    if size > MOST_FILE_BYTES:
        raise EngineError("media_limit", "media files may have 1 GiB at most")
    with open(path, "rb") as f:
        head = f.read(12)
        if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
            raise EngineError("unsupported_container", "only PCM WAV can be decoded here")
        form = None
        while len(chunk := f.read(8)) == 8:
            name, length = chunk[:4], int.from_bytes(chunk[4:], "little")
            if name == b"fmt ":
                raw = f.read(length)
                if len(raw) < 16:
                    break
                kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
                if kind == 0xFFFE and len(raw) >= 26:
                    kind = int.from_bytes(raw[24:26], "little")
                form = (kind, channels, rate, bits)
            elif name == b"data" and form:
                kind, channels, rate, bits = form
                if (kind, bits) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)) or not channels or not rate:
                    raise EngineError("unsupported_codec", f"WAV format {kind} with {bits} bits")
                room = min(length, size - f.tell())
                return Wave(*form, f.tell(), room // (channels * bits // 8))
            else:
                f.seek(length, 1)
            if length % 2:
                f.seek(1, 1)
    raise EngineError("unsupported_container", "a WAV file without format or data")


def audio_metadata(path: str) -> tuple[int, int]:
    """Start and end of a file's audio in milliseconds: the start rounded down, the end up."""
    wave = probe(path)
    return 0, -(-wave.frames * 1000 // wave.rate)


def media_metadata(path: str) -> tuple[int | None, int, int]:
    """Milliseconds, video streams and audio streams."""
    return audio_metadata(path)[1], 0, 1


def _mono(raw: bytes, wave: Wave) -> np.ndarray:
    if wave.kind == 3:
        x = np.frombuffer(raw, f"<f{wave.bits // 8}").astype(np.float32)
    elif wave.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif wave.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{wave.bits // 8}").astype(np.float32) / np.float32(2.0 ** (wave.bits - 1))
    return x.reshape(-1, wave.channels).mean(1, dtype=np.float32)


class Assembler:
    """Chunks of equal length on a grid that begins with the first sample at or after the start. Gaps beyond the tolerance are silence, overlaps are clipped; the last chunk may be shorter."""

    def __init__(self, start: int, end: int, chunk: int, most: int, tolerance: int = 1):
        self.start, self.end, self.chunk, self.most, self.tolerance = start * PER_MILLI, end * PER_MILLI, chunk, most, tolerance
        self.next: int | None = None
        self.held: list[np.ndarray] = []
        self.held_from = self.size = 0
        self.chunks: list[Chunk] = []

    @property
    def finished(self) -> bool:
        return len(self.chunks) == self.most or (self.next is not None and self.next >= self.end)

    def push(self, at: int, samples: np.ndarray) -> None:
        """``samples`` whose first one is number ``at`` of the output's timeline; numbers before 0 are allowed."""
        samples = samples[max(0, self.start - at) :] if at < self.start else samples
        at = max(at, self.start)
        if at >= self.end or not len(samples) or len(self.chunks) == self.most:
            return
        if self.next is None:
            self.next = at
        if at > self.next + self.tolerance:
            self._append(np.zeros(min(at, self.end) - self.next, np.float32))
        elif at + self.tolerance < self.next:
            samples = samples[self.next - at :]
        self._append(samples)

    def _append(self, samples: np.ndarray) -> None:
        while len(samples) and not self.finished:
            own = samples[: min(self.chunk - self.size, self.end - self.next)]
            if not self.size:
                self.held_from = self.next
            self.held.append(own)
            self.size += len(own)
            self.next += len(own)
            samples = samples[len(own) :]
            if self.size == self.chunk:
                self._flush()

    def _flush(self) -> None:
        if self.size and len(self.chunks) < self.most:
            self.chunks.append(Chunk(self.held_from // PER_MILLI, (self.held_from + self.size) // PER_MILLI, np.concatenate(self.held)))
        self.held, self.size = [], 0

    def finish(self) -> list[Chunk]:
        self._flush()
        return self.chunks


def decode(path: str, start: int, end: int, chunk_millis: int, most: int) -> list[Chunk]:
    """At most ``most`` chunks of the window from ``start`` to ``end`` milliseconds. Only the window is read, in blocks."""
    chunk = chunk_samples(start, end, chunk_millis, most)
    if not chunk:
        return []
    wave = probe(path)
    last = -(-wave.frames * RATE // wave.rate)
    out, at = Assembler(start, end, chunk, most), start * PER_MILLI
    width = wave.channels * wave.bits // 8
    with open(path, "rb") as f:
        while at < min(end * PER_MILLI, last) and not out.finished:
            stop = min(at + BLOCK, last)
            low, high = at * wave.rate // RATE, min(wave.frames, (stop - 1) * wave.rate // RATE + 2)
            f.seek(wave.offset + low * width)
            x = _mono(f.read((high - low) * width), wave)
            if not len(x):
                break
            spots = np.arange(at, stop, dtype=np.float64) * wave.rate / RATE - low
            out.push(at, x if wave.rate == RATE else np.interp(spots, np.arange(len(x)), x).astype(np.float32))
            at = stop
    return out.finish()
