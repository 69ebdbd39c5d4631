"""Audio as bytes in a column: WAV containers read with tolerance, silence cut at both ends, tones. Small helpers in pandas functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 2
WAV = "rate int, channels int, width int, format int, pcm binary, fault string"
TRIMMED = "pcm binary, offset double"


def wav(content: bytes | None) -> tuple:
    """(rate, channels, bytes a sample, format, PCM, fault) of a RIFF container. A data size of nothing or beyond the end means all that follows."""
    fault = lambda why: (None, None, None, None, None, why)
    if content is None or len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return fault("no RIFF/WAVE header")
    at, kind = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        at += 8
        if name == b"fmt ":
            if size < 16 or at + 16 > len(content):
                return fault("a bad format chunk")
            kind = np.frombuffer(content, "<u2", 8, at)
        elif name == b"data":
            if kind is None:
                return fault("data before the format")
            left = len(content) - at
            rate = int(kind[2]) | int(kind[3]) << 16
            return rate, int(kind[1]), int(kind[7]) // 8, int(kind[0]), content[at : at + (size if 0 < size <= left else left)], None
        at += size + size % 2
    return fault("no data")


def trimmed(pcm: bytes, rate: int, threshold_db: float, margin_ms: int) -> tuple[bytes, float]:
    """PCM (16 bits, mono) without the silence at its ends, but for a margin, and how many seconds went at the beginning.

    Windows of 10 ms are loud if their peak is above the threshold; those from the beginning count from there, those
    from the end from the end. Silence alone leaves nothing.
    """
    samples = np.abs(np.frombuffer(pcm, "<i2", len(pcm) // WIDTH).astype(np.int32))
    n, step, least = len(samples), max(1, rate // 100), 32768 * 10 ** (threshold_db / 20)
    if not n:
        return pcm, 0.0
    loud = np.flatnonzero(samples > least)
    if not len(loud):
        return b"", 0.0
    start = int(loud[0]) // step * step
    # The windows from the end: the last loud sample is in that which ends at so many steps before it.
    end = n - (n - 1 - int(loud[-1])) // step * step
    margin = int(rate * margin_ms / 1000)
    start, end = max(0, start - margin), min(n, end + margin)
    return pcm[start * WIDTH : end * WIDTH], start / rate


def tone(hertz: float, seconds: float, rate: int, level_db: float = -12.0) -> bytes:
    """A sine of 16 bits, mono."""
    n = int(rate * seconds)
    return (32767 * 10 ** (level_db / 20) * np.sin(2 * np.pi * hertz * np.arange(n) / rate)).astype("<i2").tobytes()


def silence(ms: int, rate: int) -> bytes:
    return bytes(WIDTH * int(rate * ms / 1000))


def wrapped(pcm: bytes, rate: int) -> bytes:
    """PCM of 16 bits, mono, in a RIFF container."""
    head = [b"RIFF", (36 + len(pcm)).to_bytes(4, "little"), b"WAVEfmt ", (16).to_bytes(4, "little"), np.array([1, 1], "<u2").tobytes(), np.array([rate, rate * WIDTH], "<u4").tobytes(), np.array([WIDTH, 16], "<u2").tobytes()]
    return b"".join([*head, b"data", len(pcm).to_bytes(4, "little"), pcm])


def read_wav(content: str | Column) -> Column:
    """wav() of a binary column, as a struct of WAV."""

    @F.pandas_udf(WAV)
    def read(values: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([wav(c) for c in values], columns=[c.split(" ")[0] for c in WAV.split(", ")])
        return rows.astype({c: "Int32" for c in ("rate", "channels", "width", "format")})

    return read(content)


def trim(threshold_db: float = -45.0, margin_ms: int = 40):
    """A pandas function of (pcm, rate): the PCM without silence at its ends, and the seconds that went at the beginning."""

    @F.pandas_udf(TRIMMED)
    def cut(pcm: pd.Series, rate: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(b"", 0.0) if p is None else trimmed(p, int(r), threshold_db, margin_ms) for p, r in zip(pcm, rate)], columns=["pcm", "offset"])

    return cut


def spoken(rate: int = 24_000, hertz: float = 240.0):
    """A pandas function of (lead ms, seconds, tail ms): a WAV of silence, a tone and silence."""

    @F.pandas_udf("binary")
    def make(lead: pd.Series, seconds: pd.Series, tail: pd.Series) -> pd.Series:
        return pd.Series([wrapped(silence(a, rate) + tone(hertz, s, rate) + silence(b, rate), rate) for a, s, b in zip(lead, seconds, tail)])

    return make


def duration(pcm: Column, rate: Column) -> Column:
    """Seconds of PCM of 16 bits, mono."""
    return F.octet_length(pcm) / (WIDTH * rate)
