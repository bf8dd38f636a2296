"""WAV files to signals and back, and raw blobs."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.functions.constants import AUDIO_EXTENSIONS
from bitloom.functions.udfs import struct


def read_blobs(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """(name, length, content) of the files below a path; ``least`` leaves shorter ones out before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.col("length") >= least).select(F.substring_index("path", "/", -1).alias("name"), "length", "content")


def wav_signal(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono signal in [-1, 1]) of a WAV file with whole-number samples of 1, 2, 3 or 4 bytes."""
    with wave.open(io.BytesIO(content)) as w:
        rate, width, channels, raw = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        x = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x -= (x >> 23) << 24
    else:
        x = np.frombuffer(raw, "<i2" if width == 2 else "<i4").astype(np.int64)
    signal = np.clip(x.astype(np.float32) / float(1 << (8 * width - 1)), -1.0, 1.0)
    return rate, signal if channels == 1 else signal.reshape(-1, channels).mean(1, dtype=np.float32)


def wav_bytes(signal: np.ndarray, rate: int) -> bytes:
    """A mono WAV file of 2-byte samples, cut toward zero."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(int(rate))
        w.writeframes((np.clip(np.asarray(signal, np.float32), -1.0, 1.0) * np.float32(32767.0)).astype("<i2").tobytes())
    return out.getvalue()


@F.pandas_udf(struct(sample_rate=T.IntegerType(), signal=T.ArrayType(T.FloatType()), error=T.StringType()))
def load_audio(content: pd.Series, extension: pd.Series) -> pd.DataFrame:
    """Signal of an audio file. Only WAV can be read without external programs; others get an error."""
    rows = []
    for b, e in zip(content, extension, strict=True):
        e = (e or "").lower()
        if e != "wav":
            rows.append((None, None, f"unsupported: {e}" + (" needs an external decoder" if e in AUDIO_EXTENSIONS else "")))
            continue
        try:
            rate, x = wav_signal(b)
            rows.append((rate, x, None))
        except (wave.Error, EOFError, ValueError, TypeError) as err:
            rows.append((None, None, f"broken WAV: {err}"))
    return pd.DataFrame(rows, columns=["sample_rate", "signal", "error"]).astype({"sample_rate": "Int32"})


@F.pandas_udf(T.BinaryType())
def export_audio(signal: pd.Series, sample_rate: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else wav_bytes(x, r) for x, r in zip(signal, sample_rate, strict=True)])
