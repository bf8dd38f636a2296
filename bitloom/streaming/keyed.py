"""Waveform and dictionary coding over streams: one state per key, kept by the state store.

Rows of a key have to arrive in order between batches; within a batch they are sorted by (ts, seq). State: the
staircase, the step and the last bit (delta modulations), the last reconstruction (DPCM) or the open phrase, the
dictionary and the session's number (LZ78), so a stream cut into any batches gives the bits of the whole signal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bitloom.functions.constants import ADM_STEP_MAX, ADM_STEP_MIN, DPCM_HIGH, DPCM_LOW

WAVE_SCHEMA = "key bigint, seq bigint, code int, y double"
STATE = "s double, d double, prev int, n bigint"
TOKEN_SCHEMA = "key string, session bigint, k bigint, idx bigint, ch string"
APPENDED = 10_000  # phrases in one message to the state store


class Wave(StatefulProcessor):
    """Base: rows (key, ts, seq, x) to rows (key, seq, code, y)."""

    def __init__(self, first: tuple):
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("wave", STATE)

    def step(self, x: float, s: float, d: float, prev: int) -> tuple[int, float, float, int]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, d, prev, n = self.state.get() if self.state.exists() else (*self.first, 0)
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"])
        seq, code, y = [], [], []
        for q, x in zip(frame["seq"], frame["x"], strict=True):
            c, s, d, prev = self.step(float(x), s, d, prev)
            seq.append(q)
            code.append(c)
            y.append(s)
        self.state.update((s, d, prev, n + len(seq)))
        yield pd.DataFrame({"key": key[0], "seq": seq, "code": code, "y": y})

    def close(self) -> None:
        pass


class Dm(Wave):
    def __init__(self, delta: float):
        super().__init__((0.0, float(delta), -1))

    def step(self, x, s, d, prev):
        up = int(x > s)
        return up, min(1.0, s + d) if up else max(-1.0, s - d), d, up


class Adm(Wave):
    def __init__(self, delta: float, multiplier: float = 1.5):
        super().__init__((0.0, float(delta), -1))
        self.multiplier = multiplier

    def step(self, x, s, d, prev):
        up = int(x > s)
        s = min(1.0, s + d) if up else max(-1.0, s - d)
        if prev >= 0:
            d = min(ADM_STEP_MAX, d * self.multiplier) if up == prev else max(ADM_STEP_MIN, d / self.multiplier)
        return up, s, d, up


class Dpcm(Wave):
    def __init__(self, bits: int, alpha: float):
        super().__init__((0.0, 0.0, -1))
        self.levels, self.alpha = 1 << bits, alpha

    def step(self, x, s, d, prev):
        span, guess = DPCM_HIGH - DPCM_LOW, self.alpha * s
        k = min(int((min(max(x - guess, DPCM_LOW), DPCM_HIGH) - DPCM_LOW) / span * self.levels), self.levels - 1)
        return k, min(max(guess + DPCM_LOW + (k + 0.5) * (span / self.levels), -1.0), 1.0), d, prev


class Lz78(StatefulProcessor):
    """Rows (key, ts, seq, text, last) to tokens. A row with last ends its session: the phrase that is still open becomes a token
    without character, and the next row begins with an empty dictionary. Without such a row the open phrase stays in the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "phrase bigint, n bigint, session bigint")
        self.told = handle.getListState("told", "at bigint, ch string")  # the dictionary of the open session: phrase k stands in place k

    def handleInputRows(self, key, rows, timerValues):
        # every call of the state is a message to the JVM: the dictionary is read once and what is new is added once
        at, n, session = self.open.get() or (0, 0, 1)
        kept = n
        known = {tuple(p): k for k, p in enumerate(self.told.get(), 1)} if n else {}
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"])
        out, new = [], []
        for text, last in zip(frame["text"], frame["last"], strict=True):
            for c in text or "":
                phrase = known.get((at, c))
                if phrase is None:
                    n += 1
                    known[at, c] = n
                    new.append((at, c))
                    out.append((key[0], session, n, at, c))
                    at = 0
                else:
                    at = phrase
            if last:
                if at:
                    out.append((key[0], session, n + 1, at, None))
                if kept:
                    self.told.clear()
                known, new = {}, []
                at, n, session, kept = 0, 0, session + 1, 0
        for k in range(0, len(new), APPENDED):
            self.told.appendList(new[k : k + APPENDED])
        self.open.update((at, n, session))
        yield pd.DataFrame(out, columns=["key", "session", "k", "idx", "ch"])

    def close(self) -> None:
        pass


def code_stream(stream: DataFrame, processor: Wave) -> DataFrame:
    """stream (key, ts, seq, x) through a wave processor."""
    return stream.groupBy("key").transformWithStateInPandas(processor, outputStructType=WAVE_SCHEMA, outputMode="append", timeMode="none")


def token_stream(stream: DataFrame) -> DataFrame:
    """stream (key, ts, seq, text, last) to LZ78 tokens."""
    return stream.groupBy("key").transformWithStateInPandas(Lz78(), outputStructType=TOKEN_SCHEMA, outputMode="append", timeMode="none")
