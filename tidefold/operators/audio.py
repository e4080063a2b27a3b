"""Audio as arrays: resampling whole clips and streams of blocks, gain."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Zero crossings of the windowed sinc on each side, and the share of the band that it keeps.
CROSSINGS, ROLL = 32, 0.945


def _kernel(up: int, down: int) -> tuple[np.ndarray, int]:
    """The low-pass filter at `up` times the input's rate, and its half length."""
    cut = ROLL / max(up, down)
    half = int(math.ceil(CROSSINGS / cut))
    t = np.arange(-half, half + 1)
    return cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(math.pi * t / (half + 1))) * up, half


class Resampler:
    """A polyphase resampler that is fed blocks: what it gives for a signal doesn't depend on where the signal is cut.

    Between blocks it holds only the input that the filter still reaches.
    """

    def __init__(self, rate: int, target: int):
        both = math.gcd(rate, target)
        self.up, self.down = target // both, rate // both
        self.taps, self.half = _kernel(self.up, self.down)
        self.held = np.zeros(self.half // self.up + 1)  # silence before the signal
        self.first = -len(self.held)  # the place of the first held sample
        self.made = self.taken = 0

    def feed(self, block: np.ndarray, last: bool = False) -> np.ndarray:
        """The samples that this block completes; after the last block all that are left."""
        if self.up == self.down:
            return np.asarray(block, dtype=np.float32)
        self.taken += len(block)
        total = -(-self.taken * self.up // self.down)
        x = np.concatenate((self.held, np.asarray(block, dtype=np.float64)))
        if last:
            x = np.concatenate((x, np.zeros(self.half // self.up + 2)))
        reach = (self.first + len(x) - 1) * self.up - self.half  # the last place that the filter covers from here
        upto = total if last else max(self.made, min(total, reach // self.down + 1))
        out = np.arange(self.made, upto)
        centre = out * self.down
        low = -((self.half - centre) // self.up)  # first input within reach: ceil((centre - half) / up)
        width = 2 * self.half // self.up + 1
        at = low[:, None] + np.arange(width)[None, :]
        tap = centre[:, None] - at * self.up + self.half
        ok = (tap >= 0) & (tap < len(self.taps))
        place = np.clip(at - self.first, 0, len(x) - 1)
        y = (np.where(ok, self.taps[np.clip(tap, 0, len(self.taps) - 1)], 0.0) * x[place]).sum(axis=1) if len(out) else np.zeros(0)
        self.made = upto
        keep = max(self.first, -((self.half - self.made * self.down) // self.up))
        self.held, self.first = x[keep - self.first :], keep
        return y.astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    return Resampler(rate, target).feed(x, last=True)


def resampled(df: DataFrame, samples: str, rate: int, target: int) -> DataFrame:
    """SF20: `samples` (array<float>) from one rate to another, ceil(n * target / rate) of them; null stays null."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else resample(np.asarray(v, dtype=np.float64), rate, target) for v in x])

    return df.withColumn(samples, run(samples))


def resample_blocks(blocks: DataFrame, key: str, index: str, samples: str, rate: int, target: int, chunk: int) -> DataFrame:
    """ST6: files given as blocks in order to chunks of `chunk` samples at another rate, the last one short: (key, chunk, samples).

    A worker holds one block, the filter's carry and a chunk, however long a file; blocks may be of any lengths.
    """
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state, rest, number = None, None, np.zeros(0, np.float32), 0

        def flush(at, signal, final):
            whole = len(signal) if final else len(signal) // chunk * chunk
            parts = [signal[i : i + chunk] for i in range(0, whole, chunk)]
            return pd.DataFrame({key: pd.Series([name] * len(parts), dtype=object), "chunk": np.arange(at, at + len(parts)), "samples": pd.Series(parts, dtype=object)}), signal[whole:]

        for pdf in batches:
            for k, block in zip(pdf[key], pdf[samples]):
                if state is None or k != name:
                    if state is not None:
                        out, _ = flush(number, np.concatenate((rest, state.feed(np.zeros(0), last=True))), True)
                        yield out
                    name, state, rest, number = k, Resampler(rate, target), np.zeros(0, np.float32), 0
                out, rest = flush(number, np.concatenate((rest, state.feed(np.asarray(block, dtype=np.float64)))), False)
                number += len(out)
                yield out
        if state is not None:
            yield flush(number, np.concatenate((rest, state.feed(np.zeros(0), last=True))), True)[0]

    sorted_ = blocks.select(key, index, samples).repartition(key).sortWithinPartitions(key, index)
    return sorted_.select(key, samples).mapInPandas(run, f"`{key}` {kind}, chunk long, samples array<float>")


def frame_gain(x: np.ndarray, frame: int, least: float = -80.0) -> float:
    """Loudest frame's level in decibels, frames of `frame` samples at half steps, `least` at least."""
    step = max(1, frame // 2)
    starts = range(0, max(1, len(x) - frame + 1), step)
    power = max((float(np.mean(np.square(x[s : s + frame]))) for s in starts), default=0.0) if len(x) else 0.0
    return max(least, 10 * math.log10(power)) if power > 0 else least


def gains(df: DataFrame, samples: str, frame: int, out: str = "gain") -> DataFrame:
    """SF27: each clip's gain."""
    return df.withColumn(out, F.pandas_udf(lambda x: pd.Series([frame_gain(np.asarray(v, dtype=float), frame) for v in x]), "double")(samples))
