"""Scalar column functions: numbers, times, configuration values, losses, scales."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once: inside a function over an array, a plain expression is computed for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def nullish(value) -> Column:
    """Null for null, `none`, `null` and blank strings in any case."""
    t = F.trim(_c(value))
    return F.when(~F.lower(t).isin("none", "null", ""), t)


def sample_count(duration, rate) -> Column:
    """Samples of a clip, rounded half to even."""
    return F.bround(_c(duration) * _c(rate)).cast("long")


def iso_utc(ts) -> Column:
    """A time as ISO 8601 in UTC with milliseconds and Z."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def size_duration(size, rate: int, channels: int, width: int) -> Column:
    """Seconds that a file's bytes hold, each factor at least 1."""
    return _c(size).cast("double") / (max(1, rate) * max(1, channels) * max(1, width))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def softmax(array) -> Column:
    """An array's softmax, by its largest value."""
    x = F.transform(_c(array), lambda v: v.cast("double"))
    powers = let(x, lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
    return let(powers, lambda p: let(F.aggregate(p, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(p, lambda v: v / total)))


def squared_error(x, y) -> Column:
    """Mean squared difference of two arrays of one length."""
    square = F.zip_with(_c(x), _c(y), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.aggregate(square, F.lit(0.0), lambda a, v: a + v) / F.size(_c(x))


def focal_loss(p, target, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    """Binary focal loss of a probability."""
    pt = F.when(_c(target) == 1, _c(p)).otherwise(1 - _c(p))
    a = F.when(_c(target) == 1, F.lit(alpha)).otherwise(1 - alpha)
    return -a * F.pow(1 - pt, F.lit(gamma)) * F.ln(F.greatest(pt, F.lit(1e-12)))


def smooth_l1(x, y, beta: float = 1.0) -> Column:
    d = F.abs(_c(x) - _c(y))
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def hz_to_mel(hz) -> Column:
    return 2595.0 * F.log10(1.0 + _c(hz) / 700.0)


def mel_to_hz(mel) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), _c(mel) / 2595.0) - 1.0)


def annealed(step, start: float, end: float, total: int) -> Column:
    """Linear from start to end over `total` steps, then end."""
    return F.when(_c(step) >= total, F.lit(end)).otherwise(end - (end - start) * (1 - _c(step) / total))


def conv_length(n, layers: list[tuple[int, int]]) -> Column:
    """Frames after convolution layers (kernel, stride) without padding."""
    out = _c(n)
    for kernel, stride in layers:
        out = F.floor((out - kernel) / stride) + 1
    return out


def mix_share(gain_a, gain_b, share: float = 0.5) -> Column:
    """Blend share of the first signal from its gain difference to the second, in decibels."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (_c(gain_a) - _c(gain_b)) / 20.0) * (1 - share) / share)


def moments(x: Column, use) -> Column:
    """`use` of an array's mean and population deviation, each computed once."""
    total = lambda f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))
    return let(F.try_divide(total(lambda v: v), F.size(x)), lambda mean: let(F.sqrt(F.try_divide(total(lambda v: (v - mean) * (v - mean)), F.size(x))), lambda std: use(mean, std)))


def zscore(array) -> Column:
    """An array less its mean, over its population deviation (0 where that is 0)."""
    x = F.transform(_c(array), lambda v: v.cast("double"))
    return let(x, lambda x: moments(x, lambda mean, std: F.transform(x, lambda v: F.coalesce(F.try_divide(v - mean, std), F.lit(0.0)))))


def rms(array) -> Column:
    x = _c(array)
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / F.size(x))


def loudness_db(array) -> Column:
    """Level of an array's root mean square in decibels, from -100 up."""
    return F.greatest(20.0 * F.log10(F.greatest(rms(array), F.lit(1e-12))), F.lit(-100.0))


def with_gain(array, db) -> Column:
    """An array's values raised by so many decibels."""
    return F.transform(_c(array), lambda v: v.cast("double") * F.pow(F.lit(10.0), _c(db) / 20.0))


def sinc_filter(low, high, width: int, rate: float) -> Column:
    """Band-pass filter of `width` (odd) taps between two frequencies: two sincs' difference under a Hamming window."""

    def sinc(cut: Column, n: Column) -> Column:
        x = 2 * math.pi * cut * n / rate
        return 2 * cut / rate * F.when(n == 0, F.lit(1.0)).otherwise(F.sin(x) / x)

    half = width // 2
    at = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda n: n.cast("double"))
    return F.transform(at, lambda n: (sinc(_c(high), n) - sinc(_c(low), n)) * (0.54 + 0.46 * F.cos(2 * math.pi * n / (width - 1))))


def position_table(pos, dim: int) -> Column:
    """Sines, then cosines of a position at `dim` / 2 frequencies falling from 1 to 1/10000."""
    half = dim // 2
    angle = [_c(pos).cast("double") * (10_000.0 ** (-i / half)) for i in range(half)]
    return F.array(*[F.sin(a) for a in angle], *[F.cos(a) for a in angle])


def alibi_slopes(heads: int) -> list[float]:
    """Slopes of attention biases for so many heads: powers of 2^(-8/n) for the power of two n up to them, and for others
    every second slope of twice as many."""

    def powers(n: int) -> list[float]:
        return [2.0 ** (-8.0 * (i + 1) / n) for i in range(n)]

    n = 1 << (heads.bit_length() - 1)
    return powers(n) + powers(2 * n)[0::2][: heads - n]


def alibi_bias(i, j, slope) -> Column:
    """Attention bias between two places: the slope times their distance, negative."""
    return -F.abs(_c(i) - _c(j)) * _c(slope)


def mel_points(low: float, high: float, n: int) -> list[float]:
    """n frequencies evenly spaced on the mel scale."""
    a, b = 2595 * math.log10(1 + low / 700), 2595 * math.log10(1 + high / 700)
    return [700 * (10 ** ((a + (b - a) * i / (n - 1)) / 2595) - 1) for i in range(n)]
