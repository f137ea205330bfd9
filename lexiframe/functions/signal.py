"""Signals as array Columns: levels, scaling, framing, deltas, interpolation. Nothing here leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def squares(v: Column) -> Column:
    return total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def rms(v: Column) -> Column:
    return F.sqrt(F.try_divide(squares(v), F.size(v)))


def peak(v: Column) -> Column:
    return F.array_max(F.transform(v, F.abs))


def mono(channels: Column) -> Column:
    """The mean of the channels, each an array of equal length."""
    n = F.size(channels)
    first = F.transform(F.get(channels, 0), lambda x: F.lit(0.0))
    added = F.aggregate(channels, first, lambda s, c: F.zip_with(s, c, lambda a, b: a + b.cast("double")))
    return F.transform(added, lambda x: x / n)


def normalize_loudness(v: Column, target_dbfs: float = -23.0) -> Column:
    k = F.lit(10 ** (target_dbfs / 20)) / F.greatest(rms(v), F.lit(1e-6))
    return let(k, lambda k: F.transform(v, lambda x: x.cast("double") * k))


def normalize_peak(v: Column, level: float = 0.9) -> Column:
    """Scaled to the level; silence stays."""
    return let(peak(v).cast("double"), lambda p: F.transform(v, lambda x: x.cast("double") / F.when(p == 0, 1.0).otherwise(p) * level))


def normalize_peak_dbfs(v: Column, level: float = -1.0) -> Column:
    k = F.lit(10 ** (level / 20)) / F.greatest(peak(v).cast("double"), F.lit(1e-6))
    return let(k, lambda k: F.transform(v, lambda x: x.cast("double") * k))


def clip_to_unit(v: Column) -> Column:
    """Divided by the peak only where that is over 1, as before writing 16-bit samples."""
    return let(F.greatest(peak(v).cast("double"), F.lit(1.0)), lambda p: F.transform(v, lambda x: x.cast("double") / p))


def dbfs(v: Column, floor_added: bool = True) -> Column:
    """Level in decibels; the floor of 1e-9 is added to the root mean square, or bounds it."""
    r = F.coalesce(rms(v), F.lit(0.0))
    return 20 * F.log10(r + 1e-9 if floor_added else F.greatest(r, F.lit(1e-9)))


def snr_db(clean: Column, noisy: Column) -> Column:
    noise = F.zip_with(clean, noisy, lambda c, n: n.cast("double") - c.cast("double"))
    return 10 * F.log10((squares(clean) + 1e-12) / (squares(noise) + 1e-12))


def pre_emphasis(v: Column, a: float = 0.97) -> Column:
    return let(doubles(v), lambda d: F.transform(d, lambda x, i: x - F.when(i > 0, F.get(d, i - 1)).otherwise(0.0) * a))


def delta(v: Column) -> Column:
    """Slope over two neighbours each side, the ends repeated."""

    def slopes(d: Column) -> Column:
        at = lambda i: F.get(d, F.greatest(F.lit(0), F.least(F.size(d) - 1, i)))
        return F.transform(d, lambda x, i: (at(i + 1) - at(i - 1) + 2 * (at(i + 2) - at(i - 2))) / 10)

    return let(doubles(v), slopes)


def fit_length(v: Column, n: int) -> Column:
    return F.slice(F.concat(v, F.array_repeat(F.lit(0).cast("float"), n)), 1, n)


def frames(v: Column, win: int, hop: int) -> Column:
    """Full windows; none if shorter than one."""
    some = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - win) / hop).cast("int")), lambda k: F.slice(v, k * hop + 1, win))
    return F.when(F.size(v) >= win, some).otherwise(F.array().cast("array<array<double>>"))


def frame_energy(v: Column, win: int, hop: int) -> Column:
    """Root mean square of each window; of all samples if there are fewer."""
    return F.when(F.size(v) >= win, F.transform(frames(doubles(v), win, hop), rms)).otherwise(F.array(rms(v)))


def interp_unvoiced(f0: Column) -> Column:
    """Zeros filled linearly between the voiced frames around them, held at the ends; without any voiced frame, 0.001 added."""
    d = doubles(f0)

    def filled(voiced: Column) -> Column:
        def fill(x: Column, i: Column) -> Column:
            n = F.size(F.filter(voiced, lambda s: s["i"] <= i))

            def between(n: Column) -> Column:
                before, after = F.get(voiced, n - 1), F.get(voiced, n)
                line = before["x"] + (after["x"] - before["x"]) * F.try_divide((i - before["i"]).cast("double"), after["i"] - before["i"])
                return F.when(n == 0, after["x"]).when(after.isNull(), before["x"]).otherwise(line)

            return F.when(x > 0, x).otherwise(let(n, between))

        return F.when(F.size(voiced) == 0, F.transform(d, lambda x: x + 1e-3)).otherwise(F.transform(d, fill))

    return let(F.filter(F.transform(d, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] > 0), filled)


def pick_indices(n: Column, k: int) -> Column:
    """k indices evenly over 0 to n - 1, truncated; all of them if n is no more than k."""
    some = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("int"))
    return F.when(n > k, some).otherwise(F.sequence(F.lit(0), n - 1))


def regrid(v: Column, n: int) -> Column:
    """n values picked evenly from a contour, places truncated, whether it is longer or shorter; an empty one gives zeros."""
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.size(v) - 1) / max(1, n - 1)).cast("int"))
    return F.when(F.size(v) > 0, F.transform(at, lambda i: F.get(v, i))).otherwise(F.array_repeat(F.lit(0.0), n))


def silence(seconds: Column, rate: int = 22050) -> Column:
    """Samples that are zero."""
    return F.array_repeat(F.lit(0.0), F.floor(seconds * rate).cast("int"))


def interpolate(xs: Column, ys: Column, n: Column) -> Column:
    """Piecewise linear through (xs, ys), xs rising, at 0 to n - 1; held beyond the ends."""

    def line(p: Column) -> Column:
        def at(i: Column) -> Column:
            def near(k: Column) -> Column:
                x0, x1, y0, y1 = F.get(p["x"], k), F.get(p["x"], k + 1), F.get(p["y"], k), F.get(p["y"], k + 1)
                return F.when(k < 0, F.get(p["y"], F.lit(0))).when(x1.isNull(), y0).otherwise(y0 + (y1 - y0) * (i - x0) / (x1 - x0))

            return let(F.size(F.filter(p["x"], lambda x: x <= i)) - 1, near)

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    return let(F.struct(xs.alias("x"), ys.alias("y")), line)


def energy_gain(source: Column, target: Column) -> Column:
    """Gain of each frame, held between 0.1 and 4."""
    return F.zip_with(source, target, lambda s, t: F.least(F.lit(4.0), F.greatest(F.lit(0.1), t / F.greatest(s, F.lit(1e-6)))))


def apply_gain(v: Column, gain: Column, win: int, hop: int) -> Column:
    """Samples times the gains of all frames that cover them; overlapping gains multiply."""

    def at(x: Column, i: Column) -> Column:
        lo = F.greatest(F.lit(0), F.ceil((i - win + 1) / hop).cast("int"))
        hi = F.least(F.size(gain) - 1, F.floor(i / hop).cast("int"))
        own = F.when(hi >= lo, F.slice(gain, lo + 1, F.greatest(F.lit(0), hi - lo + 1))).otherwise(F.array().cast("array<double>"))
        return x * F.aggregate(own, F.lit(1.0), lambda s, g: s * g)

    return F.transform(doubles(v), at)


def pitch_ratio(source: Column, target: Column) -> Column:
    """Mean of the target's voiced over the source's, held between 0.6 and 1.6; 1 without voiced frames."""
    mean = lambda f: F.try_divide(total(F.filter(doubles(f), lambda x: x > 0)), F.size(F.filter(f, lambda x: x > 0)))
    return F.least(F.lit(1.6), F.greatest(F.lit(0.6), F.coalesce(mean(target) / mean(source), F.lit(1.0))))


def l2_normalize(v: Column) -> Column:
    return let(F.greatest(F.sqrt(squares(v)), F.lit(1e-12)), lambda norm: F.transform(doubles(v), lambda x: x / norm))


def dft_power(v: Column, n: int) -> Column:
    """Power at bins 0 to n / 2 of an n-point transform, by sums of products with fixed twiddles; for short n."""
    d = F.slice(doubles(v), 1, n)

    def power(k: int) -> Column:
        cos = F.array(*[F.lit(math.cos(2 * math.pi * k * i / n)) for i in range(n)])
        sin = F.array(*[F.lit(math.sin(2 * math.pi * k * i / n)) for i in range(n)])
        re, im = total(F.zip_with(d, cos, lambda a, b: a * b)), total(F.zip_with(d, sin, lambda a, b: a * b))
        return re * re + im * im

    return F.array(*[power(k) for k in range(n // 2 + 1)])


def spectral_floor(mag: Column, noise: Column, over: float = 1.8, floor: float = 0.05) -> Column:
    return F.zip_with(mag, noise, lambda m, q: F.greatest(m - over * q, floor * m))
