"""Signal operators that need transforms: numpy over Arrow batches, one clip a row; clips never meet, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import FORMANTS


def _window(kind: str, n: int) -> np.ndarray:
    k = 2 * np.pi * np.arange(n) / n  # periodic
    return 0.5 - 0.5 * np.cos(k) if kind == "hann" else 0.54 - 0.46 * np.cos(k)


def stft(x: np.ndarray, n_fft: int = 512, hop: int = 128, win: int | None = None, kind: str = "hann") -> np.ndarray:
    """(bins, frames), centred, reflected at the ends."""
    win = win or n_fft
    w = np.zeros(n_fft)
    w[(n_fft - win) // 2 : (n_fft - win) // 2 + win] = _window(kind, win)
    p = np.pad(x.astype(np.float64), n_fft // 2, mode="reflect" if len(x) > n_fft // 2 else "constant")
    f = np.lib.stride_tricks.sliding_window_view(p, n_fft)[::hop]
    return np.fft.rfft(f * w, axis=1).T


def istft(spec: np.ndarray, length: int, n_fft: int = 512, hop: int = 128, kind: str = "hann") -> np.ndarray:
    w = _window(kind, n_fft)
    f = np.fft.irfft(spec.T, n_fft, axis=1) * w
    out, norm = np.zeros(n_fft + hop * (len(f) - 1)), np.zeros(n_fft + hop * (len(f) - 1))
    for k in range(len(f)):
        out[k * hop : k * hop + n_fft] += f[k]
        norm[k * hop : k * hop + n_fft] += w * w
    out = out / np.maximum(norm, 1e-11)
    out = out[n_fft // 2 : n_fft // 2 + length]
    return np.pad(out, (0, max(0, length - len(out))))


def noise_estimate(mag: np.ndarray, n_init: int = 6) -> np.ndarray:
    return mag[:, : min(n_init, mag.shape[1])].mean(1, keepdims=True)


def spectral_subtraction(x: np.ndarray, n_fft: int = 512, hop: int = 128, over_sub: float = 1.8, floor: float = 0.05) -> np.ndarray:
    if not len(x):
        return x
    s = stft(x, n_fft, hop)
    mag = np.abs(s)
    clean = np.maximum(mag - over_sub * noise_estimate(mag), floor * mag)
    y = istft(clean * np.exp(1j * np.angle(s)), len(x), n_fft, hop)
    return y * (10 ** (-1 / 20) / max(float(np.abs(y).max()), 1e-6))


def _mel(f):
    return 2595 * np.log10(1 + f / 700)


@lru_cache(16)
def mel_bank(sr: int, n_fft: int, n_mels: int, lo: float = 0.0, hi: float | None = None) -> np.ndarray:
    edges = 700 * (10 ** (np.linspace(_mel(lo), _mel(hi or sr / 2), n_mels + 2) / 2595) - 1)
    return _triangles(edges, sr, n_fft)


def _triangles(edges: np.ndarray, sr: int, n_fft: int) -> np.ndarray:
    f = np.linspace(0, sr / 2, n_fft // 2 + 1)
    up = (f[None] - edges[:-2, None]) / np.maximum(edges[1:-1] - edges[:-2], 1e-9)[:, None]
    down = (edges[2:, None] - f[None]) / np.maximum(edges[2:] - edges[1:-1], 1e-9)[:, None]
    return np.maximum(0, np.minimum(up, down))


@lru_cache(16)
def linear_bank(sr: int, n_fft: int, n: int) -> np.ndarray:
    return _triangles(np.linspace(0, sr / 2, n + 2), sr, n_fft)


def dct_matrix(n_out: int, n_in: int) -> np.ndarray:
    """Orthonormal type II."""
    k, i = np.arange(n_out)[:, None], np.arange(n_in)[None]
    m = np.cos(np.pi / n_in * (i + 0.5) * k) * np.sqrt(2 / n_in)
    m[0] /= np.sqrt(2)
    return m


def log_mel(x: np.ndarray, sr: int = 16000, n_mels: int = 80, n_fft: int = 512) -> np.ndarray:
    p = np.abs(stft(x, n_fft, int(0.010 * sr), int(0.025 * sr))) ** 2
    return np.log(np.maximum(mel_bank(sr, n_fft, n_mels) @ p, 1e-6)).T


def mfcc(x: np.ndarray, sr: int = 16000, n_mfcc: int = 30, n_mels: int = 40, n_fft: int = 512, hop: int = 160) -> np.ndarray:
    p = mel_bank(sr, n_fft, n_mels) @ (np.abs(stft(x, n_fft, hop)) ** 2)
    db = 10 * np.log10(np.maximum(p, 1e-10))
    return (dct_matrix(n_mfcc, n_mels) @ np.maximum(db, db.max() - 80)).T


def deltas(f: np.ndarray) -> np.ndarray:
    p = np.pad(f, ((2, 2), (0, 0)), mode="edge")
    n = len(f)
    return (p[3 : 3 + n] - p[1 : 1 + n] + 2 * (p[4 : 4 + n] - p[:n])) / 10


def lfcc(x: np.ndarray, sr: int = 16000, n_filters: int = 40, n_ceps: int = 60, n_fft: int = 512, hop: int = 160) -> np.ndarray:
    """Cepstra of linear filters with first and second slopes, after pre-emphasis. More cepstra than filters repeat mirrored."""
    x = x.astype(np.float64)
    x = np.concatenate([x[:1], x[1:] - 0.97 * x[:-1]])
    p = linear_bank(sr, n_fft, n_filters) @ (np.abs(stft(x, n_fft, hop, int(0.025 * sr), "hamming")) ** 2)
    c = (dct_matrix(n_ceps, n_filters) @ np.log(np.maximum(p, 1e-8))).T
    d = deltas(c)
    return np.concatenate([c, d, deltas(d)], 1)


def f0(x: np.ndarray, sr: int = 16000, lo: float = 75.0, hi: float = 400.0, win: int | None = None, hop: int | None = None) -> np.ndarray:
    """Pitch of each 10 ms frame by normalised autocorrelation; 0 where it is unvoiced."""
    win, hop = win or int(0.040 * sr), hop or int(0.010 * sr)
    if len(x) < win:
        return np.zeros(max(1, len(x) // hop))
    a, b = int(sr / hi), min(int(sr / lo), win - 1)
    out = []
    for f in np.lib.stride_tricks.sliding_window_view(x.astype(np.float64), win)[::hop]:
        f = f - f.mean()
        c = np.fft.irfft(np.abs(np.fft.rfft(f, 2 * win)) ** 2)[:win]
        e = np.cumsum(f * f)
        lags = np.arange(a, b + 1)
        norm = np.sqrt(np.maximum(e[win - lags - 1] * (e[-1] - np.concatenate([[0], e])[lags]), 1e-12))
        r = c[a : b + 1] / norm
        k = int(np.flatnonzero(r >= 0.97 * r.max())[0])  # of nearly equal peaks the shortest lag, not a multiple of it
        k += int(r[k : k + 1 + a // 2].argmax())
        out.append(sr / (a + k) if r[k] > 0.5 else 0.0)
    return np.array(out)


def resample(x: np.ndarray, old: int, new: int, width: int = 6) -> np.ndarray:
    """Band-limited by a windowed sinc."""
    if old == new or not len(x):
        return x.astype(np.float64)
    n, cut = int(np.ceil(len(x) * new / old)), min(old, new) / old * 0.99
    at = np.arange(n) * old / new
    half = int(np.ceil(width / cut))
    k = np.floor(at)[:, None].astype(np.int64) + np.arange(-half, half + 1)[None]
    t = (at[:, None] - k) * cut
    w = np.where(np.abs(t) < width, np.cos(np.pi * t / width / 2) ** 2, 0) * np.sinc(t) * cut
    return (np.where((k >= 0) & (k < len(x)), x[np.clip(k, 0, len(x) - 1)], 0) * w).sum(1)


def shift_pitch(x: np.ndarray, sr: int, ratio: float) -> np.ndarray:
    """There and back between two rates: the length and, but for the band limit, the pitch stay."""
    return resample(resample(x, sr, max(1, int(sr / ratio))), max(1, int(sr / ratio)), sr)[: len(x)]


def formant_speech(ipa: str, sr: int = 22050, seconds: float = 0.08, seed: int = 0) -> np.ndarray:
    """A vowel's formants as sines for each symbol, a burst of seeded noise for any other."""
    n, rng, parts = int(seconds * sr), np.random.default_rng(seed), []
    t = np.arange(n) / sr
    for ch in ipa:
        if ch not in FORMANTS:
            parts.append(0.05 * rng.standard_normal(n // 3))
            continue
        tone = sum(g * np.sin(2 * np.pi * f * t) for g, f in zip((0.4, 0.25, 0.15), FORMANTS[ch]))
        parts.append(0.5 * np.sin(2 * np.pi * 140.0 * t) * tone * (np.exp(-3 * t) + 0.3))
    y = np.concatenate(parts) if parts else np.zeros(sr)
    return y / (float(np.abs(y).max()) or 1.0) * 0.9


def on_clips(df: DataFrame, samples: str, function: Callable[[np.ndarray], np.ndarray], out: str, matrix: bool = False) -> DataFrame:
    """``df`` with the function of each row's samples, as an array or an array of arrays; null stays null, an empty clip gives an empty result."""
    kind = "array<array<double>>" if matrix else "array<double>"

    @F.pandas_udf(kind)
    def apply(s: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            v = np.asarray(v, dtype=np.float64)
            r = function(v) if len(v) else np.zeros((0, 1) if matrix else 0)
            return [list(map(float, x)) for x in r] if matrix else np.asarray(r, np.float64).tolist()

        return s.map(one)

    return df.withColumn(out, apply(F.col(samples)))


def warp_waveform(df: DataFrame, source: str, source_rate: int, target: str, target_rate: int, out: str = "warped") -> DataFrame:
    """``df`` with the target clip given the source's prosody: both clips' pitch and energy, the source's warped onto the target's frames, and the target's loudness and pitch changed
    accordingly. Contours are cut to the shortest. Null clips give null."""
    from ..functions import signal as S
    from .align import warp_contours

    win, hop = int(0.025 * target_rate), int(0.010 * target_rate)
    rows = on_clips(df, source, lambda x: resample(x, source_rate, target_rate), "_s")
    rows = on_clips(on_clips(rows, "_s", lambda x: f0(x, target_rate), "_f0s"), target, lambda x: f0(x, target_rate), "_f0t")
    rows = rows.withColumn("_es", S.frame_energy(F.col("_s"), win, hop)).withColumn("_et", S.frame_energy(S.doubles(F.col(target)), win, hop))
    n = F.least(*[F.size(c) for c in ("_f0s", "_es", "_f0t", "_et")])
    for c in ("_f0s", "_es", "_f0t", "_et"):
        rows = rows.withColumn(c, F.slice(c, F.lit(1), n))
    rows = warp_contours(rows, "_f0s", "_es", "_f0t", "_et")
    loud = S.apply_gain(F.col(target), S.energy_gain(F.col("_et"), F.col("warped_energy")), win, hop)
    rows = rows.withColumn("_loud", loud).withColumn("_ratio", S.pitch_ratio(F.col("_f0t"), F.col("warped_f0")))

    @F.pandas_udf("array<double>")
    def shifted(v: pd.Series, ratio: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shift_pitch(np.asarray(x, np.float64), target_rate, float(r)).tolist() for x, r in zip(v, ratio)])

    return rows.withColumn(out, shifted("_loud", "_ratio")).drop("_s", "_f0s", "_f0t", "_es", "_et", "warped_f0", "warped_energy", "_loud", "_ratio")


DENOISERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"spectral": spectral_subtraction}


def denoise(df: DataFrame, samples: str, out: str, backend: str = "auto") -> DataFrame:
    """By a registered backend; ``auto`` takes the first registered besides the spectral one, which always works, as a fallback."""
    if backend != "auto":
        return on_clips(df, samples, DENOISERS[backend], out)
    chain = [f for k, f in DENOISERS.items() if k != "spectral"] + [spectral_subtraction]

    def first(x: np.ndarray) -> np.ndarray:
        for f in chain[:-1]:
            try:
                return f(x)
            except (RuntimeError, ValueError, MemoryError):
                continue
        return chain[-1](x)

    return on_clips(df, samples, first, out)
