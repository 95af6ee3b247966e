"""Timing and shape measures with sequential rules: peak selection, warping, wavelets.

Each runs on one series at a time in a grouped Arrow-batch function; series are spread by Spark. What comes back is small (a
row a series, peak, scale or path point). Long series are thinned before warping, by ``timing.decimated``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import TimingConfig


def _sorted(pdf: pd.DataFrame) -> tuple[str, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("k")
    return pdf["series_id"].iloc[0], pdf["obs"].to_numpy(float), pdf["sim"].to_numpy(float)


def _none(x: float) -> float | None:
    return float(x) if np.isfinite(x) else None


# Peaks


def prominences(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Height of each peak over the higher of the two lows that lie between it and higher ground (or the end)."""
    n, left, right = len(x), np.zeros(len(x), int), np.full(len(x), len(x))
    stack: list[int] = []
    for i in range(n):
        while stack and x[stack[-1]] <= x[i]:
            stack.pop()
        left[i] = stack[-1] + 1 if stack else 0
        stack.append(i)
    stack = []
    for i in range(n - 1, -1, -1):
        while stack and x[stack[-1]] <= x[i]:
            stack.pop()
        right[i] = stack[-1] if stack else n
        stack.append(i)
    return np.array([x[p] - max(x[left[p] : p + 1].min(), x[p : right[p]].min()) for p in at])


def peaks(obs: np.ndarray, sim: np.ndarray, cfg: TimingConfig) -> list[tuple[int, int, bool]]:
    """(observed place, simulated place, resolved) of each observed peak that is prominent and apart from higher ones."""
    n = len(obs)
    least = float(np.std(obs)) if cfg.prominence is None else cfg.prominence
    mid = np.flatnonzero((obs[1:-1] > obs[:-2]) & (obs[1:-1] >= obs[2:])) + 1
    mid = mid[prominences(obs, mid) > least] if len(mid) else mid
    keep: list[int] = []
    for p in mid[np.argsort(-obs[mid], kind="stable")]:
        if all(abs(p - q) >= cfg.min_distance for q in keep):
            keep.append(int(p))
    out = []
    for t in sorted(keep):
        lo, hi = max(0, t - cfg.tolerance), min(n - 1, t + cfg.tolerance)
        m = lo + int(np.argmax(sim[lo : hi + 1]))
        rising = (m == lo and lo > 0 and sim[lo - 1] > sim[lo]) or (m == hi and hi < n - 1 and sim[hi + 1] > sim[hi])
        out.append((t, m, not rising))
    return out


def peak_table(pairs: DataFrame, cfg: TimingConfig) -> DataFrame:
    """One row an observed peak; lag is NULL where the simulation still rises out of the window."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, o, s = _sorted(pdf)
        rows = [(name, t, m, m - t if ok else None, o[t], s[m], ok) for t, m, ok in peaks(o, s, cfg)]
        return pd.DataFrame(rows, columns=["series_id", "obs_k", "sim_k", "lag", "obs_q", "sim_q", "resolved"])

    return pairs.groupBy("series_id").applyInPandas(run, "series_id string, obs_k long, sim_k long, lag double, obs_q double, sim_q double, resolved boolean")


def peak_timing(table: DataFrame) -> DataFrame:
    return table.groupBy("series_id").agg(F.avg(F.abs("lag")).alias("peak_lag_abs"), F.avg("lag").alias("peak_lag_signed"), F.count_if(~F.col("resolved")).alias("unresolved"))


# Dynamic time warping


def warp(a: np.ndarray, b: np.ndarray, fraction: float) -> tuple[float, np.ndarray]:
    """(distance, path of index pairs) within a band, cell by cell along anti-diagonals; of equal ways the diagonal goes first,
    then the step in a."""
    n, m = len(a), len(b)
    band = max(1, int(np.ceil(fraction * max(n, m))), abs(n - m))
    moves: list[tuple[int, np.ndarray]] = []
    far = np.inf
    old = (0, np.zeros(0))
    older = (0, np.zeros(0))

    def get(diagonal: tuple[int, np.ndarray], i: np.ndarray) -> np.ndarray:
        lo, v = diagonal
        at = i - lo
        ok = (at >= 0) & (at < len(v))
        return np.where(ok, v[np.clip(at, 0, max(0, len(v) - 1))] if len(v) else far, far)

    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1, -((band - d) // 2)), min(n - 1, d, (d + band) // 2)
        i = np.arange(lo, hi + 1)
        cost = np.abs(a[i] - b[d - i])
        if d == 0:
            v, move = cost, np.zeros(len(i), np.int8)
        else:
            diag, up, left = get(older, i - 1), get(old, i - 1), get(old, i)
            move = np.where((diag <= up) & (diag <= left), 0, np.where(up <= left, 1, 2)).astype(np.int8)
            v = cost + np.minimum(diag, np.minimum(up, left))
        moves.append((lo, move))
        older, old = old, (lo, v)
    i, j, path = n - 1, m - 1, []
    while True:
        path.append((i, j))
        if i == 0 and j == 0:
            break
        lo, move = moves[i + j]
        step = move[i - lo]
        i, j = i - (step != 2), j - (step != 1)
    return float(old[1][-1]), np.array(path[::-1])


def warping(pairs: DataFrame, cfg: TimingConfig) -> DataFrame:
    """dtw_dist (by path length), dtw_warp (mean gap of places, in steps of the unthinned series), distance and path length.
    ``pairs`` may carry a stride from thinning."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, o, s = _sorted(pdf)
        distance, path = warp(o, s, cfg.band)
        stride = int(pdf["stride"].iloc[0])
        return pd.DataFrame([(name, distance, len(path), distance / len(path), np.abs(path[:, 0] - path[:, 1]).mean() * stride)], columns=["series_id", "distance", "path_length", "dtw_dist", "dtw_warp"])

    x = pairs if "stride" in pairs.columns else pairs.withColumn("stride", F.lit(1))
    return x.groupBy("series_id").applyInPandas(run, "series_id string, distance double, path_length long, dtw_dist double, dtw_warp double")


def warping_path(pairs: DataFrame, cfg: TimingConfig) -> DataFrame:
    """(series_id, p, i, j): the path, in places of the unthinned pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, o, s = _sorted(pdf)
        path = warp(o, s, cfg.band)[1] * int(pdf["stride"].iloc[0])
        return pd.DataFrame({"series_id": name, "p": np.arange(len(path)), "i": path[:, 0], "j": path[:, 1]})

    x = pairs if "stride" in pairs.columns else pairs.withColumn("stride", F.lit(1))
    return x.groupBy("series_id").applyInPandas(run, "series_id string, p long, i long, j long")


def ties(path: DataFrame, pairs: DataFrame, most: int = 160) -> DataFrame:
    """Path points thinned to about ``most``, with dates and values of both ends."""
    n = path.groupBy("series_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / most)).alias("every"))
    thin = path.join(n, "series_id").where("p % every = 0")
    o = pairs.select("series_id", F.col("k").alias("i"), F.col("ts").alias("obs_ts"), F.col("obs"))
    s = pairs.select("series_id", F.col("k").alias("j"), F.col("ts").alias("sim_ts"), F.col("sim"))
    return thin.join(o, ["series_id", "i"]).join(s, ["series_id", "j"]).select("series_id", "p", "obs_ts", "obs", "sim_ts", "sim")


# Cross-wavelets

FOURIER = 4 * np.pi / (6 + np.sqrt(38))


def wavelet(x: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Morlet transform (omega 6) at each scale, on a zero-padded power of two."""
    size = 1 << int(np.ceil(np.log2(len(x))))
    spectrum = np.fft.fft(x, size)
    w = 2 * np.pi * np.arange(size) / size
    positive = (np.arange(size) > 0) & (np.arange(size) <= size // 2)
    out = np.empty((len(scales), len(x)), complex)
    for i, s in enumerate(scales):
        daughter = np.where(positive, np.pi**-0.25 * np.sqrt(2 * np.pi * s) * np.exp(-((s * w - 6) ** 2) / 2), 0.0)
        out[i] = np.fft.ifft(spectrum * daughter)[: len(x)]
    return out


def _ar1(x: np.ndarray) -> float:
    a = x - x.mean()
    v = (a * a).sum()
    return float(np.clip((a[1:] * a[:-1]).sum() / v, 0, 0.999)) if v else 0.0


def cross_wavelet(pairs: DataFrame, most: int = 16384, to: int = 8192) -> DataFrame:
    """One row a series and scale: scale, period, mean_lag, frac_significant, and the power sums (weight, weighted_lag, stride) that
    make the overall lag. Positive: the simulation is late."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, o, s = _sorted(pdf)
        stride = -(-len(o) // to) if len(o) > most else 1
        m = len(o) // stride
        o, s = (x[: m * stride].reshape(m, stride).mean(1) for x in (o, s))
        o, s = ((x - x.mean()) / (x.std() or 1.0) for x in (o, s))
        top = int(np.floor(np.log2(m / 8) / 0.25)) if m >= 8 else -1
        scales = 2 * 2 ** (0.25 * np.arange(top + 1))
        a, b = _ar1(o), _ar1(s)
        edge = np.minimum(np.arange(m), m - 1 - np.arange(m))
        rows = []
        if len(scales):
            cross = wavelet(o, scales) * np.conj(wavelet(s, scales))
        for i, sc in enumerate(scales):
            period = sc * FOURIER
            noise = [(1 - r * r) / (1 + r * r - 2 * r * np.cos(2 * np.pi / period)) for r in (a, b)]
            inside = edge >= np.sqrt(2) * sc
            power = np.abs(cross[i])
            on = inside & (power > 3.999 / 2 * np.sqrt(noise[0] * noise[1]))
            lag = np.angle(cross[i][on]) / (2 * np.pi) * period
            weight = power[on].sum()
            rows.append((name, sc, period, (power[on] * lag).sum() / weight if weight > 0 else None, on.sum() / inside.sum() if inside.any() else 0.0, weight, (power[on] * lag).sum(), stride))
        return pd.DataFrame(rows, columns=["series_id", "scale", "period", "mean_lag", "frac_significant", "weight", "weighted_lag", "stride"])

    return pairs.groupBy("series_id").applyInPandas(run, "series_id string, scale double, period double, mean_lag double, frac_significant double, weight double, weighted_lag double, stride long")


def cross_wavelet_lag(by_scale: DataFrame) -> DataFrame:
    return by_scale.groupBy("series_id").agg(F.try_divide(F.sum("weighted_lag"), F.nullif(F.sum("weight"), F.lit(0.0))).alias("lag"), F.max("stride").alias("stride")).select("series_id", (F.col("lag") * F.col("stride")).alias("xwt_lag"))
