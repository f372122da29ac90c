"""Every series feature of array cells: NumPy over the rows of a batch that are equally long, no explode and no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .entropy import approximate_entropy, sample_entropy

INTEGERS = ("length", "n_peaks", "n_troughs", "has_duplicate", "has_duplicate_max", "has_duplicate_min", "sum_reoccurring_data_points", "count_above_mean", "count_below_mean", "number_crossings_mean", "number_zero_crossings", "longest_strike_above_mean", "longest_strike_below_mean")


def _runs(flag: np.ndarray) -> np.ndarray:
    """Longest run of True in each row."""
    at = np.cumsum(flag, axis=1)
    since = np.maximum.accumulate(np.where(flag, 0, at), axis=1)
    return (at - since).max(axis=1, initial=0)


def _moments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    mu = x.mean(axis=1)
    d = x - mu[:, None]
    return mu, d, (d**2).mean(axis=1)


def basic_stats(x: np.ndarray, n: int) -> dict[str, np.ndarray]:
    m = len(x)
    if not n:
        none = np.full(m, np.nan)
        return dict.fromkeys(("mean", "std", "min", "max", "range", "median"), none) | {"sum": np.zeros(m), "var": none, "cv": none}
    mu, _, var = _moments(x)
    lo, hi = x.min(axis=1), x.max(axis=1)
    return {"mean": mu, "std": np.sqrt(var), "min": lo, "max": hi, "range": hi - lo, "median": np.median(x, axis=1), "sum": x.sum(axis=1), "var": var, "cv": np.where(mu == 0, 0.0, np.sqrt(var) / np.abs(mu))}


def distribution(x: np.ndarray, n: int) -> dict[str, np.ndarray]:
    if n < 4:
        return dict.fromkeys(("skewness", "kurtosis", "q10", "q25", "q75", "q90", "iqr"), np.full(len(x), np.nan))
    _, d, var = _moments(x)
    q = dict(zip((10, 25, 75, 90), np.percentile(x, (10, 25, 75, 90), axis=1)))
    return {"skewness": (d**3).mean(axis=1) / var**1.5, "kurtosis": (d**4).mean(axis=1) / var**2 - 3, **{f"q{p}": v for p, v in q.items()}, "iqr": q[75] - q[25]}


def autocorrelation(x: np.ndarray, n: int, lags: int = 10) -> dict[str, np.ndarray]:
    out = {}
    for k in range(1, lags + 1):
        if n <= lags:
            out[f"autocorr_lag{k}"] = np.full(len(x), np.nan)
            continue
        a, b = x[:, k:], x[:, :-k]
        a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
        out[f"autocorr_lag{k}"] = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return out


def peaks(x: np.ndarray, n: int) -> dict[str, np.ndarray]:
    names = ("n_peaks", "n_troughs", "peak_mean", "peak_max", "trough_mean", "trough_min")
    rows = []
    for v in x:
        r = v[np.concatenate([[True], v[1:] != v[:-1]])] if n else v
        up = r[1:-1][(r[1:-1] > r[:-2]) & (r[1:-1] > r[2:])] if len(r) > 2 else r[:0]
        down = r[1:-1][(r[1:-1] < r[:-2]) & (r[1:-1] < r[2:])] if len(r) > 2 else r[:0]
        few = n < 3
        rows.append((np.nan if few else len(up), np.nan if few else len(down), up.mean() if len(up) else np.nan, up.max() if len(up) else np.nan, down.mean() if len(down) else np.nan, down.min() if len(down) else np.nan))
    return dict(zip(names, np.array(rows, dtype=float).reshape(-1, 6).T))


def trends(x: np.ndarray, n: int) -> dict[str, np.ndarray]:
    none = np.full(len(x), np.nan)
    if n < 2:
        return dict.fromkeys(("trend_slope", "trend_intercept", "first_value", "last_value", "change", "mean_abs_change", "mean_change"), none)
    i = np.arange(n)
    slope = ((i - i.mean()) * x).sum(axis=1) / ((i - i.mean()) ** 2).sum()
    d = np.diff(x, axis=1)
    return {"trend_slope": slope, "trend_intercept": x.mean(axis=1) - slope * i.mean(), "first_value": x[:, 0], "last_value": x[:, -1], "change": x[:, -1] - x[:, 0], "mean_abs_change": np.abs(d).mean(axis=1), "mean_change": d.mean(axis=1)}


def rolling(x: np.ndarray, n: int, windows: tuple[int, ...] = (5, 10, 20)) -> dict[str, np.ndarray]:
    out, none = {}, np.full(len(x), np.nan)
    for s in windows:
        if n < s:
            out |= {f"rolling{s}_{k}": none for k in ("mean_of_means", "max_of_means", "std_of_stds")}
            continue
        w = np.lib.stride_tricks.sliding_window_view(x, s, axis=1)
        m, sd = w.mean(axis=2), w.std(axis=2, ddof=1) if s > 1 else np.full(w.shape[:2], np.nan)
        out |= {f"rolling{s}_mean_of_means": m.mean(axis=1), f"rolling{s}_max_of_means": m.max(axis=1), f"rolling{s}_std_of_stds": sd.std(axis=1, ddof=1) if m.shape[1] > 1 else none}
    return out


def fft(x: np.ndarray, n: int, coefficients: int = 10) -> dict[str, np.ndarray]:
    none = np.full(len(x), np.nan)
    if n < 4:
        return {f"fft_coeff_{k}": none for k in range(1, coefficients + 1)} | {"spectral_energy": none, "dominant_freq_idx": none}
    f = np.abs(np.fft.fft(x, axis=1))
    top = f[:, 1 : n // 2]
    return {f"fft_coeff_{k}": f[:, k] if n // 2 >= k else none for k in range(1, coefficients + 1)} | {"spectral_energy": n * (x * x).sum(axis=1), "dominant_freq_idx": top.argmax(axis=1) + 1.0}


def entropy(x: np.ndarray, n: int, bins: int = 10) -> dict[str, np.ndarray]:
    none = np.full(len(x), np.nan)
    if n < 4:
        return {"binned_entropy": none, "sample_entropy": none, "approximate_entropy": none}
    lo, hi = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
    flat = hi == lo
    at = np.minimum(np.floor((x - np.where(flat, lo - 0.5, lo)) / np.where(flat, 1.0, hi - lo) * bins), bins - 1).astype(int)
    p = np.stack([(at == b).mean(axis=1) for b in range(bins)], axis=1)
    return {"binned_entropy": -np.where(p > 0, p * np.log(p + 1e-10), 0).sum(axis=1), "sample_entropy": np.array([sample_entropy(v) for v in x]), "approximate_entropy": np.array([approximate_entropy(v) for v in x])}


def energy(x: np.ndarray, n: int) -> dict[str, np.ndarray]:
    none = np.full(len(x), np.nan)
    if n < 2:
        return dict.fromkeys(("abs_energy", "mean_abs_change", "mean_second_deriv_central", "rms", "crest_factor"), none)
    sq = (x * x).sum(axis=1)
    rms = np.sqrt(sq / n)
    return {"abs_energy": sq, "mean_abs_change": np.abs(np.diff(x, axis=1)).mean(axis=1), "mean_second_deriv_central": (x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2]).mean(axis=1) if n > 2 else none, "rms": rms, "crest_factor": np.where(rms > 0, np.abs(x).max(axis=1) / rms, np.nan)}


def complexity(x: np.ndarray, n: int) -> dict[str, np.ndarray]:
    names = ("cid_ce", "c3", "ratio_unique_values", "has_duplicate", "has_duplicate_max", "has_duplicate_min", "sum_reoccurring_values", "sum_reoccurring_data_points", "pct_reoccurring_data_points")
    if n < 3:
        return dict.fromkeys(names, np.full(len(x), np.nan))
    s = np.sort(x, axis=1)
    new = np.concatenate([np.ones((len(x), 1), bool), s[:, 1:] != s[:, :-1]], axis=1)
    last = np.concatenate([new[:, 1:], np.ones((len(x), 1), bool)], axis=1)
    again = ~(new & last)
    distinct = new.sum(axis=1)
    return {"cid_ce": np.sqrt((np.diff(x, axis=1) ** 2).sum(axis=1)), "c3": (x[:, 2:] * x[:, 1:-1] * x[:, :-2]).mean(axis=1), "ratio_unique_values": distinct / n, "has_duplicate": distinct < n, "has_duplicate_max": again[:, -1], "has_duplicate_min": again[:, 0], "sum_reoccurring_values": np.where(again, s, 0).sum(axis=1), "sum_reoccurring_data_points": again.sum(axis=1), "pct_reoccurring_data_points": again.mean(axis=1)}


def counts(x: np.ndarray, n: int) -> dict[str, np.ndarray]:
    names = ("count_above_mean", "count_below_mean", "first_loc_max", "first_loc_min", "last_loc_max", "last_loc_min", "number_crossings_mean", "number_zero_crossings", "abs_sum_changes", "longest_strike_above_mean", "longest_strike_below_mean")
    if n < 2:
        return dict.fromkeys(names, np.full(len(x), np.nan))
    d = np.sign(x - x.mean(axis=1, keepdims=True))
    back = x[:, ::-1]
    cross = lambda s: (s[:, 1:] != s[:, :-1]).sum(axis=1)
    return dict(zip(names, ((d > 0).sum(axis=1), (d < 0).sum(axis=1), x.argmax(axis=1) / n, x.argmin(axis=1) / n, (n - 1 - back.argmax(axis=1)) / n, (n - 1 - back.argmin(axis=1)) / n, cross(d), cross(np.sign(x)), np.abs(np.diff(x, axis=1)).sum(axis=1), _runs(d > 0), _runs(d < 0))))


GROUPS = {"basic_stats": basic_stats, "distribution": distribution, "autocorrelation": autocorrelation, "peaks": peaks, "trends": trends, "rolling": rolling, "fft": fft, "entropy": entropy, "energy": energy, "complexity": complexity, "counts": counts}


def array_series(df: DataFrame, column: str, groups: list[str] | None = None) -> DataFrame:
    """``df`` with every feature of the ``groups`` (all by default) for the series in an array column.

    A series is a cell's finite values; ``length`` counts all of them, also nulls and NaN.  A null cell has nulls everywhere.
    """
    chosen = [g for g in GROUPS if groups is None or g in groups]
    with np.errstate(divide="ignore", invalid="ignore"):
        shape = {k: None for g in chosen for k in GROUPS[g](np.zeros((1, 24)), 24)} | ({"length": None} if "basic_stats" in chosen else {})
    names = list(shape)
    where = df.columns.index(column)
    new = [T.StructField(f"{column}_{k}", T.LongType() if k in INTEGERS else T.DoubleType()) for k in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column(where)
            got = {k: np.full(b.num_rows, np.nan) for k in names}
            size = pa.compute.list_value_length(cells).fill_null(-1).to_numpy(zero_copy_only=False)
            value = pa.compute.fill_null(cells.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), np.maximum(size, 0))
            ok = np.isfinite(value)
            value, row = value[ok], row[ok]
            n = np.bincount(row, minlength=b.num_rows)
            start = np.cumsum(n) - n
            for length in np.unique(n[size >= 0]).tolist():
                at = np.flatnonzero((n == length) & (size >= 0))
                x = value[start[at][:, None] + np.arange(length)[None]] if length else np.zeros((len(at), 0))
                with np.errstate(divide="ignore", invalid="ignore"):
                    for g in chosen:
                        for k, v in GROUPS[g](x, length).items():
                            got[k][at] = v
            if "length" in got:
                got["length"] = np.where(size >= 0, size, np.nan).astype(float)
            cols = [pa.array(np.where(np.isfinite(got[k]), got[k], 0), mask=~np.isfinite(got[k])) for k in names]
            yield pa.RecordBatch.from_arrays([*b.columns, *[c.cast(pa.int64()) if k in INTEGERS else c for k, c in zip(names, cols)]], names=[*b.schema.names, *[f"{column}_{k}" for k in names]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))
