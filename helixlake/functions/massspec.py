"""Spectrum functions as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_peak(mz: Column | str, peak: float | Column, tolerance: float | Column) -> Column:
    """Whether a value lies closer to ``peak`` than ``tolerance``; null for a null list, null members are passed over."""
    return F.exists(_col(mz), lambda m: F.coalesce(F.abs(m - peak) < tolerance, F.lit(False)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def bin_udf(mz: pd.Series, intensity: pd.Series, min_mz: pd.Series, n_bins: pd.Series, width: pd.Series) -> pd.Series:
    """All rows of a batch in one pass over their peaks."""
    there = mz.notna().to_numpy() & intensity.notna().to_numpy()
    rows = np.flatnonzero(there)
    counts = n_bins.to_numpy()[rows].astype(np.int64)
    base = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.array([min(len(mz.iat[r]), len(intensity.iat[r])) for r in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    join = lambda s: np.concatenate([np.asarray(s.iat[r], float)[:n] for r, n in zip(rows, sizes, strict=True)]) if len(rows) else np.zeros(0)
    m, v = join(mz), join(intensity)
    with np.errstate(invalid="ignore"):
        bins = np.floor((m - min_mz.to_numpy(float)[rows][owner]) / width.to_numpy(float)[rows][owner])
        good = (bins >= 0) & (bins < counts[owner]) & ~np.isnan(v)
    sums = np.bincount(base[owner[good]] + bins[good].astype(np.int64), v[good], int(base[-1]))
    out: list[np.ndarray | None] = [None] * len(mz)
    for k, r in enumerate(rows.tolist()):
        out[r] = sums[base[k] : base[k + 1]]
    return pd.Series(out, dtype=object)


def bin_vectors(mz: Column | str, intensity: Column | str, min_mz: float, n_bins: int, width: float) -> Column:
    """Intensities summed in ``n_bins`` bins of ``width`` from ``min_mz``; null or outlying values are passed over; null for a null list.

    Built-in functions need a pass over the peaks for every bin, hence an Arrow-batched function.
    """
    return bin_udf(_col(mz), _col(intensity), F.lit(float(min_mz)), F.lit(int(n_bins)), F.lit(float(width)))
