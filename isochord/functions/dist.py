"""Student-t tail probability as a vectorised column function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)
#: Panels for the exponent beyond its start: halves of e ** -1 per unit at one degree of freedom.
_EDGES = np.array([0, 0.25, 0.5, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128.0])


def _panels(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = np.diff(edges) / 2
    x = (edges[:-1] + half)[:, None] + half[:, None] * _NODES
    return x.ravel(), (half[:, None] * _WEIGHTS).ravel()


_STEPS, _STEP_WEIGHTS = _panels(_EDGES)
_UNIT, _UNIT_WEIGHTS = _panels(np.linspace(0, 1, 5))


def _gamma_ratio(a: np.ndarray) -> np.ndarray:
    """gamma(a + 1/2) / gamma(a); by its series where logarithms would cancel."""
    small = np.minimum(a, 1e4)
    exact = np.exp([math.lgamma(v + 0.5) - math.lgamma(v) for v in small.ravel()]).reshape(a.shape)
    r = 1 / np.maximum(a, 1.0)
    series = np.sqrt(a) * (1 - r / 8 + r ** 2 / 128 + 5 * r ** 3 / 1024 - 21 * r ** 4 / 32768)
    return np.where(a < 200, exact, series)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for any degrees of freedom from one on.

    Up to |t| = 1 one less the integral of the density from 0. Beyond, the density is
    exp(-y) with y = (df + 1) / 2 * log(1 + u^2 / df), and the tail is integrated over y, where
    it falls alike for small and large df.
    """
    t, df = np.broadcast_arrays(np.abs(np.asarray(t, float)), np.asarray(df, float))
    shape, t, df = t.shape, t.ravel()[:, None], df.ravel()[:, None]
    scale = _gamma_ratio(df / 2) / np.sqrt(df * np.pi)
    u = np.minimum(t, 1.0) * _UNIT
    near = 1 - 2 * scale[:, 0] * np.minimum(t, 1.0)[:, 0] * (
        _UNIT_WEIGHTS * np.exp(-(df + 1) / 2 * np.log1p(u * u / df))).sum(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        start = (df + 1) / 2 * np.log1p(np.maximum(t, 1.0) ** 2 / df)
        log_ratio = 2 * (start + _STEPS) / (df + 1)
        u = np.sqrt(df * np.expm1(log_ratio))
        far = 2 * scale[:, 0] * (_STEP_WEIGHTS * np.exp(log_ratio - start - _STEPS) * df
                                 / ((df + 1) * u)).sum(axis=1)
    out = np.where(t[:, 0] <= 1, near, far)
    return np.clip(np.where(np.isinf(t[:, 0]), 0.0, out), 0.0, 1.0).reshape(shape)


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = t_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
    return out.where(ok, None)
