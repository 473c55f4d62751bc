"""Small numpy filters applied to whole batches of equally long signals."""

from __future__ import annotations

from math import gcd

import numpy as np


def resample_taps(up: int, down: int, beta: float = 5.0) -> np.ndarray:
    """Kaiser-windowed low-pass of 20 * max(up, down) + 1 taps, unit gain times ``up``."""
    rate = max(up, down)
    half = 10 * rate
    n = np.arange(-half, half + 1)
    h = np.sinc(n / rate) / rate * np.kaiser(2 * half + 1, beta)
    return h / h.sum() * up


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Rational resampling along the last axis, zero beyond both ends."""
    g = gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return x.copy()
    taps, half = resample_taps(up, down), 10 * max(up, down)
    n = x.shape[-1]
    n_out = -(-n * up // down)
    reach = half // up + 1
    padded = np.concatenate([np.zeros((*x.shape[:-1], reach)), x,
                             np.zeros((*x.shape[:-1], reach + down))], axis=-1)
    out = np.empty((*x.shape[:-1], n_out))
    # outputs m, m + up, m + 2 up ... share one phase and hence one set of taps
    for first in range(min(up, n_out)):
        at = first * down
        lo = -(-(at - half) // up)
        hi = (at + half) // up
        h = taps[at - np.arange(lo, hi + 1) * up + half]
        m = np.arange(first, n_out, up)
        base = (m - first) // up * down + lo + reach
        idx = base[:, None] + np.arange(hi - lo + 1)[None, :]
        out[..., first::up] = np.take(padded, idx, axis=-1) @ h
    return out


def band_sections(lo: float, hi: float, fs: float, order: int = 4) -> list[np.ndarray]:
    """Second-order sections of a digital Butterworth band-pass."""
    w = 2 * fs * np.tan(np.pi * np.array([lo, hi]) / fs)
    width, centre = w[1] - w[0], np.sqrt(w[0] * w[1])
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * width / 2
    poles = np.concatenate([proto + s * np.sqrt(proto ** 2 - centre ** 2) for s in (1, -1)])
    z = (2 * fs + poles) / (2 * fs - poles)
    gain = np.real(width ** order * (2 * fs) ** order / np.prod(2 * fs - poles))
    upper = z[z.imag > 0]
    sections = []
    for n, p in enumerate(upper):
        b = np.array([1.0, 0.0, -1.0]) * (gain if n == 0 else 1.0)
        sections.append(np.concatenate([b, [1.0, -2 * p.real, abs(p) ** 2]]))
    return sections


def _run(sections, x: np.ndarray) -> np.ndarray:
    """Filter along the last axis, started as if the first sample had lasted for ever."""
    y, level = x.copy(), x[..., 0].copy()
    for b0, b1, b2, _, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        s1 = (gain - b0) * level
        s2 = (b2 - a2 * gain) * level
        for t in range(y.shape[-1]):
            v = y[..., t].copy()
            o = b0 * v + s1
            s1 = b1 * v - a1 * o + s2
            s2 = b2 * v - a2 * o
            y[..., t] = o
        level = gain * level
    return y


def zero_phase_band(x: np.ndarray, lo: float, hi: float, fs: float) -> np.ndarray:
    """Forward and backward band-pass with odd reflection of 27 samples at the ends."""
    sections = band_sections(lo, hi, fs)
    edge = 3 * (2 * len(sections) + 1)
    head = 2 * x[..., :1] - x[..., edge:0:-1]
    tail = 2 * x[..., -1:] - x[..., -2:-edge - 2:-1]
    y = _run(sections, np.concatenate([head, x, tail], axis=-1))
    y = _run(sections, y[..., ::-1])[..., ::-1]
    return y[..., edge:-edge]


def welch(x: np.ndarray, fs: float, nperseg: int):
    """One-sided power density: Hann windows, half overlap, mean removed per segment."""
    step = nperseg - nperseg // 2
    starts = np.arange(0, x.shape[-1] - nperseg + 1, step)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    scale = 1.0 / (fs * np.square(window).sum())
    total = 0.0
    for s in starts:
        seg = x[..., s:s + nperseg]
        spec = np.fft.rfft((seg - seg.mean(-1, keepdims=True)) * window, axis=-1)
        total = total + np.square(np.abs(spec)) * scale
    power = total / len(starts)
    last = -1 if nperseg % 2 == 0 else None
    power[..., 1:last] *= 2
    return np.fft.rfftfreq(nperseg, 1 / fs), power
