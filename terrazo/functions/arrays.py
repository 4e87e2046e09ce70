"""Array kernels that SQL can't express: water-cloud inversion, texture, coherence and offsets of image pairs."""

from __future__ import annotations

import math

import numpy as np


def wcm_power(v: np.ndarray, a: float, b: float, soil: np.ndarray, incidence_deg: float) -> np.ndarray:
    c = math.cos(math.radians(incidence_deg))
    tau = np.exp(-2 * b * v / c)
    return a * v * c * (1 - tau) + soil * tau


def wcm_turning(a: float, b: float, soil: np.ndarray, incidence_deg: float, top: float = 10.0) -> np.ndarray:
    """Water content of least power, by a golden-section search."""
    lo, hi = np.zeros_like(soil), np.full_like(soil, top)
    g = (math.sqrt(5) - 1) / 2
    for _ in range(60):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = wcm_power(x, a, b, soil, incidence_deg) < wcm_power(y, a, b, soil, incidence_deg)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def wcm_invert(power: np.ndarray, a: float, b: float, soil: np.ndarray, incidence_deg: float, top: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Water content above the turning point by bisection, and a flag: ok, ambiguous, floor, sat, or nan where power isn't above 0."""
    turn = wcm_turning(a, b, soil, incidence_deg, top)
    floor, ceiling = wcm_power(turn, a, b, soil, incidence_deg), wcm_power(np.full_like(soil, top), a, b, soil, incidence_deg)
    lo, hi = turn.copy(), np.full_like(soil, top)
    for _ in range(60):
        mid = (lo + hi) / 2
        up = wcm_power(mid, a, b, soil, incidence_deg) < power
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    root = (lo + hi) / 2
    bare = wcm_power(np.zeros_like(soil), a, b, soil, incidence_deg)
    flag = np.select([~np.isfinite(power) | ~np.isfinite(soil) | (power <= 0), power <= floor, power >= ceiling, power < bare], ["nan", "floor", "sat", "ambiguous"], "ok")
    root = np.select([flag == "nan", flag == "floor", flag == "sat"], [np.nan, turn, top], root)
    return root, flag


def glcm_entropy(image: np.ndarray, inside: np.ndarray, levels: int = 8) -> float:
    """Mean Shannon entropy (nats) of symmetric co-occurrence in four directions, over grey levels of the whole image.

    nan under 16 pixels with a value, or where a direction has no pair inside.
    """
    inside = inside & np.isfinite(image)
    if inside.sum() < 16:
        return float("nan")
    lo, hi = np.nanpercentile(image, [1, 99])
    q = (np.clip((np.where(inside, image, lo) - lo) / max(hi - lo, 1e-6), 0, 1) * (levels - 1)).astype(int)
    out = []
    for dr, dc in ((0, 1), (1, 1), (1, 0), (1, -1)):
        rows, cols = image.shape
        r0, r1 = slice(0, rows - dr), slice(dr, rows)
        c0, c1 = (slice(0, cols - dc), slice(dc, cols)) if dc >= 0 else (slice(-dc, cols), slice(0, cols + dc))
        both = inside[r0, c0] & inside[r1, c1]
        m = np.zeros((levels, levels))
        np.add.at(m, (q[r0, c0][both], q[r1, c1][both]), 1)
        m = m + m.T
        if not m.sum():
            return float("nan")
        p = m[m > 0] / m.sum()
        out.append(float(-(p * np.log(p)).sum()))
    return float(np.mean(out))


def boxcar(a: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square around each cell, cut at the border."""
    k = size // 2
    pad = np.pad(a, ((k + 1, k), (k + 1, k)))
    ones = np.pad(np.ones(a.shape), ((k + 1, k), (k + 1, k)))

    def sums(x: np.ndarray) -> np.ndarray:
        c = x.cumsum(0).cumsum(1)
        return c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]

    return sums(pad) / sums(ones)


def coherence(a: np.ndarray, b: np.ndarray, size: int = 9) -> np.ndarray:
    num = boxcar(a * b.conj(), size)
    return np.abs(num) / np.sqrt(np.maximum(boxcar(np.abs(a) ** 2, size).real * boxcar(np.abs(b) ** 2, size).real, 1e-30))


def fourier_shift(a: np.ndarray, dy: float, dx: float) -> np.ndarray:
    ky, kx = np.fft.fftfreq(a.shape[0])[:, None], np.fft.fftfreq(a.shape[1])[None, :]
    return np.fft.ifft2(np.fft.fft2(a) * np.exp(-2j * np.pi * (ky * dy + kx * dx)))


def offset(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Shift of b against a from the cross-correlation's peak, refined by parabolas."""
    x, y = np.abs(a) - np.abs(a).mean(), np.abs(b) - np.abs(b).mean()
    c = np.fft.ifft2(np.fft.fft2(y) * np.fft.fft2(x).conj()).real
    out = []
    peak = np.unravel_index(c.argmax(), c.shape)
    for axis in (0, 1):
        n, at = c.shape[axis], list(peak)
        v = []
        for d in (-1, 0, 1):
            at[axis] = (peak[axis] + d) % n
            v.append(c[tuple(at)])
        bend = v[0] - 2 * v[1] + v[2]
        s = peak[axis] + (0.5 * (v[0] - v[2]) / bend if bend else 0.0)
        out.append(float(s - n if s > n / 2 else s))
    return out[0], out[1]


def sublook_coherence(z: np.ndarray, size: int = 9) -> np.ndarray:
    """Coherence of the two halves of the occupied azimuth band (bins with a quarter of the peak's power at least)."""
    f = np.fft.fftshift(np.fft.fft(z, axis=0), axes=0)
    power = (np.abs(f) ** 2).sum(1)
    used = np.flatnonzero(power >= 0.25 * power.max())
    lo, hi = used[0], used[-1] + 1
    half = (hi - lo) // 2
    looks = [np.fft.ifft(np.fft.ifftshift(np.pad(f[s : s + half], ((0, len(f) - half), (0, 0))), axes=0), axis=0) for s in (lo, lo + half)]
    return coherence(looks[0], looks[1], size)


def student_p(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation by the t distribution (regularised incomplete beta by a continued fraction)."""
    if n < 3 or not math.isfinite(rho):
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    t2 = rho * rho * df / (1 - rho * rho)
    return _beta(df / (df + t2), df / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def loo_errors(x: np.ndarray, y: np.ndarray, target: np.ndarray, degree: int) -> np.ndarray:
    """Leave-one-out residuals of a polynomial surface, from the diagonal of its hat matrix."""
    terms = np.stack([x**i * y**j for i in range(degree + 1) for j in range(degree + 1 - i)], 1)
    q, _ = np.linalg.qr(terms)
    residual = target - q @ (q.T @ target)
    return residual / np.maximum(1 - (q * q).sum(1), 1e-12)
