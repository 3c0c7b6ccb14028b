"""Numerical kernels on one signal: numpy only, tested without Spark."""

from __future__ import annotations

import numpy as np

Array = np.ndarray


def simpson(y: Array, x: Array) -> float:
    """Composite Simpson on uneven x; an even number of samples ends with the parabola through the last three."""
    n = len(y)
    if n < 2:
        return 0.0
    if n == 2:
        return float((x[1] - x[0]) * (y[0] + y[1]) / 2)
    m = n if n % 2 else n - 1
    h = np.diff(x)
    a, b = h[0 : m - 1 : 2], h[1 : m - 1 : 2]
    f0, f1, f2 = y[0 : m - 2 : 2], y[1 : m - 1 : 2], y[2:m:2]
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = (a + b) / 6 * ((2 - b / a) * f0 + (a + b) ** 2 / (a * b) * f1 + (2 - a / b) * f2)
    total = float(np.nansum(parts))
    if n % 2 == 0:
        a, b = h[-1], h[-2]
        total += float(y[-1] * (2 * a * a + 3 * a * b) / (6 * (a + b)) + y[-2] * (a * a + 3 * a * b) / (6 * b) - y[-3] * a**3 / (6 * b * (a + b)))
    return total


def trapezoid(y: Array, x: Array) -> float:
    return float(((x[1:] - x[:-1]) * (y[1:] + y[:-1])).sum() / 2)


def maxima(y: Array) -> Array:
    """Strict local maxima, flat tops at the floor of their middle, edges never."""
    if len(y) < 3:
        return np.empty(0, int)
    start = np.concatenate([[0], np.nonzero(np.diff(y))[0] + 1])
    end = np.concatenate([start[1:] - 1, [len(y) - 1]])
    v = y[start]
    top = np.nonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]))[0] + 1
    return (start[top] + end[top]) // 2


def prominences(y: Array, peaks: Array) -> tuple[Array, Array, Array]:
    """Prominence, left base and right base of each peak: the lowest places, nearest to it, up to the next higher value."""
    at = np.asarray(peaks, int)
    if np.isnan(y).any():
        low = [np.nonzero(y[:p] > y[p])[0] for p in at]
        high = [np.nonzero(y[p + 1 :] > y[p])[0] for p in at]
        left = np.array([p - int(np.argmin(y[h[-1] if len(h) else 0 : p + 1][::-1])) for p, h in zip(at, low, strict=True)], int)
        right = np.array([p + int(np.argmin(y[p : h[0] + p + 2 if len(h) else len(y)])) for p, h in zip(at, high, strict=True)], int)
    else:
        left, right = lowest_before(y)[at], len(y) - 1 - lowest_before(y[::-1])[len(y) - 1 - at]
    return y[at] - np.maximum(y[left], y[right]), left, right


def lowest_before(y: Array) -> Array:
    """The place of the lowest value from behind the last higher value up to each place, the last of equal ones; one pass."""
    out, tops, lows, places = [], [], [], []  # values that later ones have not reached, and the lowest since the one before
    for i, v in enumerate(y.tolist()):
        low, place = v, i
        while tops and tops[-1] <= v:
            tops.pop()
            other, at = lows.pop(), places.pop()
            if other < low:
                low, place = other, at
        tops.append(v)
        lows.append(low)
        places.append(place)
        out.append(place)
    return np.array(out, int)


def widths(y: Array, peaks: Array, rel: float = 0.5) -> tuple[Array, Array, Array]:
    """Width, left and right crossing at ``rel`` of each prominence, by linear interpolation."""
    prom, base_l, base_r = prominences(y, peaks)
    left, right = np.zeros(len(peaks)), np.zeros(len(peaks))
    for k, p in enumerate(peaks):
        level = y[p] - rel * prom[k]
        i = p
        while i > base_l[k] and y[i] > level:
            i -= 1
        left[k] = i + (level - y[i]) / (y[i + 1] - y[i]) if y[i] < level else i
        i = p
        while i < base_r[k] and y[i] > level:
            i += 1
        right[k] = i - (level - y[i]) / (y[i - 1] - y[i]) if y[i] < level else i
    return right - left, left, right


def find_peaks(y: Array, prominence: float = 0.0, width: float = 0.0, height: float | None = None, distance: int = 1, rel: float = 0.5, flat: bool = True) -> Array:
    """Maxima of at least the height, distance (tallest first), prominence and width asked for; flat tops only if ``flat``."""
    p = maxima(y)
    if not flat and len(p):
        p = p[(y[p] > y[p - 1]) & (y[p] > y[p + 1])]
    if height is not None:
        p = p[y[p] >= height]
    if distance > 1 and len(p):
        keep = np.ones(len(p), bool)
        for k in np.argsort(y[p], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(p - p[k]) < distance
                near[k] = False
                keep &= ~near
        p = p[keep]
    if prominence and len(p):
        p = p[prominences(y, p)[0] >= prominence]
    if width and len(p):
        p = p[widths(y, p, rel)[0] >= width]
    return p


def savgol(y: Array, window: int, order: int, derivative: int = 0, delta: float = 1.0) -> Array:
    """Savitzky-Golay; edges evaluate the polynomial of the outermost whole window."""
    n = len(y)
    window = min(window, n if n % 2 else n - 1)
    if window < 3:
        return y.astype(float) if derivative == 0 else np.zeros(n)
    order, half = min(order, window - 1), window // 2
    at = np.arange(-half, half + 1, dtype=float)
    fit = np.linalg.pinv(np.vander(at, order + 1, increasing=True))
    power = np.arange(order + 1)
    factor = np.array([np.prod(np.arange(k - derivative + 1, k + 1)) if k >= derivative else 0.0 for k in power])

    def row(t: float) -> Array:
        return (factor * np.where(power >= derivative, t ** np.maximum(power - derivative, 0), 0.0)) @ fit / delta**derivative

    out = np.empty(n)
    out[half : n - half] = np.convolve(y, row(0.0)[::-1], mode="valid")
    for t in range(half):
        out[t] = row(t - half) @ y[:window]
        out[n - 1 - t] = row(half - t) @ y[n - window :]
    return out


def median_filter(y: Array, kernel: int) -> Array:
    half = kernel // 2
    return np.median(np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(half), y, np.zeros(half)]), kernel), axis=1)


def smooth_whittaker(y: Array, w: Array, lam: float, order: int = 2) -> Array:
    """Weighted penalised least squares, solved as a band: (W + lam D'D) z = W y, D the differences of ``order`` 1 or 2."""
    n = len(y)
    if n <= order:
        return y.astype(float)
    d = np.diff(np.eye(order + 1), order, axis=0)[0] if order else np.ones(1)
    bands = np.zeros((order + 1, n))
    for k in range(n - order):  # D'D by its diagonals
        for i in range(order + 1):
            for j in range(i, order + 1):
                bands[j - i, k + i] += lam * d[i] * d[j]
    bands[0] += w
    # banded Cholesky, lower form: bands[k, i] holds the entry (i + k, i)
    rhs = w * y
    for i in range(n):
        bands[0, i] = np.sqrt(bands[0, i])
        m = min(order, n - 1 - i)
        bands[1 : m + 1, i] /= bands[0, i]
        for k in range(1, m + 1):
            bands[: m + 1 - k, i + k] -= bands[k, i] * bands[k : m + 1, i]
    z = rhs.astype(float)
    for i in range(n):
        z[i] /= bands[0, i]
        m = min(order, n - 1 - i)
        z[i + 1 : i + 1 + m] -= bands[1 : m + 1, i] * z[i]
    for i in range(n - 1, -1, -1):
        m = min(order, n - 1 - i)
        z[i] = (z[i] - bands[1 : m + 1, i] @ z[i + 1 : i + 1 + m]) / bands[0, i]
    return z


#: Signals of more points are cut for :func:`whittaker_many`.
LONG = 1024


def whittaker_many(y: Array, w: Array, lengths: Array, lam: float, order: int = 2) -> Array:
    """:func:`smooth_whittaker` of many signals at once, one a row, padded beyond their ``lengths``; a step of the band serves all rows."""
    n, d = y.shape[1], np.diff(np.eye(order + 1), order, axis=0)[0]
    bands = np.zeros((order + 1, n, len(y)))
    there = lam * (np.arange(n - order)[:, None] < lengths - order)
    for i in range(order + 1):
        for j in range(i, order + 1):
            bands[j - i, i : n - order + i] += d[i] * d[j] * there
    bands[0] += w.T
    rhs = (w * y).T
    return (banded_long(bands, rhs) if n > LONG else banded(bands, rhs[:, None])[:, 0]).T


def banded(bands: Array, rhs: Array) -> Array:
    """Solutions [place, right side, lane] of banded systems: ``bands[k, i]`` holds the entry (i + k, i), and is overwritten."""
    order, n, z = len(bands) - 1, bands.shape[1], np.array(rhs)
    for i in range(n):
        bands[0, i] = np.sqrt(bands[0, i])
        m = min(order, n - 1 - i)
        bands[1 : m + 1, i] /= bands[0, i]
        for k in range(1, m + 1):
            bands[: m + 1 - k, i + k] -= bands[k, i] * bands[k : m + 1, i]
        z[i] /= bands[0, i]
        z[i + 1 : i + 1 + m] -= bands[1 : m + 1, i, None] * z[i]
    for i in range(n - 1, -1, -1):
        m = min(order, n - 1 - i)
        z[i] = (z[i] - (bands[1 : m + 1, i, None] * z[i + 1 : i + 1 + m]).sum(0)) / bands[0, i]
    return z


def banded_long(bands: Array, rhs: Array) -> Array:
    """:func:`banded` for one right side, exact, in steps that grow with the root of the length.

    The places are cut into stretches, ``order`` places apart. Stretches are solved side by side for the right side and for
    what couples them to the places between; those then meet in a block-tridiagonal system.
    """
    o, n, lanes = len(bands) - 1, *rhs.shape
    m = max(int(np.sqrt(n)), 2 * o)
    count = -(-n // (m + o))
    whole = np.zeros((o + 1, count * (m + o), lanes))
    whole[:, :n] = bands
    whole[0, n:] = 1.0
    whole = whole.reshape(o + 1, count, m + o, lanes)
    f = np.zeros((count * (m + o), lanes))
    f[:n] = rhs
    f = f.reshape(count, m + o, lanes)
    inner = whole[:, :, :m].transpose(0, 2, 1, 3).copy()
    left, right = np.zeros((2, count, o, o, lanes))  # [stretch, its first or last places, places between, lane]
    between = np.zeros((count, o, o, lanes))
    for s in range(o):
        for k in range(o + 1):
            if s + k < o:
                between[:, s + k, s] = between[:, s, s + k] = whole[k, :, m + s]
            else:
                left[1:, s + k - o, s] = whole[k, :-1, m + s]
        for k in range(s + 1, o + 1):  # place m + s is k further than a place of the stretch
            right[:, o + s - k, s] = whole[k, :, m + s - k]
    sides = np.zeros((m, 1 + 2 * o, count, lanes))
    sides[:, 0] = f[:, :m].swapaxes(0, 1)
    sides[:o, 1 : 1 + o] = left.transpose(1, 2, 0, 3)
    sides[m - o :, 1 + o :] = right.transpose(1, 2, 0, 3)
    z = banded(inner.reshape(o + 1, m, -1), sides.reshape(m, 1 + 2 * o, -1)).reshape(sides.shape)
    first, last = z[:o].transpose(2, 0, 1, 3), z[m - o :].transpose(2, 0, 1, 3)  # [stretch, place, side, lane]
    by_right, by_left = np.einsum("bpsl,bpkl->bskl", right, last), np.einsum("bpsl,bpkl->bskl", left, first)
    by_left = np.concatenate([by_left[1:], np.zeros_like(by_left[:1])])  # of the stretch behind
    to_lanes = lambda x: np.ascontiguousarray(np.moveaxis(x, -1, 1))
    diagonal = to_lanes(between - by_right[:, :, 1 + o :] - by_left[:, :, 1 : 1 + o])
    before, behind = to_lanes(-by_right[:, :, 1 : 1 + o]), to_lanes(-by_left[:, :, 1 + o :])
    value = to_lanes((f[:, m:] - by_right[:, :, 0] - by_left[:, :, 0])[:, :, None])
    for b in range(1, count):
        factor = np.linalg.solve(diagonal[b - 1].swapaxes(1, 2), before[b].swapaxes(1, 2)).swapaxes(1, 2)
        diagonal[b] -= factor @ behind[b - 1]
        value[b] -= factor @ value[b - 1]
    for b in range(count - 1, -1, -1):
        value[b] = np.linalg.solve(diagonal[b], value[b] - behind[b] @ value[b + 1] if b + 1 < count else value[b])
    cut = value[..., 0].swapaxes(1, 2)  # [stretch, place between, lane]
    out = np.empty_like(f)
    out[:, m:] = cut
    out[:, :m] = (z[:, 0] - np.einsum("mkbl,bkl->mbl", z[:, 1 + o :], cut)).swapaxes(0, 1)
    out[1:, :m] -= np.einsum("mkbl,bkl->bml", z[:, 1 : 1 + o, 1:], cut[:-1])
    return out.reshape(-1, lanes)[:n]


def reweighted_many(many: list[Array], method: str, lam: float, p: float = 0.01, order: int = 2, rounds: int = 50, tolerance: float = 1e-3) -> list[Array]:
    """asls, arpls or airpls baselines of signals of like length; each stops by its own rule."""
    lengths = np.array([len(y) for y in many])
    y = np.stack([np.pad(np.asarray(v, float), (0, lengths.max() - len(v))) for v in many])
    real = np.arange(y.shape[1]) < lengths[:, None]
    w, out, left = np.ones(y.shape), y.copy(), np.arange(len(y))
    for turn in range(1, rounds + 1):
        if not len(left):
            break
        own, was = real[left], w[left]
        z = whittaker_many(y[left], was, lengths[left], lam, order)
        out[left] = z
        d = np.where(own, y[left] - z, 0.0)
        below, stop = d < 0, np.zeros(len(left), bool)
        if method == "asls":
            new = np.where(d > 0, p, 1 - p)
        elif method == "arpls":
            count = np.maximum(below.sum(1), 1)[:, None]
            mean = (d * below).sum(1, keepdims=True) / count
            spread = np.sqrt((((d - mean) ** 2) * below).sum(1, keepdims=True) / count)
            stop = (below.sum(1) < 2) | (spread[:, 0] == 0)
            spread[stop] = 1.0
            new = 1 / (1 + np.exp(np.clip(2 * (d - (2 * spread - mean)) / spread, -500, 500)))
        else:
            total = (np.abs(d) * below).sum(1, keepdims=True)
            stop = total[:, 0] <= tolerance * np.abs(y[left]).sum(1)
            total[stop] = 1.0
            new = np.where(below, np.exp(np.minimum(turn * np.abs(d) / total, 500)), 0.0)
            edge = np.exp(np.minimum(turn * (np.abs(d) * below).max(1) / total[:, 0], 500))
            new[:, 0] = edge
            new[np.arange(len(left)), lengths[left] - 1] = edge
        new = np.where(own, new, 1.0)
        settled = np.sqrt((((new - was) * own) ** 2).sum(1) / ((was * own) ** 2).sum(1)) < tolerance
        w[left] = np.maximum(new, 1e-12)
        left = left[~(stop | settled)]
    return [z[:n] for z, n in zip(out, lengths, strict=True)]


def baselines(many: list[Array], method: str, lam: float, together: int = 512) -> list[Array]:
    """:func:`baseline` of each signal; reweighted ones of like length are solved together."""
    out: list[Array | None] = [None] * len(many)
    if method not in ("asls", "arpls", "airpls"):
        return [baseline(y, method, lam) for y in many]
    order = sorted((i for i in range(len(many)) if len(many[i]) >= 4), key=lambda i: len(many[i]))
    at = 0
    while at < len(order):
        room = 1.25 * len(many[order[at]]) + 8
        end = at + 1
        while end < len(order) and end - at < together and len(many[order[end]]) <= room:
            end += 1
        for i, z in zip(order[at:end], reweighted_many([many[i] for i in order[at:end]], method, lam), strict=True):
            out[i] = z
        at = end
    return [baseline(y, method, lam) if z is None else z for y, z in zip(many, out, strict=True)]


def spline_basis(n: int, knots: int, degree: int = 3) -> Array:
    """B-splines of evenly spaced knots at ``n`` even places, one a column; rows sum to 1."""
    x, inner = np.linspace(0, 1, n)[:, None], np.linspace(0, 1, knots)
    h = inner[1]
    t = np.concatenate([-h * np.arange(degree, 0, -1), inner, 1 + h * np.arange(1, degree + 1)])
    b = ((x >= t[:-1]) & (x < t[1:])).astype(float)
    b[-1] = 0
    b[-1, degree + knots - 2] = 1  # the last place belongs to the last interval
    for d in range(1, degree + 1):
        b = ((x - t[: -d - 1]) * b[:, :-1] + (t[d + 1 :] - x) * b[:, 1:]) / (d * h)
    return b


def spline_baseline(y: Array, method: str, lam: float, p: float, rounds: int, tolerance: float) -> Array:
    """Penalised splines, reweighted: irsqr (quantile ``p``) or mixture_model (noise and positive peaks by expectation-maximisation)."""
    b = spline_basis(len(y), min(100, max(5, len(y) // 4)))
    d2 = np.diff(np.eye(b.shape[1]), 2, axis=0)
    bend = lam * d2.T @ d2
    span = float(np.ptp(y)) or 1.0

    def fit(w: Array) -> Array:
        bw = b * w[:, None]
        return b @ np.linalg.solve(bw.T @ b + bend + 1e-10 * w.sum() * np.eye(b.shape[1]), bw.T @ y)

    if method == "irsqr":
        w = np.ones(len(y))
        z = fit(w)
        for _ in range(rounds):
            d = y - z
            w = np.where(d > 0, p, 1 - p) / np.sqrt(d * d + (1e-4 * span) ** 2) * span
            last, z = z, fit(w)
            if np.linalg.norm(z - last) <= tolerance * max(np.linalg.norm(last), 1e-30):
                break
        return z
    w = np.ones(len(y))
    for _ in range(10):  # a first guess, asymmetric
        z = fit(w)
        w = np.where(y > z, 0.01, 0.99)
    share, sigma = 0.5, 1e-3 * span
    below = (y - z)[y < z]
    if len(below):
        sigma = max(float(np.sqrt((below**2).mean())), 1e-6 * span)
    for _ in range(rounds):
        d = y - z
        normal = share * np.exp(-0.5 * (d / sigma) ** 2) / (sigma * np.sqrt(2 * np.pi))
        peak = np.where(d > 0, (1 - share) / max(float(d.max()), 1e-6 * span), 0.0)
        new = normal / np.maximum(normal + peak, 1e-300)
        new[d <= 0] = 1.0
        share, sigma = float(np.clip(new.mean(), 0.01, 0.99)), max(float(np.sqrt((new * d * d).sum() / new.sum())), 1e-6 * span)
        z = fit(np.maximum(new, 1e-6))
        if np.linalg.norm(new - w) <= tolerance * np.linalg.norm(w):
            break
        w = new
    return z


def quiet_baseline(y: Array, half: int | None = None, quantile: float = 15.0) -> Array:
    """fastchrom: places of low rolling deviation are baseline, straight lines between them; what falls below a line joins them."""
    n = len(y)
    half = min(half or max(2, n // 50), (n - 1) // 2)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(y, half, mode="reflect"), 2 * half + 1)
    spread, mean = around.std(1), around.mean(1)
    limit = float(np.percentile(spread, quantile))
    known, level, at = spread <= limit, mean.copy(), np.arange(n)
    while True:
        z = np.interp(at, at[known], level[known])
        low = np.nonzero(~known & (y < z - 2 * limit))[0]
        if not len(low):
            return z
        for run in np.split(low, np.nonzero(np.diff(low) > 1)[0] + 1):
            deepest = run[int(np.argmin((y - z)[run]))]
            known[deepest], level[deepest] = True, y[deepest]


def baseline(y: Array, method: str = "arpls", lam: float = 1e4, p: float = 0.01, order: int = 2, degree: int = 2, half: int = 20, rounds: int = 50, tolerance: float = 1e-3) -> Array:
    """Baseline by asls, arpls, airpls, modpoly, imodpoly, snip, irsqr, mixture_model or fastchrom, as published."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 4:
        return np.full(n, y.min() if n else 0.0)
    if method in ("asls", "arpls", "airpls"):
        w = np.ones(n)
        z = y
        for turn in range(1, rounds + 1):
            z = smooth_whittaker(y, w, lam, order)
            d = y - z
            if method == "asls":
                new = np.where(d > 0, p, 1 - p)
            elif method == "arpls":
                below = d[d < 0]
                if len(below) < 2 or below.std() == 0:
                    break
                m, s = below.mean(), below.std()
                new = 1 / (1 + np.exp(np.clip(2 * (d - (2 * s - m)) / s, -500, 500)))
            else:
                total = np.abs(d[d < 0]).sum()
                if total <= tolerance * np.abs(y).sum():
                    break
                new = np.where(d >= 0, 0.0, np.exp(np.minimum(turn * np.abs(d) / total, 500)))
                new[0] = new[-1] = np.exp(min(turn * (np.abs(d[d < 0]).max() / total), 500))
            if np.linalg.norm(new - w) / np.linalg.norm(w) < tolerance:
                break
            w = np.maximum(new, 1e-12)
        return z
    if method in ("modpoly", "imodpoly"):
        x, base, last = np.linspace(-1, 1, n), y.copy(), 0.0
        for turn in range(rounds):
            fit = np.polynomial.polynomial.polyval(x, np.polynomial.polynomial.polyfit(x, base, degree))
            if method == "imodpoly":
                dev = (base - fit).std()
                if turn == 0:
                    base = np.where(y > fit + dev, fit + dev, y)
                base = np.minimum(base, fit + dev)
                if turn and abs(dev - last) <= tolerance * max(dev, 1e-30):
                    return fit
                last = dev
            else:
                new = np.minimum(base, fit)
                if np.linalg.norm(new - base) <= tolerance * max(np.linalg.norm(base), 1e-30):
                    return fit
                base = new
        return fit
    if method == "snip":
        out = y.copy()
        for k in range(min(half, (n - 1) // 2), 0, -1):
            out[k : n - k] = np.minimum(out[k : n - k], (out[: n - 2 * k] + out[2 * k :]) / 2)
        return out
    if method in ("irsqr", "mixture_model"):
        return spline_baseline(y, method, lam, max(p, 0.05), rounds, tolerance)
    if method == "fastchrom":
        return quiet_baseline(y)
    raise ValueError(f"unknown baseline {method}")


def smooth(y: Array, method: str | None, lam: float = 0.1, order: int = 1, window: int = 3, poly: int = 1, kernel: int = 5) -> Array:
    if not method:
        return y
    if method == "whittaker":
        return smooth_whittaker(y, np.ones(len(y)), lam, order)
    if method == "savgol":
        return savgol(y, window, poly)
    if method == "median":
        return median_filter(y, kernel)
    raise ValueError(f"unknown smoother {method}")


def erfcx(x: Array) -> Array:
    """exp(x²)·erfc(x): series near zero by Chebyshev-fitted rational form, continued fraction beyond."""
    x = np.asarray(x, float)
    a = np.abs(x)
    t = 1 / (1 + a / 2)
    # fixed values: coefficients of a published rational approximation of erfc
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = np.zeros_like(a)
    for k in reversed(c):
        poly = poly * t + k
    positive = t * np.exp(np.clip(poly, -700, 700))
    return np.where(x >= 0, positive, 2 * np.exp(np.minimum(x * x, 700)) - positive)


def emg(t: Array, area: float | Array, mu: float | Array, sigma: float | Array, tau: float | Array) -> Array:
    """Exponentially modified Gaussian that integrates to ``area``."""
    sigma, tau = np.maximum(sigma, 1e-6), np.maximum(tau, 1e-9)
    k, z = tau / sigma, (t - mu) / sigma
    return area / (2 * tau) * np.exp(-z * z / 2) * erfcx((1 / k - z) / np.sqrt(2))


def nnls(a: Array, b: Array, rounds: int = 300) -> Array:
    """Lawson-Hanson non-negative least squares."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        if active.all() or w[~active].max(initial=0) <= 1e-10:
            break
        active[np.argmax(np.where(active, -np.inf, w))] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[active].min(initial=1) > 0:
                break
            bad = active & (s <= 0)
            x = x + np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300)) * (s - x)
            active &= x > 1e-12
            x[~active] = 0
        x = s
    return x


def hungarian(cost: Array) -> list[tuple[int, int]]:
    """Least total cost one-to-one assignment, by potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, way, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            cur = c[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (cur < least[1:])
            least[1:][better], way[1:][better] = cur[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def sharpness(y: Array, left: int, right: int) -> float:
    """Mean of the median slopes, a step, up to the top and down from it, over points a quarter of the way from the line between the bounds to the top.

    Where only one side has such points its slope counts as it is, upward positive; no height above the line, or none at
    all, gives -1.
    """
    part = np.asarray(y[left : right + 1], float)
    top = int(np.argmax(part)) if len(part) else 0
    if len(part) < 2 or part[top] <= 0:
        return -1.0
    line = part[0] + (part[-1] - part[0]) * top / (len(part) - 1)
    if part[top] <= line:
        return -1.0
    place = np.arange(len(part))
    high = part >= line + 0.25 * (part[top] - line)
    up, down = (high & (place < top)).nonzero()[0], (high & (place > top)).nonzero()[0]
    rise = float(np.median((part[top] - part[up]) / (top - up))) if len(up) else None
    fall = float(np.median((part[down] - part[top]) / (down - top))) if len(down) else None
    if rise is None and fall is None:
        return -1.0
    return fall if rise is None else rise if fall is None else (rise - fall) / 2


def shape_angle(xa: Array, ya: Array, xb: Array, yb: Array) -> float:
    """Angle in degrees between two traces on the union of their axes; without a norm 90."""
    x = np.union1d(xa, xb)
    a, b = np.interp(x, xa, ya), np.interp(x, xb, yb)
    norm = np.sqrt(trapezoid(a * a, x) * trapezoid(b * b, x))
    return float(np.degrees(np.arccos(np.clip(trapezoid(a * b, x) / norm, 0, 1)))) if norm > 0 else 90.0


def is_shared(y: Array, edge: float = 0.3, delta: float = 0.3) -> bool:
    """More than one inner maximum, or an edge too high, or edges too unlike; a single point or a trace at zero is not shared."""
    if len(y) < 2:
        return False
    if len(maxima(y)) > 1:
        return True
    top = float(np.max(y))
    return top != 0 and bool(max(y[0], y[-1]) / top >= edge or abs(y[0] - y[-1]) / top >= delta)


def lag(xa: Array, ya: Array, xb: Array, yb: Array, most: float, points: int = 10_000) -> float:
    """Shift of b against a (same unit as x) of the highest cross-correlation within ``most``; 0 where it can't be told."""
    low, high = max(xa[0], xb[0]), min(xa[-1], xb[-1])
    if high <= low:
        return 0.0
    x = np.linspace(low, high, points)
    a, b = np.interp(x, xa, ya), np.interp(x, xb, yb)
    if a.std() == 0 or b.std() == 0:
        return 0.0
    a, b = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
    size = 1 << (2 * points - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(b, size) * np.conj(np.fft.rfft(a, size)), size)
    step = (high - low) / (points - 1)
    k = min(int(most / step), points - 1)
    shifts = np.concatenate([np.arange(0, k + 1), np.arange(-k, 0)])
    return float(shifts[int(np.argmax(full[shifts]))] * step)
