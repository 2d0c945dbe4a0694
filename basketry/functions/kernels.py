"""NumPy kernels of one fit: min 1/2 w'Gw - (c - lam)'w over w >= 0, from a window's Gram matrix G = X'X and c = X'y."""

from __future__ import annotations

import numpy as np


def _solve(g: np.ndarray, d: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(g, d)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(g, d, rcond=None)[0]


def _null_direction(g: np.ndarray) -> np.ndarray | None:
    """A direction that the quadratic form does not see, if its columns depend on each other."""
    try:
        pivots = np.diag(np.linalg.cholesky(g)) ** 2
        if pivots.min() > 1e-9 * pivots.max():
            return None
    except np.linalg.LinAlgError:
        pass
    values, vectors = np.linalg.eigh(g)
    return vectors[:, 0] if values[0] <= 1e-11 * max(float(values[-1]), 1e-300) else None


def active_set(g: np.ndarray, d: np.ndarray, w: np.ndarray, tol: float) -> np.ndarray:
    """The exact non-negative minimizer of 1/2 w'Gw - d'w, from a start ``w``: positive entries are solved for, the worst
    violator joins, entries that turn negative leave. Where the positive entries' columns depend on each other, the weights move along the dependence, to where it pays, until one of
    them is 0. Raises if it ends without a minimizer: when steps run out and an entry still gains more than rounding explains."""
    w = np.where(w > 1e-12, w, 0.0)
    inside = w > 0
    for _ in range(10 * len(d) + 50):
        while inside.any():
            at = np.flatnonzero(inside)
            v = _null_direction(g[np.ix_(at, at)])
            if v is not None:
                v = v if d[at] @ v > 0 else -v
                if not (v < 0).any():
                    v = -v
                steps = np.where(v < 0, w[at] / np.maximum(-v, 1e-300), np.inf)
                out = int(np.argmin(steps))
                w[at] = np.maximum(w[at] + steps[out] * v, 0.0)
                w[at[out]] = 0.0
                inside[at[out]] = False
                continue
            z = np.zeros_like(w)
            z[at] = np.linalg.solve(g[np.ix_(at, at)], d[at])
            down = inside & (z <= 0)
            if not down.any():
                w = z
                break
            step = min(1.0, float(np.min(w[down] / np.maximum(w[down] - z[down], 1e-300))))
            w = np.maximum(w + step * (z - w), 0.0)
            leave = down & (w <= 1e-14)
            if not leave.any():
                leave = down & (w == w[down].min())
            inside &= ~leave
            w[~inside] = 0.0
        gain = np.where(inside, -np.inf, d - g @ w)
        j = int(np.argmax(gain))
        if gain[j] <= tol:
            return w
        inside[j] = True
    if float(np.max(d - g @ w)) > max(tol, 1e-7 * float(np.abs(d).max())):
        raise RuntimeError("the active set did not settle")
    return w


def grown_fit(gram: list, factor: list, c: list, w: list, column: list, own: float, c_new: float):
    """The least squares over w >= 0 when one column joins: (w, gram, factor, c) with that column last.

    ``gram``: x_i'x_j of the columns so far, ``factor``: its lower Cholesky rows, ``column``: their products with the new one, ``own``: its square. The factor grows by one row; it is
    not extended once a column depends on those before it (its rows are then fewer than the columns).
    """
    gram = [[*row, v] for row, v in zip(gram, column, strict=True)] + [[*column, own]]
    c = [*c, c_new]
    if len(factor) == len(column):
        lower = _lower(factor)
        along = np.linalg.solve(lower, np.array(column)) if factor else np.zeros(0)
        pivot = own - float(along @ along)
        if pivot > 1e-12 * max(own, 1e-300):
            factor = [*factor, [*along.tolist(), float(np.sqrt(pivot))]]
    if len(factor) == len(c):
        lower = _lower(factor)
        z = np.linalg.solve(lower.T, np.linalg.solve(lower, np.array(c)))
        if (z > 0).all():
            return z, gram, factor, c
    return active_set(np.array(gram), np.array(c), np.append(np.asarray(w, dtype=float), 0.0), 1e-12), gram, factor, c


def _lower(rows: list) -> np.ndarray:
    out = np.zeros((len(rows), len(rows)))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _trace(k: int, w: np.ndarray, before: np.ndarray, g: np.ndarray, d: np.ndarray) -> tuple[int, float, float, float]:
    slope = g @ w - d
    return k, float(np.linalg.norm(w - before)), float(np.max(np.where(w > 0, np.abs(slope), np.maximum(-slope, 0.0)))), float(0.5 * w @ g @ w - d @ w)


def fista(g, d, w, tol, most, trace):
    """Accelerated projected gradient with restarts."""
    step = 1.0 / max(float(np.linalg.eigvalsh(g)[-1]), 1e-12)
    v, t = w.copy(), 1.0
    for k in range(1, most + 1):
        new = np.maximum(v - step * (g @ v - d), 0.0)
        if (v - new) @ (new - w) > 0:
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        trace.append(_trace(k, new, w, g, d)) if k % 25 == 0 else None
        small = np.linalg.norm(new - w) <= tol * max(1.0, np.linalg.norm(w))
        w, t = new, t2
        if small:
            return w, k, True
    return w, most, False


def coordinate_descent(g, d, w, tol, most, trace):
    diagonal, slope = np.maximum(np.diag(g), 1e-12), g @ w - d
    for k in range(1, most + 1):
        before = w.copy()
        for j in range(len(w)):
            new = max(w[j] - slope[j] / diagonal[j], 0.0)
            if new != w[j]:
                slope += g[:, j] * (new - w[j])
                w[j] = new
        trace.append(_trace(k, w, before, g, d)) if k % 25 == 0 else None
        if np.linalg.norm(w - before) <= tol * max(1.0, np.linalg.norm(before)):
            return w, k, True
    return w, most, False


def splitting(g, d, w, tol, most, trace):
    """Alternating directions with a fixed penalty of the Gram's mean eigenvalue."""
    rho = max(float(np.trace(g)) / len(d), 1e-12)
    inverse, u = np.linalg.inv(g + rho * np.eye(len(d))), np.zeros_like(w)
    for k in range(1, most + 1):
        x = inverse @ (d + rho * (w - u))
        new = np.maximum(x + u, 0.0)
        u += x - new
        trace.append(_trace(k, new, w, g, d)) if k % 25 == 0 else None
        small = np.linalg.norm(x - new) <= tol and rho * np.linalg.norm(new - w) <= tol * max(1.0, np.linalg.norm(d))
        w = new
        if small:
            return w, k, True
    return w, most, False


ALGORITHMS = {"fista": fista, "cd": coordinate_descent, "admm": splitting}


def fit_l1(g: np.ndarray, c: np.ndarray, lam, algo: str = "fista", start: np.ndarray | None = None, tol: float = 1e-8, most: int = 3000):
    """(w, iterations, converged, trace). ``lam`` is one penalty or one per asset; the end point is polished exactly."""
    d, trace = c - lam, []
    w, k, done = ALGORITHMS[algo](g, d, np.zeros_like(c) if start is None else start.copy(), tol, most, trace)
    w = active_set(g, d, w, 1e-10 * max(1.0, float(np.abs(c).max(initial=0.0))))
    trace.append(_trace(k, w, w, g, d))
    return w, k, done, trace


def fit_omp(g: np.ndarray, c: np.ndarray, yy: float, k: int, tol: float = 1e-10):
    """Greedy: the asset of largest positive correlation joins and the active set is refitted, up to ``k`` assets."""
    if k < 1:
        raise ValueError("k must be positive")
    w, chosen, trace = np.zeros_like(c), [], []
    while len(chosen) < min(k, len(c)):
        corr = c - g @ w
        corr[chosen] = -np.inf
        j = int(np.argmax(corr))
        if corr[j] <= 1e-12:
            break
        chosen.append(j)
        w = np.zeros_like(c)
        w[chosen] = active_set(g[np.ix_(chosen, chosen)], c[chosen], np.zeros(len(chosen)), 1e-12)
        rss = float(yy - 2 * c @ w + w @ g @ w)
        trace.append((len(chosen), max(rss, 0.0), float(np.max(c - g @ w)), 0.5 * rss))
        if rss < tol * tol:
            break
    return w, len(chosen), True, trace


def fit_reweighted(g: np.ndarray, c: np.ndarray, lam: float, rounds: int = 5, epsilon: float = 1e-3, algo: str = "fista", relative: bool = False):
    """Up to ``rounds`` fits: the first with penalty ``lam`` for all, each later one with lam / (w + epsilon) from the weights before, until the support is stable.

    ``relative`` takes the weights' shares instead and scales the penalties so that the least one is ``lam``: for problems whose weights are far
    from ``epsilon``. A fit without weights ends it.
    """
    w, total, done, trace = fit_l1(g, c, lam, algo)
    for _ in range(rounds - 1):
        if relative and not w.any():
            break
        inverse = 1.0 / ((w / w.sum() if relative else w) + epsilon)
        new, k, done, more = fit_l1(g, c, lam * (inverse / inverse.min() if relative else inverse), algo, start=w)
        total, trace = total + k, trace + more
        same = np.array_equal(new > 1e-8, w > 1e-8)
        w = new
        if same:
            break
    return w, total, done, trace


def l1_path(g: np.ndarray, c: np.ndarray, least: float = 0.0) -> tuple[list[float], list[np.ndarray]]:
    """All breakpoints of min 1/2 w'Gw - c'w + lam sum(w) over w >= 0, from the largest useful penalty down to ``least``: (penalties, weights).

    Between two breakpoints the weights are a straight line: the active ones move along G_AA^-1 1 as the penalty falls, until an entry reaches 0 and leaves or a product
    c_j - G_j w of another one reaches the penalty and that one joins. The last entry is at ``least``. A column that depends on the active ones can't join; it
    stays at the bound with weight 0, as long as it does not gain.
    """
    p = len(c)
    w, lam = np.zeros(p), float(c.max(initial=0.0))
    if lam <= least:
        return [max(lam, least)], [w]
    active, lams, weights = [int(np.argmax(c))], [lam], [w.copy()]
    barred: set[int] = set()
    scale = 1e-12 * max(lam, 1.0)
    for _ in range(50 * p + 100):
        a = np.array(active)
        up = _solve(g[np.ix_(a, a)], np.ones(len(a)))  # dw / d(-lam)
        fall = g[:, a] @ up  # how fast each product falls
        product = c - g @ w
        step, leaves, joins = lam - least, None, None
        for i, j in enumerate(active):
            if up[i] < 0 and -w[j] / up[i] < step:
                step, leaves = max(float(-w[j] / up[i]), 0.0), j
        for j in range(p):
            if j in active or j in barred or fall[j] >= 1 - 1e-12:
                continue
            s = float((lam - product[j]) / (1 - fall[j]))
            if s < step:
                step, leaves, joins = max(s, 0.0), None, j
        w[a] += step * up
        lam -= step
        if leaves is not None:
            w[leaves] = 0.0
            active.remove(leaves)
            barred = {leaves}  # it may not come back at the same penalty
        elif joins is not None:
            active.append(joins)
            b = np.array(active)
            smallest = np.linalg.eigvalsh(g[np.ix_(b, b)])[0]
            if smallest <= 1e-12 * max(float(np.diag(g)[b].max()), 1e-300):
                active.pop()
                barred = barred | {joins}
            elif step > scale:
                barred = set()
        if step > scale:
            barred -= {j for j in barred if j != leaves and j != joins}
            lams.append(lam)
            weights.append(w.copy())
        else:
            weights[-1] = w.copy()
        if lam <= least + scale or not active:
            break
    else:
        raise RuntimeError("the path did not end")
    return lams, weights
