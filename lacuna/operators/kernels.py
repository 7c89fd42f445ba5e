"""NumPy imputers for one series at a time: ``f(t, y, gone, period, rng, **options) -> filled``.

``y`` holds NaN where ``gone`` is true. The registry runs them on batches of whole series and falls back to the mean where one fails; ``rnn_many`` and
``gb_many`` take a batch in one call, each series with a model of its own.
"""

from __future__ import annotations

import numpy as np


# ---------------------------------------------------------------- splines and Gaussian processes
def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline by the tridiagonal system of second derivatives; the end cubics continue outside."""
    n = len(x)
    if n < 2:
        return np.full(len(at), y[0] if n else np.nan)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(n)
    if n > 2:
        diag, rhs, upper = 2 * (h[:-1] + h[1:]), 6 * np.diff(d), h[1:-1].copy()
        for i in range(1, n - 2):
            w = h[i] / diag[i - 1]
            diag[i] -= w * h[i]
            rhs[i] -= w * rhs[i - 1]
        m[n - 2] = rhs[-1] / diag[-1]
        for i in range(n - 4, -1, -1):
            m[i + 1] = (rhs[i] - upper[i] * m[i + 2]) / diag[i]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    a, b = x[k + 1] - at, at - x[k]
    hk = h[k]
    return (m[k] * a**3 + m[k + 1] * b**3) / (6 * hk) + (y[k] / hk - m[k] * hk / 6) * a + (y[k + 1] / hk - m[k + 1] * hk / 6) * b


def spline(t, y, gone, period, rng):
    seen = ~gone
    x, first = np.unique(t[seen], return_index=True)
    out = y.copy()
    out[gone] = natural_spline(x, y[seen][first], t[gone])
    return out


def _matern(r: np.ndarray, log_amp: float, log_scale: float) -> tuple[np.ndarray, np.ndarray]:
    s = np.sqrt(3) * r / np.exp(0.5 * log_scale)
    e = np.exp(log_amp - s)
    return (1 + s) * e, 0.5 * s * s * e  # kernel, derivative by the log of the squared scale


def gp_fit(x: np.ndarray, y: np.ndarray, noise: float, restarts: int, rng: np.random.Generator, steps: int = 40) -> np.ndarray:
    """(log amplitude, log squared scale) that minimise the negative log likelihood, by quasi-Newton steps from perturbed starts."""
    r = np.abs(x[:, None] - x[None, :])

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        k, dk = _matern(r, *np.clip(p, -20, 20))
        try:
            L = np.linalg.cholesky(k + noise**2 * np.eye(len(x)))
        except np.linalg.LinAlgError:
            return np.inf, np.zeros(2)
        inv = np.linalg.inv(L)
        a = inv.T @ (inv @ y)
        w = inv.T @ inv - np.outer(a, a)
        return float(0.5 * y @ a + np.log(np.diag(L)).sum()), 0.5 * np.array([(w * k).sum(), (w * dk).sum()])

    start = np.array([np.log(np.var(y) + 1e-12), np.log(20 * np.median(np.diff(np.sort(x))) + 1e-12)])
    best, low = start, loss(start)[0]
    for i in range(max(1, restarts)):
        p = best + (0.5 * rng.standard_normal(2) if i else 0)
        f, g = loss(p)
        H = np.eye(2)
        for _ in range(steps):
            d = -H @ g
            if d @ g >= 0:
                H, d = np.eye(2), -g
            step = min(1.0, 2.0 / (np.abs(d).max() + 1e-12))
            while step > 1e-6:
                f1, g1 = loss(p + step * d)
                if f1 < f + 1e-4 * step * (d @ g):
                    break
                step /= 2
            else:
                break
            s, yk = step * d, g1 - g
            p, done, f, g = p + s, abs(f - f1) < 1e-7, f1, g1
            if s @ yk > 1e-12:
                rho = 1 / (s @ yk)
                V = np.eye(2) - rho * np.outer(s, yk)
                H = V @ H @ V.T + rho * np.outer(s, s)
            if done:
                break
        if f < low:
            best, low = p, f
    return best


def gp_predict(t, y, gone, rng, restarts: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and variance of a Matern-3/2 process at the missing samples."""
    seen = ~gone
    x, mu = t[seen], y[seen].mean()
    f = y[seen] - mu
    noise = max(float(np.std(np.diff(y[seen])) / np.sqrt(2)) if len(f) > 1 else 0.0, 1e-6)
    p = np.clip(gp_fit(x, f, noise, restarts, rng), -20, 20)
    k = _matern(np.abs(x[:, None] - x[None, :]), *p)[0] + noise**2 * np.eye(len(x))
    L = np.linalg.cholesky(k)
    ks = _matern(np.abs(t[gone][:, None] - x[None, :]), *p)[0]
    v = np.linalg.solve(L, ks.T)
    return mu + v.T @ np.linalg.solve(L, f), np.maximum(np.exp(p[0]) - (v * v).sum(axis=0), 0)


def gp_matern(t, y, gone, period, rng, restarts: int = 20):
    out = y.copy()
    out[gone] = gp_predict(t, y, gone, rng, restarts)[0]
    return out


# ---------------------------------------------------------------- lag matrices, chained equations, trees
def design(t: np.ndarray, y: np.ndarray, period: float, L: int = 5) -> np.ndarray:
    """Columns lag0, lag1, lead1, .., sin, cos; NaN beyond the edges and where missing."""
    n, cols = len(y), [y]
    for k in range(1, L + 1):
        cols += [np.r_[np.full(min(k, n), np.nan), y[:-k]][:n], np.r_[y[k:], np.full(min(k, n), np.nan)][:n]]
    x = 2 * np.pi * t / period
    return np.column_stack([*cols, np.sin(x), np.cos(x)])


def bayesian_ridge(X: np.ndarray, y: np.ndarray, rounds: int = 300, tol: float = 1e-3):
    """Evidence maximisation over noise and weight precisions; returns a predictor."""
    xm, ym = X.mean(axis=0), y.mean()
    U, s, Vt = np.linalg.svd(X - xm, full_matrices=False)
    yc, n = y - ym, len(y)
    alpha, lam, w = 1 / (np.var(y) + 1e-12), 1.0, np.zeros(X.shape[1])
    Uy = U.T @ yc
    for _ in range(rounds):
        new = Vt.T @ (Uy * s / (s * s + lam / alpha))
        rss = ((yc - (X - xm) @ new) ** 2).sum()
        gamma = (alpha * s * s / (lam + alpha * s * s)).sum()
        lam = (gamma + 2e-6) / ((new**2).sum() + 2e-6)
        alpha = (n - gamma + 2e-6) / (rss + 2e-6)
        moved, w = np.abs(new - w).sum(), new
        if moved < tol:
            break
    return lambda Z: ym + (Z - xm) @ w


def chained(X: np.ndarray, fit, rounds: int, tol: float = 1e-3) -> np.ndarray:
    """Round-robin regression of incomplete columns on all others, fewest gaps first."""
    gaps = np.isnan(X)
    with np.errstate(all="ignore"):
        means = np.array([np.nanmean(c) if (~np.isnan(c)).any() else 0.0 for c in X.T])
    Z = np.where(gaps, means, X)
    order = [j for j in np.argsort(gaps.sum(axis=0), kind="stable") if 0 < gaps[:, j].sum() < len(X)]
    scale = np.abs(X[~gaps]).max() if (~gaps).any() else 1.0
    for _ in range(rounds):
        before = Z.copy()
        for j in order:
            rest = np.delete(Z, j, axis=1)
            Z[gaps[:, j], j] = fit(rest[~gaps[:, j]], X[~gaps[:, j], j])(rest[gaps[:, j]])
        if np.abs(Z - before).max() < tol * scale:
            break
    return Z


def ts_mice(t, y, gone, period, rng, L: int = 5, max_iter: int = 10, n_chains: int = 1):
    """Chains only differ if they sample; without sampling one equals their mean."""
    out = y.copy()
    out[gone] = chained(design(t, y, period, L), bayesian_ridge, max_iter)[gone, 0]
    return out


def _unit(most, n):
    """The power of two of which ``n`` numbers up to ``most``, rounded to it, have sums without an error, whatever their order."""
    return np.ldexp(1.0, np.frexp(most)[1] + np.frexp(n)[1] - 52)


class Forest:
    """Regression trees on binned features, all grown level by level with histograms.

    ``rows`` (trees, n) are each tree's sample indices. ``ridge`` shrinks leaf values and gains; ``depth`` bounds growth.
    """

    def __init__(self, X: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, ridge: float = 0.0, min_leaf: int = 1, bins: int = 64):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in X.T]
        B, width = self._bin(X), bins
        trees, n = rows.shape
        node = np.repeat(np.arange(trees), n)
        unit = _unit(np.abs(y).max(initial=0), n)
        flat, target = rows.reshape(-1), (np.rint(y / unit) * unit)[rows.reshape(-1)]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        count = trees
        live = np.ones(len(flat), dtype=bool)
        for level in range(depth + 1):
            g = np.bincount(node, target, count)
            m = np.bincount(node, minlength=count).astype(float)
            value = g / np.maximum(m + ridge, 1e-12)
            feature, cut = np.full(count, -1), np.zeros(count, dtype=np.int64)
            if level < depth:
                best = np.full(count, 1e-12)
                base = g * g / np.maximum(m + ridge, 1e-12)
                for j in range(B.shape[1]):
                    cell = node[live] * width + B[flat[live], j]
                    cg = np.cumsum(np.bincount(cell, target[live], count * width).reshape(count, width), axis=1)
                    cm = np.cumsum(np.bincount(cell, minlength=count * width).reshape(count, width), axis=1)
                    rg, rm = g[:, None] - cg, m[:, None] - cm
                    gain = np.where((cm >= min_leaf) & (rm >= min_leaf), cg**2 / np.maximum(cm + ridge, 1e-12) + rg**2 / np.maximum(rm + ridge, 1e-12) - base[:, None], -1.0)
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(count), at]
                    better = top > best
                    best[better], feature[better], cut[better] = top[better], j, at[better]
            split = feature >= 0
            child = np.cumsum(np.r_[0, split[:-1]]) * 2
            self.levels.append((feature, cut, child, value))
            if not split.any():
                break
            keep = split[node]
            node, flat, target = node[keep], flat[keep], target[keep]
            right = B[flat, feature[node]] > cut[node]
            node, live = child[node] + right, np.ones(len(flat), dtype=bool)
            count = 2 * int(split.sum())
        self.trees = trees

    def _bin(self, X: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, X.T)])

    def predict(self, X: np.ndarray) -> np.ndarray:
        """Mean over the trees."""
        B = self._bin(X)
        n = len(X)
        out = np.zeros(n)
        node, row = np.repeat(np.arange(self.trees), n), np.tile(np.arange(n), self.trees)
        for feature, cut, child, value in self.levels:
            leaf = feature[node] < 0
            np.add.at(out, row[leaf], value[node[leaf]])
            node, row = node[~leaf], row[~leaf]
            node = child[node] + (B[row, feature[node]] > cut[node])
            if not len(node):
                break
        return out / self.trees


def rf_impute(t, y, gone, period, rng, L: int = 5, n_estimators: int = 100, max_depth: int = 14):
    X = design(t, y, period, L)[:, 1:]
    train = ~gone & np.isfinite(X).all(axis=1)
    if train.sum() < 2:
        raise ValueError("no complete rows to learn from")
    X = np.where(np.isnan(X), np.nanmedian(X, axis=0), X)
    rows = rng.integers(0, train.sum(), (n_estimators, train.sum()))
    out = y.copy()
    out[gone] = Forest(X[train], y[train], rows, max_depth).predict(X[gone])
    return out


def _cells(edges: np.ndarray, X: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges.T, X.T)])


def boosted_many(sets: list, rounds: int, depth: int, rate: float, ridge: float = 1.0, bins: int = 64) -> list[np.ndarray]:
    """Predictions for ``Z`` of each set ``(X, y, Z)`` by gradient-boosted trees of its own, all sets' trees grown together level by level.

    The trees are those of ``Forest`` with one tree a set, whose nodes never mix. Rows are binned and, by every feature, sorted once; nodes stay in that order
    as they divide, so a level costs the rows it holds, not the bins of its nodes. Sums are whole numbers of a set's unit (``_unit``), the same in any order.
    """
    sizes, asked = np.array([len(y) for _, y, _ in sets]), [len(Z) for *_, Z in sets]
    B, C = [], []
    for X, _, Z in sets:
        edges = np.quantile(X, np.linspace(0, 1, bins)[1:-1], axis=0)
        B.append(_cells(edges, X))
        C.append(_cells(edges, Z))
    B, C, y = np.concatenate(B, axis=1), np.concatenate(C, axis=1), np.concatenate([y for _, y, _ in sets])
    base = np.array([t.mean() for _, t, _ in sets])
    roots, questions, first = np.repeat(np.arange(len(sets)), sizes), np.repeat(np.arange(len(sets)), asked), np.cumsum(sizes) - sizes
    sorted_rows = np.argsort(roots * bins + B, axis=1, kind="stable")
    sorted_bins = np.take_along_axis(B, sorted_rows, axis=1).astype(np.int16)
    f, total = base[roots], np.zeros(C.shape[1])
    for _ in range(rounds):
        rest = y - f
        unit = _unit(np.maximum.reduceat(np.abs(rest), first), sizes)
        units = np.rint(rest / unit[roots])
        if not np.isfinite(units).all():
            raise ArithmeticError("values without a finite sum")
        exact = units.astype(np.int64)
        node, flat, znode, zflat, count = roots, np.arange(len(y)), questions, np.arange(C.shape[1]), len(sets)
        rows, cells = sorted_rows, sorted_bins
        for level in range(depth + 1):
            g = np.bincount(node, units[flat], count)
            m = np.bincount(node, minlength=count)
            value = g * unit / np.maximum(m + ridge, 1e-12)
            feature, cut, split = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64), np.zeros(count, dtype=bool)
            if level < depth:
                ends = np.cumsum(m)
                owner, place = np.repeat(np.arange(count), m), np.arange(rows.shape[1])
                left = place - (ends - m)[owner] + 1
                behind = np.cumsum(g.astype(np.int64)) - g.astype(np.int64)
                gain = np.cumsum(exact[rows], axis=1)
                gain -= behind[owner]
                gain = gain.astype(float)
                other = g[owner] - gain
                gain *= gain
                gain /= np.maximum(left + ridge, 1e-12)
                other *= other
                other /= np.maximum(m[owner] - left + ridge, 1e-12)
                gain += other
                gain -= (g * g / np.maximum(m + ridge, 1e-12))[owner]
                np.copyto(gain[:, :-1], -1.0, where=cells[:, 1:] == cells[:, :-1])
                gain[:, ends - 1] = -1.0
                top = np.maximum.reduceat(gain, ends - m, axis=1)
                feature = top.argmax(axis=0)
                best = top[feature, np.arange(count)]
                split = best * unit * unit > 1e-12
                hits = np.flatnonzero(gain[feature[owner], place] == best[owner])
                cut = cells[feature, hits[np.searchsorted(owner[hits], np.arange(count))]]
            keep, zkeep = split[node], split[znode]
            f[flat[~keep]] += rate * value[node[~keep]]
            total[zflat[~zkeep]] += value[znode[~zkeep]]
            if not split.any():
                break
            # left children first, then right ones
            child, count = np.cumsum(split) - 1, int(split.sum())
            node, flat, znode, zflat = node[keep], flat[keep], znode[zkeep], zflat[zkeep]
            right, zright = B[feature[node], flat] > cut[node], C[feature[znode], zflat] > cut[znode]
            if level + 1 < depth:
                side = np.zeros(len(y), dtype=np.int8)
                side[flat] = 1 + right
                side = side[rows]
                parts = [np.flatnonzero(side == k).reshape(len(side), -1) for k in (1, 2)]
                places = np.concatenate(parts, axis=1)
                rows, cells = np.take(rows, places), np.take(cells, places)
            node, znode = child[node] + count * right, child[znode] + count * zright
            unit, count = np.tile(unit[split], 2), 2 * count
    return np.split(base[questions] + rate * total, np.cumsum(asked)[:-1])


def chained_many(frames: list[np.ndarray], fit_many, rounds: int, tol: float = 1e-3) -> list[np.ndarray]:
    """``chained`` of many frames at once; ``fit_many`` predicts ``Z`` for many ``(X, y, Z)``. Each frame has its own order of columns and its own end."""
    gaps = [np.isnan(X) for X in frames]
    Z, orders, scales = [], [], []
    for X, gap in zip(frames, gaps):
        means = np.array([c[~g].mean() if not g.all() else 0.0 for c, g in zip(X.T, gap.T)])
        Z.append(np.where(gap, means, X))
        orders.append([j for j in np.argsort(gap.sum(axis=0), kind="stable") if 0 < gap[:, j].sum() < len(X)])
        scales.append(np.abs(X[~gap]).max() if (~gap).any() else 1.0)
    going = list(range(len(frames)))
    for _ in range(rounds):
        before = {i: Z[i].copy() for i in going}
        for step in range(max((len(orders[i]) for i in going), default=0)):
            part = [i for i in going if step < len(orders[i])]
            sets = []
            for i in part:
                j = orders[i][step]
                rest, g = np.delete(Z[i], j, axis=1), gaps[i][:, j]
                sets.append((rest[~g], frames[i][~g, j], rest[g]))
            for i, got in zip(part, fit_many(sets)):
                Z[i][gaps[i][:, orders[i][step]], orders[i][step]] = got
        going = [i for i in going if not np.abs(Z[i] - before[i]).max() < tol * scales[i]]
        if not going:
            break
    return Z


#: Rows of the series whose trees grow together: their histograms stay in the cache.
TOGETHER = 1 << 13


def gb_many(series: list, L: int = 5, n_estimators: int = 100, max_depth: int = 4, max_iter: int = 5, n_chains: int = 1, learning_rate: float = 0.3) -> list[np.ndarray]:
    """``gb_mice`` of many series ``(t, y, gone, period, rng)``."""
    out, at = [], 0
    while at < len(series):
        rows = np.cumsum([len(s[1]) for s in series[at:at + TOGETHER]])
        part = series[at:at + max(1, int(np.searchsorted(rows, TOGETHER)))]
        at += len(part)
        filled = chained_many([design(t, y, period, L) for t, y, _, period, _ in part], lambda sets: boosted_many(sets, n_estimators, max_depth, learning_rate), max_iter)
        out += [np.where(gone, Z[:, 0], y) for (_, y, gone, *_), Z in zip(part, filled)]
    return out


def gb_mice(t, y, gone, period, rng, L: int = 5, n_estimators: int = 100, max_depth: int = 4, max_iter: int = 5, n_chains: int = 1, learning_rate: float = 0.3):
    return gb_many([(t, y, gone, period, rng)], L, n_estimators, max_depth, max_iter, n_chains, learning_rate)[0]


# ---------------------------------------------------------------- Hankel factorisation
def mf_impute(t, y, gone, period, rng, rank: int = 10, alpha: float = 1e-3, tol: float = 1e-4, max_iter: int = 200):
    """Alternating least squares on the Hankel matrix, started from a truncated SVD; anti-diagonal means."""
    n = len(y)
    D = n // 2
    i = np.arange(D)[:, None] + np.arange(n - D + 1)[None, :]
    H, seen = y[i], ~gone[i]
    with np.errstate(all="ignore"):
        means = np.array([c[s].mean() if s.any() else y[~gone].mean() for c, s in zip(np.where(seen, H, 0).T, seen.T)])
    full = np.where(seen, H, means[None, :])
    U, s, Vt = np.linalg.svd(full, full_matrices=False)
    k = min(rank, len(s))
    U, V = U[:, :k] * s[:k], Vt[:k].T
    ridge, last = alpha * np.eye(k), np.inf
    Z, M = np.where(seen, H, 0.0), seen.astype(float)
    for _ in range(max_iter):
        A = np.einsum("jk,jr,js->krs", M, U, U, optimize=True) + ridge
        V = np.linalg.solve(A, (Z.T @ U)[:, :, None])[:, :, 0]
        A = np.einsum("jk,kr,ks->jrs", M, V, V, optimize=True) + ridge
        U = np.linalg.solve(A, (Z @ V)[:, :, None])[:, :, 0]
        err = np.sqrt((((H - U @ V.T) * M)[seen] ** 2).mean())
        if abs(last - err) < tol * max(err, 1e-12):
            break
        last = err
    est = np.bincount(i.reshape(-1), (U @ V.T).reshape(-1), n) / np.bincount(i.reshape(-1), minlength=n)
    out = y.copy()
    out[gone] = est[gone]
    return out


# ---------------------------------------------------------------- neural imputers
class Adam:
    def __init__(self, params: dict[str, np.ndarray], lr: float):
        self.p, self.lr, self.i = params, lr, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.i += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] -= self.lr * (self.m[k] / (1 - 0.9**self.i)) / (np.sqrt(self.v[k] / (1 - 0.999**self.i)) + 1e-8)


def _init(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return rng.uniform(-1, 1, shape) / np.sqrt(shape[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _lstm(X: np.ndarray, W: np.ndarray, U: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states over the last axis but one of ``X``; leading axes are series, each with weights of its own."""
    n = U.shape[-2]
    h = c = np.zeros((*X.shape[:-2], n))
    out, tape = np.empty((*X.shape[:-1], n)), []
    XW = X @ W + b[..., None, :]
    for k in range(X.shape[-2]):
        z = XW[..., k, :] + (h[..., None, :] @ U)[..., 0, :]
        s, g = _sigmoid(z[..., :3 * n]), np.tanh(z[..., 3 * n:])
        i, f, o = s[..., :n], s[..., n:2 * n], s[..., 2 * n:]
        c1 = f * c + i * g
        tc = np.tanh(c1)
        tape.append((i, f, o, g, c, tc, h))
        h, c = o * tc, c1
        out[..., k, :] = h
    return out, tape


def _lstm_back(X: np.ndarray, dH: np.ndarray, U: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = U.shape[-2]
    dh = dc = np.zeros((*X.shape[:-2], n))
    dZ, prev = np.empty((*X.shape[:-1], 4 * n)), np.empty((*X.shape[:-1], n))
    UT = np.ascontiguousarray(np.swapaxes(U, -1, -2))
    for k in range(X.shape[-2] - 1, -1, -1):
        i, f, o, g, c, tc, h = tape[k]
        d = dH[..., k, :] + dh
        dc1 = dc + d * o * (1 - tc * tc)
        z = np.concatenate([dc1 * g * i * (1 - i), dc1 * c * f * (1 - f), d * tc * o * (1 - o), dc1 * i * (1 - g * g)], axis=-1)
        dZ[..., k, :] = z
        dh, dc, prev[..., k, :] = (z[..., None, :] @ UT)[..., 0, :], dc1 * f, h
    return np.swapaxes(X, -1, -2) @ dZ, np.swapaxes(prev, -1, -2) @ dZ, dZ.sum(axis=-2)


#: Weights of the networks trained side by side, and rows of their series, padded.
WEIGHTS, PADDED = 1 << 19, 1 << 15


def _rnn_side_by_side(series: list, h: int, epochs: int, lr: float) -> list[np.ndarray]:
    """Networks of several series, trained in step. Shorter series end in padding that has no error, so no gradient comes from it."""
    sizes = np.array([len(y) for _, y, *_ in series])
    B, T = len(series), sizes.max()
    X, m, z, scale, drawn = np.zeros((B, T, 3)), np.zeros((B, T)), np.zeros((B, T)), [], []
    for b, (t, y, gone, _, rng) in enumerate(series):
        mu, sd = y[~gone].mean(), y[~gone].std() or 1.0
        n = len(y)
        m[b, :n], z[b, :n] = ~gone, np.where(gone, 0.0, (y - mu) / sd)
        X[b, :n, 2] = np.diff(t, prepend=t[0])
        scale.append((mu, sd))
        drawn.append(rng.uniform(-1, 1, 2 * (12 * h + 4 * h * h) + 2 * h))
    X[..., 0], X[..., 1] = z, m
    place = np.arange(T)[None, :]
    back = np.where(place < sizes[:, None], sizes[:, None] - 1 - place, place)[:, :, None]  # the series in reverse, padding behind it
    drawn, at, P = np.array(drawn), 0, {}
    for name, shape in (("Wf", (3, 4 * h)), ("Uf", (h, 4 * h)), ("Wb", (3, 4 * h)), ("Ub", (h, 4 * h)), ("o", (2 * h, 1))):
        size = shape[0] * shape[1]
        P[name] = drawn[:, at:at + size].reshape(B, *shape) / np.sqrt(shape[0])
        at += size
    P |= {"bf": np.zeros((B, 4 * h)), "bb": np.zeros((B, 4 * h)), "ob": np.zeros((B, 1))}
    opt, XB = Adam(P, lr), np.take_along_axis(X, back, axis=1)
    for epoch in range(epochs + 1):
        hf, tf = _lstm(X, P["Wf"], P["Uf"], P["bf"])
        hb, tb = _lstm(XB, P["Wb"], P["Ub"], P["bb"])
        H = np.concatenate([hf, np.take_along_axis(hb, back, axis=1)], axis=-1)
        pred = (H @ P["o"])[..., 0] + P["ob"]
        if epoch == epochs:
            break
        d = (2 * m * (pred - z) / sizes[:, None])[..., None]
        dH = d @ np.swapaxes(P["o"], -1, -2)
        g = {"o": np.swapaxes(H, -1, -2) @ d, "ob": d.sum(axis=1)}
        g["Wf"], g["Uf"], g["bf"] = _lstm_back(X, dH[..., :h], P["Uf"], tf)
        g["Wb"], g["Ub"], g["bb"] = _lstm_back(XB, np.take_along_axis(dH[..., h:], back, axis=1), P["Ub"], tb)
        opt.step(g)
    return [np.where(gone, pred[b, :len(y)] * scale[b][1] + scale[b][0], y) for b, (_, y, gone, *_) in enumerate(series)]


def rnn_many(series: list, hidden_size: int = 64, epochs: int = 50, lr: float = 1e-3) -> list[np.ndarray]:
    """``rnn_impute`` of many series ``(t, y, gone, period, rng)``: one network a series, series of about one length side by side."""
    out: list = [None] * len(series)
    todo = sorted(range(len(series)), key=lambda i: len(series[i][1]))
    most = max(1, WEIGHTS // (8 * hidden_size * (hidden_size + 4)))
    while todo:
        k = max(1, min(most, PADDED // max(1, len(series[todo[-1]][1]))))
        part, todo = todo[-k:], todo[:-k]
        for i, filled in zip(part, _rnn_side_by_side([series[i] for i in part], hidden_size, epochs, lr)):
            out[i] = filled
    return out


def rnn_impute(t, y, gone, period, rng, hidden_size: int = 64, epochs: int = 50, lr: float = 1e-3):
    """Bidirectional LSTM over (value, mask, time step), trained on the observed samples' squared error."""
    return rnn_many([(t, y, gone, period, rng)], hidden_size, epochs, lr)[0]


def _mlp(x: np.ndarray, P: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    a = np.maximum(x @ P[f"{name}1"] + P[f"{name}b1"], 0)
    return a, _sigmoid(a @ P[f"{name}2"] + P[f"{name}b2"])


def _mlp_back(x, a, dz, P, name):
    """Gradients given the gradient ``dz`` before the output's sigmoid; also that of the input."""
    da = (dz @ P[f"{name}2"].T) * (a > 0)
    return {f"{name}1": np.outer(x, da), f"{name}b1": da, f"{name}2": np.outer(a, dz), f"{name}b2": dz}, da @ P[f"{name}1"].T


def gain_impute(t, y, gone, period, rng, hint_rate: float = 0.1, lambda_recon: float = 10.0, epochs: int = 200, lr: float = 1e-3):
    """Adversarial imputation: a generator fills the min-max scaled series, a discriminator guesses which samples are real."""
    lo, hi = y[~gone].min(), y[~gone].max()
    span = hi - lo or 1.0
    m, n = (~gone).astype(float), len(y)
    x = np.where(gone, 0.0, (y - lo) / span)
    hid = max(32, min(256, n))
    P = {"g1": _init(rng, n, hid), "gb1": np.zeros(hid), "g2": _init(rng, hid, n), "gb2": np.zeros(n)}
    Q = {"d1": _init(rng, 2 * n, hid), "db1": np.zeros(hid), "d2": _init(rng, hid, n), "db2": np.zeros(n)}
    og, od = Adam(P, lr), Adam(Q, lr)
    for _ in range(epochs):
        inp = m * x + (1 - m) * rng.uniform(0, 0.01, n)
        hidden = rng.random(n) < hint_rate
        hint = np.where(hidden, 0.5, m)
        a, fake = _mlp(inp, P, "g")
        d_in = np.r_[m * x + (1 - m) * fake, hint]
        b, prob = _mlp(d_in, Q, "d")
        od.step(_mlp_back(d_in, b, (prob - m) / n, Q, "d")[0])
        b, prob = _mlp(d_in, Q, "d")
        # the generator wants its samples called real, and the observed ones rebuilt
        _, back = _mlp_back(d_in, b, (1 - m) * (prob - 1) / n, Q, "d")
        dfake = back[:n] * (1 - m) + lambda_recon * 2 * m * (fake - x) / max(m.sum(), 1)
        og.step(_mlp_back(inp, a, dfake * fake * (1 - fake), P, "g")[0])
    out = y.copy()
    out[gone] = _mlp(m * x, P, "g")[1][gone] * span + lo
    return out


def _norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mu, sd = x.mean(axis=1, keepdims=True), np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)
    return (x - mu) / sd, (x - mu) / sd, sd


def _norm_back(d: np.ndarray, xn: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return (d - d.mean(axis=1, keepdims=True) - xn * (d * xn).mean(axis=1, keepdims=True)) / sd


def saits(t, y, gone, period, rng, d_model: int = 64, n_heads: int = 4, n_layers: int = 2, epochs: int = 100, lr: float = 1e-3, diagonal_mask: bool = True):
    """Self-attention over (value, mask, time) with a learned position code; with ``diagonal_mask`` no sample attends to itself."""
    m = (~gone).astype(float)
    mu, sd = y[~gone].mean(), y[~gone].std() or 1.0
    z = np.where(gone, 0.0, (y - mu) / sd)
    tn = (t - t.min()) / ((t.max() - t.min()) or 1.0)
    X, n, d, dh = np.column_stack([z, m, tn]), len(y), d_model, d_model // n_heads
    P = {"in": _init(rng, 3, d), "pos": 0.02 * rng.standard_normal((n, d)), "out": _init(rng, d, 1), "ob": np.zeros(1)}
    for i in range(n_layers):
        P |= {f"{k}{i}": _init(rng, d, d) for k in "qkvw"} | {f"a{i}": _init(rng, d, 2 * d), f"c{i}": _init(rng, 2 * d, d)}
    mask = np.where(np.eye(n, dtype=bool), -1e9, 0.0) if diagonal_mask and n > 1 else np.zeros((n, n))
    opt = Adam(P, lr)
    heads = lambda x: x.reshape(n, n_heads, dh).transpose(1, 0, 2)
    flat = lambda x: x.transpose(1, 0, 2).reshape(n, d)
    for epoch in range(epochs + 1):
        h, tape = X @ P["in"] + P["pos"], []
        for i in range(n_layers):
            q, k, v = (heads(h @ P[f"{c}{i}"]) for c in "qkv")
            s = q @ k.transpose(0, 2, 1) / np.sqrt(dh) + mask
            s = np.exp(s - s.max(axis=2, keepdims=True))
            s /= s.sum(axis=2, keepdims=True)
            o = flat(s @ v)
            h1, n1, s1 = _norm(h + o @ P[f"w{i}"])
            f = np.maximum(h1 @ P[f"a{i}"], 0)
            h2, n2, s2 = _norm(h1 + f @ P[f"c{i}"])
            tape.append((h, q, k, v, s, o, h1, n1, s1, f, n2, s2))
            h = h2
        pred = (h @ P["out"] + P["ob"])[:, 0]
        if epoch == epochs:
            break
        e = (2 * m * (pred - z) / max(m.sum(), 1))[:, None]
        g = {"out": h.T @ e, "ob": e.sum(axis=0)}
        dhid = e @ P["out"].T
        for i in range(n_layers - 1, -1, -1):
            x, q, k, v, s, o, h1, n1, s1, f, n2, s2 = tape[i]
            dr = _norm_back(dhid, n2, s2)
            df = (dr @ P[f"c{i}"].T) * (f > 0)
            g[f"c{i}"], g[f"a{i}"] = f.T @ dr, h1.T @ df
            dr = _norm_back(dr + df @ P[f"a{i}"].T, n1, s1)
            g[f"w{i}"] = o.T @ dr
            do = heads(dr @ P[f"w{i}"].T)
            dv, ds = s.transpose(0, 2, 1) @ do, do @ v.transpose(0, 2, 1)
            ds = s * (ds - (ds * s).sum(axis=2, keepdims=True)) / np.sqrt(dh)
            dhid = dr
            for c, dc in (("q", ds @ k), ("k", ds.transpose(0, 2, 1) @ q), ("v", dv)):
                g[f"{c}{i}"] = x.T @ flat(dc)
                dhid = dhid + flat(dc) @ P[f"{c}{i}"].T
        g["in"], g["pos"] = X.T @ dhid, dhid
        opt.step(g)
    out = y.copy()
    out[gone] = pred[gone] * sd + mu
    return out
