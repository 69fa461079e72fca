"""Learning kernels on NumPy arrays: clustering, diagonal Gaussians, distance distributions, profiles."""

from __future__ import annotations

import numpy as np

from tidewave.constants import PROFILE_SCHEMA_VERSION
from tidewave.functions.signal import from_half, random_numbers, to_half


#: Rows and columns of a block of distances that is held at once.
BLOCK_ROWS, TILE = 256, 1024
#: Models that are fitted at once, each without one block.
FITS = 16


def seed_centroids(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ with the seeded generator."""
    draws = iter(random_numbers(seed, k + 1).tolist())
    n = len(x)
    out = [x[min(n - 1, int(next(draws) * n))].copy()]
    near = np.full(n, np.inf)
    while len(out) < k:
        near = np.minimum(near, np.square(x.astype(float) - out[-1]).sum(1))
        hit = np.flatnonzero(next(draws) * near.sum() - np.cumsum(near) <= 0)
        out.append(x[hit[0] if len(hit) else n - 1].copy())
    return np.stack(out).astype(np.float32)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All pairs' squared distances, one row of ``y`` at a time: memory is that of the result and of one copy of ``x``."""
    x = x.astype(float)
    out = np.empty((len(x), len(y)))
    for j, row in enumerate(y):
        gap = x - row
        out[:, j] = np.einsum("id,id->i", gap, gap)
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre nearest to each row, the first of equals: by products of matrices, and where two centres are nearly as near by differences."""
    out = np.empty(len(x), np.int64)
    mean = centres.astype(float).mean(0)
    c = centres.astype(float) - mean
    own = np.square(c).sum(1)
    for a in range(0, len(x), TILE):
        y = x[a : a + TILE].astype(float) - mean
        d = own - 2 * (y @ c.T)
        best = d.argmin(1)
        if len(c) > 1:
            two = np.partition(d, 1, axis=1)
            doubt = np.flatnonzero(~(two[:, 1] - two[:, 0] > 1e-9 * (np.square(y).sum(1) + own.max())))
            best[doubt] = squared_distances(x[a + doubt], centres).argmin(1)
        out[a : a + TILE] = best
    return out


def lloyd(x: np.ndarray, k: int, iterations: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    centres = seed_centroids(x, k, seed)
    label = np.zeros(len(x), np.int64)
    for _ in range(iterations):
        new = nearest(x, centres)
        moved = (new != label).any()
        label = new
        for c in range(k):
            if (label == c).any():
                centres[c] = x[label == c].astype(float).mean(0)
        if not moved:
            break
    return label, centres, float(np.square(x.astype(float) - centres[label]).sum())


def kmeans(x: np.ndarray, k: int, iterations: int = 50, seed: int = 1, restarts: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """(labels, centroids, inertia) of the best of several starts."""
    if not 1 <= k <= len(x):
        raise ValueError("k must be between 1 and the number of vectors")
    return min((lloyd(x, k, iterations, seed + 7919 * r) for r in range(max(1, restarts))), key=lambda c: c[2])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All pairs' distances by a product of matrices; small ones, in which that loses digits, by differences."""
    size = np.square(x).sum(1)[:, None] + np.square(y).sum(1)
    d = size - 2 * (x @ y.T)
    i, j = np.nonzero(~(d > 1e-6 * size))
    for a in range(0, len(i), TILE):
        gap = x[i[a : a + TILE]] - y[j[a : a + TILE]]
        d[i[a : a + TILE], j[a : a + TILE]] = np.einsum("id,id->i", gap, gap)
    return np.sqrt(d, out=d)


def silhouettes(x: np.ndarray, clusterings: list[tuple[int, np.ndarray]]) -> list[float]:
    """The silhouette of each (k, labels): all from one pass over the pairs, of which BLOCK_ROWS x TILE are held."""
    if len(x) < 3 or all(k < 2 for k, _ in clusterings):
        return [0.0] * len(clusterings)
    member = np.concatenate([np.eye(k)[label] for k, label in clusterings], 1)
    y = x.astype(float) - x.astype(float).mean(0)
    sums = np.zeros((len(x), member.shape[1]))
    for a in range(0, len(x), BLOCK_ROWS):
        z = min(len(x), a + BLOCK_ROWS)
        sums[a:z] += _distances(y[a:z], y[a:z]) @ member[a:z]
        for b in range(z, len(x), TILE):  # each pair once
            d = _distances(y[a:z], y[b : b + TILE])
            sums[a:z] += d @ member[b : b + TILE]
            sums[b : b + TILE] += d.T @ member[a:z]
    ends = np.cumsum([0, *(k for k, _ in clusterings)])
    return [_mean_silhouette(sums[:, a:z], label, k) for (k, label), a, z in zip(clusterings, ends[:-1], ends[1:], strict=True)]


def _mean_silhouette(sums: np.ndarray, label: np.ndarray, k: int) -> float:
    n, rows = np.bincount(label, minlength=k), np.arange(len(label))
    means = np.where(n > 0, sums / np.maximum(n, 1), np.inf)
    means[rows, label] = np.inf
    b = means.min(1) if k > 1 else np.full(len(label), np.inf)
    a = sums[rows, label] / np.maximum(n[label] - 1, 1)
    some = (n[label] >= 2) & np.isfinite(b)
    top = np.maximum(a, b)[some]
    return float(np.where(top > 0, (b[some] - a[some]) / np.where(top > 0, top, 1), 0.0).mean()) if some.any() else 0.0


def silhouette(x: np.ndarray, label: np.ndarray, k: int) -> float:
    """Mean over members of clusters of two at least; 0 if undefined."""
    return silhouettes(x, [(k, label)])[0]


def select_clustering(x: np.ndarray, low: int = 1, high: int = 5, fraction: float = 0.08, margin: float = 0.05, least: float = 0.6, seed: int = 1) -> tuple[int, np.ndarray]:
    """(k, labels): more clusters must earn their place by silhouette."""
    return scored_clustering(x, low, high, fraction, margin, least, seed)[:2]


def scored_clustering(x: np.ndarray, low: int = 1, high: int = 5, fraction: float = 0.08, margin: float = 0.05, least: float = 0.6, seed: int = 1) -> tuple[int, np.ndarray, float]:
    """(k, labels, silhouette) of select_clustering."""
    if not len(x):
        raise ValueError("no vectors to cluster")
    low = max(1, low)
    found = [(low, kmeans(x, low, seed=seed)[0])]
    for c in range(low + 1, max(low, min(high, len(x))) + 1):
        other = kmeans(x, c, seed=seed)[0]
        if np.bincount(other, minlength=c).min() >= max(2, int(np.ceil(len(x) * fraction))):
            found.append((c, other))
    scores = silhouettes(x, found)
    (k, label), best = found[0], scores[0]
    for (c, other), s in zip(found[1:], scores[1:], strict=True):
        if s >= least and s > best + margin:
            k, label, best = c, other, s
    return k, label, best


def fit_gaussian(x: np.ndarray, shrinkage: float = 0.25, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, variance, count); variances shrink towards their mean, more so for few vectors."""
    if not len(x):
        raise ValueError("no vectors to fit")
    x = x.astype(float)
    n = len(x)
    var = x.var(0, ddof=1) if n > 1 else np.zeros(x.shape[1])
    weight = min(1.0, shrinkage / max(1.0, n / 8))
    return x.mean(0), np.maximum(floor, (1 - weight) * var + weight * var.mean()), n


def mahalanobis(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return np.sqrt((np.square(x.astype(float) - mean) / var).mean(-1))


def distribution(d: np.ndarray, most: int = 512) -> dict:
    s = np.sort(np.asarray(d, float))
    q = np.percentile(s, [50, 90, 95, 99]) if len(s) else np.zeros(4)
    thin = s if len(s) <= most else s[np.floor(np.arange(most) * (len(s) - 1) / (most - 1) + 0.5).astype(int)]
    return {"samples": thin, "p50": float(q[0]), "p90": float(q[1]), "p95": float(q[2]), "p99": float(q[3]), "max": float(s[-1]) if len(s) else 0.0}


def distance_score(d: np.ndarray, dist: dict) -> np.ndarray:
    """0.5 times the rank up to the largest distance learned, then on to 1."""
    s = dist["samples"]
    d = np.asarray(d, float)
    if not len(s):
        return np.zeros(len(d))
    if len(s) > 1:
        low = np.clip(np.searchsorted(s, d, "right") - 1, 0, len(s) - 2)
        gap = s[low + 1] - s[low]
        rank = (low + np.where(gap > 0, (d - s[low]) / np.where(gap > 0, gap, 1), 0)) / (len(s) - 1)
    else:
        rank = np.zeros(len(d))
    rank = np.where(d <= s[0], 0, np.where(d >= s[-1], 1, rank))
    spread = max(dist["p95"] - dist["p50"], 0.05 * dist["max"], 1e-6)
    return np.where(d <= dist["max"], 0.5 * rank, 1 - 0.5 * np.exp(-(d - dist["max"]) / spread))


def derive_thresholds(x: np.ndarray, label: np.ndarray, k: int, shrinkage: float = 0.25, block: int = 12, p: float = 90) -> tuple[float, float]:
    """(watch, anomalous) from contiguous blocks, each scored against models fitted without it.

    A state's model without a block comes from its sums less the block's; distances of all members to the models of FITS blocks come from one product of matrices.
    """
    blocks = len(x) // max(1, block)
    if blocks < 3:
        return 0.75, 0.9
    size, scores = len(x) // blocks, []
    ends = [(b * size, len(x) if b == blocks - 1 else (b + 1) * size) for b in range(blocks)]
    best = np.ones(len(x))
    for c in range(k):
        at = np.flatnonzero(label == c)
        if len(at) < 2:
            continue
        x64 = x.astype(float)
        y = x64[at] - (mean := x64[at].mean(0))
        both = np.concatenate((np.square(y), y), 1)
        whole = both.sum(0)
        for f in range(0, blocks, FITS):
            some = [(a, z, *np.searchsorted(at, (a, z))) for a, z in ends[f : f + FITS]]
            some = [s for s in some if len(at) - (s[3] - s[2]) >= 2]
            if not some:
                continue
            n = np.array([len(at) - (j - i) for _, _, i, j in some], float)[:, None]
            less = whole - np.stack([both[i:j].sum(0) for _, _, i, j in some])
            d = x.shape[1]
            m = less[:, d:] / n
            var = np.maximum(0, less[:, :d] - n * np.square(m)) / np.maximum(1, n - 1)
            w = np.minimum(1.0, shrinkage / np.maximum(1.0, n / 8))
            v = np.maximum(1e-6, (1 - w) * var + w * var.mean(1, keepdims=True))
            far = np.concatenate((1 / v, -2 * m / v), 1) @ both.T + (np.square(m) / v).sum(1, keepdims=True)
            far = np.sqrt(np.maximum(far, 0) / d)
            for (a, z, i, j), row, mm, vv in zip(some, far, m, v, strict=True):
                best[a:z] = np.minimum(best[a:z], distance_score(mahalanobis(x[a:z], mean + mm, vv), distribution(np.concatenate((row[:i], row[j:])))))
    scores = [np.percentile(best[a:z], p) for a, z in ends]
    worst, spread = max(scores), max(max(scores) - np.percentile(scores, 75), 0.05)
    watch = float(np.clip(max(0.55, worst + 0.5 * spread), 0.55, 0.9))
    return watch, float(np.clip(max(watch + 0.05, worst + 2 * spread), watch + 0.05, 0.97))


def learn_profile(x: np.ndarray, shrinkage: float = 0.25, least: int = 8, block: int = 12, p: float = 90, features: dict[str, np.ndarray] | None = None) -> dict:
    """A profile: states by falling weight, thresholds, version."""
    if len(x) < least:
        raise ValueError("too few windows")
    if x.shape[1] == 0:
        raise ValueError("empty vectors")
    k, label = select_clustering(x)
    states = []
    for c in range(k):
        members = x[label == c]
        if not len(members):
            continue
        m, v, n = fit_gaussian(members, shrinkage)
        stats = {f: (float(a[label == c].mean()), float(a[label == c].std()), *map(float, np.percentile(a[label == c], [5, 95]))) for f, a in (features or {}).items()}
        states.append({"id": f"s{c}", "weight": n / len(x), "mean": m, "variance": v, "count": n, "distances": distribution(mahalanobis(members, m, v)), "stats": stats})
    watch, anomalous = derive_thresholds(x, label, k, shrinkage, block, p)
    return {"schema_version": PROFILE_SCHEMA_VERSION, "revision": 1, "states": sorted(states, key=lambda s: -s["weight"]), "watch": watch, "anomalous": anomalous, "calibrations": []}


def score_windows(profile: dict, x: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(score, state, distance) of each vector: the state of least score, the first of equals; without states 1."""
    if not profile["states"]:
        return np.ones(len(x)), [""] * len(x), np.zeros(len(x))
    d = np.stack([mahalanobis(x, s["mean"], s["variance"]) for s in profile["states"]])
    s = np.stack([distance_score(a, st["distances"]) for a, st in zip(d, profile["states"], strict=True)])
    at = s.argmin(0)
    i = np.arange(len(x))
    return s[at, i], [profile["states"][j]["id"] for j in at], d[at, i]


def status_for(score: float, watch: float, anomalous: float) -> str:
    return "anomalous" if score >= anomalous else "watch" if score >= watch else "normal"


def calibrate(watch: float, anomalous: float, verdict: str, score: float, rate: float = 0.5) -> tuple[float, float]:
    """Thresholds after a verdict on a check's score."""
    w, a = watch, anomalous
    if verdict == "normal" and score >= watch:
        w = watch + rate * (min(0.995, score + 0.01) - watch)
        a = max(w + 0.01, anomalous + rate * (min(0.999, score + 0.02) - anomalous))
    elif verdict == "anomalous" and score < anomalous:
        a = anomalous - rate * (anomalous - max(0.5, score - 0.01))
        w = min(a - 0.01, watch - rate * (watch - max(0.4, score - 0.05)))
    return float(np.clip(min(w, a - 0.005), 0.4, 0.995)), float(np.clip(a, 0.45, 0.999))


def compact(profile: dict) -> dict:
    """The profile with float16 states."""
    states = [s | {"mean": to_half(s["mean"]), "variance": to_half(s["variance"])} for s in profile["states"]]
    return profile | {"states": states, "compact_version": 1}


def expand(small: dict) -> dict:
    if small.get("compact_version") != 1:
        raise ValueError("unknown version of a compact profile")
    out = {k: v for k, v in small.items() if k != "compact_version"}
    return out | {"states": [s | {"mean": from_half(s["mean"]).astype(float), "variance": from_half(s["variance"]).astype(float)} for s in small["states"]]}


class MlpHead:
    """Dense ReLU layer, dropout and softmax, trained with Adam on cross-entropy."""

    def __init__(self, labels: list[str], hidden: int = 64, dropout: float = 0.3, rate: float = 0.002, seed: int = 1) -> None:
        if len(labels) < 2:
            raise ValueError("two labels at least")
        self.labels, self.hidden, self.dropout, self.rate, self.rng = labels, hidden, dropout, rate, np.random.default_rng(seed)
        self.w: list[np.ndarray] = []

    def _forward(self, x: np.ndarray, drop: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0) * drop
        z = h @ self.w[2] + self.w[3]
        e = np.exp(z - z.max(1, keepdims=True))
        return h, e / e.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: list[str], epochs: int = 40, batch: int = 16, on_epoch=None) -> float:
        """Final loss; an unknown label is an error."""
        target = np.array([self.labels.index(v) for v in y])
        d, c = x.shape[1], len(self.labels)
        self.w = [self.rng.normal(0, np.sqrt(2 / d), (d, self.hidden)), np.zeros(self.hidden), self.rng.normal(0, np.sqrt(2 / self.hidden), (self.hidden, c)), np.zeros(c)]
        m, v, t, loss = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0, 0.0
        for epoch in range(epochs):
            order, loss = self.rng.permutation(len(x)), 0.0
            for a in range(0, len(x), batch):
                i = order[a : a + batch]
                drop = (self.rng.random((len(i), self.hidden)) >= self.dropout) / (1 - self.dropout)
                h, p = self._forward(x[i], drop)
                loss -= np.log(p[np.arange(len(i)), target[i]] + 1e-12).sum()
                g = p.copy()
                g[np.arange(len(i)), target[i]] -= 1
                g /= len(i)
                back = (g @ self.w[2].T) * drop * (h > 0)
                t += 1
                for j, grad in enumerate((x[i].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                    m[j], v[j] = 0.9 * m[j] + 0.1 * grad, 0.999 * v[j] + 0.001 * grad**2
                    self.w[j] -= self.rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
            loss /= max(1, len(x))
            if on_epoch:
                on_epoch(epoch, loss)
        return float(loss)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[1]
