"""Grouping of series: k-means, K-Shape, correlation kernels with kernel PCA, busy scores.

The series that kernel PCA takes are first brought to at most ``MAX_CELLS`` cells by
resampling, whose size is checked before anything is gathered. K-Shape over any number of series is in ``kshape``.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 12_000_000
#: Keys of a kernel matrix.
MAX_KEYS = 3_000


def kmeans(df: DataFrame, columns: list[str], k: int = 5, seed: int = 42, fit_share: float = 1.0, out: str = "cluster_id") -> DataFrame:
    """``df`` with the k-means cluster of ``columns``; fitted on a hashed share of the rows."""
    rows = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df)
    part = rows if fit_share >= 1 else rows.where(F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1_000_000)) < int(fit_share * 1_000_000))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=out).fit(part)
    return model.transform(rows).drop("_v")


def busy_score(df: DataFrame, by: list[str], out: str = "busy_score") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def series_matrix(dense: DataFrame, key: str, value: str = "demand", ts: str = "bin") -> tuple[list, np.ndarray]:
    """Keys and their series as rows of a matrix, in key and time order."""
    size = dense.count()
    if size > MAX_CELLS:
        raise ValueError(f"{size} cells; resample to {MAX_CELLS} or fewer first")
    series = dense.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(ts), F.col(value).cast("double").alias("v")))).alias("s"))
    rows = sorted(series.select(key, F.transform("s", lambda x: x["v"]).alias("v")).collect(), key=lambda r: r[0])
    if len({len(r[1]) for r in rows}) > 1:
        raise ValueError("series differ in length; densify them first")
    return [r[0] for r in rows], np.array([r["v"] for r in rows], float).reshape(len(rows), -1)


def standardise(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=1, keepdims=True)) / np.maximum(x.std(axis=1, keepdims=True), 1e-12)


def _aligned(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape-based distance of each row to ``c``, and the rows shifted to where they are most like it."""
    n = x.shape[1]
    size = 1 << (2 * n - 1).bit_length()
    cross = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(c, size)), size)
    cross = np.concatenate([cross[:, -(n - 1) :], cross[:, :n]], axis=1) if n > 1 else cross[:, :1]
    norm = np.linalg.norm(x, axis=1) * np.linalg.norm(c)
    best = cross.argmax(axis=1)
    dist = 1 - cross[np.arange(len(x)), best] / np.maximum(norm, 1e-12)
    shifted = np.zeros_like(x)
    for i, s in enumerate((best - (n - 1)).tolist()):
        if s >= 0:
            shifted[i, : n - s] = x[i, s:]
        else:
            shifted[i, -s:] = x[i, : n + s]
    return dist, shifted


def kshape_labels(x: np.ndarray, k: int = 3, seed: int = 42, rounds: int = 50) -> np.ndarray:
    """K-Shape over rows of ``x`` (Paparrizos and Gravano, SIGMOD 2015): assign by shape-based distance, centre by extraction.

    Memory is that of ``x``: a centroid is the leading direction of its centred members, by power iteration.
    """
    x = standardise(np.asarray(x, float))
    n, width = x.shape
    rng = np.random.default_rng(seed)
    k = min(k, n)
    labels = rng.permutation(np.arange(n) % max(k, 1))
    centres = np.zeros((k, width))
    for _ in range(rounds):
        for j in range(k):
            own = x[labels == j]
            if not len(own):
                far = np.array([_aligned(x[i : i + 1], centres[labels[i]])[0][0] for i in range(n)]).argmax()
                labels[far], own = j, x[far : far + 1]
            if centres[j].any():
                own = _aligned(own, centres[j])[1]
            own = standardise(own)
            own = own - own.mean(axis=1, keepdims=True)
            v = own.sum(axis=0) + 1e-9 * rng.normal(size=width)
            for _ in range(100):
                nxt = own.T @ (own @ v)
                nxt -= nxt.mean()
                length = np.linalg.norm(nxt)
                if length < 1e-12 or np.abs(nxt / length - v).max() < 1e-9:
                    break
                v = nxt / length
            if ((own - v) ** 2).sum() > ((own + v) ** 2).sum():
                v = -v
            centres[j] = standardise(v[None])[0]
        dist = np.stack([_aligned(x, c)[0] for c in centres], axis=1)
        new = dist.argmin(axis=1)
        if (new == labels).all():
            break
        labels = new
    return labels


def correlation_kernel(x: np.ndarray) -> np.ndarray:
    """exp(-d2 / L) over distances between the rows of 1 - r; a constant series correlates with nothing."""
    z = standardise(x)
    r = np.clip(z @ z.T / x.shape[1], -1, 1)
    np.fill_diagonal(r, 1.0)
    d = 1 - r
    sq = (d * d).sum(axis=1)
    return np.exp(-np.maximum(sq[:, None] + sq[None] - 2 * d @ d.T, 0) / max(len(x), 1))


def kernel_pca(kernel: np.ndarray, dims: int = 2) -> np.ndarray:
    n = len(kernel)
    one = np.full((n, n), 1 / n)
    centred = kernel - one @ kernel - kernel @ one + one @ kernel @ one
    values, vectors = np.linalg.eigh(centred)
    order = np.argsort(values)[::-1][:dims]
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return vectors * sign * np.sqrt(np.maximum(values[order], 0))


def kernel_pca_clusters(dense: DataFrame, key: str, k: int = 3, dims: int = 2, seed: int = 42, value: str = "demand") -> DataFrame:
    """(key, cluster_id, pc1..) by k-means on the kernel principal components of the series' correlations, of ``MAX_KEYS`` keys at most."""
    if (n := dense.select(key).distinct().count()) > MAX_KEYS:
        raise ValueError(f"{n} keys; the kernel takes {MAX_KEYS} at most")
    keys, x = series_matrix(dense, key, value)
    kind = dict(dense.dtypes)[key]
    names = [f"pc{i + 1}" for i in range(dims)]
    pcs = kernel_pca(correlation_kernel(x), dims) if len(keys) else np.zeros((0, dims))
    df = dense.sparkSession.createDataFrame([(a, *map(float, p)) for a, p in zip(keys, pcs, strict=True)], f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in names))
    return kmeans(df, names, k=min(k, max(2, len(keys))), seed=seed)


def difference_features(panel: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``a - b`` of coalesced columns."""
    return panel.withColumns({out: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)) for out, (a, b) in pairs.items()})
