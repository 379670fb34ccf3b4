"""Numerical methods on genotype matrices. The distributed part is a Gram matrix or block of sums; what the driver holds is samples squared."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.operators.snps import gram_matrix


def _dense(gram: DataFrame) -> tuple[list, np.ndarray]:
    rows = gram.collect()  # samples squared, independent of the sites
    names = sorted({r["i"] for r in rows} | {r["j"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r["i"]], at[r["j"]]] = m[at[r["j"]], at[r["i"]]] = r["dot"]
    return names, m


def pca(g: DataFrame, n_samples: int, k: int = 2) -> tuple[DataFrame, list[float]]:
    """(sample, pc0.. , variance shares): coordinates U S of the column-centred, mean-filled matrix from its Gram matrix; each axis' largest entry is positive."""
    names, m = _dense(gram_matrix(g, n_samples))
    w, v = np.linalg.eigh(m)
    order = np.argsort(-w)[:k]
    u = v[:, order] * np.sqrt(np.maximum(w[order], 0))
    u *= np.sign(u[np.abs(u).argmax(0), range(u.shape[1])] + 1e-300)
    rows = [(n, *map(float, r)) for n, r in zip(names, u, strict=True)]
    kind = dict(g.dtypes)["sample"]
    return g.sparkSession.createDataFrame(rows, f"sample {kind}, " + ", ".join(f"pc{i} double" for i in range(u.shape[1]))), (np.maximum(w[order], 0) / max(w.clip(0).sum(), 1e-300)).tolist()


def kmeans(x: np.ndarray, k: int, seed: int = 0, starts: int = 20) -> tuple[np.ndarray, float]:
    """(labels, within-cluster sum of squares) of Lloyd's algorithm, best of ``starts`` k-means++ starts."""
    rng, best = np.random.default_rng(seed), (np.zeros(len(x), int), np.inf)
    for _ in range(starts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c) ** 2).sum(2).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[rng.integers(len(x))]])
        for _ in range(100):
            lab = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            new = np.array([x[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        ss = float(((x - c[lab]) ** 2).sum())
        if ss < best[1]:
            best = (lab, ss)
    return best


def kmeans_bic(x: np.ndarray, ks: range, seed: int = 0) -> list[tuple[int, float]]:
    """(k, BIC) with spherical Gaussian clusters of one variance; smaller is better."""
    n, d = x.shape
    out = []
    for k in ks:
        lab, ss = kmeans(x, k, seed)
        var = max(ss / max(1, (n - k) * d), 1e-12)
        sizes = np.bincount(lab, minlength=k)
        ll = sum(s * np.log(s / n) for s in sizes if s) - n * d / 2 * np.log(2 * np.pi * var) - (n - k) * d / 2
        out.append((k, float(-2 * ll + (k * (d + 1)) * np.log(n))))
    return out


def lda(x: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Discriminant coordinates of points with labels (the last step of a DAPC)."""
    mean = x.mean(0)
    sw, sb = np.zeros((x.shape[1],) * 2), np.zeros((x.shape[1],) * 2)
    for j in np.unique(labels):
        z = x[labels == j]
        sw += (z - z.mean(0)).T @ (z - z.mean(0))
        sb += len(z) * np.outer(z.mean(0) - mean, z.mean(0) - mean)
    w, v = np.linalg.eig(np.linalg.solve(sw + 1e-9 * np.eye(len(sw)), sb))
    return (x - mean) @ v.real[:, np.argsort(-w.real)[:k]]


def nmf(v: np.ndarray, k: int, seed: int = 0, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(Q, G, error) with v ~ Q G, rows of Q summing to one; multiplicative updates."""
    rng = np.random.default_rng(seed)
    q, g = rng.random((len(v), k)) + 0.1, rng.random((k, v.shape[1])) + 0.1
    for _ in range(steps):
        g *= (q.T @ v) / np.maximum(q.T @ q @ g, 1e-12)
        q *= (v @ g.T) / np.maximum(q @ (g @ g.T), 1e-12)
    s = q.sum(1, keepdims=True)
    return np.where(s > 0, q / np.maximum(s, 1e-12), 1 / k), g, float(np.linalg.norm(v - q @ g))


def disjunctive(g: DataFrame) -> DataFrame:
    """site, sample, state (0, 1, 2): the indicator columns that are one."""
    return g.where("dosage is not null").select("site", "sample", F.col("dosage").alias("state"))


def admixture_cv(matrix: np.ndarray, ks: range, share: float = 0.05, seed: int = 0) -> list[tuple[int, float]]:
    """(k, cross-entropy of held-out genotypes) of an indicator-coded factorisation; matrix of dosages, -1 missing."""
    rng = np.random.default_rng(seed)
    seen = np.argwhere(matrix >= 0)
    hold = seen[rng.random(len(seen)) < share]
    m = matrix.copy()
    m[hold[:, 0], hold[:, 1]] = -1
    mean = np.array([np.bincount(c[c >= 0], minlength=3) / max(1, (c >= 0).sum()) for c in m.T])
    ind = np.where(m[:, :, None] >= 0, np.eye(3)[np.maximum(m, 0)], mean[None])
    out = []
    for k in ks:
        q, g, _ = nmf(ind.reshape(len(m), -1), k, seed)
        p = (q @ g).reshape(len(m), -1, 3)
        p = p / np.maximum(p.sum(2, keepdims=True), 1e-12)
        out.append((k, float(-np.mean(np.log(np.maximum(p[hold[:, 0], hold[:, 1], matrix[hold[:, 0], hold[:, 1]]], 1e-9)))) if len(hold) else float("nan")))
    return out


def matrix_blocks(g: DataFrame, sites_per_block: int = 4096) -> DataFrame:
    """block, sample, sites, dosages: the matrix as bounded rows for column-wise work."""
    b = g.withColumn("block", F.floor(F.col("site") / sites_per_block))
    return b.groupBy("block", "sample").agg(F.sort_array(F.collect_list(F.struct("site", F.coalesce("dosage", F.lit(-1)).alias("d")))).alias("c")).select("block", "sample", F.transform("c", lambda x: x["site"]).alias("sites"), F.transform("c", lambda x: x["d"]).alias("dosages"))


def snmf(blocks: DataFrame, samples: list, ks: list[int], inits: int = 2, rounds: int = 20, inner: int = 10, share: float = 0.05, seed: int = 0) -> list[tuple[int, np.ndarray, float]]:
    """(k, Q, cross-entropy of held-out genotypes) of one factorisation V ~ Q G over all sites jointly, the best of ``inits`` starts by error.

    ``blocks``: as ``matrix_blocks``; V holds three indicator columns a site, missing and held-out cells the site's means. Q (samples x k, rows
    summing to one) is on the driver; every round each block fits its own part of G to Q, and only the sums V G' and G G' (samples x k and k x k,
    added up where the blocks are) come back, for all k and starts in one pass. A cell is held out by a hash of its site and sample.
    """
    rng = np.random.default_rng(seed)
    place = {s: i for i, s in enumerate(samples)}
    runs = [(k, q / q.sum(1, keepdims=True)) for k in ks for _ in range(inits) for q in [rng.random((len(samples), k)) + 0.1]]
    names = samples

    def fit(d):
        import pandas as pd

        sites = sorted({x for c in d["sites"] for x in c})
        at, m = {x: i for i, x in enumerate(sites)}, np.full((len(names), len(sites)), -1)
        for row in d.itertuples():
            m[place[row.sample], [at[x] for x in row.sites]] = row.dosages
        h = np.array([zlib.crc32(f"{seed}:{s}:{x}".encode()) for s in names for x in sites], np.float64).reshape(m.shape) / 2**32
        hold = (h < share) & (m >= 0)
        seen = np.where(hold, -1, m)
        mean = np.stack([(seen == a).sum(0) for a in range(3)], 1) / np.maximum((seen >= 0).sum(0), 1)[:, None]
        v = np.where(seen[:, :, None] >= 0, np.eye(3)[np.maximum(seen, 0)], mean[None]).reshape(len(names), -1)
        out = []
        for r, (k, q) in enumerate(runs):
            g = np.tile(v.mean(0), (k, 1)) + 1e-3
            top, both = q.T @ v, q.T @ q
            for _ in range(inner):
                g *= top / np.maximum(both @ g, 1e-12)
            p = (q @ g).reshape(len(names), -1, 3)
            p = p / np.maximum(p.sum(2, keepdims=True), 1e-12)
            miss = -np.log(np.maximum(p[hold, m[hold]], 1e-9)).sum()
            out.append((r, np.concatenate([(v @ g.T).ravel(), (g @ g.T).ravel(), [((v - q @ g) ** 2).sum(), miss, hold.sum()]]).tolist()))
        return pd.DataFrame(out, columns=["run", "sums"])

    best: dict[int, tuple] = {}
    for step in range(rounds):
        sums = blocks.groupBy("block").applyInPandas(fit, "run int, sums array<double>").select("run", F.posexplode("sums").alias("i", "x")).groupBy("run", "i").agg(F.sum("x").alias("x"))
        got: dict[int, dict[int, float]] = {}
        for r in sums.collect():  # runs * (samples * k + k * k + 3) rows, whatever the sites
            got.setdefault(r.run, {})[r.i] = r.x
        for r, (k, q) in enumerate(runs):
            x = np.array([got[r][i] for i in range(len(got[r]))]) if r in got else np.zeros(q.size + k * k + 3)
            vg, gg, (error, miss, n) = x[: q.size].reshape(q.shape), x[q.size : -3].reshape(k, k), x[-3:]
            if step == rounds - 1:
                if k not in best or error < best[k][0]:
                    best[k] = (error, q, miss / n if n else float("nan"))
            else:
                q = q * vg / np.maximum(q @ gg, 1e-12)
                runs[r] = (k, q / np.maximum(q.sum(1, keepdims=True), 1e-12))
    return [(k, *best[k][1:]) for k in ks if k in best]
