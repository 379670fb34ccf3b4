"""Exact top-k inner-product search by columnar branch and bound.

Vectors lie dimension by dimension (vertical layout). Scores are accumulated one block of dimensions at a
time; after each block the Cauchy-Schwarz product of the remaining masses bounds what is still to come, and
pairs that cannot reach the running k-th score are dropped. Once few pairs survive, they are compacted into
a list and only those are carried through the remaining blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusflow.session import cut, prepare

K, DIM_BLOCK, CHUNK, QUERY_CHUNK = 20, 16, 1024, 256
#: Vectors of one side that meet in one task: the shuffle holds pairs * (1/QUERY_GROUP + 1/CAND_GROUP) rows.
QUERY_GROUP, CAND_GROUP = 16384, 8192
_FAR = np.iinfo(np.int64).max


def quantize(c: str | Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, as array<double>, which holds these whole numbers exactly; null unless all components are finite."""
    c = F.col(c) if isinstance(c, str) else c
    good = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    # floor() gives a long, which a large double would leave; whole doubles of 2^52 and more are their own floor
    floor = lambda y: F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y)
    return F.when(good, F.transform(c, lambda x: floor(x.cast("double") * scale)))


def _large(qid, q, cid, c, k):
    """Exact scores by Python integers, for components whose sums leave the 53 bits of a double. A score among the best that no long holds is an error."""
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    out_q, out_c, out_s = [], [], []
    co = whole(c)
    for i, row in enumerate(whole(q)):
        s = co @ row if co.shape[1] else np.zeros(len(co), object)
        order = sorted((-int(x), int(v)) for x, v in zip(s, cid, strict=True) if v != qid[i])[:k]
        if any(not -(2**63) <= -x < 2**63 for x, _ in order):
            raise OverflowError(f"a score of query {qid[i]} needs more than 64 bits")
        out_q += [qid[i]] * len(order)
        out_c += [v for _, v in order]
        out_s += [-x for x, _ in order]
    return np.array(out_q, np.int64), np.array(out_c, np.int64), np.array(out_s, np.int64)


def branch_and_bound(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int = K):
    """(query id, candidate id, score) of each query's ``k`` best candidates other than itself, ties to the smaller id."""
    order = np.argsort(cid, kind="stable")  # in id order a later candidate loses every tie, so a bound equal to the k-th score is out
    cid, c = cid[order], c[order]
    d = q.shape[1]
    if d and float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * d * CHUNK >= 2.0**52:
        return _large(qid, q, cid, c, k)
    perm = np.argsort(-(c.astype(float) ** 2).sum(0), kind="stable") if len(c) else np.arange(d)  # the most mass first
    qf, ct = q[:, perm].astype(float), np.ascontiguousarray(c[:, perm].T.astype(float))
    edges = [*range(0, d, DIM_BLOCK), d] if d else [0, 0]
    mass = lambda m, axis: [np.sqrt((m[:, e:] ** 2).sum(1) if axis else (m[e:] ** 2).sum(0)) for e in edges]
    rq, rc = mass(qf, 1), mass(ct, 0)
    outs = []
    for a in range(0, len(qid), QUERY_CHUNK):
        z = slice(a, a + QUERY_CHUNK)
        ids, m = qid[z], len(qid[z])
        best_s, best_c = np.full((m, k), -np.inf), np.full((m, k), _FAR)
        for lo in range(0, len(cid), CHUNK):
            hi = min(lo + CHUNK, len(cid))
            floor = best_s[:, -1]
            part, pairs = np.zeros((m, hi - lo)), None
            for j in range(len(edges) - 1):
                block = slice(edges[j], edges[j + 1])
                if pairs is None:
                    part += qf[z, block] @ ct[block, lo:hi]
                    alive = part + rq[j + 1][z, None] * rc[j + 1][None, lo:hi] * (1 + 1e-9) + 1e-6 > floor[:, None]
                    if alive.mean() < 0.25:  # compact
                        pairs = np.nonzero(alive)
                        kept = part[pairs]
                else:
                    qi, ci = pairs
                    for x in range(block.start, block.stop):
                        kept += qf[z, x][qi] * ct[x, lo:hi][ci]
                    alive = kept + rq[j + 1][z][qi] * rc[j + 1][lo:hi][ci] * (1 + 1e-9) + 1e-6 > floor[qi]
                    pairs, kept = (qi[alive], ci[alive]), kept[alive]
            if pairs is None:  # most pairs live: keep the k best of each row
                part[ids[:, None] == cid[None, lo:hi]] = -np.inf
                n = hi - lo
                key = part * n + (n - 1 - np.arange(n))
                top = np.argpartition(-key, min(k, n) - 1, axis=1)[:, : min(k, n)]
                new_s, new_c = np.take_along_axis(part, top, 1), cid[lo:hi][top]
                new_c = np.where(np.isfinite(new_s), new_c, _FAR)
                s, v = np.hstack([best_s, new_s]), np.hstack([best_c, new_c])
                o = np.lexsort((v, -s), axis=1)[:, :k]
                best_s, best_c = np.take_along_axis(s, o, 1), np.take_along_axis(v, o, 1)
            elif len(pairs[0]):
                qi, ci = pairs
                other = ids[qi] != cid[lo:hi][ci]
                qi, s, v = qi[other], kept[other], cid[lo:hi][ci[other]]
                rows = np.unique(qi)
                qi, s, v = np.concatenate([qi, np.repeat(rows, k)]), np.concatenate([s, best_s[rows].ravel()]), np.concatenate([v, best_c[rows].ravel()])
                o = np.lexsort((v, -s, qi))
                qi, s, v = qi[o], s[o], v[o]
                rank = np.arange(len(qi)) - np.repeat(np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]), np.unique(qi, return_counts=True)[1])
                o = rank < k
                best_s[qi[o], rank[o]], best_c[qi[o], rank[o]] = s[o], v[o]
        own = np.isfinite(best_s)
        outs.append((np.repeat(ids, own.sum(1)), best_c[own], np.rint(best_s[own]).astype(np.int64)))
    return tuple(np.concatenate(x) if outs else np.empty(0, np.int64) for x in (zip(*outs, strict=True) if outs else ((), (), ())))


def topk_search(vectors: DataFrame, query: Column, k: int = K, query_group: int = QUERY_GROUP, cand_group: int = CAND_GROUP) -> DataFrame:
    """The ``k`` best inner products of every query row against all rows.

    ``vectors``: (vec_id long, q array<bigint> or array<double> of whole numbers); ``query``: which rows are queries. Returns query_id, rank,
    vec_id, score. Scores are exact at any magnitude; one among the ``k`` best that no long holds is an error. Rows with a null id or vector take
    no part; vectors of different length never meet; a candidate with the query's own id is the query's own row. A repeated candidate row
    counts as often as it occurs; a query that occurs more than once asks once. Ties go to the smaller id. An empty table gives no rows, further
    columns play no part. Candidates and queries are dealt by a hash of id and vector into groups of bounded size, each pair of groups is one
    independent task, and only ``k`` rows a query and group go on to the final ranking.
    """
    prepare(vectors.sparkSession)
    v = vectors.where("vec_id is not null and q is not null").select("vec_id", "q", F.size("q").alias("dim"), query.alias("is_query"))
    v = cut(v.groupBy("vec_id", "q", "dim", "is_query").agg(F.count("*").alias("times")))  # repeated rows fall together before they are dealt
    n, m = v.agg(F.count("*"), F.count_if(F.col("is_query"))).first()
    cg, qg = max(1, math.ceil(n / cand_group)), max(1, math.ceil(m / query_group))
    deal = lambda g: F.pmod(F.xxhash64("vec_id", "q"), F.lit(g))
    every = lambda g: F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    cand = v.select("dim", deal(cg).cast("int").alias("cg"), every(qg).alias("qg"), "vec_id", "q", F.least("times", F.lit(k)).cast("int").alias("times"))
    quer = v.where("is_query").select("dim", every(cg).alias("cg"), deal(qg).cast("int").alias("qg"), "vec_id", "q")

    def both(key, left: pa.Table, right: pa.Table) -> pa.Table:
        sides = []
        for t in (left, right):
            ids = t["vec_id"].combine_chunks().to_numpy(zero_copy_only=False)
            flat = pa.chunked_array(t["q"].chunks, t["q"].type).combine_chunks()
            flat = flat.flatten().to_numpy(zero_copy_only=False) if t.num_rows else np.empty(0, np.int64)
            dim = key[0].as_py()
            mat = flat.reshape(len(ids), dim)
            sides.append((ids, mat))
        times = left["times"].to_numpy()
        ids, mat = sides[0]
        if times.max(initial=1) > 1:  # at most k times each, which is all that can be seen of them
            ids, mat = np.repeat(ids, times), np.repeat(mat, times, axis=0)
        qid, cid, s = branch_and_bound(*sides[1], ids, mat, k)
        return pa.table({"query_id": pa.array(qid, pa.int64()), "vec_id": pa.array(cid, pa.int64()), "score": pa.array(s, pa.int64())})

    found = cand.groupBy("dim", "cg", "qg").cogroup(quer.groupBy("dim", "cg", "qg")).applyInArrow(both, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
