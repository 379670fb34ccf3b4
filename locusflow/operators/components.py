"""Connected components: stars inside batches of edges, then alternating large-star and small-star rounds over what links the stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.session import cut, prepare, release, tidy

#: Edges whose stars are formed at once.
CHUNK = 1 << 18
#: Links between stars that one task joins (4 MB).
LINKS = 1 << 18


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    j = down.join(least, "u")
    return j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) of a graph: each of its nodes with the smallest of its component."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kind = None
    for b in batches:
        kind = b.schema.field("u").type
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            x, y = find(u), find(v)
            if x != y:
                root[max(x, y)] = min(x, y)
    if root:
        yield pa.record_batch({"node": pa.array(list(root), kind), "component": pa.array([find(x) for x in list(root)], kind)})


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of the nodes 0 to n - 1 the smallest that the edges (a, b) reach: roots hook to smaller ones, then paths are halved."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        far = x != y
        if not far.any():
            return root
        a, b, x, y = a[far], b[far], x[far], y[far]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of some ``CHUNK`` edges (u, v) with the smallest node of its component among these edges, itself included."""

    def star(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        ends = pa.chunked_array(t.column("u").chunks + t.column("v").chunks)
        if not pa.types.is_integer(ends.type):
            yield from _joined(iter(held))
            return
        nodes, at = np.unique(ends.to_numpy(), return_inverse=True)
        root = _labels(at[: len(t)], at[len(t) :], len(nodes))
        yield pa.record_batch({"node": pa.array(nodes, ends.type), "component": pa.array(nodes[root], ends.type)})

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield from star(held)
            held, n = [], 0
    if n:
        yield from star(held)


def _at_once(e: DataFrame, kind: str) -> DataFrame:
    """(node, component) of the edges (u, v) of a result of ``cut``, which goes, in one task."""
    out = cut(e.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}"))
    release(e)
    return out


def _rounds(e: DataFrame) -> DataFrame:
    """(node, component) of the distinct edges (u, v) of a result of ``cut``, which goes, by star rounds."""
    n = None
    while True:
        new = cut(_small_star(_large_star(e)))
        m = new.count()
        # equal numbers of distinct rows, none of them new: the same set
        same = m == n and (m == 0 or new.join(e, ["u", "v"], "left_anti").isEmpty())
        release(e)
        e, n = new, m
        if same or m == 0:
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", few: int = 0) -> DataFrame:
    """``(node, component)`` of every node that has an edge; ``component`` is the smallest node reachable.

    Edges that come together are first joined to stars, ``CHUNK`` at a time, as they lie, without a shuffle: a component whose edges
    lie together is then done. A node of several stars links their centres, and only these links go through the star rounds (or one task, up to ``LINKS``); the rounds
    needed grow with the logarithm of the longest path. The minimum of a hub's neighbours is pre-aggregated before the shuffle,
    joins on hubs are left to adaptive skew splitting, and every round is checkpointed so that lineage
    stays short. Self loops and null ends are ignored; repeated edges count once; no edges give no rows.
    A graph of at most ``few`` distinct edges (both ends of one type) is joined in one task instead, with the same result.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u != v")
    if few:
        e = cut(e.distinct())
        if e.count() <= few:
            kind = e.schema["u"].dataType.simpleString()
            out = _at_once(e, kind)
            tidy(spark)
            return out
    else:
        prepare(spark)
    # both ends of the wider type
    kind = e.select(F.coalesce("u", "v").alias("u")).schema["u"].dataType.simpleString()
    stars = cut(e.select(F.col("u").cast(kind), F.col("v").cast(kind)).mapInArrow(_stars, f"node {kind}, component {kind}"))
    if few:
        release(e)
    out = cut(stars.groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("_most")))
    many = out.where("component < _most")
    if many.isEmpty():
        release(stars)
        tidy(spark)
        return out.select("node", "component")
    links = cut(stars.join(many.select("node", F.col("component").alias("v")), "node").where("component != v").select(F.col("component").alias("u"), "v").distinct())
    release(stars)
    found = (_at_once(links, kind) if links.count() <= LINKS else _rounds(links)).select(F.col("node").alias("component"), F.col("component").alias("_c"))
    tidy(spark)
    return out.join(found, "component", "left").select("node", F.coalesce("_c", "component").alias("component"))
