"""Similarity graphs of loci: best edges, components, contraction of one sample's copies, and constrained splitting."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.operators.components import connected_components
from locusflow.session import cut

#: A component with more nodes than this many times the samples is split at a similarity threshold before the exact split.
OVERSIZE = 10


def best_edges(hits: DataFrame) -> DataFrame:
    """src < dst, pid, qcov: the lexicographically largest (pid, qcov) of each unordered pair; self hits go."""
    h = hits.where("query != target").select(F.least("query", "target").alias("src"), F.greatest("query", "target").alias("dst"), "pid", "qcov")
    return h.groupBy("src", "dst").agg(F.max(F.struct("pid", "qcov")).alias("b")).select("src", "dst", "b.pid", "b.qcov")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component of every node; a node without edges is its own."""
    c = connected_components(edges)
    return nodes.select("node").join(c, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def duplicate_samples(members: DataFrame) -> DataFrame:
    """component, nodes, samples, burden (nodes more than samples), duplicated. ``members``: component, node, sample."""
    d = members.groupBy("component", "sample").agg(F.count("*").alias("n"))
    return d.groupBy("component").agg(F.sum("n").alias("nodes"), F.count("*").alias("samples"), F.sum(F.col("n") - 1).alias("burden"), (F.max("n") > 1).alias("duplicated"))


def contract(members: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """node, rep: nodes of one sample within a component that are joined by edges of pid >= ``least`` become their smallest."""
    m = members.select("node", "sample")
    same = edges.where(F.col("pid") >= least).join(m.withColumnsRenamed({"node": "src", "sample": "s1"}), "src").join(m.withColumnsRenamed({"node": "dst", "sample": "s2"}), "dst").where("s1 = s2")
    c = connected_components(same.select("src", "dst"))
    return m.join(c, "node", "left").select("node", F.coalesce("component", "node").alias("rep"))


def _kruskal(nodes: Iterable, sample: dict, edges: list[tuple]) -> dict:
    """Union by edges in order (-pid, -qcov, ends), only where the two sides share no sample."""
    root = {n: n for n in nodes}
    held = {n: {sample[n]} for n in root}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for _, _, a, b in sorted((-p, -q, a, b) for a, b, p, q in edges):
        a, b = find(a), find(b)
        if a != b and not held[a] & held[b]:
            a, b = min(a, b), max(a, b)
            root[b] = a
            held[a] |= held.pop(b)
    return {n: find(n) for n in root}


def presplit(members: DataFrame, edges: DataFrame, n_samples: int, thresholds: tuple[float, ...] = (0.92, 0.94, 0.96, 0.98, 1.0)) -> DataFrame:
    """members with components over the size cap split at the lowest threshold that brings them under it: each threshold is one pass of
    connected components over the components still too large, so no oversized one ever reaches a single task. What is too large even
    at the last threshold becomes single nodes."""
    cap = OVERSIZE * n_samples
    done, left = None, members
    for t in (*thresholds, None):
        size = left.groupBy("component").agg(F.count("*").alias("n"))
        big = size.where(F.col("n") > cap).select("component")
        fit = left.join(big, "component", "left_anti")
        done = fit if done is None else done.unionByName(fit)
        left = left.join(big, "component", "left_semi")
        if t is None:
            return done.unionByName(left.withColumn("component", F.col("node")))
        if left.isEmpty():
            return done
        own = left.select(F.col("node").alias("src")).join(edges.where(F.col("pid") >= t), "src").join(left.select(F.col("node").alias("dst")), "dst")
        c = connected_components(own.select("src", "dst")).withColumnRenamed("component", "_c")
        left = left.join(c, "node", "left").withColumn("component", F.coalesce("_c", "node")).drop("_c")
    return done


def lowest_presplit(members: DataFrame, edges: DataFrame, n_samples: int) -> DataFrame:
    """members with each component over the size cap split at the lowest of its own pids at which every part fits under the cap.

    Parts only get finer as the pid rises, so that pid also has the best score of the reference (most nodes in parts of two or
    more, then fewest parts, fewest single nodes, lowest pid). It is found by bisection over the distinct pids of all such
    components at once, one pass of connected components a step. Where no pid fits, or the component is of one sample, a
    placeholder stays: of each sample the best node (``representatives``; the smallest without ``n_reads`` and ``length``).
    """
    cap = OVERSIZE * n_samples
    big = cut(members.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("sample").alias("s")).where(F.col("n") > cap))
    if big.isEmpty():
        return members
    left = cut(members.join(big.select("component"), "component", "left_semi"))
    node = left.select("node", "component")
    own = edges.join(node.withColumnsRenamed({"node": "src"}), "src").join(node.withColumnsRenamed({"node": "dst", "component": "_c"}), "dst").where("component = _c").select("component", "src", "dst", "pid")
    pids = own.select("component", "pid").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("component").orderBy("pid")))
    own = cut(own.join(pids, ["component", "pid"]).select("component", "src", "dst", "rank"))
    last = own.groupBy("component").agg(F.max("rank").alias("last"))
    # the answer lies from lo to hi; last + 1 stands for none
    found = cut(big.where("s > 1").join(last, "component").select("component", "last", F.lit(1).alias("lo"), (F.col("last") + 1).alias("hi")))

    def parts(at: DataFrame) -> DataFrame:
        """left's rows of the components in ``at`` (component, rank), with the part that edges from that rank on make."""
        e = own.join(at.select("component", F.col("rank").alias("_r")), "component").where("rank >= _r")
        c = connected_components(e.select("src", "dst")).withColumnRenamed("component", "_part")
        return left.join(at.select("component"), "component", "left_semi").join(c, "node", "left").withColumn("_part", F.coalesce("_part", "node"))

    while not (todo := found.where("lo < hi")).isEmpty():
        at = cut(todo.select("component", F.expr("(lo + hi) div 2").cast("int").alias("rank")))
        most = parts(at).groupBy("component", "_part").agg(F.count("*").alias("n")).groupBy("component").agg(F.max("n").alias("most"))
        step = at.join(most, "component").select("component", "rank", (F.col("most") <= cap).alias("fits"))
        moved = found.join(step, "component", "left")
        found = cut(moved.select("component", "last", F.expr("if(fits is null or fits, lo, rank + 1)").alias("lo"), F.expr("if(fits, rank, hi)").alias("hi")))
    fits = cut(found.where("lo <= last").select("component", F.col("lo").alias("rank")))
    cut_up = parts(fits).withColumn("component", F.col("_part")).select(*members.columns)
    over = left.join(fits, "component", "left_anti")
    best = representatives(over) if {"n_reads", "length"} <= set(members.columns) else over.groupBy("component", "sample").agg(F.min("node").alias("node"))
    placeholder = over.join(best, ["component", "sample", "node"], "left_semi").select(*members.columns)
    return members.join(big.select("component"), "component", "left_anti").select(*members.columns).unionByName(cut_up).unionByName(placeholder)


def split_components(members: DataFrame, edges: DataFrame, n_samples: int) -> DataFrame:
    """component, node, sample, part: each component cut so that no part has a sample twice, strongest edges first (constrained Kruskal).

    Components over the size cap are split by ``lowest_presplit`` first. Every row is a node with one of the edges it begins, if any; a task
    walks the rows of many components, each bounded by the size cap. Components without a repeated sample pass unchanged. Order of work inside
    a component is fixed, so the result does not depend on partitioning.
    """
    m = lowest_presplit(members, edges, n_samples)
    e = edges.select(F.col("src").alias("node"), "dst", F.col("pid").cast("double").alias("pid"), F.col("qcov").cast("double").alias("qcov"))
    if m is not members:  # components were cut: edges across a cut must not gather in a task
        m = cut(m)
        own = m.select("node", "component")
        e = e.join(own, "node").join(own.withColumnsRenamed({"node": "dst", "component": "_c"}), "dst").where("component = _c").select("node", "dst", "pid", "qcov")
    rows = m.select("component", "node", "sample").join(e, "node", "left").select("component", "node", "sample", "dst", "pid", "qcov")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, links, now, out = {}, [], None, []

        def close():
            if len(set(nodes.values())) == len(nodes):
                out.extend((now, n, s, None) for n, s in nodes.items())
            else:
                part = _kruskal(nodes, nodes, [x for x in links if x[1] in nodes])
                out.extend((now, n, s, part[n]) for n, s in nodes.items())

        def batch():
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["component", "node", "sample", "part"])

        types = None
        for b in batches:
            if types is None:
                t = {f.name: f.type for f in b.schema}
                types = [t["component"], t["node"], t["sample"], t["node"]]
            for c, x, s, y, p, q in zip(*(b.column(n).to_pylist() for n in ("component", "node", "sample", "dst", "pid", "qcov")), strict=True):
                if c != now:
                    if nodes:
                        close()
                    nodes, links, now = {}, [], c
                nodes[x] = s
                if y is not None:
                    links.append((x, y, p, q))
            if len(out) > 10_000:
                yield batch()
        if nodes:
            close()
        if out:
            yield batch()

    kinds = dict(m.dtypes)
    schema = f"component {kinds['component']}, node {kinds['node']}, sample {kinds['sample']}, part {kinds['node']}"
    split_up = rows.repartition("component").sortWithinPartitions("component").mapInArrow(split, schema)
    return split_up.withColumn("part", F.coalesce("part", "component"))


def representatives(members: DataFrame) -> DataFrame:
    """component, sample, node: of each sample the node with the most reads, then the longest, then the smallest."""
    return members.groupBy("component", "sample").agg(F.min_by("node", F.struct(-F.col("n_reads"), -F.col("length"), F.col("node"))).alias("node"))
