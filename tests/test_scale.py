"""Steps that must not grow faster than their input."""

import random
import re

import pytest

from locusflow.operators import components, graph, intervals
from locusflow.operators.components import connected_components


def expected(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("chunk, links", [(1 << 18, 1 << 18), (7, 1 << 18), (7, 0)])
@pytest.mark.parametrize("kind", [int, str])
def test_components_of_stars(spark, monkeypatch, chunk, links, kind):
    """Chains, a hub and random edges give the same components whether their stars lie in one batch or are linked over many."""
    monkeypatch.setattr(components, "LINKS", links)
    real, at = components._stars, chunk

    def small(batches):
        components.CHUNK = at  # in the worker
        return real(x.slice(i, 3) for x in batches for i in range(0, x.num_rows, 3))

    monkeypatch.setattr(components, "_stars", small)
    rng = random.Random(5)
    e = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 160)] + [(300 - i, 300) for i in range(40)] + [(7, 7)]
    rng.shuffle(e)
    e = [(kind(a), kind(b)) for a, b in e]
    df = spark.createDataFrame([*e, (None, e[0][0])], f"src {'long' if kind is int else 'string'}, dst {'long' if kind is int else 'string'}").repartition(3)
    got = connected_components(df).collect()
    assert {r.node: r.component for r in got} == expected(e) and len(got) == len({r.node for r in got})


def test_components_that_lie_together_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "_small_star", lambda e: pytest.fail("a round"))
    e = [(c * 100 + i, c * 100 + i + 1) for c in range(20) for i in range(30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == expected(e)


def test_split_writes_no_copy_of_its_nodes_and_edges(spark, monkeypatch):
    """Nothing is written beside the components where none is over the size cap; links that leave a component do not count."""
    monkeypatch.setattr(graph, "cut", lambda df: pytest.fail("a copy") if "sample" in df.columns or "pid" in df.columns else df)
    members = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (1, 4, "b"), (9, 9, "a"), (9, 10, "b"), (20, 20, "a")], "component long, node long, sample string")
    edges = spark.createDataFrame([(1, 2, 0.99, 1.0), (2, 3, 0.9, 1.0), (3, 4, 0.98, 1.0), (9, 10, 0.9, 1.0), (4, 9, 1.0, 1.0)], "src long, dst long, pid double, qcov double")
    got = sorted(map(tuple, graph.split_components(members, edges, 4).select("component", "node", "sample", "part").collect()))
    assert got == [(1, 1, "a", 1), (1, 2, "b", 1), (1, 3, "a", 3), (1, 4, "b", 3), (9, 9, "a", 9), (9, 10, "b", 9), (20, 20, "a", 20)]


def islands(rows, distance, strict):
    out = []
    for chrom in {r[0] for r in rows}:
        far = None
        for c, s, e in sorted(r for r in rows if r[0] == chrom):
            if far is None or (s >= far + distance if strict else s > far + distance):
                out.append([c, s, e, 1])
            else:
                out[-1][2:] = max(out[-1][2], e), out[-1][3] + 1
            far = e if far is None else max(far, e)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("distance, strict", [(0, False), (3, False), (0, True)])
def test_merge_over_many_tiles(spark, distance, strict):
    """Long intervals over several tiles, equal and empty ones, at small tiles."""
    rng = random.Random(distance)
    rows = [(c, s, s + rng.choice((0, 1, 5, 9, 9, 70))) for c in (0, 1) for s in (rng.randrange(900) for _ in range(90))]
    rows += [*rows[:9], (2, 5, 5), (2, 5, 5), (2, 30, 30)]
    df = spark.createDataFrame(rows, "chrom long, start long, end long")
    got = intervals.merge(df, distance, strict, tile=16)
    assert sorted(map(tuple, got.select("chrom", "start", "end", "n").collect())) == islands(rows, distance, strict)


def test_no_window_over_a_scaffolds_rows(spark):
    df = spark.createDataFrame([(1, 0, 0, 5), (2, 0, 3, 9)], "sample long, chrom long, start long, end long")
    for out in (intervals.merge(df), intervals.multi_intersect(df, 2), intervals.low_depth_mask(df, intervals.coverage(df), 2)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"windowspecdefinition\(chrom#\w+, start#", plan)
