from locusflow.operators import graph


def test_oversize_components_split_at_their_own_pids(spark):
    """Cap 20: pids under 0.92 are cut where the parts fit; where none fits, each sample's best node stands for the component."""
    members, edges = [], []

    def path(first, n, pid, component, samples=2):
        members.extend((component, i, f"s{i % samples}", i % 5, i % 3) for i in range(first, first + n))
        edges.extend((i, i + 1, pid, 1.0) for i in range(first, first + n - 1))

    path(100, 15, 0.89, 100)
    path(115, 15, 0.89, 100)
    path(130, 15, 0.91, 100)
    edges.extend([(114, 115, 0.86, 1.0), (129, 130, 0.87, 1.0)])
    path(200, 25, 0.9, 200)  # no pid fits
    path(300, 25, 0.9, 300, samples=1)
    path(400, 12, 0.85, 400)  # under the cap
    path(500, 30, 0.88, 500)
    edges[-15] = (*edges[-15][:2], 0.87, 1.0)  # one weak link in the middle
    m = spark.createDataFrame(members, "component long, node long, sample string, n_reads long, length long")
    e = spark.createDataFrame(edges, "src long, dst long, pid double, qcov double")
    got = {}
    for r in graph.lowest_presplit(m, e, 2).collect():
        got.setdefault(r.component, []).append(r.node)
    best = lambda s: max((i for i in range(200, 225) if i % 2 == s), key=lambda i: (i % 5, i % 3, -i))
    want = [range(100, 115), range(115, 130), range(130, 145), {best(0), best(1)}, {max(range(300, 325), key=lambda i: (i % 5, i % 3, -i))}, range(400, 412), range(500, 515), range(515, 530)]
    assert sorted(sorted(x) for x in got.values()) == sorted(sorted(x) for x in want)
    split = {r.node: r.part for r in graph.split_components(m, e, 2).collect()}
    assert split[best(0)] == split[best(1)] and len([n for n in split if 200 <= n < 225]) == 2
    assert len({split[n] for n in range(100, 145)}) < 45  # not all single nodes
