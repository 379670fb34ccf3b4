import numpy as np
import pytest

from locusflow.operators import numeric, snps


def planted(spark):
    """Two populations with opposite alleles at most sites, over several blocks of sites."""
    r = np.random.default_rng(4)
    rows = []
    for site in range(120):
        freq = r.choice([0.05, 0.95])
        for s in range(10):
            f = freq if s < 5 else 1 - freq
            rows.append((site, s, int(r.binomial(2, f)) if r.random() < 0.9 else None))
    return spark.createDataFrame(rows, "site long, sample long, dosage int")


def test_one_membership_matrix_over_all_blocks(spark):
    g = planted(spark)
    (_, _, one), (k, q, two) = numeric.snmf(numeric.matrix_blocks(g, 25), list(range(10)), [1, 2], rounds=25)
    assert k == 2 and two < one - 0.2
    assert np.allclose(q.sum(1), 1)
    a, b = q[:5].mean(0), q[5:].mean(0)
    assert a.argmax() != b.argmax() and a.max() > 0.8 and b.max() > 0.8


def test_gram_matrix_against_numpy(spark):
    g = planted(spark)
    m = np.full((120, 10), np.nan)
    for r in g.where("dosage is not null").collect():
        m[r.site, r.sample] = r.dosage
    x = np.nan_to_num(m - np.nanmean(m, 1, keepdims=True))
    want = x.T @ x
    got = {(r.i, r.j): r.dot for r in snps.gram_matrix(g, 10).collect()}
    assert set(got) == {(i, j) for i in range(10) for j in range(i, 10)}
    assert all(v == pytest.approx(want[k], abs=1e-9) for k, v in got.items())
    assert snps.gram_matrix(g.limit(0), 10).count() == 0
