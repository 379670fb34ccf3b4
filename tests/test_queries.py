import glob

import duckdb
import pandas as pd
import pytest

from locusflow.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    return c


def keyed(d: pd.DataFrame):
    def plain(x):
        if x is None or (not isinstance(x, (list, tuple)) and pd.isna(x)):
            return "null"
        x = x.item() if hasattr(x, "item") else x
        return str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in d[sorted(d.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert keyed(got) == keyed(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_partitions_do_not_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append([keyed(registry.QUERIES[q](spark, SF).toPandas()) for q in ("interval_multiinter", "constrained_split", "snp_site_masks")])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]
