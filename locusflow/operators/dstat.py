"""Introgression tests on derived-allele frequencies of four labels, as block sums and delete-one algebra."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


def label_frequencies(g: DataFrame, labels: DataFrame) -> DataFrame:
    """site, label, freq, called: mean dosage over twice the called samples."""
    return g.where("dosage is not null").join(F.broadcast(labels), "sample").groupBy("site", "label").agg((F.sum("dosage") / (2 * F.count("*"))).alias("freq"), F.count("*").alias("called"))


def site_patterns(freq: DataFrame, quartet: tuple[str, str, str, str]) -> DataFrame:
    """site, abba, baba, bbaa of sites that all four labels cover; both polarisations count."""
    wide = freq.where(F.col("label").isin(*quartet)).groupBy("site").pivot("label", list(quartet)).agg(F.first("freq")).dropna()
    p1, p2, p3, p4 = (F.col(f"`{q}`") for q in quartet)
    sym = lambda a, b, c, d: (1 - a) * b * c * (1 - d) + a * (1 - b) * (1 - c) * d
    return wide.select("site", sym(p1, p2, p3, p4).alias("abba"), sym(p2, p1, p3, p4).alias("baba"), sym(p3, p2, p1, p4).alias("bbaa"))


def block_sums(patterns: DataFrame, blocks: DataFrame) -> DataFrame:
    """block, sites, abba, baba, bbaa, d. ``blocks``: site, block."""
    b = patterns.join(blocks, "site").groupBy("block").agg(F.count("*").alias("sites"), *[F.sum(c).alias(c) for c in ("abba", "baba", "bbaa")])
    return b.withColumn("d", (F.col("abba") - F.col("baba")) / F.nullif(F.col("abba") + F.col("baba"), F.lit(0.0)))


def d_statistic(patterns: DataFrame) -> DataFrame:
    """One row: sites, abba, baba, bbaa, d."""
    t = patterns.agg(F.count("*").alias("sites"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("abba", "baba", "bbaa")])
    return t.withColumn("d", (F.col("abba") - F.col("baba")) / F.nullif(F.col("abba") + F.col("baba"), F.lit(0.0)))


@F.pandas_udf(DoubleType())
def _erfc(z: pd.Series) -> pd.Series:
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore")


def jackknife(blocks: DataFrame, p_value: bool = True) -> DataFrame:
    """One row: n, d, se, z, lo, hi, p from block sums: delete-one ratios (N - n_b)/(D - d_b), se = sqrt((n-1)/n sum (t_b - mean)^2).

    Two aggregates over the blocks; the totals are one row. Blocks without a defined ratio left are ignored; se is null for fewer than two.
    """
    b = blocks.select((F.col("abba") - F.col("baba")).alias("num"), (F.col("abba") + F.col("baba")).alias("den"))
    t = b.agg(F.sum("num").alias("num_all"), F.sum("den").alias("den_all"))
    drop = b.join(F.broadcast(t)).withColumn("t", (F.col("num_all") - F.col("num")) / F.nullif(F.col("den_all") - F.col("den"), F.lit(0.0)))
    a = drop.agg(F.count("t").alias("n"), F.first("num_all").alias("num_all"), F.first("den_all").alias("den_all"), F.var_pop("t").alias("v"))
    a = a.select("n", (F.col("num_all") / F.nullif(F.col("den_all"), F.lit(0.0))).alias("d"), F.when(F.col("n") > 1, F.sqrt((F.col("n") - 1) * F.col("v"))).alias("se"))
    a = a.withColumn("z", F.col("d") / F.nullif(F.col("se"), F.lit(0.0))).withColumns({"lo": F.col("d") - 1.96 * F.col("se"), "hi": F.col("d") + 1.96 * F.col("se")})
    return a.withColumn("p", _erfc("z")) if p_value else a


def bootstrap(loci: DataFrame, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """One row: d, sd, lo, hi over ``replicates`` resamples of loci (loc, abba, baba): each locus is weighted by a Poisson(1) draw
    from a hash of seed, replicate and locus, the large-sample form of drawing loci with replacement, so nothing is shuffled but sums."""
    steps, p, c = [], math.exp(-1), 0.0
    for k in range(12):
        c += p
        steps.append(c)
        p /= k + 1
    r = loci.select("loc", "abba", "baba", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "r", "loc"), 11).cast("double") / F.lit(2.0**53)
    w = sum(((u > x).cast("int") for x in steps[1:]), (u > steps[0]).cast("int"))
    d = r.withColumn("w", w).groupBy("r").agg((F.sum(F.col("w") * (F.col("abba") - F.col("baba"))) / F.nullif(F.sum(F.col("w") * (F.col("abba") + F.col("baba"))), F.lit(0.0))).alias("d"))
    return d.agg(F.avg("d").alias("d"), F.stddev_samp("d").alias("sd"), F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"))


def sign_runs(blocks: DataFrame) -> DataFrame:
    """One row: longest run of one sign and number of sign switches along the blocks. A zero (to 12 digits) ends a run but is not a sign to switch from."""
    w = Window.orderBy("block")  # blocks, not sites: a few thousand rows
    s = blocks.select("block", F.signum(F.round(F.coalesce("d", F.lit(0.0)), 12)).alias("s"))
    s = s.withColumn("new", F.when(F.col("s") == F.lag("s").over(w), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = s.where("s != 0").groupBy("run").agg(F.count("*").alias("n"))
    v = s.where("s != 0").withColumn("turn", F.when(F.col("s") != F.lag("s").over(w), 1).otherwise(0))
    return runs.agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest")).join(v.agg(F.coalesce(F.sum("turn"), F.lit(0)).alias("switches")))


def locus_blocks(sites: DataFrame, loci_per_block: int) -> DataFrame:
    """site, block: consecutive loci (dense numbers) in groups."""
    return sites.select("site", F.floor(F.col("loc") / loci_per_block).alias("block"))


def f_branch(fg: DataFrame) -> DataFrame:
    """branch, recipient, value: median over sisters of the least f over descendants. ``fg``: branch, recipient, sister, descendant, f (null: undefined)."""
    m = fg.groupBy("branch", "recipient", "sister").agg(F.min("f").alias("f"))
    return m.groupBy("branch", "recipient").agg(F.percentile("f", 0.5).alias("value"))
