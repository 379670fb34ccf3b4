"""Summaries of within-sample clusters and of split components, cluster membership, joined arms and seeded samples of loci."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Unknown bases between the two arms of a joined pair.
SPACER = 24


def cluster_summary(rows: DataFrame) -> DataFrame:
    """cluster, cores (distinct), reads and seed (the node of most reads, ties to the smaller) from rows of cluster, core, node, reads."""
    return rows.groupBy("cluster").agg(F.countDistinct("core").alias("cores"), F.sum("reads").alias("reads"), F.min_by("node", F.struct(-F.col("reads"), "node")).alias("seed"))


def sample_burden(members: DataFrame) -> DataFrame:
    """Per sample: components it is in, those that were split, those where it is in several parts itself, and their shares.

    ``members``: component, part, sample. Two mergeable aggregates; only (component, sample) pairs meet the split components.
    """
    parts = members.groupBy("component").agg(F.countDistinct("part").alias("parts"))
    own = members.groupBy("component", "sample").agg(F.countDistinct("part").alias("own"))
    j = own.join(parts, "component")
    got = j.groupBy("sample").agg(F.count("*").alias("components"), F.count_if(F.col("parts") > 1).alias("split"), F.count_if(F.col("own") > 1).alias("multi"))
    return got.withColumns({"split_share": F.col("split") / F.col("components"), "multi_share": F.col("multi") / F.col("components")})


def normalize_membership(q: DataFrame, clusters: int) -> DataFrame:
    """Rows of sample, k, weight scaled to a sum of one a sample; a sample whose weights are all nought gets equal shares."""
    total = F.sum("weight").over(Window.partitionBy("sample"))
    return q.select("sample", "k", F.when(total > 0, F.col("weight") / total).otherwise(F.lit(1.0 / clusters)).alias("share"))


def assignments(q: DataFrame) -> DataFrame:
    """sample, cluster (the greatest share's, ties to the lowest) and its share."""
    best = F.min(F.struct((-F.col("share")).alias("less"), F.col("k")))
    return q.groupBy("sample").agg(best.alias("b")).select("sample", F.col("b.k").alias("cluster"), (-F.col("b.less")).alias("share"))


def split_arms(seq: str | Column, spacer: int = SPACER) -> tuple[Column, Column]:
    """What lies before and after the first run of ``spacer`` unknown bases; without one the whole sequence and null."""
    c = F.col(seq) if isinstance(seq, str) else seq
    at = F.instr(c, "N" * spacer)
    return F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(c), F.when(at > 0, F.substr(c, at + spacer))


def join_arms(left: Column, right: Column, spacer: int = SPACER) -> Column:
    return F.when(right.isNull(), left).otherwise(F.concat(left, F.lit("N" * spacer), right))


def sample_loci(loci: DataFrame, n: int, seed: int, key: str = "locus") -> DataFrame:
    """``n`` loci drawn by a seeded digest of the key, in order of the key: the same draw on any partitioning."""
    return loci.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n).orderBy(key)


def gamma_prior(low: float, high: float) -> tuple[float, float]:
    """Shape and rate of the gamma distribution with mean (low + high) / 2 and variance (high - low)^2 / 16."""
    mean, var = (low + high) / 2, (high - low) ** 2 / 16
    return mean * mean / var, mean / var


def scaled_posterior(draws: DataFrame, columns: list[str], rate: str = "mu", generation: str = "gen") -> DataFrame:
    """Divergence times (tau*) in years, tau * generation / rate, and population sizes (theta*), theta / (4 * rate), of posterior draws."""
    one = lambda c: F.col(c) * F.col(generation) / F.col(rate) if c.startswith("tau") else F.col(c) / (4 * F.col(rate))
    return draws.withColumns({c: one(c) for c in columns})
