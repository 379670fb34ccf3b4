"""Paralog screening: per-site depth and allele metrics, per-locus flags, and the reduce over samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def depth_z(sites: DataFrame) -> DataFrame:
    """``sites`` with dp_z: log1p(DP) less its mean over its sample standard deviation (1 for one row, at least 1e-12), over each sample's rows."""
    s = sites.groupBy("sample").agg(F.avg(F.log1p("dp")).alias("_m"), F.coalesce(F.stddev_samp(F.log1p("dp")), F.lit(1.0)).alias("_s"))
    return sites.join(F.broadcast(s), "sample").withColumn("dp_z", (F.log1p("dp") - F.col("_m")) / F.greatest("_s", F.lit(1e-12))).drop("_m", "_s")


def allele_metrics(sites: DataFrame, least: int) -> DataFrame:
    """With n_alleles (AD of ``least`` or more), second and third: the second and third largest AD over DP; all 0 where DP is."""
    ad = F.sort_array("ad", asc=False)
    part = lambda i: F.when((F.col("dp") > 0) & (F.size("ad") > i), F.get(ad, F.lit(i)) / F.col("dp")).otherwise(0.0)
    return sites.withColumns({"n_alleles": F.when(F.col("dp") > 0, F.size(F.filter("ad", lambda x: x >= least))).otherwise(0), "second": part(1), "third": part(2)})


def locus_metrics(sites: DataFrame, max_z: float, max_third: float, max_het: float, max_alleles: int = 2) -> DataFrame:
    """sample, rid, n_sites, max_dp, max_z, het, n_third, fail flags, pass. ``sites``: sample, rid, dp, dp_z, third, n_alleles, het."""
    m = sites.groupBy("sample", "rid").agg(F.count("*").alias("n_sites"), F.max("dp").alias("max_dp"), F.max(F.abs("dp_z")).alias("max_z"), F.avg(F.col("het").cast("int")).alias("het"), F.count_if(F.col("third") > max_third).alias("n_third"), F.max("n_alleles").alias("n_alleles"))
    m = m.withColumns({"fail_depth": F.col("max_z") > max_z, "fail_third": F.col("n_third") > 0, "fail_het": F.col("het") > max_het, "fail_alleles": F.col("n_alleles") > max_alleles})
    return m.withColumn("pass", ~(F.col("fail_depth") | F.col("fail_third") | F.col("fail_het") | F.col("fail_alleles")))


def across_samples(calls: DataFrame, most: float, least_data: int = 1) -> DataFrame:
    """rid, n_data, n_good, n_fail, fail_fraction, keep: calls of samples without data do not count. ``calls``: sample, rid, has_data, good."""
    r = calls.groupBy("rid").agg(F.count_if("has_data").alias("n_data"), F.count_if(F.col("has_data") & F.col("good")).alias("n_good"))
    r = r.withColumn("n_fail", F.col("n_data") - F.col("n_good")).withColumn("fail_fraction", F.coalesce(F.col("n_fail") / F.nullif(F.col("n_data"), F.lit(0)), F.lit(0.0)))
    return r.withColumn("keep", (F.col("n_data") >= least_data) & (F.col("fail_fraction") <= most))


def rad_wgs(rad: DataFrame, wgs: DataFrame) -> DataFrame:
    """Full outer join of both reduces by rid, missing counts 0; keep unless either side drops it."""
    a = rad.select("rid", F.col("n_data").alias("rad_data"), F.col("n_fail").alias("rad_fail"), F.col("keep").alias("rad_keep"))
    b = wgs.select("rid", F.col("n_data").alias("wgs_data"), F.col("n_fail").alias("wgs_fail"), F.col("keep").alias("wgs_keep"))
    j = a.join(b, "rid", "full")
    return j.select("rid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rad_data", "rad_fail", "wgs_data", "wgs_fail")], (F.coalesce("rad_keep", F.lit(True)) & F.coalesce("wgs_keep", F.lit(True))).alias("keep"))


def softclip_fraction(regions: DataFrame, reads: DataFrame, least: int) -> DataFrame:
    """rid, reads, clipped, fraction (0 without reads): ``reads``: rid, clip."""
    r = reads.groupBy("rid").agg(F.count("*").alias("reads"), F.count_if(F.col("clip") >= least).alias("clipped"))
    return regions.select("rid").join(r, "rid", "left").select("rid", F.coalesce("reads", F.lit(0)).alias("reads"), F.coalesce("clipped", F.lit(0)).alias("clipped"), F.coalesce(F.col("clipped") / F.nullif(F.col("reads"), F.lit(0)), F.lit(0.0)).alias("fraction"))
