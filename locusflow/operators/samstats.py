"""Alignment statistics and duplicate removal on long SAM records: qname, flag, rname, pos, mapq, cigar, rnext, tlen, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions.genotypes import edit_distance_tag, softclip


def flag(bit: int) -> Column:
    return F.col("flag").bitwiseAND(bit) != 0


def structural(a: DataFrame) -> DataFrame:
    """Primary mapped records: none of 0x4, 0x100, 0x200, 0x800."""
    return a.where(F.col("flag").bitwiseAND(0x4 | 0x100 | 0x200 | 0x800) == 0)


def single_end(a: DataFrame, mapq: int = 20, clip: int = 25, nm: int = 50) -> DataFrame:
    """One row: reads, low_mapq, clip_fail, nm_fail, passing, mean, median and population sd of MAPQ. A read is counted under the first test it fails for passing."""
    s = a.select("mapq", softclip("cigar").alias("clip"), edit_distance_tag("tags").alias("nm"))
    ok = (F.col("mapq") >= mapq) & (F.col("clip") <= clip) & (F.col("nm") < nm)
    return s.agg(F.count("*").alias("reads"), F.count_if(F.col("mapq") < mapq).alias("low_mapq"), F.count_if(F.col("clip") > clip).alias("clip_fail"), F.count_if(F.col("nm") >= nm).alias("nm_fail"), F.count_if(ok).alias("passing"), F.avg("mapq").alias("mapq_mean"), F.percentile("mapq", 0.5).alias("mapq_median"), F.stddev_pop("mapq").alias("mapq_sd"))


def templates(a: DataFrame) -> DataFrame:
    """qname, reads, mapq (least), clip, nm, tlen (largest): the mates of a name together, pre-aggregated before the shuffle."""
    return a.groupBy("qname").agg(F.count("*").alias("reads"), F.min("mapq").alias("mapq"), F.max(softclip("cigar")).alias("clip"), F.max(edit_distance_tag("tags")).alias("nm"), F.max(F.abs("tlen")).alias("tlen"))


def paired(a: DataFrame, mapq: int = 20, clip: int = 25, nm: int = 50, tlen: int = 2000) -> DataFrame:
    t = templates(a)
    ok = (F.col("mapq") >= mapq) & (F.col("clip") <= clip) & (F.col("nm") < nm) & (F.col("tlen") <= tlen)
    return t.agg(F.count("*").alias("templates"), F.count_if(F.col("mapq") < mapq).alias("low_mapq"), F.count_if(F.col("clip") > clip).alias("clip_fail"), F.count_if(F.col("nm") >= nm).alias("nm_fail"), F.count_if(F.col("tlen") > tlen).alias("tlen_fail"), F.count_if(ok).alias("passing"), F.avg("mapq").alias("mapq_mean"))


def histogram(a: DataFrame, value: str) -> DataFrame:
    return a.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))


def remove_duplicates(a: DataFrame, umi: bool = False) -> DataFrame:
    """One record for each (rname, pos, strand, umi): the highest MAPQ, then the smallest name. UMIs stand in names as UMI_ and letters."""
    keys = ["rname", "pos", "strand", "umi"]
    x = a.withColumn("strand", flag(0x10)).withColumn("umi", F.regexp_extract("qname", "UMI_([ACGTN]+)", 1) if umi else F.lit(""))
    cols = [c for c in a.columns]
    best = x.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(-F.col("mapq"), F.col("qname"), *[F.col(c) for c in cols if c not in ("mapq", "qname")])).alias("r"))
    return best.select("r.*")


def classify_layout(a: DataFrame) -> DataFrame:
    """sample, layout: paired, single, or mixed (an error for a sample's file) from primary mapped records."""
    s = a.where(F.col("flag").bitwiseAND(0x904) == 0).groupBy("sample").agg(F.max(flag(0x1)).alias("p"), F.max(~flag(0x1)).alias("s"))
    return s.select("sample", F.when(F.col("p") & F.col("s"), "mixed").when(F.col("p"), "paired").otherwise("single").alias("layout"))


def same_scaffold_pairs(a: DataFrame, most: int = 2000) -> DataFrame:
    return a.where(flag(0x1) & ~flag(0x4) & ~flag(0x8) & ((F.col("rnext") == "=") | (F.col("rnext") == F.col("rname"))) & (F.abs("tlen") <= most))
