"""Files that other programs read or write: trimming reports, marker lists, membership matrices, species-tree inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.sources.text import FormatError, numbered_lines, require

_SIDE = "struct<total_reads: long, total_bases: long>"
_REPORT = f"summary struct<before_filtering: {_SIDE}, after_filtering: {_SIDE}>, filtering_result struct<low_quality_reads: long, too_many_N_reads: long, too_short_reads: long>"


def trim_reports(spark: SparkSession, path: str) -> DataFrame:
    """file, reads and bases before and after, and reads dropped by reason, of JSON reports; a malformed one raises FormatError."""
    df = spark.read.schema(_REPORT + ", _corrupt_record string").option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    bad = df.where("_corrupt_record is not null or summary.before_filtering is null or summary.after_filtering is null").select("file").first()
    if bad:
        raise FormatError(f"not a trimming report: {bad['file']}")
    side = lambda s: [F.col(f"summary.{s}_filtering.total_{x}").alias(f"{x}_{s}") for x in ("reads", "bases")]
    return df.select("file", *side("before"), *side("after"), "filtering_result.*")


def markers(spark: SparkSession, path: str) -> DataFrame:
    """chrom, marker, cm, pos, a1, a2 of a PLINK .bim file."""
    return spark.read.schema("chrom string, marker string, cm double, pos long, a1 string, a2 string").option("sep", "\t").csv(path)


def membership(spark: SparkSession, path: str) -> DataFrame:
    """row, k, weight of a .Q or .P matrix: numbers between spaces, every line of equal length (else FormatError)."""
    lines = numbered_lines(spark, path).where("trim(value) != ''").select(F.col("line").alias("row"), F.split(F.trim("value"), r"\s+").alias("x"))
    low, high = lines.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if low != high:
        raise FormatError(f"lines of {low} to {high} columns")
    return lines.select("row", F.posexplode("x").alias("k", "weight")).withColumn("weight", F.col("weight").cast("double"))


def species_tree_lines(seqs: DataFrame, imap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequence file and map file as lines: a PHYLIP block a locus with names pop^sample, and sample and population.

    ``seqs``: locus, sample, seq; samples without a population are left out. A locus's rows meet in one group.
    """
    j = require(seqs, "locus", "sample", "seq").join(F.broadcast(imap), "sample")
    name = F.concat(F.col("pop").cast("string"), F.lit("^"), F.col("sample").cast("string"))
    row = F.struct(name.alias("name"), "seq")
    g = j.groupBy("locus").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    head = F.concat_ws(" ", F.size("rows").cast("string"), F.length(F.col("rows")[0]["seq"]).cast("string"))
    body = F.array_join(F.transform("rows", lambda r: F.concat(r["name"], F.lit("  "), r["seq"])), "\n")
    blocks = g.select(F.col("locus").alias("line"), F.concat(head, F.lit("\n"), body, F.lit("\n")).alias("value"))
    return blocks, imap.select(F.col("sample").alias("line"), F.concat_ws(" ", F.col("sample").cast("string"), F.col("pop").cast("string")).alias("value"))


def species_tree_control(populations: dict[str, int], newick: str, loci: int, theta: tuple[float, float], tau: tuple[float, float], seed: int = 1, burnin: int = 2000, samples: int = 20000, prefix: str = "out") -> str:
    """Control text of a species-tree run: populations with sample counts, guide tree, gamma priors, chain settings."""
    names = list(populations)
    keys = {
        "seed": seed, "seqfile": f"{prefix}.seqs.txt", "Imapfile": f"{prefix}.imap.txt", "outfile": f"{prefix}.out.txt", "mcmcfile": f"{prefix}.mcmc.txt", "nloci": loci,
        "species&tree": f"{len(names)} {' '.join(names)}\n    {' '.join(str(populations[n]) for n in names)}\n    {newick}",
        "thetaprior": f"gamma {theta[0]:g} {theta[1]:g}", "tauprior": f"gamma {tau[0]:g} {tau[1]:g}", "burnin": burnin, "nsample": samples,
    }
    return "\n".join(f"{k} = {v}" for k, v in keys.items()) + "\n"
