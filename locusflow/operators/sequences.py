"""Alignments: locus, sample, seq (equal lengths within a locus), exploded to locus, pos, sample, base only where columns matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusflow.functions.genotypes import base_copies, is_iupac_het


def sites(seqs: DataFrame) -> DataFrame:
    """locus, sample, pos (from 0), base (upper case; a gap is N)."""
    b = F.regexp_replace(F.upper("seq"), "-", "N")
    return seqs.select("locus", "sample", F.posexplode(F.filter(F.split(b, ""), lambda x: x != "")).alias("pos", "base"))


def site_classes(cells: DataFrame) -> DataFrame:
    """locus, pos, second (copies of the second-commonest base, heterozygotes adding both), hets, kind: invariant, autapomorphy or pis."""
    a = cells.withColumn("_b", F.explode(F.array_distinct(base_copies("base"))))
    per = a.groupBy("locus", "pos", "_b").agg(F.count("*").alias("n"))
    s = per.groupBy("locus", "pos").agg(F.sort_array(F.collect_list("n"), asc=False).alias("c"))  # four bases at most
    second = F.when(F.size("c") > 1, F.col("c")[1]).otherwise(0)
    h = cells.groupBy("locus", "pos").agg(F.count_if(is_iupac_het("base")).alias("hets"))
    return h.join(s, ["locus", "pos"], "left").select("locus", "pos", F.coalesce(second, F.lit(0)).alias("second"), "hets").withColumn("kind", F.when(F.col("second") == 0, "invariant").when(F.col("second") == 1, "autapomorphy").otherwise("pis"))


def locus_trim(cells: DataFrame, least: int) -> DataFrame:
    """locus, first, last: the outermost columns that ``least`` samples or more cover; without any, the whole locus."""
    c = cells.groupBy("locus", "pos").agg(F.count_if(F.col("base") != "N").alias("n"))
    return c.groupBy("locus").agg(F.coalesce(F.min(F.when(F.col("n") >= least, F.col("pos"))), F.min("pos")).alias("first"), F.coalesce(F.max(F.when(F.col("n") >= least, F.col("pos"))), F.max("pos")).alias("last"))


def apply_trim(seqs: DataFrame, trim: DataFrame) -> DataFrame:
    return seqs.join(trim, "locus").withColumn("seq", F.substring("seq", F.col("first") + 1, F.col("last") - F.col("first") + 1)).drop("first", "last")


def row_masks(seqs: DataFrame, least_observed: float, most_het: float) -> DataFrame:
    """With seq all N where too few bases are observed, or too many of those are heterozygous; observed, het."""
    up = F.upper("seq")
    obs = F.length(F.regexp_replace(up, "[N-]", ""))
    het = F.length(F.regexp_replace(up, "[^RYSWKM]", ""))
    s = seqs.withColumns({"observed": obs, "het": het})
    bad = (F.col("observed") < least_observed * F.length("seq")) | (F.coalesce(F.col("het") / F.nullif(F.col("observed"), F.lit(0)), F.lit(0.0)) > most_het)
    return s.withColumn("masked", bad).withColumn("seq", F.when(bad, F.repeat(F.lit("N"), F.length("seq"))).otherwise(F.col("seq")))


def filter_loci(seqs: DataFrame, min_samples: int, max_row_missing: float, min_length: int) -> DataFrame:
    """locus, samples, length, reason (null: kept): too few samples with data, then no row complete enough, then too short."""
    up = F.upper("seq")
    obs = F.length(F.regexp_replace(up, "[N-]", ""))
    s = seqs.withColumn("obs", obs).groupBy("locus").agg(F.count_if(F.col("obs") > 0).alias("samples"), F.max(F.length("seq")).alias("length"), F.count_if((F.col("obs") > 0) & (1 - F.col("obs") / F.nullif(F.length("seq"), F.lit(0)) <= max_row_missing)).alias("whole"))
    return s.select("locus", "samples", "length", F.when(F.col("samples") < min_samples, "samples").when(F.col("whole") < min_samples, "missing").when(F.col("length") < min_length, "length").alias("reason"))


def concatenation(loci: DataFrame, parts: int = 1024) -> DataFrame:
    """locus, start, end (1-based, inclusive) of each locus in the concatenated alignment, in order of locus (locus, length).

    Lengths are summed by ranges of the locus number first, so the running sum is over ranges, then inside each.
    """
    p = loci.withColumn("_p", F.floor(F.col("locus") / parts))
    w = Window.orderBy("_p")
    per = p.groupBy("_p").agg(F.sum("length").alias("n"))
    before = per.select("_p", (F.sum("n").over(w) - F.col("n")).alias("before"))
    v = Window.partitionBy("_p").orderBy("locus")
    j = p.withColumn("_at", F.sum("length").over(v)).join(before, "_p")
    return j.select("locus", (F.col("before") + F.col("_at") - F.col("length") + 1).alias("start"), (F.col("before") + F.col("_at")).alias("end"))


def concatenate(seqs: DataFrame, samples: DataFrame, loci: DataFrame) -> DataFrame:
    """sample, locus, seq with absent samples as N, to be written in order of locus: a sample's whole sequence never sits in one row."""
    names = F.broadcast(samples.agg(F.sort_array(F.collect_list("sample")).alias("_s")))
    full = loci.select("locus", "length").join(names).select("locus", "length", F.explode("_s").alias("sample"))
    return full.join(seqs, ["locus", "sample"], "left").select("sample", "locus", F.coalesce("seq", F.repeat(F.lit("N"), F.col("length"))).alias("seq"))


def occupancy(seqs: DataFrame) -> DataFrame:
    """sample, loci, bases (not missing)."""
    obs = F.length(F.regexp_replace(F.upper("seq"), "[N-]", ""))
    return seqs.groupBy("sample").agg(F.count_if(obs > 0).alias("loci"), F.sum(obs).alias("bases"))


def consensus(cells: DataFrame) -> DataFrame:
    """locus, seq: the commonest of A, C, G, T in each column, ties in that order; columns without a base are left out."""
    b = cells.where(F.col("base").isin(*"ACGT")).groupBy("locus", "pos", "base").agg(F.count("*").alias("n"))
    top = b.groupBy("locus", "pos").agg(F.min_by("base", F.struct(-F.col("n"), F.col("base"))).alias("base"))
    s = top.groupBy("locus").agg(F.sort_array(F.collect_list(F.struct("pos", "base"))).alias("c"))  # one locus' columns
    return s.select("locus", F.array_join(F.transform("c", lambda x: x["base"]), "").alias("seq"))
