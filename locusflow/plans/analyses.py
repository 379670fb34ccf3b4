"""Entry points: one function an analysis, from tables to tables, and a small command line."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions.trees import parse_newick, rooted_quartets
from locusflow.operators import dstat, popgen, sequences, snps
from locusflow.plans.external import run as external
from locusflow.session import cut, prepare
from locusflow.sources import text


@dataclass
class SnpView:
    """Filtered genotypes with their masks and statistics."""

    genotypes: DataFrame
    masks: DataFrame
    statistics: DataFrame
    samples: DataFrame
    missing: DataFrame = field(default=None)


def snpex(g: DataFrame, samples: DataFrame, max_sample_missing: float = 1.0, min_depth: int | None = None, unlinked: bool = False, seed: int = 1, **filters) -> SnpView:
    """Depth mask, site filters, one drop of samples and a rerun, and optionally one SNP a locus. ``g``: site, sample, dosage, loc and what the filters need."""
    if min_depth is not None:
        g = snps.depth_mask(text.require(g, "dp"), min_depth)
    if filters.get("min_qual") is not None:
        text.require(g, "qual")
    miss, masks = snps.prune_samples(g, samples, max_sample_missing, **filters)
    masks = cut(masks)
    stay = miss.where(F.col("missing") <= max_sample_missing).select("sample")
    keep = masks.where("keep").select("site")
    out = g.join(keep, "site", "left_semi").join(F.broadcast(stay), "sample", "left_semi")
    if unlinked:
        one = snps.one_per_block(out.select("site", "loc").distinct(), "loc", F.xxhash64("site", F.lit(seed)))
        out = out.join(one.select("site"), "site", "left_semi")
    return SnpView(out, masks, snps.mask_counts(masks), stay, miss)


def popgen_tables(c: DataFrame, sizes: dict | None = None) -> dict[str, DataFrame]:
    """population, pairwise, sfs, global and, with population sizes, theta tables of per-site allele counts; ``c`` is cut once and shared."""
    c = cut(c)
    out = {"population": popgen.per_population(c), "pairwise": popgen.pairwise(c), "sfs": popgen.folded_sfs(c), "global": popgen.global_fit(c)}
    return out | ({"theta": popgen.theta_tajima(c, sizes)} if sizes else {})


def baba(g: DataFrame, labels: DataFrame, blocks: DataFrame, quartets: list[tuple[str, str, str, str]] | None = None, newick: str | None = None) -> DataFrame:
    """p1, p2, p3, p4, and the jackknife row of each quartet, given or taken from a rooted tree. Frequencies are computed once for all."""
    quartets = quartets or rooted_quartets(parse_newick(newick or ""))
    freq = cut(dstat.label_frequencies(g, labels))
    out = None
    for q in quartets:
        row = dstat.jackknife(dstat.block_sums(dstat.site_patterns(freq, q), blocks)).select(*[F.lit(x).alias(f"p{i + 1}") for i, x in enumerate(q)], "*")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no quartet to test")
    return out


def seqex(seqs: DataFrame, min_samples: int = 4, max_row_missing: float = 1.0, min_length: int = 1, trim: int = 1, least_observed: float = 0.0, most_het: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(kept alignments, verdict on every locus): trim, mask rows, trim again, filter."""
    s = sequences.apply_trim(seqs, sequences.locus_trim(sequences.sites(seqs), trim))
    s = cut(sequences.row_masks(s, least_observed, most_het).select("locus", "sample", "seq"))
    s = sequences.apply_trim(s, sequences.locus_trim(sequences.sites(s), trim))
    verdict = sequences.filter_loci(s, min_samples, max_row_missing, min_length)
    return s.join(verdict.where("reason is null").select("locus"), "locus", "left_semi"), verdict


def vcf_to_store(spark: SparkSession, path: str, out: str, ld_block: int = 20_000) -> None:
    """``out``/genotypes and ``out``/sites as Parquet from a VCF of SNPs: dosage (null: missing), depth, base; blocks of ``ld_block`` bases as loci."""
    v = text.vcf(prepare(spark), path).where((F.length("ref") == 1) & F.forall("alts", lambda a: F.length(a) == 1))
    site = F.xxhash64("chrom", "pos")
    c = text.vcf_calls(v).withColumn("site", site)
    multi = (F.coalesce("a0", F.lit(0)) > 1) | (F.coalesce("a1", F.lit(0)) > 1)
    c.select("site", "sample", (F.col("a0") + F.col("a1")).cast("long").alias("dosage"), "dp", "base", "qual", multi.alias("multi"), (F.length("ref") != 1).alias("gap")).write.mode("overwrite").parquet(f"{out}/genotypes")
    sites = v.select(site.alias("site"), F.col("chrom").alias("scaff"), "pos", "ref", F.col("alts")[0].alias("alt"), "qual")
    sites.join(snps.ld_blocks(sites, ld_block).withColumnRenamed("block", "loc"), "site").write.mode("overwrite").parquet(f"{out}/sites")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("locusflow")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("vcf2store")
    a.add_argument("vcf")
    a.add_argument("out")
    b = sub.add_parser("popgen")
    b.add_argument("store")
    b.add_argument("imap")
    b.add_argument("out")
    for step in ("trim", "map", "call", "align", "cluster", "tree", "species_tree", "admixture", "embed"):
        sub.add_parser(step).add_argument("--program")
    o = p.parse_args(args)
    if o.what not in ("vcf2store", "popgen"):
        print(external(o.what, o.program))
        return 0
    spark = prepare(SparkSession.builder.appName("locusflow").getOrCreate())
    if o.what == "vcf2store":
        vcf_to_store(spark, o.vcf, o.out)
    else:
        pops, _ = text.imap(spark, o.imap)
        for name, df in popgen_tables(popgen.counts_from_genotypes(spark.read.parquet(f"{o.store}/genotypes"), pops)).items():
            df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(f"{o.out}/{name}")
    print(json.dumps({"done": o.what}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
