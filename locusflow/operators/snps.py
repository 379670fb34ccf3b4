"""SNP matrices stored long: one row per called or missing (site, sample) cell; absent cells are missing.

``g``: site, sample, dosage (null: missing), and where used scaff, pos, loc, dp, multi (an allele index over 1), gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MASKS = ("gap", "multiallelic", "coverage", "population", "quality", "invariant", "maf")


def depth_mask(g: DataFrame, least: int) -> DataFrame:
    """Calls with less depth than ``least`` become missing, before any site filter."""
    return g.withColumn("dosage", F.when(F.col("dp") >= least, F.col("dosage")))


def site_masks(g: DataFrame, n_samples: int, min_cov: int | float = 4, maf: int | float = 0.0, imap: DataFrame | None = None, minmap: dict | None = None, min_qual: float | None = None) -> DataFrame:
    """site, the seven masks (true: the site fails), called, alt, keep.

    ``min_cov``: an int is a number of samples, a float a share; ``maf``: a float is a folded frequency, an int an alternative count.
    Invariant: every dosage, missing ones as 0, equals the half-even rounded mean of the called ones; a site without calls
    is invariant but has no frequency, so it never fails ``maf``. Populations with a minimum (``minmap``) need that many called samples.
    """
    has = set(g.columns)
    flag = lambda c: F.max(F.col(c)) if c in has else F.lit(False)
    aggs = [F.count("dosage").alias("called"), F.sum("dosage").alias("alt"), F.avg("dosage").alias("mean"), F.min(F.coalesce("dosage", F.lit(0))).alias("lo"), F.max(F.coalesce("dosage", F.lit(0))).alias("hi"), F.count("*").alias("cells"), flag("gap").alias("gap"), flag("multi").alias("multiallelic")]
    if "qual" in has:
        aggs.append(F.first("qual").alias("qual"))
    minmap = minmap or {}
    if minmap:
        g = g.join(F.broadcast(imap), "sample", "left")  # one row a sample
        aggs += [F.count_if((F.col("pop") == p) & F.col("dosage").isNotNull()).alias(f"_pop{i}") for i, p in enumerate(minmap)]
    s = g.groupBy("site").agg(*aggs)
    lo = F.when(F.col("cells") < n_samples, F.least("lo", F.lit(0))).otherwise(F.col("lo"))
    hi = F.when(F.col("cells") < n_samples, F.greatest("hi", F.lit(0))).otherwise(F.col("hi"))
    common = F.bround(F.coalesce("mean", F.lit(0.0)), 0)
    freq = F.col("alt") / F.nullif(F.col("called") * 2, F.lit(0))
    low = (F.least(freq, 1 - freq) < maf) if isinstance(maf, float) else (F.col("alt") < maf)
    need = min_cov if isinstance(min_cov, int) else min_cov * n_samples
    pop = F.lit(False)
    for i, m in enumerate(minmap.values()):
        pop = pop | (F.col(f"_pop{i}") < m)
    qual = (F.col("qual").isNull() | F.isnan("qual") | (F.col("qual") < min_qual)) if min_qual is not None else F.lit(False)
    out = s.select("site", "called", F.coalesce("alt", F.lit(0)).alias("alt"), F.coalesce("gap", F.lit(False)).alias("gap"), F.coalesce("multiallelic", F.lit(False)).alias("multiallelic"), (F.col("called") < need).alias("coverage"), pop.alias("population"), qual.alias("quality"), ((lo == common) & (hi == common)).alias("invariant"), F.coalesce(low, F.lit(False)).alias("maf"))
    bad = F.lit(False)
    for m in MASKS:
        bad = bad | F.col(m)
    return out.withColumn("keep", ~bad)


def mask_counts(masks: DataFrame) -> DataFrame:
    """mask, sites: how many sites fail each mask (a site can count in several), how many there are and how many stay."""
    one = masks.agg(F.count("*").alias("total"), *[F.count_if(F.col(m)).alias(m) for m in (*MASKS, "keep")])
    return one.select(F.explode(F.create_map(*[x for m in ("total", *MASKS, "keep") for x in (F.lit(m), F.col(m))])).alias("mask", "sites"))


def missing_by_sample(g: DataFrame, sites: DataFrame, samples: DataFrame) -> DataFrame:
    """sample, missing: share of ``sites`` without a call (0 without sites)."""
    n = sites.agg(F.count("*").alias("n"))  # one row
    called = g.where("dosage is not null").join(sites.select("site"), "site", "left_semi").groupBy("sample").agg(F.count("*").alias("c"))
    return samples.select("sample").join(F.broadcast(n)).join(called, "sample", "left").select("sample", F.when(F.col("n") > 0, 1 - F.coalesce("c", F.lit(0)) / F.col("n")).otherwise(0.0).alias("missing"))


def prune_samples(g: DataFrame, samples: DataFrame, most: float, **filters) -> tuple[DataFrame, DataFrame]:
    """(missing by sample on the filtered sites, site masks again over the samples with at most ``most`` missing). One drop, one rerun."""
    first = site_masks(g, samples.count(), **filters)
    miss = missing_by_sample(g, first.where("keep"), samples)
    stay = miss.where(F.col("missing") <= most).select("sample")
    return miss, site_masks(g.join(F.broadcast(stay), "sample", "left_semi"), stay.count(), **filters)


def ld_blocks(sites: DataFrame, width: int) -> DataFrame:
    """site, block: dense numbers of the non-empty blocks of ``width`` bases, by scaffold and place (sites: site, scaff, pos)."""
    b = sites.withColumn("_b", F.floor(F.col("pos") / width))
    keys = b.select("scaff", "_b").distinct()
    per = keys.groupBy("scaff").agg(F.count("*").alias("n"))
    before = per.select("scaff", (F.sum("n").over(Window.orderBy("scaff")) - F.col("n")).alias("before"))  # one row a scaffold
    num = keys.withColumn("i", F.row_number().over(Window.partitionBy("scaff").orderBy("_b")) - 1).join(before, "scaff").select("scaff", "_b", (F.col("before") + F.col("i")).alias("block"))
    return b.join(num, ["scaff", "_b"]).select("site", "block")


def one_per_block(sites: DataFrame, block: str, order: Column) -> DataFrame:
    """The first site of each block by ``order`` (a seeded hash, with the site to break ties)."""
    return sites.groupBy(block).agg(F.min_by("site", F.struct(order, F.col("site"))).alias("site"))


def bootstrap_loci(loci: DataFrame, seed: int) -> DataFrame:
    """loc, draws: how often each locus comes up when as many loci as there are get drawn with replacement (a hash of seed and draw picks one).

    Loci are numbered by parts: a part's rows are counted first, then numbered on their own.
    """
    names = loci.select("loc").distinct().withColumn("_p", F.pmod(F.xxhash64("loc"), F.lit(1024)))
    n = names.count()
    per = names.groupBy("_p").agg(F.count("*").alias("n"))  # 1024 rows at most
    before = per.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("before"))
    index = names.withColumn("i", F.row_number().over(Window.partitionBy("_p").orderBy("loc")) - 1).join(F.broadcast(before), "_p").select("loc", (F.col("before") + F.col("i")).alias("i"))
    draws = loci.sparkSession.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))).alias("i")).groupBy("i").agg(F.count("*").alias("draws"))
    return index.join(draws, "i", "left").select("loc", F.coalesce("draws", F.lit(0)).alias("draws"))


def population_counts(g: DataFrame, imap: DataFrame) -> DataFrame:
    """site, pop, ref, alt allele counts of called samples. Without a population a sample is its own: give such an ``imap``."""
    return g.where("dosage is not null").join(F.broadcast(imap), "sample").groupBy("site", "pop").agg(F.sum(2 - F.col("dosage")).alias("ref"), F.sum("dosage").alias("alt"))


def population_frequencies(g: DataFrame, imap: DataFrame) -> DataFrame:
    """site, pop, freq: alternative allele frequency (populations without calls have no row)."""
    return population_counts(g, imap).select("site", "pop", (F.col("alt") / (F.col("alt") + F.col("ref"))).alias("freq"))


def _filled(g: DataFrame, n_samples: int) -> DataFrame:
    """Calls less their site's mean: a missing cell, filled with the mean, is then 0 and needs no row."""
    m = g.where("dosage is not null").groupBy("site").agg(F.avg("dosage").alias("mean"))
    return g.where("dosage is not null").join(m, "site").select("site", "sample", (F.col("dosage") - F.col("mean")).alias("x"), "mean")


def gram_matrix(g: DataFrame, n_samples: int) -> DataFrame:
    """i, j, dot: products of mean-filled, column-centred sample rows, i <= j. Each task multiplies dense blocks of its sites and sends one samples-squared matrix on."""
    x = _filled(g, n_samples).select("site", "sample", "x").repartition("site").sortWithinPartitions("site")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total, met, held, kind = {}, np.zeros((0, 0)), np.zeros((0, 0), bool), None, None

        def add(rows: pa.Table):
            nonlocal total, met
            names = rows["sample"].to_pylist()
            for n in names:
                place.setdefault(n, len(place))
            grown = len(place) - len(total)
            if grown:
                total, met = np.pad(total, (0, grown)), np.pad(met, (0, grown))
            cols, sites = np.fromiter((place[n] for n in names), np.int64, len(names)), np.unique(np.asarray(rows["site"]), return_inverse=True)[1]
            dense, has = np.zeros((sites.max() + 1, len(place))), np.zeros((sites.max() + 1, len(place)))
            dense[sites, cols], has[sites, cols] = rows["x"].to_numpy(), 1
            total += dense.T @ dense
            met |= (has.T @ has) > 0

        for b in batches:
            kind = b.schema.field("sample").type
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows:  # the rows of the last site may go on
                whole = int(np.flatnonzero(np.asarray(held["site"]) != held["site"][-1].as_py())[-1:].sum() + 1) if held["site"][0] != held["site"][-1] else 0
                if whole:
                    add(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            add(held)
        names = list(place)
        pairs = [(a, b) for a in range(len(names)) for b in range(len(names)) if names[a] <= names[b] and met[a, b]]
        if pairs:
            yield pa.record_batch({"i": pa.array([names[a] for a, _ in pairs], kind), "j": pa.array([names[b] for _, b in pairs], kind), "dot": pa.array([float(total[p]) for p in pairs])})

    of = dict(g.dtypes)["sample"]
    return x.mapInArrow(products, f"i {of}, j {of}, dot double").groupBy("i", "j").agg(F.sum("dot").alias("dot"))


def dissimilarity(g: DataFrame, n_samples: int) -> DataFrame:
    """i, j, d = s_ii + s_jj - 2 s_ij with S = G G' / sites, on mean-filled genotypes; 0 on the diagonal. i <= j."""
    gram = gram_matrix(g, n_samples)
    n = F.broadcast(g.where("dosage is not null").agg(F.count_distinct("site").alias("n")))
    own = gram.where("i = j").select("i", F.col("dot").alias("own"))
    return gram.join(F.broadcast(own), "i").join(F.broadcast(own.select(F.col("i").alias("j"), F.col("own").alias("own2"))), "j").join(n).select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise((F.col("own") + F.col("own2") - 2 * F.col("dot")) / F.col("n")).alias("d"))


def browser_sites(g: DataFrame, n_samples: int, least: int | float, most_missing: float, maf: float) -> DataFrame:
    """Per site: called, missing, maf (0 without calls), bad_allele, invariant, pass. A threshold up to 1 is a share, rounded up."""
    has = set(g.columns)
    need = F.ceil(F.lit(least * n_samples)) if least <= 1 else F.lit(int(least))
    s = g.groupBy("site").agg(F.first("loc").alias("loc"), F.first("scaff").alias("scaff"), F.count("dosage").alias("called"), F.coalesce(F.sum("dosage"), F.lit(0)).alias("alt"), F.coalesce(F.max("multi") if "multi" in has else F.lit(False), F.lit(False)).alias("bad_allele"), F.min("dosage").alias("lo"), F.max("dosage").alias("hi"))
    f = F.coalesce(F.col("alt") / F.nullif(F.col("called") * 2, F.lit(0)), F.lit(0.0))
    s = s.select("site", "loc", "scaff", "called", (1 - F.col("called") / n_samples).alias("missing"), F.least(f, 1 - f).alias("maf"), "bad_allele", F.coalesce(F.col("lo") == F.col("hi"), F.lit(True)).alias("invariant"))
    return s.withColumn("pass", ~F.col("bad_allele") & ~F.col("invariant") & (F.col("called") >= need) & (F.col("missing") <= most_missing) & (F.col("maf") >= maf))


def browser_filter_counts(sites: DataFrame, need: int, most_missing: float, maf: float) -> DataFrame:
    """filter, sites: a long table of failures and totals."""
    one = sites.agg(F.count("*").alias("total"), F.count_if("bad_allele").alias("bad_allele"), F.count_if("invariant").alias("invariant"), F.count_if(F.col("called") < need).alias("coverage"), F.count_if(F.col("missing") > most_missing).alias("missing"), F.count_if(F.col("maf") < maf).alias("maf"), F.count_if("pass").alias("pass"))
    return one.select(F.explode(F.create_map(*[x for m in one.columns for x in (F.lit(m), F.col(m))])).alias("filter", "sites"))


def browser_loci(sites: DataFrame) -> DataFrame:
    """loc, scaff, sites, passing, mean called and missing."""
    return sites.groupBy("loc").agg(F.min("scaff").alias("scaff"), F.count("*").alias("sites"), F.count_if("pass").alias("passing"), F.avg("called").alias("mean_called"), F.avg("missing").alias("mean_missing"))


def impute_zero(g: DataFrame, sites: DataFrame, samples: DataFrame) -> DataFrame:
    """Every (site, sample) cell of a bounded sample table, missing ones as 0. The samples travel as one array beside each site."""
    names = F.broadcast(samples.agg(F.sort_array(F.collect_list("sample")).alias("_s")))
    full = sites.select("site").join(names).select("site", F.explode("_s").alias("sample"))
    return full.join(g.select("site", "sample", "dosage"), ["site", "sample"], "left").withColumn("dosage", F.coalesce("dosage", F.lit(0)))


def impute_sample(g: DataFrame, sites: DataFrame, samples: DataFrame, imap: DataFrame, seed: int = 1) -> DataFrame:
    """Missing cells drawn from Binomial(2, population frequency) by a hash of seed, site and sample; populations without calls give 0."""
    full = impute_zero(g.withColumn("dosage", F.coalesce("dosage", F.lit(-1))), sites, samples)
    known = g.where("dosage is not null").select("site", "sample", F.lit(True).alias("_known"))
    f = population_frequencies(g, imap)
    u = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), "site", "sample"), 11).cast("double") / F.lit(2.0**53)
    j = full.join(known, ["site", "sample"], "left").join(F.broadcast(imap), "sample").join(f, ["site", "pop"], "left")
    draw = F.coalesce(F.when(u(1) < F.col("freq"), 1).otherwise(0) + F.when(u(2) < F.col("freq"), 1).otherwise(0), F.lit(0))
    return j.select("site", "sample", F.when(F.coalesce("_known", F.lit(False)), F.col("dosage")).otherwise(draw).cast("long").alias("dosage"))
