"""Exports. Text formats are DataFrames of ordered lines (``line``, ``value``) that Spark writes in parts; files in one piece are
streamed to the driver partition by partition."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions.genotypes import marker_id


def write_lines(lines: DataFrame, path: str) -> None:
    """Text parts in order of ``line``."""
    lines.orderBy("line").select("value").write.mode("overwrite").text(path)


def write_file(lines: DataFrame, path: str) -> None:
    """One local text file, held a partition at a time."""
    with Path(path).open("w") as f:
        for r in lines.orderBy("line").select("value").toLocalIterator():
            f.write(r["value"] + "\n")


def _numbered(df: DataFrame, *order) -> DataFrame:
    """line as a sortable struct of the given columns."""
    return df.select(F.struct(*order).alias("line"), "value")


def fasta_lines(seqs: DataFrame) -> DataFrame:
    return _numbered(seqs.withColumn("value", F.concat(F.lit(">"), F.col("sample").cast("string"), F.lit("\n"), F.col("seq"))), "sample")


def phylip_lines(seqs: DataFrame) -> DataFrame:
    """A header of counts, then names padded to the longest and five more, a space, and the sequence (sample, seq)."""
    name = F.col("sample").cast("string")
    size = seqs.agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("sites"), F.max(F.length(name)).alias("w"))
    head = size.select(F.lit(0).alias("o"), F.lit("").alias("s"), F.concat_ws(" ", F.col("n").cast("string"), F.col("sites").cast("string")).alias("value"))
    body = seqs.join(F.broadcast(size.select("w"))).select(F.lit(1).alias("o"), name.alias("s"), F.concat(F.rpad(name, F.col("w") + 5, F.lit(" ")), F.lit(" "), F.col("seq")).alias("value"))
    return _numbered(head.unionByName(body), "o", "s")


def nexus_lines(seqs: DataFrame, width: int = 100) -> DataFrame:
    """An interleaved NEXUS data block."""
    name = F.col("sample").cast("string")
    size = seqs.agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("sites"))
    head = size.select(F.lit(-1).alias("o"), F.lit("").alias("s"), F.concat(F.lit("#NEXUS\nBEGIN DATA;\n  DIMENSIONS NTAX="), F.col("n"), F.lit(" NCHAR="), F.col("sites"), F.lit(";\n  FORMAT DATATYPE=DNA MISSING=N GAP=- INTERLEAVE=YES;\n  MATRIX")).alias("value"))
    part = seqs.select(name.alias("s"), "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / width))).alias("o"))
    body = part.select("o", "s", F.concat(F.lit("  "), F.rpad("s", 30, " "), F.lit(" "), F.substring("seq", (F.col("o") * width + 1).cast("int"), F.lit(width))).alias("value"))
    tail = size.select(F.lit(1 << 40).alias("o"), F.lit("").alias("s"), F.lit("  ;\nEND;").alias("value"))
    return _numbered(head.select(F.col("o").cast("long").alias("o"), "s", "value").unionByName(body).unionByName(tail), "o", "s")


def treemix_lines(counts: DataFrame, pops: list[str]) -> DataFrame:
    """ref,alt of each population (site, pop, ref, alt) in the order given; populations without calls are 0,0."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    w = counts.groupBy("site").pivot("pop", pops).agg(F.first("ref").alias("ref"), F.first("alt").alias("alt"))
    body = w.select(F.lit(1).alias("o"), "site", F.concat_ws(" ", *[F.concat(cell(f"`{p}_ref`"), F.lit(","), cell(f"`{p}_alt`")) for p in pops]).alias("value"))
    head = counts.sparkSession.createDataFrame([(0, None, " ".join(pops))], f"o int, site {dict(counts.dtypes)['site']}, value string")
    return _numbered(head.unionByName(body), "o", "site")


def plink_rows(g: DataFrame, n_samples: int) -> DataFrame:
    """site, bytes: 2-bit genotypes, four a byte with the first in the low bits: 0 is 00, 1 is 10, 2 is 11, missing is 01 (samples are numbered 0..n-1)."""
    code = F.when(F.col("dosage") == 0, 0).when(F.col("dosage") == 1, 2).when(F.col("dosage") == 2, 3).otherwise(1)
    m = g.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct(F.col("sample").cast("int").alias("k"), code.alias("v")))).alias("m"))
    one = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(1))
    byte = lambda b: sum((F.when(F.lit(4 * b + k < n_samples), one(F.lit(4 * b + k))).otherwise(0) * (1 << (2 * k)) for k in range(1, 4)), one(F.lit(4 * b)))
    text = F.concat(*[F.lpad(F.hex(byte(b).cast("long")), 2, "0") for b in range(-(-n_samples // 4))])
    return m.select("site", F.unhex(text).alias("bytes"))


def bim_lines(sites: DataFrame) -> DataFrame:
    """chrom, id, 0, position, alt, ref of sites (site, scaff, pos, loc, loc_pos, ref, alt); only A, C, G, T references."""
    v = F.concat_ws("\t", (F.col("scaff") + 1).cast("string"), marker_id("loc", "loc_pos"), F.lit("0"), (F.col("pos") + 1).cast("string"), F.col("alt"), F.when(F.col("ref").isin(*"ACGT"), F.col("ref")).otherwise(F.raise_error(F.lit("reference base needed"))))
    return _numbered(sites.withColumn("value", v), "site")


def fam_lines(samples: DataFrame) -> DataFrame:
    s = F.col("name")
    return _numbered(samples.withColumn("value", F.concat_ws(" ", s, s, F.lit("0"), F.lit("0"), F.lit("0"), F.lit("-9"))), "sample")


def write_plink(g: DataFrame, sites: DataFrame, samples: DataFrame, prefix: str) -> None:
    """prefix.bed, .bim and .fam; sites in order of their number."""
    n = samples.count()
    with Path(f"{prefix}.bed").open("wb") as f:
        f.write(b"\x6c\x1b\x01")
        for r in plink_rows(g.join(sites.select("site"), "site", "left_semi"), n).orderBy("site").toLocalIterator():
            f.write(bytes(r["bytes"]))
    write_file(bim_lines(sites), f"{prefix}.bim")
    write_file(fam_lines(samples), f"{prefix}.fam")


def matrix_lines(cells: DataFrame, names: list) -> DataFrame:
    """A square matrix of (i, j, d) with i <= j, one line a row."""
    both = cells.select("i", "j", "d").unionByName(cells.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    w = both.groupBy("i").pivot("j", names).agg(F.first("d"))
    return _numbered(w.withColumn("value", F.concat_ws(" ", *[F.format_string("%.8f", F.coalesce(F.col(f"`{n}`"), F.lit(0.0))) for n in names])), "i")


def vcf_lines(calls: DataFrame, names: list[str], source: str = "locusflow") -> DataFrame:
    """A VCF of calls (chrom, pos from 0, ref, alt, qual, sample, gt): PASS sites, GT only."""
    head = f"##fileformat=VCFv4.2\n##source={source}\n##FORMAT=<ID=GT,Number=1,Type=String,Description=\"Genotype\">\n" + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])
    w = calls.groupBy("chrom", "pos", "ref", "alt", "qual").pivot("sample", names).agg(F.first("gt"))
    q = F.when(F.col("qual").isNull() | F.isnan("qual"), ".").otherwise(F.col("qual").cast("string"))
    body = w.select(F.lit(1).alias("o"), "chrom", "pos", F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", "alt", q, F.lit("PASS"), F.lit("."), F.lit("GT"), *[F.coalesce(F.col(f"`{n}`"), F.lit("./.")) for n in names]).alias("value"))
    first = calls.sparkSession.createDataFrame([(0, "", 0, head)], "o int, chrom string, pos long, value string")
    return _numbered(first.unionByName(body), "o", "chrom", "pos")


def loci_lines(seqs: DataFrame, classes: DataFrame) -> DataFrame:
    """.loci blocks: aligned rows of each locus, then a line with - under singletons, * under shared variants and the locus number."""
    name = F.rpad(F.col("sample").cast("string"), 12, " ")
    rows = seqs.select("locus", F.lit(0).alias("o"), F.col("sample").cast("string").alias("s"), F.concat(name, F.lit(" "), F.col("seq")).alias("value"))
    mark = F.when(F.col("kind") == "pis", "*").when(F.col("kind") == "autapomorphy", "-").otherwise(" ")
    foot = classes.groupBy("locus").agg(F.sort_array(F.collect_list(F.struct("pos", mark.alias("m")))).alias("c")).select("locus", F.lit(1).alias("o"), F.lit("").alias("s"), F.concat(F.rpad(F.lit("//"), 12, " "), F.lit(" "), F.array_join(F.transform("c", lambda x: x["m"]), ""), F.lit("|"), F.col("locus").cast("string"), F.lit("|")).alias("value"))
    return _numbered(rows.unionByName(foot), "locus", "o", "s")


def write_table(df: DataFrame, path: str, digits: int = 8) -> None:
    """A headed TSV with rounded doubles."""
    df.select(*[F.format_string(f"%.{digits}f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
