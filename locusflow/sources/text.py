"""Readers of genomics text formats as DataFrames. Big files are split by Spark; only dimension files are read whole."""

from __future__ import annotations

import re
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusflow.functions import genotypes as fg


class FormatError(ValueError):
    """An input file is not what its reader needs."""


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value of text files. Lines are numbered inside each block of a file; a small table of blocks carries the counts on."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    per = t.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = per.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    i = F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1
    return t.withColumn("i", i).join(F.broadcast(before), ["file", "block"]).select("file", (F.col("before") + F.col("i")).alias("line"), "value")


def fastq(spark: SparkSession, path: str, max_reads: int | None = None) -> DataFrame:
    """file, read (number in the file), header, seq, qual of FASTQ files, gzip included. A cut-off last record is left out."""
    q = numbered_lines(spark, path).withColumn("read", F.floor(F.col("line") / 4))
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    r = q.groupBy("file", "read").agg(part(0).alias("header"), part(1).alias("seq"), part(3).alias("qual"), F.count("*").alias("n")).where("n = 4").drop("n")
    return r if max_reads is None else r.where(F.col("read") < max_reads)


def fastq_pairs(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Mates by number in their files: read, seq, qual, seq2, qual2."""
    b = r2.select("read", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    return r1.select("read", "header", "seq", "qual").join(b, "read", "left")


def mate_of(name: str) -> tuple[str, int]:
    """(sample, mate) of a FASTQ file name; mate 0 for single-end. Endings and common suffixes go."""
    stem = re.sub(r"\.(fastq|fq)(\.gz)?$", "", name.rsplit("/", 1)[-1])
    m = re.search(r"[._-]R?([12])(?:_001)?$", stem) or re.search(r"_R([12])_", stem)
    if not m:
        return stem, 0
    return re.sub(r"[._-]+$", "", stem[: m.start()] + (stem[m.end() - 1 :] if m.group(0).endswith("_") else "")), int(m.group(1))


def fasta(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """name, header, seq (upper case) of FASTA files; records are split where a line starts with >."""
    t = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"\A>", "").alias("v")).where("trim(v) != ''")
    header = F.trim(F.regexp_extract("v", r"\A([^\r\n]*)", 1))
    f = t.select(F.regexp_extract(header, r"\A(\S*)", 1).alias("name"), header.alias("header"), F.upper(F.regexp_replace(F.regexp_replace("v", r"\A[^\n]*\n?", ""), r"\s+", "")).alias("seq"))
    return f if only is None else f.where(F.col("name").isin(only))


def locus_database(spark: SparkSession, path: str) -> DataFrame:
    """locus, sample, seq of records headed ``chrom:start-end sample``."""
    return fasta(spark, path).select(F.col("name").alias("locus"), F.regexp_extract("header", r"\s(\S+)\z", 1).alias("sample"), "seq")


def bed(spark: SparkSession, path: str, with_depth: bool = False) -> DataFrame:
    """chrom, start, end, rid[, depth]; comment, track and browser lines are skipped, malformed rows are an error."""
    t = spark.read.text(path).where(~F.col("value").rlike(r"\A(#|track|browser)|\A\s*\z")).select(F.split("value", r"\t").alias("p"))
    num = lambda i: F.when(F.get("p", F.lit(i)).rlike(r"\A\d+\z"), F.get("p", F.lit(i)).cast("long")).otherwise(F.raise_error(F.lit("malformed BED row")).cast("long"))
    b = t.select(F.get("p", F.lit(0)).alias("chrom"), num(1).alias("start"), num(2).alias("end"), *([F.element_at("p", -1).cast("double").alias("depth")] if with_depth else []))
    return b.withColumn("rid", F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))


def fai(spark: SparkSession, path: str) -> DataFrame:
    """idx, chrom, length in reference order."""
    n = numbered_lines(spark, path).where("value != ''").withColumn("p", F.split("value", r"\t"))
    return n.select(F.col("line").alias("idx"), F.get("p", F.lit(0)).alias("chrom"), F.get("p", F.lit(1)).cast("long").alias("length"))


def sam(spark: SparkSession, path: str, exclude: int = 0) -> DataFrame:
    """SAM records without their header: the eleven fields and the optional ones as ``tags``; records with any flag of ``exclude`` go."""
    t = spark.read.text(path).where(~F.startswith("value", F.lit("@"))).select(F.split("value", r"\t").alias("p")).where(F.size("p") >= 11)
    names = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    d = t.select(*[(F.get("p", F.lit(i)).cast("long") if n in ("flag", "pos", "mapq", "pnext", "tlen") else F.get("p", F.lit(i))).alias(n) for i, n in enumerate(names)], F.array_join(F.slice("p", 12, 1 << 20), "\t").alias("tags"))
    return d.where(F.col("flag").bitwiseAND(exclude) == 0)


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length of the @SQ lines."""
    t = spark.read.text(path).where(F.startswith("value", F.lit("@SQ")))
    return t.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    head = spark.read.text(path).where(F.startswith("value", F.lit("#CHROM"))).first()
    if head is None:
        raise FormatError(f"{path} has no #CHROM line")
    return head["value"].split("\t")[9:]


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """site rows: chrom, pos (from 0), ref, alts, qual (NaN if missing), filter, and calls: array of (sample, gt, dp, gq, ad) by each record's own FORMAT."""
    names = vcf_samples(spark, path)
    t = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.col("value") != "")).select(F.split("value", r"\t").alias("p"))
    keys = F.split(F.get("p", F.lit(8)), ":")

    def field(x, key):
        at = F.array_position(keys, key).cast("int")
        return F.when(at > 0, F.get(F.split(x, ":"), at - 1))

    calls = F.zip_with(F.array(*map(F.lit, names)).cast("array<string>"), F.slice("p", 10, max(1, len(names))), lambda s, x: F.struct(s.alias("sample"), F.coalesce(field(x, "GT"), F.lit("./.")).alias("gt"), fg.depth(field(x, "DP")).alias("dp"), field(x, "GQ").try_cast("int").alias("gq"), fg.allele_depths(field(x, "AD")).alias("ad")))
    return t.select(F.get("p", F.lit(0)).alias("chrom"), (F.get("p", F.lit(1)).cast("long") - 1).alias("pos"), F.get("p", F.lit(3)).alias("ref"), F.split(F.get("p", F.lit(4)), ",").alias("alts"), fg.site_quality(F.get("p", F.lit(5))).alias("qual"), F.get("p", F.lit(6)).alias("filter"), calls.alias("calls"))


def vcf_calls(v: DataFrame) -> DataFrame:
    """chrom, pos, ref, alts, qual, filter, sample, gt, dp, gq, ad, a0, a1, base: one row a call; a half-missing call is missing."""
    c = v.select("chrom", "pos", "ref", "alts", "qual", "filter", F.explode("calls").alias("c")).select("*", "c.*").drop("c").withColumn("_g", fg.gt_alleles("gt"))
    letter = lambda a: F.get(F.concat(F.array("ref"), F.col("alts")), F.col(f"_g.{a}"))
    return c.withColumns({"a0": F.col("_g.a0"), "a1": F.col("_g.a1"), "base": fg.genotype_base(letter("a0"), letter("a1"))}).drop("_g")


def _small(spark: SparkSession, path: str) -> list[str]:
    """Lines of a dimension file, in order."""
    return [r["value"] for r in numbered_lines(spark, path).orderBy("file", "line").collect()]


def imap(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """(sample, pop table; minima): two columns a line, # comments, and optionally a line ``# pop:n pop:n`` with the same populations."""
    rows, minima = [], {}
    for x in _small(spark, path):
        if x.startswith("#"):
            if re.fullmatch(r"#\s*(\S+:\d+\s*)+", x):
                minima = {k: int(n) for k, n in (y.rsplit(":", 1) for y in x[1:].split())}
        elif x.split():
            if len(x.split()) != 2:
                raise FormatError(f"not two columns: {x}")
            rows.append(tuple(x.split()))
    pops = {p for _, p in rows}
    if minima and set(minima) != pops:
        raise FormatError("populations and minima differ")
    if len({s for s, _ in rows}) != len(rows):
        raise FormatError("a sample is in two populations")
    return spark.createDataFrame(rows, "sample string, pop string"), minima


def minmap(spark: SparkSession, path: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for x in _small(spark, path):
        if x.split() and not x.startswith("#"):
            k, n = x.split()
            if k in out:
                raise FormatError(f"population {k} twice")
            out[k] = int(n)
    return out


def match_populations(patterns: dict[str, list[str]], samples: list[str]) -> dict[str, list[str]]:
    """Samples of each population by exact name or glob; a sample in two populations is an error."""
    out = {p: [s for s in samples if any(s == x or fnmatchcase(s, x) for x in xs)] for p, xs in patterns.items()}
    seen = [s for xs in out.values() for s in xs]
    if len(seen) != len(set(seen)):
        raise FormatError("a sample is in two populations")
    return out


def barcodes(spark: SparkSession, path: str) -> DataFrame:
    """sample, barcode, barcode2 (null without one); a sample's further lines are technical replicates with a numbered name."""
    rows, seen = [], {}
    for x in _small(spark, path):
        p = x.upper().split()
        if not p:
            continue
        name = x.split()[0]
        if len(p) not in (2, 3) or any(set(b) - set("RKSYWMCATG") for b in p[1:]):
            raise FormatError(f"barcode line: {x}")
        k = seen[name] = seen.get(name, -1) + 1
        rows.append((name, k, p[1], p[2] if len(p) == 3 else None))
    many = {n for n, k in seen.items() if k}
    return spark.createDataFrame([(f"{n}-technical-replicate-{k}" if n in many else n, b, c) for n, k, b, c in rows], "sample string, barcode string, barcode2 string")


def base_name(name: str) -> str:
    return re.sub(r"-technical-replicate-\d+$", "", name)


def sanitize(names: list[str]) -> dict[str, str]:
    """Names with bad characters replaced; two that become one are an error."""
    out = {n: re.sub(r"[^A-Za-z0-9._-]+", "_", n) for n in names}
    if len(set(out.values())) != len(out):
        raise FormatError("sample names collide")
    return out


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """type, cluster, core, size of the S and H rows of a UC file."""
    p = F.split("value", r"\t")
    t = spark.read.text(path).select(p.alias("p")).where(F.get("p", F.lit(0)).isin("S", "H"))
    return t.select(F.get("p", F.lit(0)).alias("type"), F.get("p", F.lit(1)).cast("long").alias("cluster"), F.regexp_extract(F.get("p", F.lit(8)), r"\A([^;]*)", 1).alias("core"), F.coalesce(F.regexp_extract(F.get("p", F.lit(8)), r";size=(\d+)", 1).try_cast("long"), F.lit(1)).alias("size"))


def hits(spark: SparkSession, path: str) -> DataFrame:
    """query, target, pid, qcov (both 0 to 1) of tab-separated search hits in percent."""
    p = F.split("value", r"\t")
    return spark.read.text(path).select(p.alias("p")).where(F.size("p") >= 5).select(F.get("p", F.lit(0)).alias("query"), F.get("p", F.lit(1)).alias("target"), (F.get("p", F.lit(2)).cast("double") / 100).alias("pid"), (F.get("p", F.lit(4)).cast("double") / 100).alias("qcov"))


def table_with(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A headed TSV that must have exactly these columns."""
    t = spark.read.option("sep", "\t").option("header", True).csv(path)
    if t.columns != columns:
        raise FormatError(f"columns {t.columns}, not {columns}")
    return t


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` if it has the columns that a requested filter needs."""
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise FormatError(f"input has no {', '.join(gone)}")
    return df


def with_reference(g: DataFrame, sites: DataFrame, name: str = "reference") -> DataFrame:
    """Genotypes with a synthetic reference sample: dosage 0 at every site."""
    cols = [F.col("site"), F.lit(name).alias("sample"), F.lit(0).cast("long").alias("dosage")]
    return g.select("site", "sample", "dosage").unionByName(sites.select(*cols))


def region(text: str) -> tuple[str, int, int]:
    """(chrom, start, end) of ``chrom:start-end``, 1-based and inclusive."""
    m = re.fullmatch(r"(.+):(\d+)-(\d+)", text)
    if not m or int(m[2]) > int(m[3]):
        raise FormatError(f"region {text}")
    return m[1], int(m[2]), int(m[3])


def select_scaffolds(scaffolds: DataFrame, patterns: list[str] | None) -> DataFrame:
    """Scaffolds whose whole name matches one of the regular expressions, in table order; all without any."""
    if not patterns:
        return scaffolds
    keep = F.lit(False)
    for x in patterns:
        keep = keep | F.col("chrom").rlike(rf"\A(?:{x})\z")
    return scaffolds.where(keep)
