"""Deterministic genomics-shaped views of the star-schema tables, in the DataFrame API and, for the oracle, as DuckDB SQL.

Only integer arithmetic that both engines compute alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.session import table

SAMPLES = 12


def geno(spark: SparkSession, sf: str) -> DataFrame:
    """site, sample, dosage, dp, scaff, pos, loc."""
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % SAMPLES).alias("sample"), F.col("l_partkey").alias("site"), (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_suppkey") * 3).alias("v"))
    g = li.groupBy("site", "sample").agg((F.sum("v") % 4).alias("d"), F.count("*").alias("dp"))
    return g.select("site", "sample", F.when(F.col("d") < 3, F.col("d")).alias("dosage"), "dp", (F.col("site") % 5).alias("scaff"), F.col("site").alias("pos"), F.floor(F.col("site") / 10).alias("loc"))


GENO = f"""
    g AS (
        SELECT site, sample, CASE WHEN d < 3 THEN d END AS dosage, dp, site % 5 AS scaff, site AS pos, site // 10 AS loc
        FROM (
            SELECT l_partkey AS site, l_suppkey % {SAMPLES} AS sample, CAST(SUM(l_orderkey * 7 + l_linenumber * 13 + l_suppkey * 3) % 4 AS BIGINT) AS d, COUNT(*) AS dp
            FROM lineitem GROUP BY 1, 2
        )
    )"""


def samples(spark: SparkSession) -> DataFrame:
    return spark.range(SAMPLES).select(F.col("id").alias("sample"))


def imap(spark: SparkSession) -> DataFrame:
    return spark.range(SAMPLES).select(F.col("id").alias("sample"), F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("pop"))


IMAP = f"imap AS (SELECT i AS sample, 'p' || CAST(i % 3 AS VARCHAR) AS pop FROM range({SAMPLES}) t(i))"


def labels(spark: SparkSession) -> DataFrame:
    return spark.range(SAMPLES).select(F.col("id").alias("sample"), F.element_at(F.array(*map(F.lit, "abco")), (F.col("id") % 4 + 1).cast("int")).alias("label"))


def sites(spark: SparkSession, sf: str) -> DataFrame:
    return geno(spark, sf).select("site", "scaff", "pos", "loc").distinct()


def ivl(spark: SparkSession, sf: str) -> DataFrame:
    """sample, chrom, start, end: an interval of each line, on scaffolds that grow with the table."""
    li = table(spark, sf, "lineitem")
    start = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return li.select((F.col("l_suppkey") % 4).alias("sample"), (F.col("l_partkey") % 5).alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


IVL = """ivl AS (
        SELECT l_suppkey % 4 AS sample, l_partkey % 5 AS chrom, l_orderkey * 10 + l_linenumber AS "start", l_orderkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT) AS "end"
        FROM lineitem
    )"""


def loci(spark: SparkSession, sf: str) -> DataFrame:
    """chrom, start, end of disjoint 30-base loci every 50 bases, one an order."""
    start = F.floor(F.col("o_orderkey") / 5) * 50
    return table(spark, sf, "orders").select((F.col("o_orderkey") % 5).alias("chrom"), start.alias("start"), (start + 30).alias("end"))


LOCI = """loci AS (SELECT o_orderkey % 5 AS chrom, o_orderkey // 5 * 50 AS "start", o_orderkey // 5 * 50 + 30 AS "end" FROM orders)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst, pid: each line of a part is linked to the part's next line."""
    li = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("src"))
    e = li.withColumn("dst", F.lead("src").over(Window.partitionBy("l_partkey").orderBy("src"))).where("dst is not null and src < dst")
    return e.select("src", "dst", ((F.col("src") * 31 + F.col("dst") * 17 + F.col("l_partkey")) % 100 / 100).alias("pid"))


EDGES = """edges AS (
        SELECT src, dst, (src * 31 + dst * 17 + l_partkey) % 100 / 100.0 AS pid
        FROM (SELECT l_partkey, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS src, lead(l_orderkey * 10000000 + l_partkey * 10 + l_linenumber) OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10000000 + l_partkey * 10 + l_linenumber) AS dst FROM lineitem)
        WHERE dst IS NOT NULL AND src < dst
    )"""


def seqs(spark: SparkSession, sf: str) -> DataFrame:
    """read, seq: the A, C, G, T of each document."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("read"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


SEQS = "seqs AS (SELECT doc_id AS read, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"


def reads(spark: SparkSession, sf: str) -> DataFrame:
    return seqs(spark, sf)


READS = SEQS + ", reads AS (SELECT read, seq FROM seqs)"

#: What the letters of the synthetic alignment stand for: bases, heterozygotes, missing and gap.
LETTERS = "ACGTACGTACGTRYN-"


def alignment(spark: SparkSession, sf: str) -> DataFrame:
    """locus, sample, seq of 40 columns: six orders are a locus, so loci grow with the table."""
    one = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 6).alias("locus"), (F.col("o_orderkey") % 6).alias("sample"), F.col("o_orderkey").alias("k"))
    v = lambda i: ((F.col("k") % 7 == 0).cast("int") * 7 * i + i * 5 + F.col("locus") * 3 + F.when((F.col("k") + i) % 9 == 0, F.col("sample") * 3).otherwise(0)) % 16
    chars = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.substr(F.lit(LETTERS), (v(i) + 1).cast("int"), F.lit(1)))
    return one.select("locus", "sample", F.array_join(chars, "").alias("seq"))


ALIGNMENT = f"""one AS (
        SELECT o_orderkey // 6 AS locus, o_orderkey % 6 AS sample, o_orderkey AS k FROM orders
    ),
    cells AS (
        SELECT locus, sample, CAST(i AS INTEGER) AS pos,
               substr('{LETTERS}', CAST((CASE WHEN k % 7 = 0 THEN 7 * i ELSE 0 END + i * 5 + locus * 3 + CASE WHEN (k + i) % 9 = 0 THEN sample * 3 ELSE 0 END) % 16 + 1 AS BIGINT), 1) AS raw
        FROM one, range(40) t(i)
    ),
    sites AS (SELECT locus, sample, pos, replace(raw, '-', 'N') AS base FROM cells),
    aln AS (SELECT locus, sample, string_agg(raw, '' ORDER BY pos) AS seq FROM cells GROUP BY 1, 2)"""


def sam(spark: SparkSession, sf: str) -> DataFrame:
    """SAM-shaped rows."""
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("long")
    return li.select(
        F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("qname"), F.when(F.col("l_linenumber") % 2 == 0, 16).otherwise(0).alias("flag"), (F.col("l_partkey") % 5).alias("rname"), (F.col("l_suppkey") % 50).alias("pos"),
        (F.col("l_partkey") % 61).alias("mapq"), F.concat(q.cast("string"), F.lit("M"), (F.col("l_linenumber") * 6).cast("string"), F.lit("S")).alias("cigar"), F.concat(F.lit("AS:i:5\tNM:i:"), (F.col("l_orderkey") % 70).cast("string")).alias("tags"), (F.col("l_orderkey") * F.col("l_linenumber") % 3000 - 1500).alias("tlen"),
    )


SAM = """sam AS (
        SELECT 'q' || CAST(l_orderkey AS VARCHAR) AS qname, CASE WHEN l_linenumber % 2 = 0 THEN 16 ELSE 0 END AS flag, l_partkey % 5 AS rname, l_suppkey % 50 AS pos,
               l_partkey % 61 AS mapq, CAST(l_linenumber * 6 AS BIGINT) AS clip, l_orderkey % 70 AS nm, l_orderkey * l_linenumber % 3000 - 1500 AS tlen
        FROM lineitem
    )"""


def paralog_sites(spark: SparkSession, sf: str) -> DataFrame:
    """sample, rid, dp, ad, het."""
    li = table(spark, sf, "lineitem")
    a0, a1, a2 = F.col("l_orderkey") % 20, F.col("l_partkey") % 15, F.when(F.col("l_suppkey") % 17 == 0, 5).otherwise(F.col("l_suppkey") % 2)
    return li.select((F.col("l_suppkey") % SAMPLES).alias("sample"), (F.col("l_partkey") % 97).alias("rid"), (a0 + a1 + a2).alias("dp"), F.array(a0, a1, a2.cast("long")).alias("ad"), (F.col("l_orderkey") % 3 == 0).alias("het"))


PARALOG = f"""ps AS (
        SELECT sample, rid, a0 + a1 + a2 AS dp, list_reverse_sort([a0, a1, a2]) AS ad, het FROM (
            SELECT l_suppkey % {SAMPLES} AS sample, l_partkey % 97 AS rid, l_orderkey % 20 AS a0, l_partkey % 15 AS a1, CASE WHEN l_suppkey % 17 = 0 THEN 5 ELSE l_suppkey % 2 END AS a2, l_orderkey % 3 = 0 AS het FROM lineitem
        )
    )"""
