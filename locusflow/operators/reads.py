"""Reads: k-mer counts, barcodes, demultiplexing, dereplication, motif inference. ``reads``: read, seq and what else is carried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prefix_kmers(reads: DataFrame, sizes: tuple[int, ...] = tuple(range(3, 11)), offsets: tuple[int, ...] = (0, 1)) -> DataFrame:
    """offset, k, kmer, n of read prefixes; reads shorter than offset + k do not count."""
    o = F.explode(F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(k).alias("k")) for o in offsets for k in sizes]))
    r = reads.select(F.upper("seq").alias("seq"), o.alias("_o")).select("_o.*", "seq").where(F.length("seq") >= F.col("offset") + F.col("k"))
    return r.groupBy("offset", "k", F.substring("seq", F.col("offset") + 1, F.col("k")).alias("kmer")).agg(F.count("*").alias("n"))


#: Candidates that are sent to every task at most.
SMALL = 500_000


def expand_barcodes(barcodes: DataFrame, mismatches: int = 1, deletion: bool = False) -> DataFrame:
    """sample, barcode, candidate, distance: every string within ``mismatches`` substitutions over A, C, G, T, N, at its least distance;
    with ``deletion`` also the barcode without its first base, at distance 1."""
    out = barcodes.select("sample", "barcode", F.col("barcode").alias("candidate"), F.lit(0).alias("distance"))
    layer = out
    for d in range(1, mismatches + 1):
        b = layer.select("sample", "barcode", "candidate", F.explode(F.sequence(F.lit(1), F.length("candidate"))).alias("i")).withColumn("b", F.explode(F.array(*map(F.lit, "ACGTN"))))
        layer = b.select("sample", "barcode", F.overlay("candidate", "b", F.col("i")).alias("candidate"), F.lit(d).alias("distance")).distinct()
        out = out.unionByName(layer)
    if deletion:
        out = out.unionByName(barcodes.select("sample", "barcode", F.substring("barcode", 2, 1 << 20).alias("candidate"), F.lit(1).alias("distance")))
    return out.groupBy("sample", "barcode", "candidate").agg(F.min("distance").alias("distance"))


def candidate_collisions(candidates: DataFrame) -> DataFrame:
    """candidate, samples: strings within reach of more than one sample's barcode at their least distance."""
    least = candidates.groupBy("candidate").agg(F.min("distance").alias("distance"))
    j = candidates.join(least, ["candidate", "distance"])
    return j.groupBy("candidate").agg(F.count_distinct("sample").alias("samples")).where("samples > 1")


def demultiplex(reads: DataFrame, candidates: DataFrame, cutters: list[str], slack: tuple[int, ...] = (0, 1)) -> DataFrame:
    """``reads`` with sample and status (match, ambiguous, miss): a candidate that starts the read, after up to one base of slack,
    directly followed by a cut motif. A read's best is the least (distance, slack, -length); more than one sample there is ambiguous.

    Each length and slack is one look-up of a string in the table of candidates: no shuffle of the reads where that table (samples times a barcode's
    neighbourhood) is small enough to be sent to every task. Repeated read ids are reads of their own.
    """
    at_least = candidates.groupBy("candidate", "distance").agg(F.min("sample").alias("sample"), F.count_distinct("sample").alias("n"))
    near = at_least.groupBy("candidate").agg(F.min(F.struct("distance", "sample", "n")).alias("near"), F.length("candidate").alias("len"))
    sizes = near.groupBy("len").agg(F.count("*").alias("c")).orderBy("len").collect()  # a handful of barcode lengths
    near = near.select("candidate", "near")
    if sum(r.c for r in sizes) <= SMALL:
        near = F.broadcast(near)
    reach = max(slack, default=0) + max((r.len for r in sizes), default=0) + max(map(len, cutters), default=0)  # no look-up sees more of a read
    out, ranks = reads.withColumn("_seq", F.upper(F.substring("seq", 1, reach))), []
    for n in (r.len for r in sizes):
        for s in slack:
            rest, cut = F.substring("_seq", s + n + 1, 64), F.lit(False)
            for c in cutters:
                cut = cut | F.startswith(rest, F.lit(c))
            name = f"_near{len(ranks)}"
            found = near.select(F.col("candidate").alias("_candidate"), F.col("near").alias(name))
            out = out.withColumn("_key", F.when(cut, F.substring("_seq", s + 1, n))).join(found, F.col("_key") == F.col("_candidate"), "left").drop("_key", "_candidate")
            ranks.append(F.when(F.col(name).isNotNull(), F.struct(F.col(f"{name}.distance").alias("d"), F.lit(s).alias("s"), F.lit(-n).alias("l"), F.col(f"{name}.sample").alias("sample"), F.col(f"{name}.n").alias("n"))))
    if not ranks:
        return reads.withColumns({"sample": F.lit(None).cast("string"), "status": F.lit("miss")})
    out = out.withColumn("_best", F.array_min(F.array(*ranks)))
    status = F.when(F.col("_best.n") == 1, "match").when(F.col("_best.n") > 1, "ambiguous").otherwise("miss")
    return out.select(*reads.columns, F.when(F.col("_best.n") == 1, F.col("_best.sample")).alias("sample"), status.alias("status"))


def demultiplex_pairs(r1: DataFrame, r2: DataFrame, combos: DataFrame) -> DataFrame:
    """read, sample of combinatorial barcodes: both mates' barcode (read, barcode) looked up as a pair (barcode1, barcode2, sample)."""
    j = r1.select("read", F.col("barcode").alias("barcode1")).join(r2.select("read", F.col("barcode").alias("barcode2")), "read")
    hit = j.join(F.broadcast(combos), ["barcode1", "barcode2"]).groupBy("read").agg(F.min("sample").alias("sample"), F.count_distinct("sample").alias("n"))
    return r1.select("read").distinct().join(hit, "read", "left").select("read", F.when(F.col("n") == 1, F.col("sample")).alias("sample"), F.when(F.col("n") == 1, "match").when(F.col("n") > 1, "ambiguous").otherwise("miss").alias("status"))


def demux_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("status", "sample").agg(F.count("*").alias("reads"))


def suspected_barcodes(assigned: DataFrame, length: int, share: float = 1e-4, least: int = 50, top: int = 25) -> DataFrame:
    """barcode, reads: the commonest prefixes of reads that matched nothing, with at least max(least, share * reads). Exact counts instead of a bounded sketch."""
    n = F.broadcast(assigned.agg(F.count("*").alias("all")))
    c = assigned.where("status = 'miss'").groupBy(F.substring(F.upper("seq"), 1, length).alias("barcode")).agg(F.count("*").alias("reads"))
    return c.join(n).where(F.col("reads") >= F.greatest(F.lit(least), F.col("all") * share)).orderBy(F.desc("reads"), "barcode").limit(top).drop("all")


def dereplicate(reads: DataFrame, least: int = 1) -> DataFrame:
    """seq, size, first read of identical sequences seen ``least`` times or more."""
    return reads.groupBy(F.upper("seq").alias("seq")).agg(F.count("*").alias("size"), F.min("read").alias("read")).where(F.col("size") >= least)


def infer_motifs(kmers: DataFrame, offset: int = 0, seed_k: int = 3) -> list[str]:
    """Restriction overhangs from prefix k-mer counts: each k-mer of ``seed_k`` with at least a tenth of the commonest grows while a child
    keeps three fourths of it; it splits into at most three children that together start from one half. Driver-side over the few
    strong k-mers only: counts are filtered in the plan."""
    top = kmers.where((F.col("offset") == offset) & (F.col("k") == seed_k)).agg(F.max("n")).first()[0] or 0
    if not top:
        return []
    strong = {r["kmer"]: r["n"] for r in kmers.where((F.col("offset") == offset) & (F.col("n") * 10 >= top)).collect()}  # at most 10 a size
    out = []

    def grow(s: str):
        kids = sorted(((strong.get(s + b, 0), s + b) for b in "ACGT"), reverse=True)
        best = kids[0][0]
        if best >= 0.75 * strong[s]:
            grow(kids[0][1])
        elif best >= 0.5 * strong[s] and sum(n > 0 for n, _ in kids) <= 3:
            for n, k in kids:
                if n * 10 >= top:
                    grow(k)
        else:
            out.append(s)

    for s in sorted(k for k in strong if len(k) == seed_k):
        grow(s)
    return sorted(x for x in set(out) if not any(x != y and y.startswith(x) for y in out))


def trim_reads(reads: DataFrame, start: int) -> DataFrame:
    """seq and qual from ``start`` on."""
    return reads.withColumns({c: F.substring(c, start + 1, 1 << 30) for c in ("seq", "qual") if c in reads.columns})


def one_each(reads: DataFrame, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return reads.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
