"""Interval algebra on half-open (chrom, start, end) tables.

Range joins cut each interval into bins and join on (chrom, bin); a pair is reported only in the first bin that both
share, so nothing is reported twice and no distinct is needed. Chains (merges, coverage) are running sums over events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BIN = 1024
#: Bases of a scaffold whose runs one task forms.
TILE = 1 << 20


def _binned(df: DataFrame, width: int) -> DataFrame:
    last = F.greatest(F.col("end") - 1, F.col("start"))
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))))


def range_join(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Overlapping pairs of ``left`` (chrom, start, end, ...) and ``right`` (chrom, rstart, rend, ...). Empty intervals overlap nothing."""
    r = right.withColumnsRenamed({"rstart": "start", "rend": "end"})
    r = _binned(r, width).withColumnsRenamed({"start": "rstart", "end": "rend"})
    j = _binned(left, width).join(r, ["chrom", "_bin"])
    first = F.floor(F.greatest("start", "rstart") / width)
    return j.where((F.col("start") < F.col("rend")) & (F.col("rstart") < F.col("end")) & (F.col("_bin") == first)).drop("_bin")


def _hit(left: DataFrame, right: DataFrame, how: str, width: int) -> DataFrame:
    """Semi or anti join on overlap, by the keys of the overlapping rows; equal rows of ``left`` share their fate."""
    keys = ["chrom", "start", "end"]
    hits = range_join(left.select(*keys).distinct(), right.select("chrom", F.col("start").alias("rstart"), F.col("end").alias("rend")), width).select(*keys).distinct()
    return left.join(hits, keys, how)


def semi_join(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    return _hit(left, right, "left_semi", width)


def anti_join(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    return _hit(left, right, "left_anti", width)


def clip(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """The overlaps themselves, with the columns of both sides."""
    j = range_join(left, right, width)
    return j.withColumns({"start": F.greatest("start", "rstart"), "end": F.least("end", "rend")}).drop("rstart", "rend")


def point_in_interval(points: DataFrame, intervals: DataFrame, strict: bool = False, width: int = BIN) -> DataFrame:
    """Points (chrom, pos, ...) with the interval (istart, iend, ...) that holds them; others are dropped, or an error with ``strict``."""
    i = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("istart") / width), F.floor((F.col("iend") - 1) / width))))
    p = points.withColumn("_bin", F.floor(F.col("pos") / width))
    j = p.join(i, ["chrom", "_bin"], "left" if strict else "inner")
    inside = (F.col("pos") >= F.col("istart")) & (F.col("pos") < F.col("iend"))
    if strict:
        # a point's bin may hold other intervals than its own, so a point is outside only if none of them covers it
        w = Window.partitionBy(*points.columns)
        j = j.withColumn("_ok", F.max(F.coalesce(inside, F.lit(False))).over(w))
        j = j.where(F.coalesce(inside, F.lit(False)) | F.when(~F.col("_ok"), F.raise_error(F.lit("point outside all intervals"))).cast("boolean")).drop("_ok")
        return j.drop("_bin")
    return j.where(inside).drop("_bin")


def _islands(df: DataFrame, distance: int, strict: bool, by: tuple[str, ...], value: str, agg: Callable[[str], Column]) -> DataFrame:
    """Islands by, _isle (from 1), start, end and ``value`` over their rows; equal rows keep apart where they do not overlap."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) + distance
    new = F.when((F.col("start") >= reach) if strict else (F.col("start") > reach), 1).when(reach.isNull(), 1).otherwise(0)
    isle = df.withColumn("_new", new).withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isle.groupBy(*by, "_isle").agg(F.min("start").alias("start"), F.max("end").alias("end"), agg(value).alias(value))


def _tiled(df: DataFrame, distance: int, strict: bool, by: tuple[str, ...], tile: int, value: str, agg: Callable[[str], Column]) -> DataFrame:
    """Islands by, start, end and ``value`` of rows (by, start, end, value).

    They are formed inside tiles of the scaffold, in separate tasks. A table of tiles carries across how far the tiles before reach
    and which island is the last there; the islands of a tile that begin within that reach are the first of it and belong to that island.
    """
    isles = _islands(df.withColumn("_tile", F.floor(F.col("start") / tile)), distance, strict, (*by, "_tile"), value, agg)
    w = Window.partitionBy(*by).orderBy("_tile")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    tiles = isles.groupBy(*by, "_tile").agg(F.max("end").alias("_end"), F.max("start").alias("_start"), F.max("_isle").alias("_last"))
    tiles = tiles.withColumn("_reach", F.max("_end").over(past) + distance)
    joins = lambda c: F.coalesce((F.col(c) < F.col("_reach")) if strict else (F.col(c) <= F.col("_reach")), F.lit(False))
    tiles = tiles.withColumn("_key", F.last(F.when(~joins("_start"), F.struct("_tile", "_last")), ignorenulls=True).over(past))
    names = [f"_k{i}" for i in range(len(by))]
    tiles = tiles.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("_tile").alias("_t"), "_reach", "_key")
    same = F.col("_tile").eqNullSafe(F.col("_t"))
    for c, n in zip(by, names, strict=True):
        same &= F.col(c).eqNullSafe(F.col(n))
    own = F.struct("_tile", F.col("_isle").alias("_last"))
    j = isles.join(tiles, same).select(*by, F.when(joins("start"), F.col("_key")).otherwise(own).alias("_key"), "start", "end", value)
    return j.groupBy(*by, "_key").agg(F.min("start").alias("start"), F.max("end").alias("end"), agg(value).alias(value)).drop("_key")


def merge(df: DataFrame, distance: int = 0, strict: bool = False, by: tuple[str, ...] = ("chrom",), tile: int = TILE) -> DataFrame:
    """Islands of intervals within ``distance`` of each other (book-ended ones join, unless ``strict``): by, start, end, n.

    No task passes over more than a tile of a scaffold, or its table of tiles.
    """
    return _tiled(df.select(*by, "start", "end", F.lit(1).cast("long").alias("n")), distance, strict, by, tile, "n", F.sum)


def indel_clusters(df: DataFrame, least: int = 2) -> DataFrame:
    """Clusters of strictly overlapping indels with ``least`` records or more."""
    return merge(df, strict=True).where(F.col("n") >= least)


def _running(per: DataFrame, by: tuple[str, ...], sums: dict[str, str], tile: int = TILE) -> DataFrame:
    """Rows (by, pos, deltas) as runs by, start, end and the running sum of each delta.

    Sums run inside tiles of the scaffold; a small table of tiles carries the sums and the next position across.
    """
    t = per.withColumn("_tile", F.floor(F.col("pos") / tile))
    w = Window.partitionBy(*by).orderBy("_tile")
    tiles = t.groupBy(*by, "_tile").agg(F.min("pos").alias("_first"), *[F.sum(d).alias(f"_{d}") for d in sums])
    tiles = tiles.select(*by, "_tile", F.lead("_first").over(w).alias("_next"), *[(F.sum(f"_{d}").over(w) - F.col(f"_{d}")).alias(f"_{d}") for d in sums])
    v = Window.partitionBy(*by, "_tile").orderBy("pos")
    t = t.join(tiles, [*by, "_tile"])
    return t.select(*by, F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(v), F.col("_next")).alias("end"), *[(F.col(f"_{d}") + F.sum(d).over(v)).alias(n) for d, n in sums.items()]).where(F.col("end").isNotNull())


def _events(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    df = df.where("start < end")
    return df.select(*by, F.col("start").alias("pos"), F.lit(1).alias("delta")).unionByName(df.select(*by, F.col("end").alias("pos"), F.lit(-1).alias("delta")))


def coverage(df: DataFrame, least: int = 1, by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Bedgraph runs with depth: by, start, end, depth (``least`` or more). Ends at which nothing changes do not cut a run."""
    e = _events(df, by).groupBy(*by, "pos").agg(F.sum("delta").alias("delta")).where("delta != 0")
    return _running(e, by, {"delta": "depth"}).where(F.col("depth") >= least)


def multi_intersect(df: DataFrame, samples: int, distance: int = 0, length: int = 1) -> DataFrame:
    """Loci that ``samples`` distinct samples or more cover: segments within ``distance`` are joined with the least count, then those shorter than ``length`` go."""
    one = merge(df, by=("sample", "chrom"))
    seg = coverage(one, samples).withColumnRenamed("depth", "n_samples")
    out = _tiled(seg, distance, False, ("chrom",), TILE, "n_samples", F.min)
    return out.where(F.col("end") - F.col("start") >= length)


def subtract(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Parts of the union of ``a`` that ``b`` does not cover."""
    ev = _events(a, by).withColumn("which", F.lit(0)).unionByName(_events(b, by).withColumn("which", F.lit(1)))
    per = ev.groupBy(*by, "pos").agg(F.sum(F.when(F.col("which") == 0, F.col("delta")).otherwise(0)).alias("da"), F.sum(F.when(F.col("which") == 1, F.col("delta")).otherwise(0)).alias("db"))
    seg = _running(per, by, {"da": "na", "db": "nb"}).select(*by, "start", "end", (F.col("na") > 0).alias("in_a"), (F.col("nb") > 0).alias("in_b"))
    return merge(seg.where("in_a and not in_b"), by=by).drop("n")


def union(*dfs: DataFrame) -> DataFrame:
    """Merged union of several interval tables."""
    out = dfs[0].select("chrom", "start", "end")
    for d in dfs[1:]:
        out = out.unionByName(d.select("chrom", "start", "end"))
    return merge(out).drop("n")


def pad(df: DataFrame, bases: int = 10) -> DataFrame:
    """Widened by ``bases`` on either side, not below 0."""
    return df.withColumns({"start": F.greatest(F.col("start") - bases, F.lit(0)), "end": F.col("end") + bases})


def depth_in_loci(loci: DataFrame, cov: DataFrame, width: int = BIN) -> DataFrame:
    """Mean depth of each locus (chrom, start, end) from a bedgraph (chrom, start, end, depth); loci without depth have 0."""
    keys = ["chrom", "start", "end"]
    j = range_join(loci.select(*keys), cov.select("chrom", F.col("start").alias("rstart"), F.col("end").alias("rend"), "depth"), width)
    s = j.groupBy(*keys).agg(F.sum((F.least("end", "rend") - F.greatest("start", "rstart")) * F.col("depth")).alias("bases"))
    return loci.join(s, keys, "left").withColumn("mean_depth", F.coalesce("bases", F.lit(0)) / (F.col("end") - F.col("start"))).drop("bases")


def low_depth_mask(loci: DataFrame, cov: DataFrame, least: int) -> DataFrame:
    """Parts of loci with less depth than ``least``."""
    return subtract(loci, cov.where(F.col("depth") >= least))


def sort_by_reference(df: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """Ordered by scaffold index, then start. ``scaffolds``: idx, chrom."""
    return df.join(scaffolds.select("chrom", "idx"), "chrom").orderBy("idx", "start", "end").drop("idx")


def callable_runs(seqs: DataFrame, by: str = "chrom") -> DataFrame:
    """Maximal runs of A, C, G, T of each sequence (by, start0, seq): by, start, end."""
    s = F.upper("seq")
    parts = F.regexp_extract_all(s, F.lit("([ACGT]+|[^ACGT]+)"), F.lit(1))
    e = seqs.select(by, "start0", F.posexplode(parts).alias("i", "run"))
    w = Window.partitionBy(by, "start0").orderBy("i")
    end = F.sum(F.length("run")).over(w)
    return e.select(by, (F.col("start0") + end - F.length("run")).alias("start"), (F.col("start0") + end).alias("end"), "run").where(F.col("run").rlike(r"\A[ACGT]")).drop("run")


def windows(scaffolds: DataFrame, size: int, step: int) -> DataFrame:
    """Sliding windows of each scaffold (chrom, length): chrom, window, wstart, wend; the last ones are cut at the end."""
    return scaffolds.withColumn("window", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("length") / step).cast("int") - 1)))).select("chrom", "window", (F.col("window") * step).alias("wstart"), F.least(F.col("window") * step + size, F.col("length")).alias("wend")).where("wstart < wend")


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
