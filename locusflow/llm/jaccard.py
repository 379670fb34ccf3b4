"""Near-duplicates by SimHash and by tiled exact comparison of shingle sets.

First the SimHash fingerprints of the sets are compared by exclusive-or and bit counts, in tiles of buckets that lose no pair within
three bits; what they link is verified on whole sets. Fingerprints further apart rule nothing out, so the rest is found exactly:

Sets are ordered by one global order, shingles common in a sample last, and a pair of similarity ``least`` or more
shares a shingle among the first n - ceil(least * n) + 1 of each, so only rows that share such a token are compared. Two
sets differ in at least as many shingles as their 512 parity bits do: within a token, tiles of these bits are compared with
numpy exclusive-or and bit counts under the radius that the set sizes allow, tile pairs whose population counts differ beyond it
are skipped, and what is left is verified on whole sets. None of these steps rules out a similar pair, whatever the order.

Besides the pairs of near fingerprints, the members of a token meet its leader, the set with the most common shingles; then each token's components
meet along a forest of their likeliest pairs; at last every pair that is still of two components and not ruled out is verified.
So a group of near copies costs about its size. Tokens of more than a tile of rows are split by set size and a hash into
tiles that are compared pair by pair in separate tasks. Only the speed depends on the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.llm.common import arrow_map, utf8
from locusflow.llm.simhash import hashes, near_links, simhash
from locusflow.operators.components import connected_components
from locusflow.session import cut, prepare, release, tidy

WORDS, LEAST = 5, Fraction(4, 5)
#: Bits in which linked fingerprints differ at most.
RADIUS = 3
#: Documents sampled to learn which shingles are common, rows of them that make a shingle common, and how many are kept.
SAMPLE, COMMON, MOST = 4000, 4, 50_000
#: Rows of a token that one task holds, and rows of a tile that is compared at once.
TILE, EDGE = 8192, 512
#: Links of so few pairs, 4 MB, are joined to components in one task; more of them in rounds.
FEW = 1 << 18


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, and without a word there is none."""
    return np.unique(hashes(raw, words).view(np.int64))


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that are common in a sample of the texts, and their counts there."""
    part = min(1.0, SAMPLE / max(texts.count(), 1))
    some = texts.where(F.pmod("h", F.lit(1 << 20)) < round(part * (1 << 20))).dropDuplicates(["h"])

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"s": pa.array(np.concatenate([shingles(x, words) for x in b.column("raw").to_pylist()]), pa.int64())})

    rows = arrow_map(some.select("raw"), f, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "s").limit(MOST).collect()
    got = np.array(sorted((r.s, r.n) for r in rows), np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def ordered(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: Fraction) -> tuple[np.ndarray, int, int]:
    """The first n - ceil(least * n) + 1 shingles, the common ones last; how many of them are not common; the mean count of all shingles in the sample, in thousandths."""
    weight, n = np.zeros(len(s), np.int64), len(s)
    if not n:
        return s, 0, 0
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
        weight = np.where(common[0][at] == s, common[1][at], 0)
    first = np.lexsort((s, weight))[: n - -(-n * least.numerator // least.denominator) + 1]
    return s[first], int((weight[first] == 0).sum()), int(weight.sum()) * 1000 // n


def parity(s: np.ndarray) -> bytes:
    """Of each of 512 classes of shingles whether the set holds an odd number: two sets differ in at least as many shingles as these bits."""
    return np.packbits((np.bincount(s & 511, minlength=512) & 1).astype(np.uint8)).tobytes()


def fine_parity(s: np.ndarray) -> bytes:
    """``parity`` over at least four classes a shingle (a power of two): 16 times smaller than the set, and nearly as telling."""
    k = max(9, min(20, (4 * len(s)).bit_length()))
    return np.packbits((np.bincount(s & ((1 << k) - 1), minlength=1 << k) & 1).astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two fine parities differ, the longer folded to the shorter's classes."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


#: Words of the filter by which texts are looked up without a shuffle: at most 2^21, 16 MB; beyond some 10^8 texts it lets more through.
FILTER = 1 << 21


def _filter(keys: DataFrame) -> np.ndarray:
    """Bloom filter of a column h of hashes: two bits a key."""
    size = 1 << max(10, min(FILTER.bit_length() - 1, (keys.count() // 4).bit_length()))
    at = lambda by, up: F.struct(F.shiftrightunsigned("h", by).bitwiseAND(F.lit(size - 1)).alias("word"), F.shiftrightunsigned("h", up).bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = keys.select(F.explode(F.array(at(0, 40), at(22, 46))).alias("p")).select("p.word", F.expr("shiftleft(1L, p.bit)").alias("m")).groupBy("word").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows["word"].to_numpy()] = rows["m"].to_numpy()
    return out.view(np.uint64)


def _held(h: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold; never false of one that it does."""
    u, mask = h.view(np.uint64), np.uint64(len(bloom) - 1)
    bit = lambda by, up: bloom[(u >> np.uint64(by)) & mask] >> ((u >> np.uint64(up)) & np.uint64(63)) & np.uint64(1)
    return (bit(0, 40) & bit(22, 46)) == 1


def _enough(n1, p1, n2, p2, least: Fraction):
    """Whether two sets, of n1 and n2 shingles, that first meet at positions p1 and p2 can still reach ``least``. Columns or numpy."""
    a, b = least.numerator, least.denominator
    size = (n1 * b >= n2 * a) & (n2 * b >= n1 * a)
    return size & ((n1 - p1) * (a + b) >= (n1 + n2) * a) & ((n2 - p2) * (a + b) >= (n1 + n2) * a)


def tile_pairs(n, pos, comp, bits, side, least: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, positions, share of bits that differ) of the pairs of different components that are not ruled out, tile by tile.

    ``bits``: 512 parity bits as eight uint64; ``side``: 2 meets all, 0 only meets 1.
    """
    up, down = least.numerator, least.denominator
    pop = np.bitwise_count(bits).sum(1, dtype=np.int64)
    both = bool((side == 2).any())
    x = np.arange(len(n)) if both else np.flatnonzero(side == 0)
    y = x if both else np.flatnonzero(side == 1)
    x, y = x[np.lexsort((pop[x], n[x]))], y[np.lexsort((pop[y], n[y]))]
    for i in range(0, len(x), EDGE):
        xi = x[i : i + EDGE]
        for j in range(i if both else 0, len(y), EDGE):
            yj = y[j : j + EDGE]
            radius = (n[xi[-1]] + n[yj[-1]]) * (down - up) // (down + up)  # rows are in order of n
            if n[yj[0]] * up > n[xi[-1]] * down or n[xi[0]] * up > n[yj[-1]] * down or pop[yj].min() - pop[xi].max() > radius or pop[xi].min() - pop[yj].max() > radius:
                continue
            u, v = np.nonzero(_enough(n[xi][:, None], pos[xi][:, None], n[yj][None], pos[yj][None], least) & (comp[xi][:, None] != comp[yj][None]))
            if both and i == j:
                u, v = u[u < v], v[u < v]
            u, v = xi[u], yj[v]
            differ = np.zeros(len(u), np.int64)
            for k in range(bits.shape[1]):
                differ += np.bitwise_count(bits[u, k] ^ bits[v, k])
            near = differ * (down + up) <= (n[u] + n[v]) * (down - up)
            if near.any():
                yield u[near], v[near], differ[near] / (n[u] + n[v])[near]


def _forest(comp, u, v, far) -> np.ndarray:
    """Which pairs, nearest first, are the first to connect two components."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for e in np.lexsort((v, u, far)).tolist():
        a, b = find(int(comp[u[e]])), find(int(comp[v[e]]))
        if a != b:
            root[a] = b
            kept.append(e)
    return np.array(kept, np.int64)


def _cross(least: Fraction, forest: bool):
    """Streams rows sorted by token and tile: pairs (src, dst) of different components, along a forest of each tile or all. Where a forest leaves pairs out, a row holds the token alone."""
    names = ("token", "tile", "sig", "n", "pos", "comp", "side")

    def of(run) -> Iterator[np.ndarray]:
        token, _, sig, n, pos, comp, side, bits = run
        if len(sig) < 2:
            return
        held, total = [], 0
        for u, v, far in tile_pairs(n, pos, comp, bits, side, least):
            if not forest:
                yield np.stack([np.minimum(sig[u], sig[v]), np.maximum(sig[u], sig[v])], 1)
                continue
            k = _forest(comp, u, v, far)
            held.append((u[k], v[k], far[k]))
            total += len(u)
        if held:
            u, v, far = (np.concatenate(x) for x in zip(*held, strict=True))
            k = _forest(comp, u, v, far)
            yield np.stack([np.minimum(sig[u], sig[v]), np.maximum(sig[u], sig[v])], 1)[k]
            if total > len(k):
                left.append(int(token[0]))

    left: list[int] = []

    def batch_of(out):
        e = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
        tokens, none = list(left), [None] * len(left)
        left.clear()
        return pa.record_batch({"src": pa.array([*e[:, 0].tolist(), *none], pa.int64()), "dst": pa.array([*e[:, 1].tolist(), *none], pa.int64()), "token": pa.array([None] * len(e) + tokens, pa.int64())})

    def whole(rows) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
        out, m = [], 0
        for lo, hi in zip(starts, np.r_[starts[1:], len(rows[0])], strict=True):
            for p in of([x[lo:hi] for x in rows]):
                out.append(p)
                m += len(p)
                if m > 1 << 16:
                    yield batch_of(out)
                    out, m = [], 0
        if out or left:
            yield batch_of(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names] + [np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, 8)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            ends = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))  # the rows of the last tile may go on
            last = int(ends[-1]) + 1 if len(ends) else 0
            if last:
                yield from whole([x[:last] for x in held])
                held = [x[last:] for x in held]
        if held is not None:
            yield from whole(held)

    return run


def _tiled(rows: DataFrame, tile: int, least: Fraction) -> DataFrame:
    """rows (token, sig, pos, comp, n, bits, many) with tile and side: tokens of at most ``tile`` rows are one tile; others are cut by size class (classes
    more than one apart cannot be similar) and a hash, and each pair of their tiles is a tile of its own."""
    small = rows.where(F.col("many") <= tile).withColumns({"tile": F.lit(0).cast("long"), "side": F.lit(2).cast("long")}).drop("many")
    band = F.floor(F.ln(F.greatest(F.col("n"), F.lit(1)).cast("double")) / (math.log(1 / least) * 1.01)).cast("long")
    hot = rows.where(F.col("many") > tile).drop("many").withColumn("band", band)
    parts = hot.groupBy("token", "band").agg(F.ceil(F.count("*") / tile).cast("int").alias("s"))
    own = hot.join(parts, ["token", "band"]).withColumn("sub", F.pmod(F.xxhash64("sig"), F.col("s")).cast("long")).drop("s")
    other = parts.select("token", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"), F.col("band").alias("band2"), "s")
    met = own.join(other, ["token", "band"]).withColumn("sub2", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    code = lambda p, s: p * 16777216 + s
    a, b = code(F.col("band"), F.col("sub")), code(F.col("band2"), F.col("sub2").cast("long"))
    pair = F.least(a, b) * (1 << 31) + F.greatest(a, b) + 1
    side = F.when(a == b, 2).when(a < b, 0).otherwise(1).cast("long")
    return small.unionByName(met.withColumns({"tile": pair, "side": side}).select(*small.columns))


def _verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs whose whole sets reach ``least``."""
    a, b = sets.toDF("src", "x"), sets.toDF("dst", "y")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "src").join(b, "dst").where(both * least.denominator >= (F.size("x") + F.size("y") - both) * least.numerator).select("src", "dst")


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """src < dst: pairs of ``sets`` (sig, fp) whose fingerprints differ in at most ``RADIUS`` bits, enough of them to connect all such. The first set of a
    fingerprint stands for it, and meets its others."""
    first = cut(sets.groupBy("fp").agg(F.min("sig").alias("one")))
    same = sets.join(first, "fp").where("sig != one").select(F.col("one").alias("src"), F.col("sig").alias("dst"))
    a, b = first.toDF("src", "x"), first.toDF("dst", "y")
    near = near_links(first.select("fp"), RADIUS).join(a, "src").join(b, "dst").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
    return same.unionByName(near)


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def near_groups(df: DataFrame, text: str = "text", words: int = WORDS, least: Fraction = LEAST, tile: int = TILE) -> DataFrame:
    """h (``text_hash``) and component of each distinct text: equal over chains of links of Jaccard similarity ``least`` or more between
    the sets of ``words``-word shingles (ASCII letters in lower case, split at white space). Null texts count as empty; texts without a
    word are one component. Repeated rows count once; an empty table gives no rows."""
    spark = prepare(df.sparkSession)
    tidy(spark)
    texts = df.select(text_hash(text).alias("h"), utf8(text).alias("raw"))
    common = _common(texts, words)

    def coded(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x, words) for x in b.column("raw").to_pylist()]
        sig = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        first = [ordered(s, common, least) for s in sets]
        return pa.record_batch({
            "h": b.column("h"), "sig": pa.array(sig), "n": pa.array([len(s) for s in sets], pa.int64()), "prefix": pa.array([f[0] for f in first], pa.list_(pa.int64())),
            "rare": pa.array([f[1] for f in first], pa.int64()), "score": pa.array([f[2] for f in first], pa.int64()), "fp": pa.array(np.array([simhash(s) for s in sets], np.uint64).view(np.int64)), "bits": pa.array([parity(s) for s in sets], pa.binary()), "fine": pa.array([fine_parity(s) for s in sets], pa.binary()),
        })

    rows = cut(arrow_map(texts, coded, "h long, sig long, n long, prefix array<long>, rare long, score long, fp long, bits binary, fine binary"))
    of = cut(rows.groupBy("h").agg(F.min("sig").alias("sig")))
    bits = cut(rows.groupBy("sig").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("bits").alias("bits"), F.min("fine").alias("fine")))
    reps = rows.groupBy("sig").agg(F.min_by(F.struct("n", "rare", "score", "prefix"), "h").alias("r"))
    dealt = reps.select("sig", "r.n", "r.rare", "r.score", F.posexplode("r.prefix").alias("pos", "token"))
    # the leader of a token: by a window where the token is rare; a common one has too many rows for one task and is aggregated first
    packed = F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("pos").cast("long"))  # fewer bytes to shuffle
    rare = dealt.where("pos < rare").select("token", "sig", packed.alias("at")).repartition("token")
    w = Window.partitionBy("token")
    rare = rare.withColumn("many", F.count("*").over(w)).withColumn("lead", F.min(F.struct("sig", "at")).over(w)).where("many > 1").select("token", "sig", "at", F.col("lead.sig").alias("lead"), F.col("lead.at").alias("lead_at"))
    often = dealt.where("pos >= rare").select("token", "sig", packed.alias("at"), F.struct(-F.col("score"), "sig", packed.alias("at")).alias("me"))
    lead = often.groupBy("token").agg(F.count("*").alias("many"), F.min("me").alias("lead")).where("many > 1").select("token", F.col("lead.sig").alias("lead"), F.col("lead.at").alias("lead_at"))
    shared = cut(rare.unionByName(often.drop("me").join(lead, "token")))
    release(rows)
    tidy(spark)
    n_of, pos_of = lambda c: F.shiftright(c, 32), lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    ok = _enough(n_of("at"), pos_of("at"), n_of("lead_at"), pos_of("lead_at"), least)
    star = shared.where((F.col("sig") != F.col("lead")) & ok).select(F.least("lead", "sig").alias("src"), F.greatest("lead", "sig").alias("dst"))

    def near(b: pa.RecordBatch) -> pa.RecordBatch:
        n = (b.column("n1").to_numpy() + b.column("n2").to_numpy()) * (least.denominator - least.numerator)
        differ = np.array([differing(x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)], np.int64)
        return b.filter(pa.array(differ * (least.denominator + least.numerator) <= n)).select(["src", "dst"])

    def possible(pairs: DataFrame) -> DataFrame:
        """The pairs that fine parities do not rule out."""
        fine = bits.select("sig", "n", "fine")
        return cut(arrow_map(pairs.join(fine.toDF("src", "n1", "x"), "src").join(fine.toDF("dst", "n2", "y"), "dst"), near, "src long, dst long"))

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets, made from the texts again, reach ``least``. The texts of the pairs are found without a shuffle of all."""
        sigs = pairs.select(F.explode(F.array("src", "dst")).alias("sig")).distinct()
        one = cut(of.groupBy("sig").agg(F.min("h").alias("h")).join(sigs, "sig", "left_semi"))
        bloom = spark.sparkContext.broadcast(_filter(one.select("h")))

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            h = b.column("h").to_numpy()
            first = np.unique(h, return_index=True)[1]
            b = b.take(pa.array(first[_held(h[first], bloom.value)]))
            return pa.record_batch({"h": b.column("h"), "s": pa.array([shingles(x, words) for x in b.column("raw").to_pylist()], pa.list_(pa.int64()))})

        sets = cut(arrow_map(texts, f, "h long, s array<long>").join(one, "h").select("sig", "s").dropDuplicates(["sig"]))
        found = cut(_verified(pairs, sets, least))
        release(one, sets)
        tidy(spark)
        return found

    pairs = cut(fingerprint_pairs(bits.select("sig", "fp")))
    tidy(spark)
    tried = possible(pairs.unionByName(star).distinct())
    release(pairs)
    tidy(spark)
    links, left = similar(tried), shared.select("token", "sig", "at")
    for forest in (True, False):
        label = connected_components(links, few=FEW).select(F.col("node").alias("sig"), F.col("component").alias("comp"))
        placed = left.join(label, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
        mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many")).where("lo != hi").select("token", "many")
        ready = placed.join(mixed, "token").join(bits.select("sig", "n", "bits"), "sig").select("token", "sig", pos_of("at").alias("pos"), "comp", "n", "bits", "many")
        work = _tiled(ready, tile, least).repartition("token", "tile").sortWithinPartitions("token", "tile")
        got = cut(work.mapInArrow(_cross(least, forest), "src long, dst long, token long").distinct())
        tidy(spark)
        more = cut(got.where("src is not null").select("src", "dst").join(tried, ["src", "dst"], "left_anti"))
        links = links.unionByName(similar(possible(more)))
        again = got.where("token is not null").select("token")
        if not forest or again.isEmpty():  # no token has a pair left
            break
        tried, left = tried.unionByName(more), left.join(again, "token", "left_semi")
    found = connected_components(links, few=FEW).select(F.col("node").alias("sig"), "component")
    return of.join(found, "sig", "left").select("h", F.coalesce("component", "sig").alias("component"))
