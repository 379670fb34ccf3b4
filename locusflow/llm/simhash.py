"""SimHash near-duplicates by tiled exact comparison.

Fingerprints within the radius agree on at least two of four 16-bit blocks (radius 2 spoils two at most), so the
distinct fingerprints are dealt six times, by each pair of blocks; inside such a bucket tiles are compared exactly
with numpy exclusive-or and bit counts, and tile pairs whose population counts differ beyond the radius are
skipped. Buckets of more than a tile are split by population count and a hash into tiles that are compared pair
by pair in separate tasks. Each tile pair reports a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import arrow_map, utf8
from locusflow.operators.components import connected_components
from locusflow.session import cut, prepare

RADIUS, WORDS, SEED, TILE, EDGE = 2, 3, 42, 8192, 1024
#: A fingerprint is hot where it has more than one of so many rows.
HOT = 1000


def hashes(raw: bytes, words: int = WORDS) -> np.ndarray:
    """64-bit hash of each word shingle of a text; a shorter text is one shingle, and without a word there is none."""
    tokens = raw.lower().split()  # bytes: A-Z only, and white space is \x20 and \x09-\x0D only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(tokens) - words + 1)
    spans = zip(starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of a text's word shingles; 0 without a word."""
    return simhash(hashes(raw, words))


def simhash(h: np.ndarray) -> int:
    """64-bit SimHash of hashes (8 bytes each); 0 of none."""
    n = len(h)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (the fingerprint's 64 bits as a long) of each row's whole text; null is empty. No shuffle."""
    prepare(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(x) for x in b.column("raw").to_pylist()], np.uint64).view(np.int64)
        return pa.record_batch({"id": b.column("id"), "fp": pa.array(fp, pa.int64())})

    return arrow_map(df.select(F.col(key).alias("id"), utf8(text).alias("raw")), f, f"id {kind}, fp long").withColumnRenamed("id", key)


def with_fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with fingerprint (16 hex digits) of each row's whole text; null is empty. No shuffle."""
    prepare(df.sparkSession)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode() for t in b.column(text).to_pylist()]
        return b.append_column("fingerprint", pa.array([f"{fingerprint(x):016x}" for x in raw], pa.string()))

    return arrow_map(df.drop("fingerprint"), f, ", ".join(f"`{c}` {t}" for c, t in df.drop("fingerprint").dtypes) + ", fingerprint string")


def _star(fp: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (positions in ``fp``): every member with the smallest of its component."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    best: dict[int, int] = {}
    for x in root:
        r = find(x)
        best[r] = min(best.get(r, x), x, key=lambda i: fp[i])
    return [(int(fp[best[find(x)]]), int(fp[x])) for x in root if best[find(x)] != x]


def tile_links(a: np.ndarray, b: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``a`` and ``b`` (or within ``a``), int64 fingerprints."""
    fp = a if b is None else np.concatenate([a, b])
    pop = np.bitwise_count(fp.view(np.uint64)).astype(np.int16)
    halves = [np.argsort(pop[: len(a)], kind="stable")] + ([] if b is None else [len(a) + np.argsort(pop[len(a) :], kind="stable")])
    x, y = halves[0], halves[-1]
    links, fu = [], fp.view(np.uint64)
    for i in range(0, len(x), EDGE):
        xi = x[i : i + EDGE]
        for j in range(i if b is None else 0, len(y), EDGE):
            yj = y[j : j + EDGE]
            if pop[yj[0]] - pop[xi[-1]] > radius or pop[xi[0]] - pop[yj[-1]] > radius:
                continue
            u, v = np.nonzero(np.bitwise_count(fu[xi][:, None] ^ fu[yj][None]) <= radius)
            own = xi[u] != yj[v]
            u, v = xi[u[own]], yj[v[own]]
            if len(u) > 4 * EDGE:  # many links: keep a spanning forest of this pair of tiles at once
                links += _star(fp, u, v)
            else:
                links += zip(fp[u].tolist(), fp[v].tolist(), strict=True)
    if not links:
        return []
    ids, inv = np.unique(np.array(links, np.int64), return_inverse=True)
    inv = inv.reshape(-1, 2)
    return _star(ids, inv[:, 0], inv[:, 1])


def _scan(radius: int):
    """Streams rows sorted by (key, tile): links of each run of equal key and tile. A run never spans more than two tiles of rows."""

    def of(run: list[np.ndarray]) -> list[tuple[int, int]]:
        fp, side = np.concatenate([r[0] for r in run]), np.concatenate([r[1] for r in run])
        if len(fp) < 2:
            return []
        if (side == 2).any():
            return tile_links(fp, None, radius)
        return tile_links(fp[side == 0], fp[side == 1], radius) if (side == 0).any() and (side == 1).any() else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, tile, fp, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tile", "fp", "side"))
            cut_at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
            ends = np.r_[cut_at[1:], len(key)]
            out: list[tuple[int, int]] = []
            if held_key == (key[0], tile[0]):
                held.append((fp[: ends[0]], side[: ends[0]]))
                cut_at, ends = cut_at[1:], ends[1:]
            if len(cut_at):
                if held:
                    out += of(held)
                held, held_key = [(fp[cut_at[-1] :], side[cut_at[-1] :])], (key[-1], tile[-1])
                cut_at, ends = cut_at[:-1], ends[:-1]
            size = ends - cut_at
            two = cut_at[size == 2]  # most buckets: one comparison, for all of them at once
            if len(two):
                u, v, s = fp[two], fp[two + 1], side[two] + side[two + 1]
                near = (np.bitwise_count((u ^ v).view(np.uint64)) <= radius) & ((s == 4) | (s == 1))
                out += zip(u[near].tolist(), v[near].tolist(), strict=True)
            for lo, hi in zip(cut_at[size > 2], ends[size > 2], strict=True):
                out += of([(fp[lo:hi], side[lo:hi])])
            if out:
                e = np.array(out, np.int64)
                yield pa.record_batch({"src": pa.array(e[:, 0]), "dst": pa.array(e[:, 1])})
        if held and (out := of(held)):
            e = np.array(out, np.int64)
            yield pa.record_batch({"src": pa.array(e[:, 0]), "dst": pa.array(e[:, 1])})

    return run


def _keys(fp: Column, blocks: int, kept: int) -> list[Column]:
    bits = 64 // blocks
    part = [F.shiftrightunsigned(fp, bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(blocks)]
    out = []
    for n, c in enumerate(combinations(range(blocks), kept)):
        k = F.lit(n).cast("long")
        for i in c:
            k = F.shiftleft(k, bits).bitwiseOR(part[i])
        out.append(k)
    return out


def near_links(reps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """src, dst: links between distinct fingerprints (column fp) that connect every pair within ``radius``."""
    if not 0 <= radius <= 3:
        raise ValueError("a radius from 0 to 3: a wider one leaves none of the four blocks whole")
    blocks, kept = 4, 4 - radius
    dealt = cut(reps.select("fp", F.explode(F.array(*_keys(F.col("fp"), blocks, kept))).alias("key")))
    many = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = dealt.join(many, "key")
    small = dealt.where(F.col("n") <= tile).select("key", F.lit(0).cast("long").alias("tile"), "fp", F.lit(2).alias("side"))
    hot = dealt.where(F.col("n") > tile).select("key", "fp", F.bit_count("fp").alias("pop"))
    parts = hot.groupBy("key", "pop").agg(F.ceil(F.count("*") / tile).cast("int").alias("s"))
    sub = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    # each tile meets the tiles of population counts up to the radius away; tile id: (pop, sub) of both, smaller first
    own = hot.join(parts, ["key", "pop"]).select("key", "fp", "pop", sub.alias("sub"))
    other = parts.select("key", F.explode(F.sequence(F.col("pop") - radius, F.col("pop") + radius)).alias("pop"), F.col("pop").alias("pop2"), "s")
    met = own.join(other, ["key", "pop"]).select("key", "fp", "pop", "sub", "pop2", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("sub2"))
    code = lambda p, s: p.cast("long") * 16777216 + s
    a, b = code(F.col("pop"), F.col("sub")), code(F.col("pop2"), F.col("sub2"))
    pair = F.least(a, b) * (1 << 31) + F.greatest(a, b) + 1
    side = F.when(a == b, 2).when(a < b, 0).otherwise(1)
    tiled = met.select("key", pair.alias("tile"), "fp", side.alias("side"))
    work = small.unionByName(tiled).repartition(F.col("key"), F.col("tile")).sortWithinPartitions("key", "tile")
    return work.mapInArrow(_scan(radius), "src long, dst long").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (smallest key reachable over links within ``radius`` bits) of each row.

    Null texts count as empty, whose fingerprint is zero and links like any other; very long texts are read whole.
    Rows with equal texts fall on one fingerprint and are never paired; a row with a null key gets the smallest non-null
    key of its component, or null. An empty table gives no rows; further columns of ``df`` play no part.
    """
    fps = cut(fingerprints(df, key, text))
    reps = cut(fps.groupBy("fp").agg(F.min(key).alias("rep"), F.count("*").alias("n")))
    found = connected_components(near_links(reps.select("fp"), radius))
    label = found.join(reps, found.node == reps.fp).select("component", "node", "rep")
    least = label.groupBy("component").agg(F.min("rep").alias("least"))
    moved = label.join(least, "component").select(F.col("node").alias("fp"), "least")
    of = cut(reps.join(moved, "fp", "left").select("fp", "n", F.coalesce("least", "rep").alias("component_id")))
    # fingerprints of more than a thousandth of the rows, a thousand at most, meet their rows without a shuffle; the others have no hot key
    total = fps.count()
    hot = F.broadcast(of.where(F.col("n") * HOT > total).drop("n"))
    found = fps.join(hot, "fp").unionByName(fps.join(hot.select("fp"), "fp", "left_anti").join(of.where(F.col("n") * HOT <= total).drop("n"), "fp"))
    return found.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
