"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through region and rack to its shard. At each level every child draws ln(u) / weight,
where u comes from the MD5 digest of the row's key and the child's name, and the highest draw wins, so a child's share follows its
weight. Only draws of children whose weight changes change: rows move only into or out of those subtrees. A shard that is
added comes as a new region of its own, so rows only move into it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusflow.session import cut, prepare

SHARDS, RACK, REGION = 16, 4, 2
#: Parts of each shard that are numbered on their own: at least and at most so many, between them one for so many rows.
PARTS, MOST, ROWS = 16, 65536, 1 << 20


@dataclass(frozen=True)
class Node:
    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def topology(shards: int, weights: dict[int, float] | None = None, base: int = SHARDS, rack: int = RACK, region: int = REGION) -> Node:
    """The tree of ``shards`` shards: the first ``base`` in regions of ``region`` racks of ``rack``, every later one as a region of its own."""
    if shards < 1:
        raise ValueError("at least one shard")
    w = weights or {}
    leaf = lambda i: Node(f"shard{i}", shard=i, own=w.get(i, 1.0))
    racks = [Node(f"rack{r}", tuple(leaf(i) for i in range(r * rack, min((r + 1) * rack, shards, base)))) for r in range(-(-min(shards, base) // rack))]
    regions = [Node(f"region{g}", tuple(racks[g * region : (g + 1) * region])) for g in range(-(-len(racks) // region))]
    return Node("root", (*regions, *(Node(f"region-of-{i}", (Node(f"rack-of-{i}", (leaf(i),)),)) for i in range(base, shards))))


def place(key: Column, node: Node) -> Column:
    """The shard of ``key``, as one expression: draws of a level, then the winner's own subtree. A null key is one key like any other."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError(f"no weight under {node.name}")
    if len(live) == 1:
        return place(key, live[0])
    text = F.coalesce(key.cast("string"), F.lit(""))
    draw = lambda c: F.ln((digits(F.concat(text, F.lit(f"|{c.name}")), 13).cast("double") + 0.5) / F.lit(2.0**52)) / F.lit(float(c.weight))
    won = F.array_max(F.array(*[F.struct(draw(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)]))["i"]
    return _choose(won, [place(key, c) for c in live])


def digits(text: Column, n: int) -> Column:
    """The first ``n`` hexadecimal digits of a text's MD5 digest, as a long."""
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("long")


def _choose(won: Column, of: list[Column]) -> Column:
    out = F.when(won == 0, of[0])
    for i, c in enumerate(of[1:], 1):
        out = out.when(won == i, c)
    return out


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of every row under the law ``key``.

    Size is the UTF-8 length plus one; a null text has none, so its size is 1. Slots number the rows of a shard from 0 without a gap,
    by part and key: parts (a hash of the key, size and crc32, so that a key of many rows is spread) are numbered in separate tasks and shifted by the rows of the parts before them.
    Repeated rows get slots of their own. Equal texts of different keys lie where their keys say. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    k = F.col(key)
    rows = docs.select(k, (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), place(k, topology(shards)).cast("int").alias("shard"), place(k, topology(shards + 1)).cast("int").alias("grown_shard"))
    rows = cut(rows)  # without the texts, which are read once
    parts = min(MOST, max(PARTS, -(-rows.count() // (shards * ROWS))))
    part = (digits(F.concat_ws("|", F.coalesce(k.cast("string"), F.lit("")), "size", "text_crc32"), 8) % parts).cast("int")
    rows = rows.withColumn("part", part)
    per = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))  # at most shards * MOST rows, whatever the input
    before = per.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    w = Window.partitionBy("shard", "part").orderBy(key, "size", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(w) - 1)
    return numbered.join(F.broadcast(before), ["shard", "part"]).select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), "grown_shard")
