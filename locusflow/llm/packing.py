"""Hierarchical multi-length packing of token ids.

Documents are cut into full windows; what is left of each is routed to the tier (1024, 512, 256 or 128 tokens) that
just holds it. Tiers are packed from the longest down: an item opens a window of its tier, and the gap is filled with
the largest items of shorter tiers that fit, at last with a piece cut to the exact gap. So every window is full; the
end of a block of documents is cut into powers of two, which need no padding. Sequences are then dealt to step groups
of nearly equal tokens, largest first.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import slices
from locusflow.session import prepare

WINDOW, TIERS, END_ID = 1024, (128, 256, 512, 1024), 0
#: Tokens that a step group is to hold.
STEP_TOKENS = 65536


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that cover each length exactly once; every sequence's length is a power of two."""
    window = tiers[-1]
    out = [[(d, s, window)] for d, n in enumerate(lengths) for s in range(0, n - n % window, window)]
    pool = sorted((n % window, d, n - n % window) for d, n in enumerate(lengths) if n % window)
    while pool:
        n, d, s = pool.pop()
        size = tiers[bisect_left(tiers, n)]
        seq, gap = [(d, s, n)], size - n
        while gap and pool:
            i = bisect_right(pool, (gap, float("inf"))) - 1
            if i >= 0:
                n, d, s = pool.pop(i)
            else:  # nothing fits: cut the smallest
                n, d, s = pool.pop(0)
                insort(pool, (n - gap, d, s + gap))
                n = gap
            seq.append((d, s, n))
            gap -= n
        out += [seq] if not gap else powers(seq)
    return out


def powers(seq: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut into sequences of powers of two, largest first."""
    total, out = sum(p[2] for p in seq), []
    left = [*reversed(seq)]
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        part = []
        while size:
            d, s, n = left.pop()
            take = min(n, size)
            part.append((d, s, take))
            if take < n:
                left.append((d, s + take, n - take))
            size -= take
        out.append(part)
    return out


def step_groups(sizes: list[int], tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence: the largest first, each to the group that holds the fewest tokens."""
    heap = [(0, g) for g in range(max(1, round(sum(sizes) / tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        held, g = heap[0]
        heapq.heapreplace(heap, (held + sizes[i], g))
        out[i] = g
    return out


class Tokens:
    """Ids of whole texts by the byte-level BPE in the given file of the tokenizers library.

    The fast path is tiktoken over the same vocabulary as ranks, which gives the same ids; texts that hold one of the
    tokenizer's special strings, or that tiktoken refuses, go to the tokenizers library itself.
    """

    def __init__(self, json_path: str, rank_path: str | None, pattern: str | None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(json_path), None
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        if rank_path:
            import base64

            import tiktoken

            with open(rank_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:  # its regular-expression engine gives up on some very long runs
                pass
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=1)  # kept by a worker from task to task
def public_tokens() -> Tokens:
    import public_tokenizers as p

    return Tokens(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokens=public_tokens, end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Each row's whole text is tokenized and ``end_id`` appended; a null text is empty, so it is that id alone. Repeated rows are
    packed each. Blocks of at most 2048 documents of one input partition are packed on their own: no shuffle, bounded
    memory, and the same result when a task runs again. An empty table gives no rows. sequence_id holds the partition in
    its upper bits; it is unique, not gapless. Which documents share a sequence follows from the input's partitions and batches, and
    step groups are balanced within such a block; pieces and ids do not depend on either.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seq, step = None, TaskContext.get().partitionId() << 40, TaskContext.get().partitionId() << 40
        for b in slices(batches):
            if not b.num_rows:
                continue
            enc = enc or tokens()
            ids = [np.append(enc.ids(t or ""), np.uint32(end_id)) for t in b.column("text").to_pylist()]
            packed = pack([len(x) for x in ids])
            groups = step_groups([sum(p[2] for p in s) for s in packed])
            rows, tier, group = [], [], []
            for s, g in zip(packed, groups, strict=True):
                offset, size = 0, sum(p[2] for p in s)
                for d, start, n in s:
                    rows.append((d, start, n, zlib.crc32(ids[d][start : start + n].tobytes()), len(ids[d]), seq, offset))
                    tier.append(size)
                    group.append(step + g)
                    offset += n
                seq += 1
            step += max(groups) + 1
            cols = np.array(rows, np.int64)
            yield pa.record_batch({"id": b.column("id").take(pa.array(cols[:, 0]))} | {n: pa.array(cols[:, i + 1]) for i, n in enumerate(names)} | {"tier": pa.array(tier, pa.int32()), "step_group": pa.array(group, pa.int64())})

    schema = f"id {kind}, " + ", ".join(f"`{n}` long" for n in names) + ", tier int, step_group long"
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", key)
