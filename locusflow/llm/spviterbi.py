"""SentencePiece encoding and decoding by streaming Viterbi.

A text's lattice of pieces is walked once, left to right, with a back pointer for each position; only positions within the longest piece's
reach stay live. As soon as all surviving paths run through one boundary (no edge crosses it, or the back pointers of all live positions meet in
it), the ids before it are final and are committed, so the window is bounded by the pieces, not by the text.

Unigram models: the best path has the greatest sum of scores. Merge-order models (their scores are ranks): an edge joins its path only where
merging would keep the two pieces at the joint apart. Then each position has exactly one path, and it is the segmentation that merging
gives, so ids are those of the library's own encoder.

Where no piece crosses into a word mark, every path commits before each mark. The spans between such commits are remembered, and the new
ones of a batch of texts are walked in lockstep with numpy: the same lattice, joints and back pointers, one position of all spans at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import arrow_map
from locusflow.session import prepare

MARK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: How far below the lowest score an unknown character lies, as in the unigram model.
UNKNOWN = 10.0
#: Positions between looks for a boundary on which all back pointers meet, where edges cross every boundary.
LOOK = 64
#: Remembered spans, their greatest length, and remembered joints.
SPANS, SPAN, JOINTS = 500_000, 64, 2_000_000
#: Spans of texts held at once, and positions of new spans walked at once; only memory and speed depend on them.
HELD, CELLS = 1 << 18, 1 << 21


class Table:
    """Whole numbers by whole numbers of 0 and more, looked up an array at a time; exact (open addressing, keys are compared)."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are new and differ."""
        while (self.n + len(keys)) * 2 > len(self.keys):
            old = self.keys >= 0
            k, v = self.keys[old], self.values[old]
            self.__init__(self.bits + 1)
            self.add(k, v)
        self.n += len(keys)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], at[~put]
            at = np.where(self.keys[at] >= 0, (at + 1) & (len(self.keys) - 1), at)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


class Pieces:
    """Pieces and scores of a model, ready to encode and decode. ``pieces``: (text, score, kind) by id; kind: normal, byte, unknown or other.
    ``merges``: scores are ranks of merges."""

    def __init__(self, pieces: list[tuple[str, float, str]], merges: bool = False):
        self.text = [p for p, _, _ in pieces]
        self.kind = [k for _, _, k in pieces]
        self.merges = merges
        self.best = {}
        for i, (p, s, k) in enumerate(pieces):
            if k == "normal" and p and (p not in self.best or self.best[p][0] < s):
                self.best[p] = (s, i)
        self.byte = {int(m[1], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte" and (m := _BYTE.fullmatch(p))}
        self.unk = next((i for i, (_, _, k) in enumerate(pieces) if k == "unknown"), 0)
        self.reach = max(map(len, self.best), default=1)
        self.unknown = min((s for s, _ in self.best.values()), default=0.0) - UNKNOWN
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.best)
        self.span = None if crossing else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        #: every piece, and every beginning of one (id -1): a walk stops where no piece goes on
        self.tree = {p[:n]: -1 for p in self.best for n in range(1, len(p))} | {p: i for p, (_, i) in self.best.items()}
        self.score = [s for _, s, _ in pieces]
        self.rank = {p: s for p, (s, _) in self.best.items()}
        self.raw = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "normal" else " ⁇ ".encode() if k == "unknown" else b"" for p, k in zip(self.text, self.kind, strict=True)]
        self.joints: dict[int, bool] = {}
        self.spans: dict[str, bytes] = {}
        self.steps = self.known = None  # tables of the lockstep walk
        self.widest = 0  # of all windows so far, in positions

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the adjacent pair that makes the best piece first, the leftmost of equals."""
        parts, get, none = list(text), self.rank.get, float("-inf")
        joined = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while joined:
            top = max(joined)
            if top == none:
                break
            i = joined.index(top)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i < len(joined):
                joined[i] = get(parts[i] + parts[i + 1], none)
            if i:
                joined[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def _apart(self, key: int) -> bool:
        """Whether merging keeps two pieces (id << 32 | id) apart; with -1 for the first, whether it makes the second at all. Remembered."""
        b = self.text[key & 0xFFFFFFFF]
        parts = [b] if key < 0 else [self.text[key >> 32], b]
        if len(self.joints) > JOINTS:
            self.joints.clear()
        self.joints[key] = ok = self.merged("".join(parts)) == parts
        return ok

    def _spell(self, ch: str) -> list[int]:
        return [self.byte[b] for b in ch.encode()] if len(self.byte) == 256 else [self.unk]

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of marked text, in committed groups. Of unigram paths, ties go to the longer last piece, and to a piece over an unknown character."""
        window = self._merge_window if self.merges else self._score_window
        spans, pattern = self.spans, self.span
        at, n = 0, len(text)
        while at < n:
            if pattern is None:
                end = n
            else:  # no piece crosses from other text into a mark: every path meets before it
                end = pattern.match(text, at).end()
                if end - at <= SPAN:
                    word = text[at:end]
                    got = spans.get(word)
                    if got is None:
                        if len(spans) > SPANS:
                            spans.clear()
                        spans[word] = got = np.array([i for part in window(word, 0, len(word)) for i in part], np.uint32).tobytes()
                    yield np.frombuffer(got, np.uint32).tolist()
                    at = end
                    continue
            yield from window(text, at, end)
            at = end

    def _merge_window(self, text: str, base: int, stop: int) -> Iterator[list[int]]:
        """Commits from ``base`` to ``stop``: every position has at most one path, along joints that merging keeps apart."""
        tree, reach, joints, apart = self.tree, self.reach, self.joints, self._apart
        left = -1  # the last committed id; -1: none, or an unknown character, which joins nothing
        prev, ids, far = {}, {}, base
        for start in range(base, stop):
            if start == far and start > base:  # no edge crosses: commit
                yield self._walk(text, prev, ids, base, start)
                left, base, prev, ids = ids[start], start, {}, {}
            elif start - base >= LOOK and start % LOOK == 0 and (meet := self._meet(prev, base, far)) > base:
                yield self._walk(text, prev, ids, base, meet)
                left = ids[meet]
                prev, ids, base = {k: v for k, v in prev.items() if k > meet}, {k: v for k, v in ids.items() if k > meet}, meet
            mine = left if start == base else ids.get(start)
            if mine is None:  # no path ends here
                continue
            for end in range(start + 1, min(stop, start + reach) + 1):
                own = tree.get(text[start:end])
                if own is None:
                    break
                if own >= 0:
                    ok = joints.get(key := mine << 32 | own)
                    if apart(key) if ok is None else ok:
                        prev[end], ids[end] = start, own
                        if end > far:
                            far = end
            if tree.get(text[start], -1) < 0:  # a character that is no piece stands for itself
                prev[start + 1], ids[start + 1] = start, -1
                far = max(far, start + 1)
            if far - base > self.widest:
                self.widest = far - base
        if stop > base:
            yield self._walk(text, prev, ids, base, stop)

    def _score_window(self, text: str, base: int, stop: int) -> Iterator[list[int]]:
        """Commits from ``base`` to ``stop``: the path with the greatest sum of scores to each position."""
        tree, reach, lost, scores = self.tree, self.reach, self.unknown, self.score
        best, prev, ids, far = {base: 0.0}, {}, {}, base
        for start in range(base, stop):
            meet = start if start == far else self._meet(prev, base, far) if start - base >= LOOK and start % LOOK == 0 else base
            if meet > base:
                yield self._walk(text, prev, ids, base, meet)
                zero = best[meet]
                best, prev, ids = {k: v - zero for k, v in best.items() if k >= meet}, {k: v for k, v in prev.items() if k > meet}, {k: v for k, v in ids.items() if k > meet}
                base = meet
            here = best[start]
            for end in range(start + 1, min(stop, start + reach) + 1):
                own = tree.get(text[start:end])
                if own is None:
                    break
                if own >= 0 and (end not in best or here + scores[own] > best[end]):
                    best[end], prev[end], ids[end] = here + scores[own], start, own
                    far = max(far, end)
            if start + 1 not in best or here + lost > best[start + 1]:
                best[start + 1], prev[start + 1], ids[start + 1] = here + lost, start, -1
                far = max(far, start + 1)
            if far - base > self.widest:
                self.widest = far - base
        if stop > base:
            yield self._walk(text, prev, ids, base, stop)

    def _meet(self, prev: dict[int, int], base: int, far: int) -> int:
        """The last boundary on the back pointers of every live position, or ``base``."""
        live = {i for i in range(max(base, far - self.reach), far + 1) if i in prev or i == base}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(prev[last])
        return live.pop()

    def _walk(self, text: str, prev: dict[int, int], ids: dict[int, int], base: int, end: int) -> list[int]:
        out = []
        while end > base:
            own = ids[end]
            out += [own] if own >= 0 else self._spell(text[end - 1])[::-1]
            end = prev[end]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text: a word mark goes before it and stands for each space (a mark in the text is one, too); an empty text has none."""
        if not text:
            return np.empty(0, np.uint32)
        out: list[int] = []
        for part in self.stream(MARK + text.replace(" ", MARK)):
            out += part
        return np.array(out, np.uint32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """``encode`` of each text, whose new spans are walked in lockstep first."""
        if self.span is None or not self.merges:
            return [self.encode(t) for t in texts]
        out: list[list[bytes]] = [[] for _ in texts]
        held, n = [], 0
        for i, text in enumerate(texts):
            for words in self._cut(text) if text else ():
                held.append((i, words))
                n += len(words)
                if n >= HELD:
                    self._encode_held(held, out)
                    held, n = [], 0
        self._encode_held(held, out)
        return [np.frombuffer(b"".join(x), np.uint32) for x in out]

    def _cut(self, text: str) -> Iterator[list[str]]:
        """The spans of a text, at most ``HELD`` at a time."""
        marked = MARK + text.replace(" ", MARK)
        if len(marked) <= HELD:
            yield self.span.findall(marked)
            return
        found = self.span.finditer(marked)
        while part := [m[0] for m in islice(found, HELD)]:
            yield part

    def _encode_held(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        """Appends the ids of each (text number, spans) to those of its text."""
        if len(self.spans) > SPANS:
            self.spans.clear()
        spans = self.spans
        new = {w for _, words in held for w in words} - spans.keys()
        self._lockstep([w for w in new if len(w) <= SPAN])
        for i, words in held:
            try:
                raw = b"".join(map(spans.__getitem__, words))
            except KeyError:  # long spans go through their window
                raw = b"".join(spans[w] if w in spans else np.array([i for part in self._merge_window(w, 0, len(w)) for i in part], np.uint32).tobytes() for w in words)
            out[i].append(raw)

    def _lockstep(self, words: list[str]) -> None:
        """Fills ``spans`` with the ids of the words: ``_merge_window`` of all of them, one start position at a time."""
        if not words:
            return
        words.sort(key=len, reverse=True)
        if len(words) > (step := max(1, CELLS // len(words[0]))):
            self._lockstep(words[:step])
            self._lockstep(words[step:])
            return
        if self.steps is None:
            node = {p: i + 1 for i, p in enumerate(self.tree)}  # 0 is the root
            self.steps = Table(18 + max(0, len(node) // 100_000).bit_length())
            self.steps.add(np.array([node[p[:-1]] << 21 | ord(p[-1]) if len(p) > 1 else ord(p) for p in node], np.int64), np.arange(1, len(node) + 1, dtype=np.int64))
            self.own = np.array([-1, *self.tree.values()], np.int64)
            self.known = Table(16)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(lens[0])
        codes = np.zeros((len(words), wide), np.int32)
        codes[np.arange(wide)[None] < lens[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        last, prev = np.full((len(words), wide + 1), -2, np.int32), np.zeros((len(words), wide + 1), np.int16)
        last[:, 0] = -1
        for start in range(wide):
            at = np.flatnonzero(last[: np.searchsorted(-lens, -start), start] > -2)  # words longer than the start, with a path to it
            node, reached = np.zeros(len(at), np.int64), at
            for end in range(start + 1, min(wide, start + self.reach) + 1):
                more = lens[at] >= end
                at, node = at[more], node[more]
                node = self.steps.get(node << 21 | codes[at, end - 1])
                on = node >= 0
                at, node = at[on], node[on]
                own = self.own[node]
                is_piece = own >= 0
                w, own = at[is_piece], own[is_piece]
                if len(w):
                    ok = self._apart_all((last[w, start].astype(np.int64) + 1) << 24 | own)
                    last[w[ok], end], prev[w[ok], end] = own[ok], start
                if end == start + 1:  # a character that is no piece stands for itself and joins nothing
                    lone = np.setdiff1d(reached, w, assume_unique=True)
                    last[lone, end], prev[lone, end] = -1, start
                if not len(at):
                    break
        place, rows, ids = lens.copy(), np.arange(len(words)), []
        while len(rows):
            here = place[rows]
            own = last[rows, here]
            ids.append((rows, np.where(own < 0, -2 - codes[rows, here - 1], own)))
            place[rows] = prev[rows, here]
            rows = rows[place[rows] > 0]
        n = np.zeros(len(words), np.int64)
        for r, _ in ids:
            n[r] += 1
        ends = np.cumsum(n)
        flat = np.zeros(int(ends[-1]), np.int64)
        for back, (r, v) in enumerate(ids):
            flat[ends[r] - 1 - back] = v
        odd = np.zeros(len(words), bool)
        odd[np.searchsorted(ends, np.flatnonzero(flat < 0), side="right")] = True
        raw, spans, begin = flat.astype(np.uint32).tobytes(), self.spans, 0
        for word, end, spelled in zip(words, ends.tolist(), odd.tolist(), strict=True):
            if spelled:
                spans[word] = np.array([i for v in flat[begin:end].tolist() for i in ([v] if v >= 0 else self._spell(chr(-2 - v)))], np.uint32).tobytes()
            else:
                spans[word] = raw[4 * begin : 4 * end]
            begin = end

    def _apart_all(self, keys: np.ndarray) -> np.ndarray:
        """``_apart`` of each (id + 1) << 24 | id."""
        got = self.known.get(keys)
        if (got < 0).any():
            new = np.unique(keys[got < 0])
            if self.known.n + len(new) > JOINTS:
                self.known = Table(16)
            merged, text = self.merged, self.text
            fresh = []
            for key in new.tolist():
                b = text[key & 0xFFFFFF]
                parts = [text[(key >> 24) - 1], b] if key >> 24 else [b]
                fresh.append(merged("".join(parts)) == parts)
            self.known.add(new, np.array(fresh, np.int64))
            got = self.known.get(keys)
            if (got < 0).any():  # the table was begun anew
                return self._apart_all(keys)
        return got == 1

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces join into UTF-8, marks are spaces, the first mark goes; unknown ids give U+2047 in spaces."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)  # kept by a worker from task to task
def public_pieces() -> Pieces:
    import public_tokenizers as p
    import sentencepiece

    return from_model(sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model")))


def from_model(sp) -> Pieces:
    """Pieces of a model of the library. One whose scores are whole numbers that fall with the id, but for those at the lowest, is a merge-order model."""
    kind = lambda i: "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "other" if sp.is_control(i) or sp.is_unused(i) else "normal"
    pieces = [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]
    scores = [s for _, s, k in pieces if k == "normal"]
    low = min(scores, default=0.0)
    ranks = [s for s in scores if s > low]
    return Pieces(pieces, len(scores) > 1 and all(s.is_integer() for s in scores) and all(a > b for a, b in zip(ranks, ranks[1:])))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", pieces=public_pieces) -> DataFrame:
    """key and ids (array<int>) of each row's text, read whole whatever its length; null is empty and has no ids. Ties as in ``Pieces.stream``. Equal
    texts get equal ids, one row per row; an empty table gives none, further columns play no part. No shuffle."""
    prepare(docs.sparkSession)
    kind, state = docs.schema[key].dataType.simpleString(), {}

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        p = state.setdefault("p", None) or state.update(p=pieces()) or state["p"]
        got = p.encode_all([t or "" for t in b.column("text").to_pylist()])
        offsets = np.r_[0, np.cumsum([len(x) for x in got])].astype(np.int32)
        flat = np.concatenate(got).astype(np.int32) if got else np.empty(0, np.int32)
        return pa.record_batch({"id": b.column("id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

    return arrow_map(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), f, f"id {kind}, ids array<int>").withColumnRenamed("id", key)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", pieces=public_pieces) -> DataFrame:
    """key, text, n_ids and ids_crc32 (little-endian unsigned 32-bit ids) of each row's ids, of any number; null ids give nulls. A mark (U+2581) that was
    in a text comes back as a space, as in the library. One row per row; an empty table gives none, further columns play no part. No shuffle."""
    prepare(df.sparkSession)
    kind, state = df.schema[key].dataType.simpleString(), {}

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        p = state.setdefault("p", None) or state.update(p=pieces()) or state["p"]
        col = b.column("ids")
        got = [None if not x.is_valid else x.values.to_numpy(zero_copy_only=False) for x in col]
        return pa.record_batch({
            "id": b.column("id"),
            "text": pa.array([None if x is None else p.decode(x.tolist()) for x in got], pa.string()),
            "n_ids": pa.array([None if x is None else len(x) for x in got], pa.int64()),
            "ids_crc32": pa.array([None if x is None else zlib.crc32(x.astype("<u4").tobytes()) for x in got], pa.int64()),
        })

    return arrow_map(df.select(F.col(key).alias("id"), F.col(ids).alias("ids")), f, f"id {kind}, text string, n_ids long, ids_crc32 long").withColumnRenamed("id", key)
