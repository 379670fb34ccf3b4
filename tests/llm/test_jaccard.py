import ctypes
import random
import resource
from fractions import Fraction
from itertools import combinations
from pathlib import Path

import corpus_pipeline
import pytest
from locusflow.llm import jaccard, simhash
from locusflow.operators import components
from locusflow.session import tidy

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text, words=5):
    t = text.lower().split()
    return {tuple(t[i : i + words]) for i in range(max(1, len(t) - words + 1))} if t else set()


def kept(texts):
    """Smallest position of each component at five words and 0.8, by brute force."""
    s, root = [sets(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if s[a] == s[b] or s[a] | s[b] and Fraction(len(s[a] & s[b]), len(s[a] | s[b])) >= Fraction(4, 5):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(i) for i in range(len(texts))}


def planted(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.choice((9, 60, 150)))] + (passage if r.random() < 0.5 else [])
        out.append(" ".join(base))
        for _ in range(6):
            base = list(base)  # copies of copies: similarity along chains, on both sides of 0.8
            for _ in range(r.choice((1, 1, 2, 3, 5))):
                base[r.randrange(len(base))] = word()
            out.append(" ".join(base))
    out += [" ".join(passage[: r.randrange(25, 40)]) for _ in range(8)] + ["one two", "ONE  two", "one two three", " "]
    r.shuffle(out)
    return out


def test_dedup_stage_finds_planted_near_copies(spark, monkeypatch):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    want = kept(texts)
    assert 10 < len(want) < len(texts) - 20
    assert {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()} == want
    monkeypatch.setattr(jaccard, "COMMON", 1 << 30)  # another order of shingles
    monkeypatch.setattr(jaccard, "EDGE", 3)
    monkeypatch.setattr(jaccard.near_groups, "__defaults__", ("text", 5, Fraction(4, 5), 4))  # tiles of four rows
    assert {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()} == want


def test_unlinked_texts_of_one_id_stay(spark):
    texts = ["a first text of seven plain words", "quite another matter with other words altogether", "a first text of seven plain words"]
    docs = spark.createDataFrame([(7, t, "en", "s", len(t)) for t in texts], COLUMNS)
    assert sorted(r.text for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()) == sorted(set(texts))


def test_language_stage_without_a_known_language(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "12 34", None, "s", 5), (3, None, None, "s", 0), (4, "другие слова", None, "s", 12)], COLUMNS)
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "").collect()} == {1, 4}


def test_dedup_stage_links_near_fingerprints(spark, monkeypatch):
    """With the prefix comparison switched off, the pairs of near SimHash fingerprints, verified on whole sets, are what is left."""
    r, texts = random.Random(8), []
    for _ in range(30):
        base = ["".join(r.choices("abcdefgh", k=4)) for _ in range(200)]
        for _ in range(3):
            texts.append(" ".join(base))
            base = [*base[:-1], r.choice("xyz") * 4] if r.random() < 0.7 else base[:-60] + ["".join(r.choices("mnop", k=4)) for _ in range(60)]
    fp = [simhash.simhash(jaccard.shingles(t.encode())) for t in texts]
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 3:
            assert Fraction(len(sets(texts[a]) & sets(texts[b])), len(sets(texts[a]) | sets(texts[b]))) >= Fraction(4, 5)
            root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    want = set(root)
    assert kept(texts) <= want and len(want) < len(texts) - 20
    monkeypatch.setattr(jaccard, "_enough", lambda n1, p1, n2, p2, least: n1 + n2 < 0)
    monkeypatch.setattr(jaccard, "_cross", lambda least, forest: lambda batches: iter(()))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    assert {x.doc_id for x in corpus_pipeline.dedup_stage(spark, docs, "").collect()} == want


def test_near_fingerprints_are_connected(spark):
    r = random.Random(2)
    fps = [r.getrandbits(64) - (1 << 63) for _ in range(40)]
    fps += [x ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for x in fps for _ in range(3)] + fps[:10]
    pairs = [(p.src, p.dst) for p in jaccard.fingerprint_pairs(spark.createDataFrame(list(enumerate(fps)), "sig long, fp long")).collect()]
    root, want = list(range(len(fps))), list(range(len(fps)))
    for links, of in ((pairs, root), ([(a, b) for a, b in combinations(range(len(fps)), 2) if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 3], want)):
        for a, b in links:
            x, y = of[a], of[b]
            of[:] = [min(x, y) if z in (x, y) else z for z in of]
    assert root == want and all(a < b for a, b in pairs) and len(set(want)) < 100


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    """On a table of many partitions the rounds over its links made most of the tasks, whose records the driver holds."""
    texts = planted(6)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    stars = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda e: 1 / 0)
    assert {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()} == kept(texts)
    monkeypatch.setattr(components, "_large_star", stars)
    edges = [(i, i + 1) for i in range(30, 60)] + [(7, 90), (90, 3), (3, 3), (None, 4), (4, None), (50, 51), (-5, 7)]
    found = lambda rows, few: sorted(map(tuple, components.connected_components(spark.createDataFrame(rows, "src long, dst long"), few=few).collect()))
    assert found(edges, 34) == found(edges, 33) == found(edges, 0) == sorted([(i, 30) for i in range(30, 61)] + [(x, -5) for x in (7, 90, 3, -5)])
    assert found([], 10) == found([(1, 1)], 10) == []


def test_tidy_gives_freed_memory_back(spark):
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "malloc_trim"):
        pytest.skip("another C library")
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    held = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize() >> 20
    blocks = [libc.malloc(1000) for _ in range(100_000)]
    for p in blocks:
        ctypes.memset(p, 1, 1000)
    for p in blocks[:-1]:  # the last one keeps the heap from shrinking by itself
        libc.free(p)
    before = held()
    tidy(spark)
    assert held() < before - 60
    libc.free(blocks[-1])
