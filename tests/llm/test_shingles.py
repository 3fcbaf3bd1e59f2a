"""Near copies of the pipeline against brute-force Jaccard similarity."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from loadcast.llm import shingles


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """Smallest ids of the components of all pairs with Jaccard similarity of 0.8 or more."""
    sets = {r.doc_id: plain_shingles(r.text) for r in rows}
    root = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def edited(words, edits, rng):
    """Single words replaced, far enough apart that every edit costs five shingles."""
    words = list(words)
    for k in range(edits):
        words[k * len(words) // edits + len(words) // edits // 2] = f"new{rng.random()}"
    return words


def test_edited_copies(spark):
    rng, rows = random.Random(3), []
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        # edits of 1 to 8 of 396 shingles' 400 words: similarity 0.97 to 0.82; 12 and more: below 0.8
        for edits in (0, 1, 4, 6, 8, 12, 20):
            rows.append((len(rows), " ".join(edited(words, edits, rng) if edits else words), "own"))
    rows += [(1000, None, "x"), (1001, "", "y"), (1002, " \n", "z"), (1003, "a b", "p"), (1004, "A  b", "q"), (1005, "a c", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = shingles.keep_one(docs).collect()
    want = plain_kept(docs.collect())
    assert len(want) == 40 * 3 + 3 and {r.doc_id for r in kept} == want and len(kept) == len(want)
    source = {r[0]: r for r in rows}
    assert all(tuple(r) == source[r.doc_id] for r in kept)
    assert shingles.keep_one(docs.limit(0)).count() == 0


def test_stage_reaches_its_similarity(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, sf).collect()}
    assert kept == plain_kept(docs.select("doc_id", "text").collect())


def test_linked_keeps_components():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = rng.choice(10_000, 60, replace=False).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[rng.integers(0, 14):],
                                          rng.integers(20_000, 90_000, rng.integers(0, 9)).astype(np.uint64)]))
                for _ in range(25)]
        label = list(range(25))
        for i, j in combinations(range(25), 2):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                label = [label[i] if x == label[j] else x for x in label]
        got = list(range(25))
        for i, j in shingles.linked(sets, 0.8):
            got = [got[i] if x == got[j] else x for x in got]
        pairs = lambda x: {(i, j) for i, j in combinations(range(25), 2) if x[i] == x[j]}
        assert pairs(got) == pairs(label)
