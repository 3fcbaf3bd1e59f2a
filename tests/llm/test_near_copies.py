"""The pipeline's near copies come by SimHash: fingerprints, blocks, Hamming distance, and nothing beside them."""

from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from loadcast.llm import shingles
from loadcast.llm.common import stage
from test_shingles import plain_kept

RNG = np.random.default_rng(11)
TOP = (1 << 64) - 1


def random_set(size):
    return RNG.integers(0, 1 << 64, size, np.uint64)


def plain_fingerprints(hashes, number):
    found = []
    for k in range(number):
        counts = [0] * 64
        for h in hashes.tolist():
            z = (h + k * 0x9E3779B97F4A7C15) & TOP
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & TOP
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & TOP
            z ^= z >> 31
            counts = [c + (z >> b & 1) for b, c in enumerate(counts)]
        found.append(sum(1 << b for b, c in enumerate(counts) if 2 * c > len(hashes)))
    return found


@pytest.mark.parametrize("size", [0, 1, 2, 5, 254, 255, 256, 700])
def test_fingerprints(size):
    hashes = random_set(size)
    assert shingles.fingerprints(hashes, 5).tolist() == plain_fingerprints(hashes, 5)


@pytest.mark.parametrize("rows", [0, 200, 1_000_000, 100_000_000])
def test_pairs_at_the_similarity_meet(rows):
    """Sets of 400 at a similarity of exactly 0.8, by other elements or by fewer, share a block and keep the limits."""
    blocks, width, number = shingles.layout(rows, 0.8)
    assert rows / 2 ** width <= shingles.GROUP and blocks * width <= 64 * number
    for trial in range(200):
        base = random_set(360)
        a, b = (np.concatenate([base[:320], random_set(40)]) for _ in range(2))
        prints = np.stack([shingles.fingerprints(s, number) for s in ((a, b), (base, base[:288]))[trial % 2]])
        keys = shingles.block_keys(prints, blocks, width)
        assert (keys[0] == keys[1]).any() and len(set(keys[0].tolist())) == blocks
        assert shingles.families(prints[:, :shingles.CHECKED], 0.8).tolist() == [0, 0]


def plain_components(prints):
    """Smallest places of the components of rows within the limits."""
    label = list(range(len(prints)))
    for i, j in combinations(range(len(prints)), 2):
        bits = [(int(a) ^ int(b)).bit_count() for a, b in zip(prints[i], prints[j])]
        if sum(bits[:2]) <= shingles.distance_limit(128, 0.8) and sum(bits) <= shingles.distance_limit(256, 0.8):
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    return label


def noisy_prints(families, members):
    """Fingerprints with up to a third of their bits turned, so that some are within the limits and some are not."""
    rows = []
    for _ in range(families):
        center = RNG.random(64 * shingles.CHECKED) < 0.5
        rows += [center ^ (RNG.random(len(center)) < RNG.choice([0.05, 0.15, 0.3])) for _ in range(members)]
    return np.packbits(np.array(rows), axis=1, bitorder="little").view(np.uint64)


@pytest.mark.parametrize("cells", [1, 1 << 10, 1 << 16])
def test_families(monkeypatch, cells):
    monkeypatch.setattr(shingles, "_CELLS", cells)
    prints = noisy_prints(10, 12)
    want = plain_components(prints)
    assert len(set(want)) > 10 and shingles.families(prints, 0.8).tolist() == want


def test_candidates_keep_the_families_of_every_block(spark):
    prints, (blocks, width, _) = noisy_prints(10, 12), shingles.layout(120, 0.8)
    distinct = stage(spark.createDataFrame([(k, bytearray(p.tobytes())) for k, p in enumerate(prints)],
                                           "node long, prints binary"), "test-prints")
    label = np.arange(len(prints))
    for r in shingles.candidates(distinct, 0.8, blocks, width).collect():
        label = shingles._merged(label, np.array([r.a]), np.array([r.b]))
    want, keys = np.arange(len(prints)), shingles.block_keys(prints, blocks, width)
    for key in np.unique(keys):
        own = np.flatnonzero((keys == key).any(axis=1))
        want = shingles._merged(want, own, own[plain_components(prints[own])])
    assert label.tolist() == want.tolist() and len(set(want.tolist())) > 10


def test_no_path_beside_simhash(spark, sf, monkeypatch):
    """Without SimHash candidates only copies of the same words are folded."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    first = {}
    for r in sorted(rows):
        first.setdefault(" ".join((r.text or "").encode().lower().decode().split()), r.doc_id)
    monkeypatch.setattr(shingles, "candidates", lambda distinct, *_: distinct.selectExpr("node a", "node b").where("false"))
    kept = {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, sf).collect()}
    assert kept >= plain_kept(rows) and len(kept) > len(plain_kept(rows))
    assert kept == set(first.values())


def test_every_two_of_a_family_meet_in_a_bounded_group(spark):
    sizes = {7: 2, 8: 100, 9: 101, 10: 1500}
    rows = [(1000 * 10 * f + k, f) for f, n in sizes.items() for k in range(n)]
    met = shingles.in_parts(spark.createDataFrame(rows, "node long, family long"), 100).collect()
    groups = {}
    for r in met:
        groups.setdefault(r.key, []).append(r.node)
    assert max(map(len, groups.values())) <= 300 and all(len(set(g)) == len(g) for g in groups.values())
    pairs = {p for g in groups.values() for p in combinations(sorted(g), 2)}
    assert len(pairs) == sum(n * (n - 1) // 2 for n in sizes.values())
    assert sum(r.node < 90_000 for r in met) == 102


def test_a_family_in_parts_is_linked_like_a_whole_one(spark, monkeypatch):
    """A chain of texts, each near only to the next ones, and copies of one text, by parts of three texts."""
    words = [f"w{k}" for k in range(400)]
    rows = [" ".join(words[4 * k:4 * k + 200]) for k in range(40)] + [" ".join([*words[::-1], f"end{k}"]) for k in range(30)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    monkeypatch.setattr(shingles, "PART", 3)
    want = plain_kept(docs.collect())
    assert {r.doc_id for r in shingles.keep_one(docs).collect()} == want and 0 < len(want) < 20
