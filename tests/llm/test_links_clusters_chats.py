"""Token links, clusters and chats against plain Python, over odd rows and the smallest tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

import check
from loadcast.llm import alignment, chat, clusters, oracles, queries
from loadcast.llm.common import folder

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Control strings as text, both kinds of white space, the space mark of the pieces, no common ends, repeats, long words.
TEXTS = [None, "", " ", "one two", "one two", " lead and trail ", "a  b\n\nc\td", "x ▁ y", "plain word▁inside z",
         "<|endoftext|> </s> <unk> <0x41>", "naïve façade 東京都庁 \U0001f9d1‍\U0001f33e x", "é" * 300,
         "zxqj" * 90, "\x00\x01 \x1f b", "tail\n", "the the the the", "word " * 50 + "end", "3.14159,2,71828 x=y;z"]


def vocabularies():
    tools = alignment.Tokenizers(BYTES, PIECES)

    def spelled(spellings, ids):
        return [spellings.bytes[spellings.starts[i]:][:spellings.lengths[i]].tobytes() for i in ids]
    return tools, spelled


def plain_links(rows):
    """doc_id, facts: the contract read literally, pair by pair."""
    tools, spelled = vocabularies()
    held, found = Counter(), []
    for doc_id, text in rows:
        (a, b), raw = ([], []), (" " + (text or "")).encode()
        if text:
            a = tools.a.encode(" " + text, add_special_tokens=False).ids
            b = tools.b.encode(text)
        of_a, of_b = spelled(tools.a_bytes, a), spelled(tools.b_bytes, b)
        if not text or b"".join(of_a) != raw or b"".join(of_b) != raw:
            found.append((doc_id, 0, 0, 0, Counter(), ""))
            continue
        a_ends, b_ends = np.cumsum([len(s) for s in of_a]).tolist(), np.cumsum([len(s) for s in of_b]).tolist()
        parts, first_a, first_b = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            stop_a, stop_b = a_ends.index(end) + 1, b_ends.index(end) + 1
            parts.append((a[first_a:stop_a], b[first_b:stop_b]))
            first_a, first_b = stop_a, stop_b
        links = Counter((x, y) for p, q in parts for x in p for y in q)
        held.update(links.keys())
        found.append((doc_id, len(a), len(b), len(parts), links,
                      ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in parts)))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted(((i, a, b, g, sum(links.values()), sum(m for p, m in links.items() if held[p] == best[p[0]]),
                    sum(m * held[p] for p, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else "")
                   for i, a, b, g, links, text in found), key=str), held


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, t, "n_a", 1, "p") for k, t in enumerate(TEXTS)] + [(None, "one two", "x", 2, "q"), (3, "one two", "x", 2, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a string, block int, pairs string").repartition(3)


def test_links(spark, texts, sf):
    for docs in (texts, spark.read.parquet(f"{sf}/documents.parquet"), texts.where("false")):
        want, held = plain_links([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        got = sorted((tuple(r) for r in alignment.align(docs, BYTES, PIECES).collect()), key=str)
        assert got == want
    pairs = {(r.a, r.b): r.n for r in alignment.pair_table(texts, BYTES, PIECES).collect()}
    assert pairs == plain_links([(r.doc_id, r.text) for r in texts.select("doc_id", "text").collect()])[1]


def test_links_in_small_windows():
    tools, texts = alignment.Tokenizers(BYTES, PIECES), [t or "" for t in TEXTS]
    usual = alignment.link_texts(tools, texts)
    alignment.WINDOW_BYTES, kept = 7, alignment.WINDOW_BYTES
    try:
        small = alignment.link_texts(tools, texts)
    finally:
        alignment.WINDOW_BYTES = kept
    assert usual.hashes == small.hashes and (usual.facts == small.facts).all() and (usual.pairs == small.pairs).all()
    singly = [alignment.link_texts(tools, [t]) for t in texts]
    assert usual.hashes == [s.hashes[0] for s in singly] and usual.facts.T.tolist() == [s.facts[:, 0].tolist() for s in singly]


def test_sparse_products():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.integers(0, 3, (7, 5)) * rng.integers(0, 2, (7, 5)), rng.integers(0, 4, (5, 6))
        sparse = [alignment.Csr.of(*np.nonzero(m), m[np.nonzero(m)], m.shape) for m in (a, b)]
        product = sparse[0].product(sparse[1])
        dense = np.zeros((7, 6), np.int64)
        dense[product.rows(), product.columns] = product.values
        assert (dense == a @ b).all() and (sparse[0].transposed().times(np.arange(7)) == a.T @ np.arange(7)).all()
    ends = np.array([3, 5, 9])
    turned, listed = alignment.token_bytes(ends, 0, 9).transposed(), alignment.bytes_tokens(ends, 0, 9)
    assert (turned.starts == listed.starts).all() and (turned.columns == listed.columns).all()
    # tokens of 3, 2, 4 bytes against 1, 4, 4: shared bytes
    links = alignment.overlaps(np.array([3, 5, 9]), np.array([1, 5, 9]), 0, 9)
    assert list(zip(links.rows().tolist(), links.columns.tolist(), links.values.tolist())) == [
        (0, 0, 1), (0, 1, 2), (1, 1, 2), (2, 2, 4)]
    assert [g.tolist() for g in alignment.groups(links)] == [[0, 0, 1], [0, 0, 1]]


def plain_clusters(rows, count=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(),
                                                         r[1]))[:count]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(p) // len(groups[k]) for p in zip(*groups[k])] if groups[k] else c for k, c in enumerate(centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    cost = Counter()
    for _, distance, k in found:
        cost[k] += distance
    return sorted(((i, k, d, cost[k], sum(cost.values()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest())
                   for i, d, k in found), key=str)


@pytest.mark.parametrize("case", ["odd", "few", "none", "wide", "table"])
def test_clusters(spark, sf, case):
    rng = random.Random(case)
    # halves and quarters: many equal distances
    rows = [(k, [rng.choice((-0.5, -0.25, 0.0, 0.25)) for _ in range(64)]) for k in range(60)]
    rows = {"odd": rows + rows[:9] + [(7, rows[8][1]), (None, rows[3][1]), (70, None), (71, []), (72, [1.0] * 63),
                                      (73, [None] + [1.0] * 63), (74, [math.nan] * 64), (75, [math.inf] + [0.0] * 63),
                                      (76, [0.0] * 64)],
            "few": rows[:5], "none": [(1, None)], "wide": [(k, [x * 4e5 for x in v]) for k, v in rows]}.get(case)
    if rows is None:
        df = spark.read.parquet(f"{sf}/embeddings.parquet")
        rows = [(r.vec_id, r.embedding) for r in df.collect()]
    else:
        df = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows],
                                   "vec_id long, embedding array<double>, cluster int, cells string, distance int")
    assert sorted((tuple(r) for r in clusters.cluster(df.repartition(3)).collect()), key=str) == plain_clusters(rows)


def test_cells_bound_every_distance():
    rng = np.random.default_rng(4)
    vectors, centres = rng.integers(-40, 40, (300, 5)), rng.integers(-50, 50, (6, 5))
    cells = clusters.Cells.of(vectors[:40], vectors.min(0), vectors.max(0))
    bounds = sum(t[c] for t, c in zip(cells.tables(centres), cells.approximate(vectors).T))
    exact = ((vectors[:, None] - centres) ** 2).sum(2)
    assert (bounds[:, :6] <= exact).all() and (exact <= bounds[:, 6:]).all()


ODD_TEXTS = [None, "", "\n", "</turn>", "\n</turn>\n", "\n</turn>\n### user\nhi\n</turn>\n", "### ", "\\### ", "\\\\</turn>\\",
             queries.ODD_CHAT, "####  ### ###x", "</tur", "### user\n", "a\\", "\\" * 500 + "</turn>", "plain " * 4000, "é\U0001f600"]


def plain_chats(rows):
    found = defaultdict(list)
    for conv_id, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found[conv_id].append((role or "", text or ""))
    return sorted(((i, len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest(),
                    sum(len(x) for r, x in t if r == "assistant"),
                    hashlib.sha256("".join(x for r, x in t if r == "assistant").encode()).hexdigest())
                   for i, t in found.items()), key=str)


@pytest.mark.parametrize("case", ["odd", "long", "none", "table"])
def test_chats(spark, sf, case):
    rng = random.Random(5)
    roles = ["assistant", "user", "user", None, "", "a\\nb", "two\nlines", "### x", "</turn>", "end\\"]
    rows = {"odd": [(c, rng.choice([None, 0, 1, 1, 2, 3]), rng.choice(roles), rng.choice(ODD_TEXTS))
                    for c in [None, 1, 2, 3, 3, 3, -9] for _ in range(12)],
            "long": [(5, k, ("user", "assistant")[k % 2], f"turn {k} </turn> " * 20) for k in range(2500)]
            + [(k, 0, "assistant", "short") for k in range(9)], "none": []}.get(case)
    if rows is None:
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    df = spark.createDataFrame([(*r, True, "f", 3) for r in rows], "conv_id long, turn long, role string, text string, "
                               "whole boolean, formatted string, part int").repartition(3)
    path = folder(spark, "test-chats")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    chat.write_chats(df, path, piece_chars=50_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = chat.read_chats(spark, path)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == plain_chats(rows)
    files = spark.read.schema(chat.FILE).parquet(path).collect()
    assert sum(r.formatted_chars for r in got.collect()) == sum(len(r.formatted) for r in files)
    if case == "long":          # spread over tasks, and every piece parses by itself
        assert len({r.part for r in files if r.conv_id == 5}) > 1
        assert all(chat.parse(r.formatted) for r in files)


def test_turns_are_escaped_only_where_they_conflict():
    for role in ("user", "a\nb", "a\\nb", "\\", "### x"):
        for text in filter(None, ODD_TEXTS):
            assert chat.parse("".join(chat.formatted_turn(role, text))) == [(role, text)]
    assert "".join(chat.formatted_turn("user", "a # b \\ c </ turn>")) == "### user\na # b \\ c </ turn>\n</turn>\n"
    for wrong in ("x", "### user", "### user\nabc</turn>\n", "### user\nabc\n</turn>", "### u\n### v\nabc\n</turn>\n"):
        with pytest.raises(chat.Unreadable):
            chat.parse(wrong)


@pytest.mark.parametrize("name", ["op12_clusters", "op13_chats"])
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert not check.compare(spark, con, name, queries.QUERIES[name], oracles.ORACLES[name], sf)[1]
