"""Every operator on documents against plain Python, over one fixture of odd rows and the smallest table."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loadcast.llm import huffman, licenses, mixing, oracles, packing, pii, quality, sharding, simhash
from loadcast.llm.common import folder
from loadcast.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, part int, key string, row int"
LONG = " ".join(f"word{k % 977} and, then ({k})" for k in range(9000))
NEAR = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 8
ODD = [
    (1, None, "en", "b"), (2, "", "en", None), (3, " \t\n ", "en", "a"), (4, LONG, "en", "a"),
    (5, NEAR, "en", "a"), (6, NEAR + "more", None, "a"), (7, NEAR, "en", "c"), (7, NEAR, "en", "c"),
    (None, "Released under the MIT license. released under THE mit License", "fr", "é"), (8, "a  b c \x1f d ", "en", "b"),
    (9, "mail x.y@z.example.org, or +1 (212) 555-0199 4111 1111 1111 1111 at 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8", "en", "b"),
    (10, "café CAFÉ İstanbul Kelvin licensed under the apache license, version 2.0 cc-by-nc", "en", "a"),
    (11, "un deux trois\n\nun deux trois\nun deux trois\n \n####", "en", "d"), (12, "x", "en", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, s, len(t or ""), 1, 2, "k", 3) for i, t, lang, s in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(params=["odd", "small", "empty"])
def docs(request, odd, small):
    return {"odd": odd, "small": small, "empty": odd.where("false")}[request.param]


def plain(df):
    return [tuple(r) for r in df.collect()]


def ids_of(vocabulary, text):
    library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    return library.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_packing(docs):
    rows = packing.pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY)).collect()
    want = Counter()
    for doc_id, text in plain(docs.select("doc_id", "text")):
        ids = ids_of(WORD_VOCABULARY, text or "") + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = ids[start:start + 2048]
            want[doc_id, piece, start, len(own), crc(own)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == best_fit([r.length for r in rows], 2048)


def best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 300).tolist() + [64] * 5 + [1] * 40
    plan = packing.fit_plan(dict(Counter(lengths)), 64)
    used = Counter()
    for length, rank, pieces, first, per, offset in plan.tolist():
        for k in range(pieces):
            spot = offset + k % per * length
            used.update((first + k // per, p) for p in range(spot, spot + length))
    assert max(used.values()) == 1 and len(used) == sum(lengths)
    assert max(p for _, p in used) < 64
    assert len({s for s, _ in used}) == best_fit(lengths, 64)


def test_sequences_hold_the_ids(spark, odd):
    packed = packing.pack_documents(odd, public_tokenizers.path(WORD_VOCABULARY)).cache()
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == r.ids


def test_token_files(spark, docs):
    path = folder(spark, "test-files")
    huffman.write_corpus(docs, path, public_tokenizers.path(BYTE_VOCABULARY), block_ids=2000)
    rows = sorted(plain(huffman.read_corpus(spark, path, with_ids=True)), key=lambda r: r[1])
    texts = sorted(plain(docs.select("doc_id", "text")), key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for doc_id, text in texts:
        ids = ids_of(BYTE_VOCABULARY, text or "") + [2]
        want.append((doc_id, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(((r[0], r[2], r[3]) for r in rows), key=str) == sorted(want, key=str)
    assert [r[0] for r in rows] == [w[0] for w in want]
    at = 0
    for r in rows:
        assert r[1] == at and crc(np.frombuffer(r[4], "<u4")) == r[3]
        at += r[2]


@pytest.mark.parametrize("counts", [[5], [1, 1], [0, 3, 0, 1], list(range(1, 40)), [2 ** k for k in range(20)]])
def test_code_lengths(counts):
    bits = 8
    lengths = huffman.code_lengths(np.array(counts), bits).astype(int)
    used = lengths[lengths > 0]
    assert (np.array(counts)[lengths == 0] == 0).all() and used.max() <= bits
    assert (2.0 ** -used).sum() <= 1
    ids = np.repeat(np.arange(len(counts)), np.minimum(counts, 50))
    np.random.default_rng(1).shuffle(ids)
    code = huffman.Code(lengths.astype(np.uint8), bits)
    block = huffman.encode_block(ids, code.codes(), code.lengths)
    out, = huffman.decode_blocks([block[0]], [block[1]], [len(ids)], code.decoding_table())
    assert (out == ids).all()


def test_code_is_optimal_without_a_limit():
    import heapq
    counts = np.random.default_rng(3).integers(1, 1000, 60)
    heap, cost = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (huffman.code_lengths(counts, 24).astype(int) * counts).sum() == cost


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    shingles = [b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows, distance=4):
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    ids = defaultdict(list)
    for (doc_id, _), c in zip(rows, label):
        if doc_id is not None:
            ids[c].append(doc_id)
    return [min(ids[c], default=None) for c in label]


@pytest.mark.parametrize("bound", [2048, 2])
def test_simhash(docs, bound):
    rows = [(d, plain_fingerprint(t or "")) for d, t in plain(docs.select("doc_id", "text"))]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(rows, plain_components(rows)))
    assert Counter(plain(simhash.near_duplicates(docs, group_bound=bound))) == want


@pytest.mark.parametrize("bound", [2048, 3])
def test_links_keep_components(spark, bound):
    rng = np.random.default_rng(4)
    values = set()
    for _ in range(6):
        at = int(rng.integers(0, 2 ** 63))
        for _ in range(30):
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                at ^= 1 << int(bit)
            values.add(at)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = list(zip(range(len(signed)), [v & (1 << 64) - 1 for v in signed]))
    table = simhash.stage(spark.createDataFrame(list(zip(range(len(signed)), signed)), "doc_id long, bits long"), "t")
    found = {r.bits & (1 << 64) - 1: r.component_id for r in simhash.components_of(table, group_bound=bound).collect()}
    assert [found[b] for _, b in rows] == plain_components(rows)


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = simhash.near_duplicates(odd).collect()
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({(r.component_id) for r in rows}) == len(set(ids))
    assert {i for i in ids if i is not None} == {r.component_id for r in rows if r.component_id is not None}


def test_licenses(docs):
    phrases = [(label, p.split()) for label, p in licenses.PHRASES]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = Counter()
    for doc_id, text in plain(docs.select("doc_id", "text")):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        places = [(k, label) for label, p in phrases for k in range(len(words)) if words[k:k + len(p)] == p]
        starts = [k for k, _ in places]
        want[doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None),
             ",".join(sorted({label for _, label in places}))] += 1
    rows = licenses.scan(docs).collect()
    assert Counter(tuple(r)[:6] for r in rows) == want
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licenses_with_edits(spark):
    full = dict((t.split()[0], (label, t)) for label, t in licenses.TEMPLATES)["redistribution"][1].split()
    edited = full[:5] + ["really"] + full[5:12] + full[13:]
    apart = [w for word in full for w in (word, "between")]
    other = "This work is licensed under the GNU General Public License, version 2 or 1".split()
    docs = spark.createDataFrame([(1, " ".join(["before"] * 7 + edited)), (2, " ".join(apart)), (3, " ".join(other))],
                                 "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert rows[1].labels == "bsd" and 0.5 < rows[1].score < 1
    assert rows[2].labels == "" and rows[3].labels == "gpl-2"


def plain_licenses(words):
    """Labels of the method's own and the best cover, by nested loops over one text's words."""
    labels, best = set(), 0.0
    for label, text in licenses.TEMPLATES:
        template = text.split()
        k = 2 if 4 <= len(template) <= 10 else 3
        n_grams, diagonals = len(template) - k + 1, defaultdict(list)
        for place in range(n_grams):
            for at in range(len(words) - k + 1):
                if words[at:at + k] == template[place:place + k]:
                    diagonals[at - place].append((at, place))
        chains = []
        for d in sorted(diagonals):
            if chains and d - chains[-1][-1] <= 4:
                chains[-1].append(d)
            else:
                chains.append([d])
        for group in [[d] for d in diagonals] + chains:
            seen = [hit for d in group for hit in diagonals[d]]
            covered = len({place for _, place in seen}) / n_grams
            best = max(best, covered)
            span = words[min(at for at, _ in seen):max(at for at, _ in seen) + k]
            told = [list(dict.fromkeys(w for w in part if w in licenses.TELLING)) for part in (span, template)]
            if covered >= 0.6 and (told[0] == told[1] or not told[1]):
                labels.add(label)
    return labels, best


def test_licenses_with_random_edits(spark):
    """Labels and scores as nested loops find them, on notices and passages with words put in, dropped and exchanged."""
    draw = random.Random(5)
    extra = "the terms of new lesser affero license version 2 3 under mit public and not licensed".split()
    texts = []
    for _ in range(300):
        words = []
        for _ in range(draw.randrange(1, 4)):
            words += draw.choices(extra, k=draw.randrange(5))
            one = draw.choice(licenses.TEMPLATES)[1].split()
            for _ in range(draw.randrange(4)):
                k = draw.randrange(len(one))
                one[k:k + draw.randrange(2)] = draw.choices(extra, k=draw.randrange(3))
                one = one or ["mit"]
            words += one
        texts.append(words)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    labelled = 0
    for r in licenses.scan(docs).collect():
        own, best = plain_licenses(texts[r.doc_id])
        assert set(filter(None, r.labels.split(","))) == own | set(filter(None, r.base_labels.split(",")))
        assert r.score == pytest.approx(max(best, float(r.n_base > 0)))
        labelled += bool(own)
    assert labelled > 100


NOTICES = [
    ("licensed under the terms of the GNU General Public License version 3", "gpl-3"),
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gpl-3"),
    ("it is licensed under the new mit license.", "mit"),
    ("Released under the terms of the MIT license", "mit"),
    ("licensed under the GNU Lesser General Public License, version 3", "lgpl-3"),
    ("under the terms of the GNU Lesser General Public License version 2.1", "lgpl-2.1"),
    ("licensed under the GNU Affero General Public License version 3", "agpl-3"),
    ("licensed under the GNU library General Public License version 2", ""),
    ("licensed under CC BY-SA 4.0", "cc-by-sa"), ("licensed under CC BY 4.0", "cc-by"),
    ("licensed under cc0, licensed under the mit license", "mit"),
    ("licensed under a new contract, and the general public gave license to version 3", ""),
]


def test_license_notices(spark):
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(NOTICES)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(docs).collect()} == {k: labels for k, (_, labels) in enumerate(NOTICES)}


def test_shards(docs):
    tree = sharding.even_tree()
    rows = sharding.shard(docs, tree, sharding.with_new_shard(tree)).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                   for d, t in plain(docs.select("doc_id", "text")))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r.slot)
        assert 0 <= r["shard"] < 16 and r.grown_shard in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len({r["shard"] for r in rows if r.doc_id == i}) == 1 for i in {r.doc_id for r in rows})


def test_shards_follow_sql_and_weights(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    tree = sharding.even_tree()
    rows = sharding.shard(spark.read.parquet(f"{sf}/documents.parquet"), tree, sharding.with_new_shard(tree))
    got = plain(rows.select("doc_id", "size", F.lit("key"), "shard", "grown_shard"))
    assert sorted(got) == sorted(con.execute(oracles.SHARDS).fetchall())
    keys = spark.range(8000).withColumn("key", F.col("id").cast("string"))
    heavier = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    heavier["region1"]["rack1.0"][5] = 3.0
    both = sharding.descend(sharding.descend(keys, tree, "key", "was"), heavier, "key", "now").collect()
    share = Counter(r.now for r in both)
    assert abs(share[5] / 8000 - 3 / 18) < 0.02 and abs(share[0] / 8000 - 1 / 18) < 0.01
    # rows leave the other subtrees only for the one whose weight grew
    assert all(r.was == r.now or 4 <= r.now < 8 for r in both)


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    sizes = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, s, t in plain(
        docs.select("doc_id", "source", "text"))]
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter(sizes)
    total = defaultdict(int)
    for _, s, n in sizes:
        total[s] += n
    target = shares(total)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in total:
        most = max(n for _, own, n in sizes if own == s)
        assert abs(taken[s] - target[s]) <= most
    assert Counter(map(tuple, mixing.mix(docs.repartition(5)).collect())) == Counter(map(tuple, rows))


def shares(total):
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(total.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * total[s] for s in over}
        rest -= sum(3 * total[s] for s in over)
        free -= over
    return target


def test_mixing_tree_has_levels(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(1).alias("copy"),
                                    (F.col("id") % 50 + 1).alias("size"))
    items = rows.select("source", "doc_id", "size", F.col("copy").cast("long").alias("copy"),
                        (F.col("size") * 0.3).alias("mass"))
    out = mixing.round_fractions(items, chunk=4).collect()
    assert len(out) == 3000 and len({r.doc_id for r in out}) == 3000
    words = sum(r.size for r in out if r.up)
    assert abs(words - 0.3 * sum(r.size for r in out)) <= 50
    assert 700 < sum(r.up for r in out) < 1100


def test_taken_documents(odd):
    key = ["doc_id", "source", "text"]
    got = Counter(plain(mixing.taken_documents(odd).select(key)))
    copies = defaultdict(int)
    for r in mixing.mix(odd).collect():
        copies[r.doc_id, r.source] += r.copies
    have = defaultdict(int)
    for (d, s, _), n in got.items():
        have[d, s] += n
    assert {k: v for k, v in copies.items() if v} == dict(have)


def test_quality_follows_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    names = [d[0] for d in con.execute(oracles.QUALITY).description]
    want = Counter(con.execute(oracles.QUALITY).fetchall()) if docs.count() else Counter()
    assert Counter(plain(quality.judge(docs).select(names))) == want
    kept = Counter(plain(quality.keep_good(docs).select("doc_id", "text")))
    ids = Counter(r.doc_id for r in quality.judge(docs).where("kept").collect())
    assert Counter(d for (d, _), n in kept.items() for _ in range(n)) == ids


def test_rule_order_pays():
    rejected = np.array([[1, 0, 1], [1, 0, 0], [0, 1, 0], [0, 0, 0]], bool)
    assert quality.order_rules(np.array([1.0, 1.0, 10.0]), rejected) == [0, 1, 2]
    assert quality.order_rules(np.array([30.0, 1.0, 10.0]), rejected) == [1, 2, 0]


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def plain_spans(text):
    spans = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0:
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    kinds = ["email", "ip", "card", "phone"]
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))


@pytest.mark.parametrize("text", [
    "a@b.c@d.e x@y z%+-._@a-b.c-d.e. @a.b a@b..c", "1.2.3.4.5.6.7.8 999.1.1.1 01.02.03.004 0000255.1.1.1 1.2.3",
    "4111-1111 1111 1111 4111111111111112 +44 20 7946 0958 +1 ( +12 34 +", "+1 (212) 555-0199+1 (212) 555-0199x",
    "é@é.é ü1.2.3.4 १.२.३.४ 4539 1488 0343 6467 8"])
def test_base_spans(text):
    assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == plain_spans(text)


def test_long_zeros_are_judged():
    text = "0" * 5000 + ".1.1.1"
    assert pii.base_spans(text) == [(pii.KINDS.index("ip"), 0, len(text))]


def test_personal_data(docs):
    rows = pii.find(docs).collect()
    want = Counter()
    for doc_id, text in plain(docs.select("doc_id", "text")):
        spans = plain_spans(text or "")
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        count = Counter(k for k, _, _ in spans)
        want[doc_id, count["email"], count["ip"], count["card"], count["phone"],
             hashlib.sha256(listed.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in rows) == want


def test_patterns_find_what_seeds_miss(spark):
    texts = [f"some words and please call me {k}: phone number +1 (212) 555-01{k:02d} thanks" for k in range(10)]
    texts += ["other words, phone number 212-555-0177 thanks", "in the year 20245 nothing happened, phone call",
              "the page number 1234567 is long"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    at = texts[10].index("212")
    assert rows[10].spans == f"phone:{at}:{at + 12}" and rows[10].n_phone == 0
    assert rows[11].spans == rows[12].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[10] == "other words, phone number <PHONE> thanks" and clean[12] == texts[12]


def plain_patterns(text):
    """Kind, place, pattern and instance of every seed and candidate, by reading all of the text before each place."""
    base, seen = pii.sightings(text)
    rows = []
    for kind, start, end, _, _ in seen:
        # places before this one that do not overlap it or another place that does stand as words
        group = start
        while any(s < group < e for _, s, e, _, _ in seen):
            group = min(s for _, s, e, _, _ in seen if s < group < e)
        before = text[:group]
        cuts = sorted({c for _, s, e, _, _ in seen if e <= group for c in (s, e)})
        cuts = [c for c in cuts if not any(s < c < e for _, s, e, _, _ in seen)]
        parts = [before[a:b] for a, b in zip([0, *cuts], [*cuts, len(before)])]
        tail = parts[-1].rstrip(pii.GLUE)
        words = [w for part in [*parts[:-1], tail] for w in part.split()]
        rows.append((kind, start, end, re.sub("[0-9]", "0", " ".join(
            [*words[-2:], "_" + parts[-1][len(tail):]]).lower()), text[start:end].lower()))
    return rows


PATTERN_TEXTS = [
    "call me: phone number +1 (212) 555-0199, or 4111 1111 1111 1111 then 20245", "id=12345/67890, key=\"99999\" #88888",
    f"{'long' * 20}word {'x' * 150} 1234567 and 7654321", "a@b.cd 10.0.0.1.2.3.4 +1.2.3.4.55.66.77 123456", "12345 12345=12345==12345",
    "deadbeef" * 5 + "1 then " + "deadbeef" * 5 + "2", "no digits here", "123456",
]


def test_patterns_of_places(small):
    for text in [*PATTERN_TEXTS, *(r.text for r in small.collect())]:
        want = [(k, s, e, pii.identity(p), pii.identity(i)) for k, s, e, p, i in plain_patterns(text or "")]
        assert pii.sightings(text or "")[1] == want


def test_long_texts_without_white_space_cost_their_length():
    begin = time.process_time()
    pii.sightings("@" * 300_000)
    pii.sightings("12345=" * 60_000)
    pii.sightings(("deadbeef01" * 4 + ":") * 10_000 + "x" * 1_000_000 + " 1234567")
    assert time.process_time() - begin < 20


def plain_bootstrap(texts):
    """The spans that the graph adds, in dictionaries."""
    sights = [(row, *s) for row, text in enumerate(texts) for s in pii.sightings(text or "")[1]]
    pairs = {(p, i) for _, _, _, _, p, i in sights}
    seeds = {}
    for _, kind, _, _, _, i in sights:
        if kind >= 0:
            seeds[i] = (min(kind, seeds.get(i, (kind,))[0]), 1.0)
    known = seeds
    for _ in range(pii.ROUNDS):
        patterns = {}
        for pattern in {p for p, _ in pairs}:
            mine = [i for p, i in pairs if p == pattern]
            for kind in range(len(pii.KINDS)):
                scores = [known[i][1] for i in mine if i in known and known[i][0] == kind]
                if len(scores) >= pii.SUPPORT and sum(scores) / len(mine) >= pii.CONFIDENT:
                    patterns[pattern] = (sum(scores) / len(mine), -kind)
        known = dict(seeds)
        for i in {i for _, i in pairs} - set(seeds):
            best = max((patterns[p] for p, j in pairs if j == i and p in patterns), default=None)
            if best:
                known[i] = (-best[1], best[0])
    found = {(row, -patterns[p][1], s, e) for row, kind, s, e, p, _ in sights if kind < 0 and p in patterns}
    return found | {(row, kind, s, e) for row, kind, s, e, _, _ in sights if kind == 4}


def test_pattern_graph(spark):
    """Chains of patterns and instances over three rounds, ties between kinds, patterns short of support or confidence."""
    draw = random.Random(3)
    heads = ["phone number", "my card", "server at", "order no", "see page", "ticket id"]
    texts = []
    for _ in range(240):
        seed = draw.choice([f"+1 (212) 555-{draw.randrange(40):04d}", f"10.0.{draw.randrange(9)}.{draw.randrange(30)}",
                            "4111 1111 1111 1111", f"{draw.randrange(60) + 2125550100}", f"{draw.randrange(25) + 70000}"])
        kind = 0 if seed[0] == "+" else 2 if seed[:3] == "10." else 1 if seed[0] == "4" else draw.randrange(6)
        texts.append(f"some text {heads[kind if draw.random() < 0.9 else draw.randrange(6)]}: {seed} ends")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, added = plain_bootstrap(texts), 0
    for r in pii.find(docs).collect():
        mine = plain_spans(texts[r.doc_id])
        more = [(pii.KINDS[k], s, e) for row, k, s, e in want if row == r.doc_id]
        order = sorted([*mine, *more], key=lambda s: (s[1], pii.KINDS.index(s[0])))
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in order)
        added += len(more)
    assert added > 10


#: Names that the operators give to columns of their own.
CLASHES = ("bits _bits root _root nth _nth size rows copies taken again _again _row row base seen more spans kind start "
           "doc part rank_in_part length key bucket shard slot words hashes template found component_id").split()


@pytest.mark.parametrize("work", [
    quality.keep_good, simhash.keep_one, pii.redact, mixing.taken_documents, quality.judge, simhash.near_duplicates,
    pii.find, mixing.mix, licenses.scan, lambda d: sharding.shard(d, sharding.even_tree()),
    lambda d: packing.pack_documents(d, public_tokenizers.path(WORD_VOCABULARY)).drop("sequence_id", "offset")])
@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_clashing_names(odd, work, rows):
    lean = odd.select("doc_id", "text", "source").where("true" if rows == "odd" else "false")
    extra = lean.select("*", *(F.array(F.lit(name)).alias(name) for name in CLASHES))
    want, got = work(lean), work(extra)
    if set(CLASHES) <= set(got.columns):                     # a stage: columns kept as they were
        assert got.columns == extra.columns
        assert all(r[name] == [name] for r in got.collect() for name in CLASHES)
        got = got.select(lean.columns)
    assert Counter(map(str, plain(got))) == Counter(map(str, plain(want)))


def test_strings_of_added_tokens_are_the_library_s_to_read(spark):
    """Both vocabularies' own strings, doubled, inside words and in other letters, as the unswitched library reads them."""
    end, start = "<|endoftext|>", "<|startoftext|>"
    texts = [f"see {end} here", f"a{end}b", end + end, f"{start}x {end}", end.upper(), f" {end}", "<|end oftext|>", "plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for vocabulary, end_id in ((BYTE_VOCABULARY, 2), (WORD_VOCABULARY, 0)):
        want = [ids_of(vocabulary, t) for t in texts]
        assert any(max(i) >= 49406 for i in want)
        path = folder(spark, "test-added")
        huffman.write_corpus(docs, path, public_tokenizers.path(vocabulary), end_id=end_id)
        got = {r.doc_id: r for r in huffman.read_corpus(spark, path).collect()}
        assert [got[k].ids_crc32 for k in range(len(texts))] == [crc([*i, end_id]) for i in want]
    pieces = packing.pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY)).collect()
    assert {r.doc_id: r.ids_crc32 for r in pieces} == {k: crc([*ids_of(WORD_VOCABULARY, t), 0]) for k, t in enumerate(texts)}


def test_many_short_documents_in_a_block(spark):
    """A block of one-id documents costs its ids, not their square."""
    docs = spark.range(70_000).selectExpr("id as doc_id", "if(id % 7 = 0, null, '') as text").coalesce(1)
    path = folder(spark, "test-short")
    huffman.write_corpus(docs, path, public_tokenizers.path(BYTE_VOCABULARY))
    got = huffman.read_corpus(spark, path)
    assert got.where("n_tokens = 1 and start = doc_id").count() == 70_000
    assert [r.ids_crc32 for r in got.select("ids_crc32").distinct().collect()] == [crc([2])]
