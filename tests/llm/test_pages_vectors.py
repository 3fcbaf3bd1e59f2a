"""Page extraction and nearest neighbours."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcast.llm import neighbours, pages

PAGE = ("<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href='/a'>Home</a></li><li><a>News</a></li></ul></nav><!-- <p>no</p> --><article><h1>A &amp; B</h1>"
        "<p><b>First  para\n of text, with words.<br><p>Second&nbsp;one, 1 < 2 and more words to read.</p></article>"
        "<footer>&copy; someone, all rights</footer></body></html>")


def test_blocks():
    found = pages.blocks(PAGE)
    assert [b.text for b in found] == ["Home", "News", "A & B", "First para of text, with words.",
                                       "Second one, 1 < 2 and more words to read.", "© someone, all rights"]
    assert [pages.seed_label(b.path) for b in found] == [0, 0, 1, 1, 1, 0]
    assert pages.blocks("") == [] and pages.blocks("plain") == [pages.Block((), "plain", 0)]
    assert [b.text for b in pages.blocks("<p>cut &am<foot")] == ["cut &am"]
    assert [b.text for b in pages.blocks("<p title='a>b'>x<script>never closed <p>y")] == ["x"]


@pytest.mark.parametrize("html", [
    "<html><head><title>x <b>y</title><meta charset=utf-8><script>'<p>no'</script><body><p>one<p>two</body></html>",
    "<html><head><title>x</title><article><p>one<p>two</article>", "<head><link rel=a>one<p>two",
    "<p>one<svg width='1'/><p>two", "<p>one<svg><style/><title/><path d=''/></svg><p>two</p><style>no</style>",
    "<p>one</p><svg><svg/>no<svg><g/></svg>no</svg><p>two</p><svg></svg>",
    "<p>one<button><p>two<button>no</button>", "<p>one</p><iframe src=a /><p>two</p><iframe>no</iframe>",
    "<title>no</title><p>one<object data=a><p>two", "<p>one<p>two<script src='a>no</script><textarea>no <p>no"])
def test_left_out_end_tags(html):
    assert [b.text for b in pages.blocks(html)] == ["one", "two"]


def test_gradients():
    rng = np.random.default_rng(0)
    model = pages.Labeller(1, hidden=3)
    x, real = pages.padded([rng.normal(size=(n, pages.DIM)).astype(np.float32) for n in (4, 2)])
    label = np.array([[1, 0], [0, 1], [1, -1], [-1, -1]], np.float32)

    def loss():
        s = model.scores(x, real)
        known = (label >= 0) & (real > 0)
        return (np.logaddexp(0, s) - label * s)[known].mean()

    for name, gradient in model.gradients(x, real, label).items():
        weights = model.weights[name] = model.weights[name].astype(np.float64)
        for place in [tuple(rng.integers(0, d) for d in weights.shape) for _ in range(6)]:
            keep = weights[place]
            weights[place] = keep + 1e-4
            up = loss()
            weights[place] = keep - 1e-4
            down = loss()
            weights[place] = keep
            assert gradient[place] == pytest.approx((up - down) / 2e-4, abs=2e-3)


def test_extraction(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    extra = spark.createDataFrame([(None, None, None), (10 ** 6, "u", ""), (10 ** 6, "u", PAGE), (10 ** 6, "u", PAGE)],
                                  "page_id long, url string, html string")
    both = table.unionByName(extra, allowMissingColumns=True)
    rows = pages.extract(both).collect()
    assert Counter((r.page_id, r.url) for r in rows) == Counter(map(tuple, both.select("page_id", "url").collect()))
    html = {r.page_id: r.html for r in table.collect()}
    right = wrong = 0
    for r in rows:
        assert r.n_chars == len(r.text)
        if r.page_id in html:
            want = {b.text for b in pages.blocks(html[r.page_id]) if pages.seed_label(b.path) == 1}
            got = set(filter(None, r.text.split("\n")))
            right, wrong = right + len(want & got), wrong + len(want ^ got)
    assert wrong <= 0.01 * right
    assert pages.extract(both.where("false")).collect() == []


def test_held_out_layouts():
    import random
    model = pages.train([PAGE.replace("words", f"word{k} of some {k}") for k in range(60)])
    rng = random.Random(77)
    made = [pages.other_layout(pages.blocks(PAGE), rng) for _ in range(150)]
    guessed = pages.label(model, [[b for b, _ in m] for m in made])
    hits = [bool(y) == bool(g) for m, own in zip(made, guessed) for (_, y), g in zip(m, own)]
    assert np.mean(hits) > 0.93


def brute(vectors, k):
    rows = {}
    for i, v in vectors:
        if i is not None and i % 100 == 0 and good(v):
            far = {}
            for j, w in vectors:
                if j is not None and j != i and good(w) and len(w) == len(v):
                    far[j] = min(far.get(j, np.inf), float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())))
            rows[i] = sorted(((d, j) for j, d in far.items()))[:k]
    return rows


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = [(k, rng.normal(size=6).tolist()) for k in range(120)]
    vectors += [(k, [1.0] + [0.0] * 5) for k in range(190, 220)] + [(3, vectors[3][1])]
    vectors += [(300, None), (400, []), (500, [0.0] * 6), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] + [1.0] * 5),
                (800, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (900, [1.0, 2.0]), (901, [2.0, 2.0]), (1000, [5.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = found(neighbours.nearest(df, lambda i: i % 100 == 0))
    want = {k: v for k, v in brute(vectors, 10).items() if v}
    assert got.keys() == want.keys()
    for q, own in got.items():
        assert len(own) == len(want[q])
    assert [j for _, j in got[200]] == [190, 191, 192, 193, 194, 195, 196, 197, 198, 199]
    assert got[900] == want[900]
    assert found(neighbours.nearest(df.where("false"), lambda i: i % 100 == 0)) == {}


@pytest.mark.parametrize("fill", [2048, 1])
def test_recall(spark, fill):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 10)
    got = found(neighbours.nearest(df, lambda i: i % 100 == 0, fill=fill))
    hits = [j in {x for _, x in got[q]} for q, own in want.items() for _, j in own]
    assert np.mean(hits) >= 0.9
    for q, own in got.items():
        assert len(own) == 10 and own == sorted(own)
        exact = dict((j, d) for d, j in brute([(i, v) for i, v in [(r.vec_id, r.embedding) for r in df.where(
            F.col("vec_id").isin([q, *[j for _, j in own]])).collect()]], 20)[q])
        assert all(d == pytest.approx(exact[j], rel=1e-12) for d, j in own)
        break
